from vitrina.checks import queries as q
from vitrina.sources import tables as tb

PART = "p_partkey long, p_name string, p_size int, p_type string, p_brand string, p_retailprice double"


def test_titles_of_parts_are_dealt_to_all_cores(spark, tmp_path):
    rows = [(i, f"red bolt {i}", i % 50, "SMALL", "Brand#1", float(i)) for i in range(400)] + [(7, None, None, None, None, None)] * 2
    spark.createDataFrame(rows, PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    titles = tb.part_titles(spark, str(tmp_path))
    assert titles.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    same = tb.part_items(spark, str(tmp_path))
    assert titles.columns == same.columns
    assert not titles.exceptAll(same).take(1) and not same.exceptAll(titles).take(1)


def test_words_are_written_once_for_vocabulary_and_vectors(spark, sf_dir):
    terms = q._written_terms(spark, sf_dir, (1, 2))
    assert terms.inputFiles() and all("/words-" in f for f in terms.inputFiles())  # not the documents' rules again
    assert "title" not in terms.columns and "words" not in terms.columns
