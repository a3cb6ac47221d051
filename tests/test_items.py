import pytest

from vitrina.sources.items import (
    FLAT_ITEM,
    ITEM,
    as_items,
    parse_items,
    read_items,
    read_untyped,
    spread,
)

LINES = [
    '{"title":"Funda s6","cat_0":"a","cat_1":"b","cat_2":"c","price":10.5,"extra":1}',
    '{"title":"Cable","cat_0":"a","cat_1":"b","cat_2":"d"}',
]


def test_read_items(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join(LINES))
    df = read_items(spark, str(tmp_path / "*"))
    assert df.schema == ITEM
    assert sorted((r.title, r.price) for r in df.collect()) == [("Cable", None), ("Funda s6", 10.5)]
    assert read_items(spark, str(tmp_path), partitions=5).rdd.getNumPartitions() == 5
    assert "extra" in read_untyped(spark, str(tmp_path)).columns


def test_read_flat_items(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"title":"Funda","category":"a"}')
    assert read_items(spark, str(tmp_path), FLAT_ITEM).first().category == "a"


def test_as_items_binds_by_name(spark):
    df = spark.createDataFrame([(7, 1, "c", "b", "a", "t")], "id int, price int, cat_2 string, cat_1 string, cat_0 string, title string")
    assert as_items(df).columns == ITEM.names
    assert as_items(df, keep_extra=True).columns == ["id", *ITEM.names]
    assert as_items(df).first().price == 1.0
    with pytest.raises(ValueError, match="missing"):
        as_items(df.drop("price"))


def test_parse_items(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, line string")
    assert parse_items(df, "line").orderBy("i").first().title == "Funda s6"


def test_spread_leaves_many_partitions(spark):
    assert spread(spark.range(10).repartition(40)).rdd.getNumPartitions() == 40
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 8
