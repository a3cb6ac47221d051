import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vitrina.operators import learners as ln
from vitrina.operators.vocabulary import Limits, item_terms, vocabulary
from vitrina.plans import classify as cl
from vitrina.plans.preprocess import with_terms


def test_null_empty_and_odd_groups_have_models(spark):
    rows = []
    for g in (None, "", "a/b", "null", "=a/b", "x y"):
        for i in range(12):
            rows.append((g, f"{g}-{i % 2}", Vectors.dense([float(i % 2), 1.0]), float(i)))
    rows += [("one", "only", Vectors.dense([0.0, 1.0]), 1.0), ("none", None, Vectors.dense([0.0, 1.0]), 1.0), (None, None, Vectors.dense([0.0, 1.0]), None)]
    df = spark.createDataFrame(rows, ["g", "c", "features", "price"])
    models = ln.fit_per_group(df, "g", "c", ln.naive_bayes, trim=None)
    assert set(models.models) == {None, "", "a/b", "null", "=a/b", "x y"} and models.constants == {"one": "only"}
    found = models.transform(df)
    assert found.count() == len(rows)
    assert not found.where("c is not null and not c <=> category").take(1)
    assert found.where("g = 'none' and category is null").count() == 1
    assert not ln.fit_per_group(df.limit(0), "g", "c", ln.naive_bayes, trim=None).models


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(0, "aaa one", "A"), (0, "bbb two", "B"), (None, "aaa one", "A"), (None, "bbb", "B"), (None, "", "A")]
    rows += [(i, "aaa one" if i % 2 else "bbb two", "A" if i % 2 else "B") for i in range(1, 40)]
    return spark.createDataFrame([(i, t, c, f"{c}1", f"{c}12", float(k)) for k, (i, t, c) in enumerate(rows)], "item_id long, title string, cat_0 string, cat_1 string, cat_2 string, price double")


@pytest.mark.parametrize("max_terms", [1000, 2])
def test_rows_of_one_id_keep_their_own_terms(repeated, max_terms):
    """The path with a broadcast vocabulary and the joined one give the same rows."""
    terms = with_terms(repeated, (1, 2))
    vocab = vocabulary(terms, "terms", 100)
    by = {r.term: r["index"] for r in vocab.collect()}
    rows = item_terms(terms, "terms", vocab, ["cat_0"], max_terms=max_terms).collect()
    assert len(rows) == 44 and len({r.row_id for r in rows}) == 44
    for r in rows:
        own = {by[w] for w in (("aaa", "one", "aaa one") if r.cat_0 == "A" else ("bbb", "two", "bbb two"))}
        assert {t["index"] for t in r.terms} <= own


def test_cascade_has_a_row_for_every_row(repeated):
    features = cl.build_features(repeated, [*cl.LEVELS, "price"], {1: Limits(100, 1)})
    found = cl.cascade(features.terms, cl.fit_hierarchy(features, trim=None))
    assert found.count() == 44
    assert sorted(r.predicted_cat_0 for r in found.where("item_id = 0").collect()) == ["A", "B"]
    assert sorted(r.predicted_cat_2 for r in found.where("item_id is null").collect()) in (["A12", "A12", "B12"], ["A12", "B12", "B12"])
    flat = cl.classify(features.terms, cl.fit_flat(features, "cat_0"), "cat_0", ["cat_0"])
    assert flat.count() == 44 and flat.where(F.col("cat_0") != F.col("prediction")).count() <= 1
    new = cl.classify(cl.new_item_terms(repeated, features), cl.fit_flat(features, "cat_0"), "cat_0")
    assert new.count() == 44 and new.columns == ["item_id", "prediction", "label", "score"]
