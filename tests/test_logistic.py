import os
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.operators import logistic
from vitrina.operators.bayes import BayesModel, Level, predict
from vitrina.operators.logistic import Block, fit_logistic
from vitrina.operators.vocabulary import Limits
from vitrina.plans import classify as cl
from vitrina.session import new_path, working_folder

TERMS = 30


def items(seed, sizes):
    """Per parent: items with random terms, whose class depends on some of them, with noise."""
    rng = random.Random(seed)
    rows = []
    for parent, (n, classes) in sizes.items():
        for i in range(n):
            terms = sorted(t for t in range(TERMS) if rng.random() < (0.05 + 0.4 * (t % 7 == 0)))
            wish = sum(terms) % classes if rng.random() < 0.5 else rng.randrange(classes)
            rows.append((len(rows) + 1, parent, f"{parent}/{wish}", [(t, 1 + i % 2) for t in terms]))
    rng.shuffle(rows)
    return rows


SCHEMA = "item_id long, up string, down string, terms array<struct<index:int,tf:bigint>>"
SIZES = {"hot": (900, 3), "two": (300, 2), "four": (400, 4), "one": (20, 1)}


def by_spark(spark, rows, parent, reg, family="auto"):
    """Coefficients by (term, label), labels by frequency, from Spark ML on the parent's items alone."""
    own = [r for r in rows if r[1] == parent]
    count = {}
    for r in own:
        count[r[2]] = count.get(r[2], 0) + 1
    order = sorted(count, key=lambda c: (-count[c], c))
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    data = [(float(order.index(r[2])), SparseVector(TERMS, [t for t, _ in r[3]], [1.0] * len(r[3]))) for r in own]
    model = LogisticRegression(regParam=reg, maxIter=1000, tol=1e-12, family=family).fit(spark.createDataFrame(data, schema))
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(weights) == 1:
        weights, start = np.vstack([np.zeros_like(weights), weights]), np.append(0.0, start)
    return order, np.vstack([weights.T, start])


def table(model, parent):
    classes = {r.label: r["class"] for r in model.classes.where(F.col("parent") == parent).collect()}
    out = np.zeros((TERMS + 1, len(classes)))
    number = model.classes.where(F.col("parent") == parent).first().model
    for r in model.cells.where(F.col("model") == number).collect():
        out[r["index"] if r["index"] >= 0 else TERMS, r.label] = r.weight
    return [classes[i] for i in sorted(classes)], out


@pytest.mark.parametrize("reg, family, block_cells", [(0.02, "auto", 1 << 20), (0.02, "auto", 6000), (0.0, "multinomial", 1 << 20)])
def test_every_parent_equals_spark_ml(spark, reg, family, block_cells):
    rows = items(3, SIZES)
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_logistic(df, [Level("down", "up")], 1000, reg, 1e-9, family, block_cells)
    for parent in ("hot", "two", "four"):
        order, weights = by_spark(spark, rows, parent, reg, family)
        labels, own = table(model, parent)
        assert labels == order
        own, weights = (x - x.mean(axis=1, keepdims=True) for x in (own, weights))
        assert np.abs(own - weights).max() < 1e-4
    about = {r.parent: r for r in model.summary.collect()}
    assert (about["one"].reason, about["one"]["classes"], about["hot"]["items"]) == ("constant", 1, 900)
    assert all(r.slope < 1e-4 for r in about.values() if r.slope is not None)


def test_blocks_do_not_change_the_fit(spark):
    df = spark.createDataFrame(items(5, SIZES), SCHEMA)
    few, many = (fit_logistic(df, [Level("down", "up")], 15, block_cells=b) for b in (1 << 20, 250))
    a, b = ({(r.model, r["index"], r.label): r.weight for r in m.cells.collect()} for m in (few, many))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


@pytest.mark.parametrize("alone", [1, 1 << 20])
def test_several_blocks_leave_no_states_behind(spark, monkeypatch, alone):
    """A model of several blocks equals that of one, fitted inside a task or by steps; states of past steps are deleted."""
    df = spark.createDataFrame(items(5, SIZES), SCHEMA)
    before = set(os.listdir(working_folder(spark))) if os.path.exists(working_folder(spark)) else set()
    one = fit_logistic(df, [Level("down", "up")], 15)
    monkeypatch.setattr(logistic, "ALONE", alone)
    many = fit_logistic(df, [Level("down", "up")], 15, block_cells=250)
    for parent in SIZES:
        if parent != "one":
            np.testing.assert_allclose(table(one, parent)[1], table(many, parent)[1], atol=1e-6)
    left = set(os.listdir(working_folder(spark))) - before
    assert left and not [name for name in left if name.split("-")[0] in ("step", "begin", "packed", "blocks")]


def test_steps_write_no_states(spark, monkeypatch):
    """Models of several blocks take turns on the driver within the bound, larger ones keep their states in tables; all fits are equal."""
    df = spark.createDataFrame(items(5, SIZES), SCHEMA)
    one = fit_logistic(df, [Level("down", "up")], 15)
    names, files, full = [], [], logistic.materialize

    def written(df, name, *args):
        names.append(name)
        found = full(df, name, *args)
        if name == "packed":
            files.append((len(found.inputFiles()), found.count()))
        return found

    monkeypatch.setattr(logistic, "materialize", written)
    for name, value in (("ALONE", 1), ("SLICE", 7)):
        monkeypatch.setattr(logistic, name, value, raising=False)
    for bound, steps in ((100_000, False), (130, False), (100, True)):  # models of 124, 93 and 31 weights: all, some at a time, not the largest
        names.clear()
        monkeypatch.setattr(logistic, "DRIVER_WEIGHTS", bound, raising=False)
        many = fit_logistic(df, [Level("down", "up")], 15, block_cells=250)
        assert ("step" in names) == steps and "ended" in names
        for parent in SIZES:
            if parent != "one":
                np.testing.assert_allclose(table(one, parent)[1], table(many, parent)[1], atol=1e-6)
    assert files[0][0] > 8 and files[0][1] > 12  # blocks are not merged into a few files by their bytes


def test_linear_tables_score_like_the_weights(spark):
    rows = items(7, SIZES) + [(9001, "hot", None, [(1, 1)]), (9002, None, "x", [(1, 1)]), (9003, "new", None, [(1, 1)]), (None, "hot", "hot/0", []), (None, "hot", "hot/1", [])]
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_logistic(df, [Level("down", "up")], 30, reg=0.01)
    found = predict(df, model.linear(), "down", F.col("up"), carry=["up", "terms"]).collect()
    assert len(found) == len(rows)
    weights = {p: table(model, p) for p in SIZES}
    for r in found:
        if r.up not in weights:
            assert r.prediction is None
            continue
        labels, w = weights[r.up]
        scores = w[-1] + sum((w[t["index"]] for t in r.terms), np.zeros(len(labels)))
        assert scores[labels.index(r.prediction)] >= scores.max() - 1e-5


def test_jobs_do_not_grow_with_parents(spark):
    def jobs(parents):
        sizes = {f"p{i:04d}": (12, 3) for i in range(parents)}
        df = spark.createDataFrame(items(1, sizes), SCHEMA)
        group = f"fit-{parents}"
        spark.sparkContext.setJobGroup(group, group)
        models = fit_logistic(df, [Level("down", "up")], 10)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert models.summary.count() == parents
        return n

    assert jobs(300) <= jobs(3) + 5


def test_no_items(spark):
    df = spark.createDataFrame([], SCHEMA)
    model = fit_logistic(df, [Level("down", "up"), Level("up")])
    assert not model.summary.take(1) and not model.linear().lists.take(1)


@pytest.fixture(scope="module")
def listings(spark):
    """Titles whose words tell the categories; ids repeat and are null, a parent has one class."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = rng.choice("xyz")
        b = f"{a}{rng.choice('12') if a != 'z' else '1'}"
        c = f"{b}{rng.choice('pqr')}"
        title = " ".join(rng.choices([a * 3, b * 3, c * 3, "common", "words"], k=6) + [c * 2, b * 2, a * 2])
        rows.append((None if i % 50 == 0 else i % 90, title, a, b, c, float(i % 40)))
    return spark.createDataFrame(rows, "item_id long, title string, cat_0 string, cat_1 string, cat_2 string, price double")


@pytest.mark.parametrize("learners", [("bayes", "bayes", "logistic"), ("logistic", "bayes", "bayes"), ("logistic",) * 3])
def test_mixed_cascade_keeps_every_row(spark, listings, learners):
    features = cl.build_features(listings, [*cl.LEVELS, "price"], {1: Limits(1000, 1), 2: Limits(1000, 1)})
    model = cl.fit_mixed(features, learners, trim=None, max_iter=12, block_cells=400 if learners[0] == "bayes" else 1 << 20)
    path = new_path(spark, "mixed")
    model.save(path)
    for fitted in (model, BayesModel.load(spark, path, model.kind)):
        found = cl.cascade(features.terms, fitted)
        assert found.count() == 300 and found.where("item_id is null").count() == 6
        assert not found.where("not startswith(predicted_cat_1, predicted_cat_0) or not startswith(predicted_cat_2, predicted_cat_1)").take(1)
    truth = listings.groupBy("item_id", "cat_2").count().withColumnRenamed("cat_2", "c")
    told = found.groupBy("item_id", F.col("predicted_cat_2").alias("c")).agg(F.count(F.lit(1)).alias("told"))
    right = truth.join(told, truth.item_id.eqNullSafe(told.item_id) & (truth.c == told.c)).agg(F.sum(F.least("count", "told"))).first()[0]
    assert right > 280


def test_learners_are_checked(listings):
    features = cl.build_features(listings, [*cl.LEVELS, "price"], {1: Limits(1000, 1)})
    with pytest.raises(ValueError):
        cl.fit_mixed(features, ("bayes",))


def test_blocks_equal_dense_sums():
    """Losses and gradients of a block with empty items, by dense matrices; numbers of cells are converted once."""
    rng = np.random.default_rng(3)
    sizes = np.array([0, 3, 0, 0, 5, 1, 0])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.concatenate([rng.choice(9, n, replace=False) for n in sizes]).astype(np.int32)
    dense = np.zeros((len(sizes), 10))
    dense[np.repeat(np.arange(len(sizes)), sizes), columns] = 1
    dense[:, 9] = 1
    for labels, width in ((np.array([0, 1, 1, 0, 1, 0, 1]), 1), (np.array([0, 1, 2, 0, 1, 2, 1]), 3)):
        weights = rng.normal(size=(10, width))
        z = dense @ weights
        full = np.hstack([np.zeros((len(z), 1)), z]) if width == 1 else z
        p = np.exp(full) / np.exp(full).sum(axis=1, keepdims=True)
        rest = p - np.eye(p.shape[1])[labels]
        loss, gradient = Block(labels.astype(np.int32), starts, columns).evaluate(weights)
        assert np.isclose(loss, -np.log(p[np.arange(len(z)), labels]).sum())
        assert np.allclose(gradient, dense.T @ (rest[:, 1:] if width == 1 else rest))
    empty = Block(np.array([0, 1], np.int32), np.zeros(3, np.int64), np.zeros(0, np.int32)).evaluate(np.zeros((10, 1)))
    assert np.isclose(empty[0], 2 * np.log(2)) and not empty[1].any()
