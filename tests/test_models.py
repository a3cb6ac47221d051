import math
import random

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from vitrina.operators import learners as ln
from vitrina.operators.bayes import BayesModel, Level, fit_bayes, predict
from vitrina.operators.chisq import chi_square
from vitrina.operators.evaluate import accuracy
from vitrina.operators.labels import label_index, one_hot
from vitrina.operators.lookup import lookup_join
from vitrina.operators.split import keyed_split
from vitrina.operators.vocabulary import (
    Limits,
    category_vocabulary,
    count_vectors,
    gram_vocabulary,
    item_terms,
    to_vectorizer,
    vocabulary,
)
from vitrina.plans import classify as cl
from vitrina.session import materialize
from vitrina.sources.models_io import assemble, load_model, model_name, save_model
from vitrina.sources.taxonomy import PLAIN_PAIR, category_names, enrich_titles, read_tree

LETTERS = [(list(w), "x") for w in ("pqr", "pqs", "pt", "p")] + [(list(w), "y") for w in ("qu", "pv", "ww")]


@pytest.fixture(scope="module")
def words(spark):
    """Random words, three classes of different size; one word holds a third of all tokens."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        label = rng.choice(["x", "x", "y", "z"])
        pool = ["hot"] * 10 + [f"w{k}" for k in range(20)] + [f"{label}{k}" for k in range(5)]
        rows.append((i, label, [rng.choice(pool) for _ in range(rng.randint(0, 12))], float(i % 50)))
    return spark.createDataFrame(
        rows, "item_id bigint, cat_0 string, words array<string>, price double"
    ).cache()


def test_letter_vocabulary(spark):
    df = spark.createDataFrame(LETTERS, "words array<string>, label string")
    rows = vocabulary(df, "words", 50).orderBy("index").collect()
    assert len(rows) == 8
    assert [(r.term, r.n) for r in rows[:3]] == [("p", 5), ("q", 3), ("w", 2)]


@pytest.mark.parametrize("min_df", [1, 40])
def test_vocabulary_equals_ml(words, min_df):
    ours = {r.term: r.n for r in vocabulary(words, "words", 1000, min_df).collect()}
    model = CountVectorizer(inputCol="words", outputCol="v", minDF=min_df).fit(words)
    assert set(ours) == set(model.vocabulary)
    order = [ours[t] for t in model.vocabulary]
    assert order == sorted(order, reverse=True)


def test_count_vectors_equal_vectorizer(words):
    vocab = materialize(vocabulary(words, "words", 15), "vocab")
    ours = {}
    for r in count_vectors(words, "words", vocab).collect():
        ours.setdefault(r.item_id, {})[r["index"]] = r.value
    model = to_vectorizer(vocab, "words", "v", binary=False)
    for r in model.transform(words).collect():
        assert ours.get(r.item_id, {}) == dict(zip(r.v.indices.tolist(), r.v.values.tolist(), strict=True))


def test_item_terms_paths_agree(words):
    vocab = materialize(vocabulary(words, "words", 15), "vocab")

    def rows(df):
        return {
            r.item_id: (r.cat_0, sorted((t["index"], t["tf"]) for t in r.terms)) for r in df.collect()
        }

    by_vectorizer = rows(item_terms(words, "words", vocab, ["cat_0"]))
    by_join = rows(item_terms(words, "words", vocab, ["cat_0"], max_terms=3))
    assert by_vectorizer == by_join
    assert len(by_join) == 400


def test_category_vocabulary_limits_each_category(words):
    rows = category_vocabulary(words, "words", "cat_0", 5).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(15))
    assert [r.cat_0 for r in rows] == ["x"] * 5 + ["y"] * 5 + ["z"] * 5


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_paths_agree(spark, how):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k")
    )
    table = materialize(
        spark.range(0, 90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"),
                                  F.when(F.col("id") < 3, 1000).otherwise(5).alias("freq")),
        "table",
    )

    def rows(df):
        return sorted((r.asDict().items() for r in df.collect()), key=repr)

    plain = rows(lookup_join(facts, table.drop("freq"), ["k"], how))
    salted = rows(lookup_join(facts, table.drop("freq"), ["k"], how, salt_on=["id"], max_rows=10))
    split = rows(lookup_join(facts, table, ["k"], how, frequency="freq", max_rows=10))
    assert [dict(r) for r in plain] == [dict(r) for r in salted] == [dict(r) for r in split]


@pytest.mark.parametrize("kind", ["bernoulli", "multinomial"])
def test_bayes_equals_ml(words, kind):
    vocab = materialize(vocabulary(words, "words", 1000), "vocab")
    terms = item_terms(words, "words", vocab, ["cat_0"])
    model = fit_bayes(terms, [Level("cat_0")], vocab.count(), kind)
    vectors = to_vectorizer(vocab, "words", "features", binary=kind == "bernoulli").transform(words)
    indexer = StringIndexer(inputCol="cat_0", outputCol="label").fit(vectors)
    ml = NaiveBayes(modelType=kind).fit(indexer.transform(vectors))
    classes = {r.label: r for r in model.classes.collect()}
    assert [classes[i]["class"] for i in range(3)] == list(indexer.labels)
    for i, prior in enumerate(ml.pi):
        assert classes[i].prior == pytest.approx(prior, abs=1e-12)
    raw = {r.item_id: (r.rawPrediction.toArray(), r.prediction) for r in ml.transform(vectors).collect()}
    ours = predict(terms, model, "cat_0").collect()
    assert len(ours) == 400
    for r in ours:
        scores, label = raw[r.item_id]
        assert r.label == int(label)
        assert r.score == pytest.approx(max(scores), abs=2e-6)


def test_bayes_beyond_broadcast_agrees(words):
    vocab = materialize(vocabulary(words, "words", 1000), "vocab")
    terms = item_terms(words, "words", vocab, ["cat_0"])
    model = fit_bayes(terms, [Level("cat_0")], vocab.count())
    small = sorted(predict(terms, model, "cat_0").collect())
    large = sorted(predict(terms, model, "cat_0", max_cells=12).collect())
    assert small == large


@pytest.mark.parametrize("kind", ["bernoulli", "multinomial"])
def test_weights_beyond_bounds_are_scored_by_some_models_at_a_time(words, kind, monkeypatch):
    """Many parents, one item without and one with an unknown one: no join gets more cells than may be sent at once."""
    parent = F.when(F.col("item_id") != 7, F.concat(F.lit("g"), (F.col("item_id") % 9).cast("string")))
    rows = words.withColumn("up", parent)
    vocab = materialize(vocabulary(rows, "words", 1000), "vocab")
    terms = item_terms(rows, "words", vocab, ["cat_0", "up"])
    model = fit_bayes(terms, [Level("cat_0", "up")], vocab.count(), kind)
    known = F.when(F.col("item_id") == 9, "none").otherwise(F.col("up"))
    small = sorted(predict(terms, model, "cat_0", known).collect(), key=str)
    sent = []

    def joined(facts, table, on, **options):
        if list(on) == ["model", "index"]:
            sent.append(table.agg(F.sum(options["size"])).first()[0])
        return lookup_join(facts, table, on, **options)

    monkeypatch.setattr("vitrina.operators.bayes.lookup_join", joined)
    large = sorted(predict(terms, model, "cat_0", known, max_cells=1000).collect(), key=str)
    assert small == large and len(large) == 400
    assert len(sent) > 3 and max(sent) <= 1000


def test_cascade_never_broadcasts_the_rows(words, monkeypatch):
    """A table with a row per item is small in its files long before it is small on the driver."""
    vocab = materialize(vocabulary(words, "words", 1000), "vocab")
    rows = words.withColumn("cat_1", F.concat("cat_0", (F.col("item_id") % 3).cast("string")))
    terms = item_terms(rows, "words", vocab, ["cat_0", "cat_1"])
    model = fit_bayes(terms, [Level("cat_0"), Level("cat_1", "cat_0")], vocab.count())
    plans = []

    def written(df, name, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name, *args)

    monkeypatch.setattr(cl, "materialize", written)
    assert cl.cascade(terms, model, ("cat_0", "cat_1")).count() == 400
    assert len(plans) == 2 and not any("BroadcastHashJoin [row_id" in plan for plan in plans)
    assert "SortMergeJoin [row_id" in plans[1]


def test_bayes_prior_of_seven_and_sixty_one(spark):
    rows = [(i, "Celular" if i < 7 else "Fundas", ["celular"] if i < 7 else ["funda"]) for i in range(68)]
    df = spark.createDataFrame(rows, "item_id bigint, cat_0 string, words array<string>")
    vocab = materialize(vocabulary(df, "words", 50), "vocab")
    terms = item_terms(df, "words", vocab, ["cat_0"])
    model = fit_bayes(terms, [Level("cat_0")], vocab.count())
    priors = {r["class"]: r.prior for r in model.classes.collect()}
    assert priors["Fundas"] == pytest.approx(-0.12136085700426769, abs=1e-12)
    assert priors["Celular"] == pytest.approx(-2.1690537003695236, abs=1e-12)
    assert accuracy(predict(terms, model, "cat_0", carry=["cat_0"]), "cat_0").first().accuracy == 1.0


def test_bayes_save_and_load(spark, words, tmp_path):
    vocab = materialize(vocabulary(words, "words", 1000), "vocab")
    terms = item_terms(words, "words", vocab, ["cat_0"])
    model = fit_bayes(terms, [Level("cat_0")], vocab.count())
    model.save(f" {tmp_path}/bayes ")
    loaded = BayesModel.load(spark, f"{tmp_path}/bayes", "bernoulli")
    assert sorted(predict(terms, loaded, "cat_0").collect()) == sorted(predict(terms, model, "cat_0").collect())


def test_hierarchy_equals_one_fit_per_parent(spark, words):
    """The grouped fit gives what a loop over parents (trim, index, fit) gives."""
    items = words.withColumn("cat_1", F.concat_ws("/", "cat_0", (F.col("item_id") % 4).cast("string")))
    vocab = materialize(gram_vocabulary(items, "words", {1: Limits(1000, 1)}), "vocab")
    terms = item_terms(items, "words", vocab, ["cat_0", "cat_1", "price"])
    features = cl.Features(items, vocab, vocab.count(), terms)
    model = cl.fit_hierarchy(features, ("cat_0", "cat_1"), trim=(10, 90))
    grouped = {
        r.item_id: (r.prediction, r.score)
        for r in cl.classify_under_parent(terms, model, "cat_1", "cat_0").collect()
    }
    from vitrina.operators.price import trim_by_percentile

    for parent in ("x", "y", "z"):
        own = terms.where(F.col("cat_0") == parent)
        single = fit_bayes(trim_by_percentile(own, 10, 90), [Level("cat_1")], features.size)
        for r in predict(own, single, "cat_1").collect():
            assert grouped[r.item_id] == (r.prediction, r.score)
    cascade = cl.cascade(terms, model, ("cat_0", "cat_1")).collect()
    assert len(cascade) == 400
    assert all(r.predicted_cat_1.startswith(r.predicted_cat_0 + "/") for r in cascade)


def test_chi_square_equals_ml(words):
    vocab = materialize(vocabulary(words, "words", 1000), "vocab")
    terms = item_terms(words, "words", vocab, ["cat_0"])
    ours = {r["index"]: r.statistic for r in chi_square(terms, "cat_0").collect()}
    vectors = to_vectorizer(vocab, "words", "features").transform(words)
    indexed = StringIndexer(inputCol="cat_0", outputCol="label").fit(vectors).transform(vectors)
    expected = ChiSquareTest.test(indexed, "features", "label").first().statistics
    for index, value in ours.items():
        assert value == pytest.approx(expected[index], rel=1e-9, abs=1e-9)


def test_label_index_breaks_ties_by_the_alphabet(spark):
    df = spark.createDataFrame([(c,) for c in "bacc"], "cat string")
    rows = label_index(df, "cat").orderBy("label_index").collect()
    assert [r.label for r in rows] == ["c", "a", "b"]
    encoded = df.limit(1).select(one_hot(F.lit(1), 3).alias("a"), one_hot(F.lit(2), 3).alias("b")).first()
    assert (encoded.a, encoded.b) == ([0.0, 1.0], [0.0, 0.0])


def test_keyed_split_is_stable_and_whole(words):
    train, test = keyed_split(words)
    again, _ = keyed_split(words.repartition(3))
    assert {r.item_id for r in train.collect()} == {r.item_id for r in again.collect()}
    assert train.count() + test.count() == 400
    assert 0.8 < train.count() / 400 < 0.98


def test_models_per_group(words):
    items = words.withColumn(
        "cat_1", F.when(F.col("cat_0") == "z", "z/only").otherwise(
            F.concat_ws("/", "cat_0", (F.size("words") > 5).cast("string")))
    )
    vocab = vocabulary(words, "words", 100)
    rows = materialize(to_vectorizer(vocab, "words", "features").transform(items), "rows")
    models = ln.fit_per_group(
        rows, "cat_0", "cat_1", lambda: ln.logistic_regression(maxIter=5, regParam=0.1)
    )
    assert models.constants == {"z": "z/only"}
    assert set(models.models) == {"x", "y"}
    predicted = models.transform(rows).collect()
    assert len(predicted) == 400
    assert all(r.category.startswith(r.cat_0 + "/") for r in predicted)


def test_perceptron_selects_then_fits(words):
    vectors = to_vectorizer(vocabulary(words, "words", 100), "words", "features").transform(words)
    model = ln.fit_perceptron(vectors, "cat_0", selected=10, max_iter=20)
    assert model.stages[1].transform(model.stages[0].transform(vectors)).count() == 400
    assert len(model.stages[0].selectedFeatures) == 10


def test_named_models_round_trip(words, tmp_path):
    vectorizer = to_vectorizer(vocabulary(words, "words", 100), "words", "features")
    fitted = ln.fit_classifier(vectorizer.transform(words), "cat_0", ln.naive_bayes())
    path = save_model(str(tmp_path), f" {model_name('cat_1', 'x/y')} ", vectorizer, fitted)
    assert path.endswith("/x%2Fy-cat_1")
    loaded = load_model(str(tmp_path), "x/y-cat_1")
    before = assemble(vectorizer, fitted).transform(words).select("item_id", "category").collect()
    after = loaded.transform(words).select("item_id", "category").collect()
    assert sorted(before) == sorted(after)


def test_taxonomy(spark, tmp_path):
    (tmp_path / "tree.json").write_text(
        '[{"id":"A1","name":"Música y Películas","children_categories":[{"id":"A2","name":"Discos"}]},'
        '{"id":"A1","name":"Otra"}]'
    )
    trees = read_tree(spark, str(tmp_path / "tree.json"))
    names = category_names(trees)
    assert {r.id: r.name for r in names.collect()} == {"A1": "Otra", "A2": "Discos"}
    assert {r.id for r in category_names(trees, pattern=PLAIN_PAIR).collect()} == {"A1", "A2"}
    items = spark.createDataFrame([(1, "cd", "A1", "A2", "?")], "item_id int, title string, cat_0 string, cat_1 string, cat_2 string")
    assert enrich_titles(items, names).first().title == "cd Otra Discos "


def test_holdout_never_trains_on_test_rows(words):
    items = words.select("item_id", "cat_0", "price", F.array_join("words", " ").alias("title"))
    row = cl.holdout_accuracy(items, "cat_0", None, {1: Limits(1000, 1)}).first()
    _, test = keyed_split(items)
    assert row["items"] == test.count()
    assert math.isclose(row.accuracy + row.error, 1.0)


def test_vectorizer_totals_come_from_sparse_values(spark, sf_dir):
    """No row is made as long as the vocabulary."""
    from vitrina.checks.queries import REGISTRY

    plan = REGISTRY["vectorizer_ml"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "vector_to_array" not in plan and "unwrap" in plan.lower()
