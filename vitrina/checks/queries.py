"""The registered queries: every operator over whole tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, StringIndexer, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrina.functions.normalize import normalize_title
from vitrina.functions.stopwords import language_stop_words, listing_stop_words
from vitrina.functions.tokens import ngrams, plain_tokens, regex_tokens, without_stop_words
from vitrina.operators import labels as lb
from vitrina.operators import learners as ln
from vitrina.operators import vectors as vc
from vitrina.operators.bayes import BayesModel, Level, conditional_weights, fit_bayes
from vitrina.operators.chisq import select_terms
from vitrina.operators.counts import distinct_counts, distinct_keys, word_count
from vitrina.operators.evaluate import accuracy, accuracy_by_category
from vitrina.operators.logistic import fit_logistic
from vitrina.operators.positions import dense_positions
from vitrina.operators.price import (
    outlier_band,
    percentiles,
    price_stats,
    trim_by_percentile,
    trim_by_rank,
    trim_report,
)
from vitrina.operators.split import in_train, random_split
from vitrina.operators.vocabulary import (
    GRAM_LIMITS,
    ROW,
    Limits,
    category_vocabulary,
    count_vectors,
    gram_vocabulary,
    item_terms,
    large_vocabulary,
    to_vectorizer,
    vocabulary,
    vocabulary_sizes,
)
from vitrina.plans import classify as cl
from vitrina.plans.preprocess import preprocessing_stages, terms_of, with_terms, with_words
from vitrina.session import materialize, new_path
from vitrina.sources import tables as tb
from vitrina.sources.items import as_items, parse_items, read_items
from vitrina.sources.models_io import PREPROCESS, assemble, load_model, model_name, save_model
from vitrina.sources.taxonomy import category_names, category_tree, enrich_by_ancestors, enrich_titles

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

WORDS = {1: Limits(60_000, 5)}
GRAMS = {1: Limits(60_000, 5), 2: Limits(30_000, 5), 3: Limits(30_000, 5)}
CATS = ("cat_0", "cat_1", "cat_2")
SEP = "|"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# Sources


@query
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tb.part_items(spark, sf_dir)
    text = F.to_json(F.struct("title", *CATS, "price"))
    parsed = parse_items(items.select("item_id", text.alias("line")), "line")
    return as_items(parsed, keep_extra=True)


@query
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json-items")
    tb.part_items(spark, sf_dir).drop("item_id").write.json(path)
    return as_items(read_items(spark, path))


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(tb.table(spark, sf_dir, "documents"), "text")


# Text


def _normalized(version: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tb.all_titles(spark, sf_dir).withColumn("title", normalize_title("title", version))

    return run


for _version in ("v1", "v2", "v3", "v4", "v4_sheet"):
    REGISTRY[f"normalize_{_version}"] = _normalized(_version)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.document_items(spark, sf_dir)


def _written_terms(spark: SparkSession, sf_dir: str, grams: tuple[int, ...], stop_words: list[str] | None = None) -> DataFrame:
    """Terms for a vocabulary and the vectors under it: the words are written once, both passes make their terms of them."""
    words = with_words(_documents(spark, sf_dir)).select("item_id", *CATS, "price", "words")
    return materialize(words, "words").withColumn("terms", terms_of("words", grams, stop_words)).drop("words")


def _joined(df: DataFrame, tokens) -> DataFrame:
    return df.select("item_id", F.array_join(tokens, SEP).alias("tokens"))


@query
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_documents(spark, sf_dir), regex_tokens("title"))


@query
def tokens_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_documents(spark, sf_dir), plain_tokens("title"))


@query
def stopwords_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = with_words(_documents(spark, sf_dir))
    return _joined(words, without_stop_words("words", listing_stop_words()))


@query
def stopwords_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = with_words(_documents(spark, sf_dir), version=None)
    return _joined(words, without_stop_words("words", language_stop_words("english")))


@query
def ngrams_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(with_words(_documents(spark, sf_dir)), ngrams("words", 1))


@query
def ngrams_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(with_words(_documents(spark, sf_dir)), ngrams("words", 2))


@query
def ngrams_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(with_words(_documents(spark, sf_dir)), ngrams("words", 3))


@query
def ngrams_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-grams of the words left by the English list, split at each whitespace character."""
    words = with_words(_documents(spark, sf_dir), version=None, plain=True)
    kept = without_stop_words("words", language_stop_words("english"))
    return _joined(words, ngrams(kept, 2))


# Vocabularies and vectors


def _vocabulary(gram: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        terms = with_terms(_documents(spark, sf_dir), (gram,))
        limit = GRAM_LIMITS[gram]
        return vocabulary(terms, "terms", limit.size, limit.min_df)

    return run


REGISTRY["vocab_words"] = _vocabulary(1)
REGISTRY["vocab_2gram"] = _vocabulary(2)
REGISTRY["vocab_3gram"] = _vocabulary(3)


@query
def vocab_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1,000,000 most frequent words, 2-grams and 3-grams together."""
    return large_vocabulary(with_terms(_documents(spark, sf_dir), (1, 2, 3)), "terms", 1_000_000)


@query
def count_vector_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the 1,000,000 most frequent words of 20 items or more, looked up by a join."""
    terms = materialize(with_terms(_documents(spark, sf_dir), (1,)), "terms")
    vocab = materialize(large_vocabulary(terms, "terms", 1_000_000, 20), "vocabulary")
    rows = item_terms(terms, "terms", vocab, [], max_terms=0)
    return rows.select("item_id", F.explode("terms").alias("_t")).select("item_id", "_t.index", F.col("_t.tf").cast("double").alias("value"))


@query
def vocab_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = with_terms(_documents(spark, sf_dir), (1, 2, 3))
    return vocabulary_sizes(gram_vocabulary(terms, "terms"))


@query
def vocab_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = with_terms(_documents(spark, sf_dir), (1,), stop_words=[])
    return category_vocabulary(terms, "terms", "cat_0", 2000)


@query
def vector_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item under the vocabularies of all categories, side by side."""
    terms = _written_terms(spark, sf_dir, (1,), [])
    vocab = materialize(category_vocabulary(terms, "terms", "cat_0", 2000), "vocabulary")
    return count_vectors(terms, "terms", vocab, binary=True, repeated=True)


@query
def count_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _written_terms(spark, sf_dir, (1,))
    vocab = materialize(vocabulary(terms, "terms", 60_000, 100), "vocabulary")
    return count_vectors(terms, "terms", vocab)


@query
def assembled_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _written_terms(spark, sf_dir, (1, 2, 3))
    vocab = materialize(gram_vocabulary(terms, "terms"), "vocabulary")
    return count_vectors(terms, "terms", vocab, binary=True)


@query
def vectorizer_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words through the ML transformer: number of known terms and their total count."""
    terms = _written_terms(spark, sf_dir, (1,))
    vocab = vocabulary(terms, "terms", 60_000, 100)
    vectors = to_vectorizer(vocab, "terms", "features", binary=False).transform(terms)
    values = F.unwrap_udt("features")["values"]  # of the sparse vector; an array would be as long as the vocabulary
    return vectors.select(
        "item_id",
        F.size(F.filter(values, lambda v: v > 0)).cast("bigint").alias("terms"),
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


HASHED = 20_000  # fixed value: buckets of each term column


@query
def hashing_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's buckets with their counts."""
    words = with_words(_documents(spark, sf_dir))
    hashed = vc.hashed_terms(words, {"words": HASHED}, [])
    return hashed.select("item_id", F.explode("terms").alias("_t")).select("item_id", "_t.index", "_t.tf")


def _hashed_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-grams and words of flat items, hashed and side by side."""
    words = with_words(_documents(spark, sf_dir), version=None).withColumn("grams", ngrams("words", 2))
    return vc.hashed_terms(words, {"grams": HASHED, "words": HASHED}, ["cat_0"])


@query
def nb_hashed_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial Bayes over hashed 2-grams and words side by side."""
    terms = _hashed_grams(spark, sf_dir)
    model = fit_bayes(terms, [Level("cat_0")], 2 * HASHED, "multinomial")
    return cl.classify(terms, model, "cat_0", ["cat_0"])


@query
def chisq_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = cl.build_features(_documents(spark, sf_dir), ["cat_2"], WORDS)
    return select_terms(features.terms, features.vocabulary, "cat_2", 1000).select(
        "term", "df", "statistic"
    )


# Labels


@query
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.label_index(tb.part_items(spark, sf_dir), "cat_1")


@query
def label_index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.level_indices(_documents(spark, sf_dir), CATS)


@query
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tb.part_items(spark, sf_dir)
    labels = lb.label_index(items, "cat_1")
    indexed = lb.index_labels(items.select("item_id", "cat_1"), labels, "cat_1", "label")
    return lb.decode_labels(indexed.drop("cat_1"), labels, "label", "category")


@query
def label_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.label_catalogue(lb.label_index(tb.part_items(spark, sf_dir), "cat_0"))


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tb.part_items(spark, sf_dir)
    indexer = StringIndexer(inputCol="cat_0", outputCol="label").fit(items)
    encoded = vc.one_hot_vectors(indexer.transform(items), "label")
    return encoded.select(
        "item_id",
        F.array_join(vector_to_array("one_hot").cast("array<int>").cast("array<string>"), SEP).alias(
            "one_hot"
        ),
    )


# Counts and prices


@query
def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_counts(tb.part_items(spark, sf_dir), CATS)


@query
def distinct_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_keys(tb.part_items(spark, sf_dir), "cat_2")


@query
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_keys(tb.part_items(spark, sf_dir), "cat_0", "cat_1")


@query
def price_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = price_stats(tb.part_items(spark, sf_dir), "cat_1")
    return stats.select("cat_1", *[F.round(c, 6).alias(c) for c in stats.columns[1:]])


@query
def trim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_report(tb.part_items(spark, sf_dir), 5, 95, ["cat_1"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("p") else c for c in df.columns])


@query
def percentile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(percentiles(tb.order_items(spark, sf_dir), [2, 5, 10, 90, 95, 98]))


@query
def percentile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(percentiles(tb.part_items(spark, sf_dir), [5, 10, 90, 95], ["cat_2"]))


@query
def percentile_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tb.order_items(spark, sf_dir)
    return percentiles(orders, [5, 10, 90, 95], ["cat_1"], interpolate=False)


@query
def trim_global_2_98(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_by_percentile(tb.order_items(spark, sf_dir), 2, 98)


@query
def trim_parent_5_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_by_percentile(tb.part_items(spark, sf_dir), 5, 95, ["cat_1"])


@query
def trim_cat_10_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_by_percentile(tb.part_items(spark, sf_dir), 10, 90, ["cat_2"])


@query
def trim_documents_10_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_by_percentile(_documents(spark, sf_dir).drop("title"), 10, 90, ["cat_1"])


@query
def trim_rank_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_by_rank(tb.part_items(spark, sf_dir), 10, 90, ["cat_1"])


@query
def trim_rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items ranked by quantity: a few values with very many ties each."""
    lines = tb.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_returnflag").alias("cat_0"),
        F.col("l_quantity").alias("price"),
    )
    return trim_by_rank(lines, 5, 95, ["cat_0"])


@query
def price_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every line item in the order of quantities, a few values with very many ties each."""
    lines = tb.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_quantity").alias("price")
    )
    return dense_positions(lines.where(F.col("price").isNotNull()), ["price", "item_id"])


@query
def priced_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one category that have a price."""
    items = tb.part_items(spark, sf_dir)
    return items.where((F.col("cat_0") == "ECONOMY") & F.col("price").isNotNull())


@query
def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 dearest items, a top-k report."""
    return tb.part_items(spark, sf_dir).orderBy(F.desc_nulls_last("price"), "item_id").limit(100)


@query
def price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_band(tb.part_items(spark, sf_dir))


# Splits


@query
def split_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("item_id", in_train().alias("train"))


@query
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = random_split(_documents(spark, sf_dir).drop("title"), seed=19)
    return train.withColumn("train", F.lit(True)).unionByName(
        test.withColumn("train", F.lit(False))
    )


# Naive Bayes


def _flat(spark: SparkSession, sf_dir: str, kind: str) -> tuple[cl.Features, BayesModel]:
    features = cl.build_features(_documents(spark, sf_dir), ["cat_0"], WORDS)
    return features, cl.fit_flat(features, "cat_0", kind)


def _model_table(features: cl.Features, model: BayesModel) -> DataFrame:
    cells = conditional_weights(model).join(features.vocabulary.select("index", "term"), "index")
    return cells.select("class", "term", F.round("gain", 6).alias("gain"))


@query
def nb_bernoulli_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_table(*_flat(spark, sf_dir, "bernoulli"))


@query
def nb_multinomial_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_table(*_flat(spark, sf_dir, "multinomial"))


@query
def nb_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _flat(spark, sf_dir, "bernoulli")
    return model.classes.select(
        "class", "label", "items", F.round("prior", 6).alias("prior"),
        F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"),
    )


@query
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = _flat(spark, sf_dir, "bernoulli")
    return cl.classify(features.terms, model, "cat_0", ["cat_0"])


@query
def nb_predict_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = _flat(spark, sf_dir, "multinomial")
    return cl.classify(features.terms, model, "cat_0", ["cat_0"])


@query
def nb_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = _flat(spark, sf_dir, "bernoulli")
    terms = cl.new_item_terms(tb.conversation_items(spark, sf_dir), features)
    return cl.classify(terms, model, "cat_0")


def _hierarchy(
    spark: SparkSession, sf_dir: str, limits: dict[int, Limits]
) -> tuple[cl.Features, BayesModel]:
    features = cl.build_features(_documents(spark, sf_dir), [*CATS, "price"], limits)
    return features, cl.fit_hierarchy(features)


@query
def nb_hier_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _hierarchy(spark, sf_dir, GRAMS)
    return model.classes.select(
        "level", "parent", "class", "label", "items", F.round("intercept", 6).alias("intercept")
    )


@query
def nb_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = _hierarchy(spark, sf_dir, GRAMS)
    return cl.cascade(features.terms, model)


def _repeated(items: DataFrame) -> DataFrame:
    """The same items under ids of which many are equal and some null."""
    return items.withColumn("item_id", F.when(F.col("item_id") % 10 != 0, F.col("item_id") % 50))


@query
def nb_cascade_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a repeated or null id is predicted from its own terms: rows per id and prediction."""
    items = _repeated(tb.document_items(spark, sf_dir))
    features = cl.build_features(items, [*CATS, "price"], GRAMS)
    found = cl.cascade(features.terms, cl.fit_hierarchy(features))
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = cl.build_features(_documents(spark, sf_dir), [*CATS, "price"], GRAMS)
    return cl.cascade(features.terms, cl.fit_mixed(features))


@query
def mixed_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main program's hierarchy: Bayes for cat_0 and cat_1, logistic regression for cat_2, by predicted parent.

    Shown is what SQL can tell: the Bayes levels, and that the leaf is a child of the predicted parent.
    """
    child = F.startswith(F.col("predicted_cat_2"), F.concat("predicted_cat_1", F.lit("/")))
    return _mixed(spark, sf_dir).select("item_id", "predicted_cat_0", "predicted_cat_1", child.alias("leaf_is_child"))


@query
def mixed_cascade_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the same hierarchy next to the true ones."""
    found = _mixed(spark, sf_dir).select("item_id", "predicted_cat_2")
    return _documents(spark, sf_dir).select("item_id", "cat_2").join(found, "item_id")


@query
def logreg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logistic regressions of three levels in one loop; per model what SQL can tell, and that it beats its priors."""
    features = cl.build_features(tb.labelled_items(spark, sf_dir), [*CATS], GRAMS)
    levels = [Level("cat_0"), Level("cat_1", "cat_0"), Level("cat_2", "cat_1")]
    models = fit_logistic(features.terms, levels)
    counts = models.classes.groupBy("level", "parent").agg(F.collect_list("items").alias("sizes"))
    entropy = F.aggregate("sizes", F.lit(0.0), lambda a, n: a - n / F.col("items") * F.log(n / F.col("items")))
    return models.summary.join(counts, ["level", "parent"]).select(
        "level", "parent", "items", "classes", "terms", (F.coalesce("loss", F.lit(0.0)) <= entropy + 1e-9).alias("beats_priors")
    )


@query
def nb_under_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = _hierarchy(spark, sf_dir, WORDS)
    return cl.classify_under_parent(features.terms, model, "cat_2", "cat_1", ["cat_1", "cat_2"])


@query
def nb_hier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tb.part_titles(spark, sf_dir)
    features = cl.build_features(items, [*CATS, "price"], {1: Limits(1000, 2), 2: Limits(1000, 2)})
    return cl.cascade(features.terms, cl.fit_hierarchy(features))


# Evaluation


@query
def nb_cellphones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trim each category, English list, 2-grams of the filtered words, small vocabularies."""
    items = trim_by_percentile(_documents(spark, sf_dir), 10, 90, ["cat_1"])
    limits = {1: Limits(1000, 20), 2: Limits(1000, 20)}
    features = cl.build_features(
        items, ["cat_1"], limits, language_stop_words("english"), "filtered", None, plain=True
    )
    return cl.classify(features.terms, cl.fit_flat(features, "cat_1"), "cat_1", ["cat_1"])


@query
def accuracy_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(nb_predict(spark, sf_dir), "cat_0")


@query
def accuracy_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy_by_category(nb_predict(spark, sf_dir), "cat_0")


@query
def holdout_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.holdout_accuracy(_documents(spark, sf_dir), "cat_0", None, WORDS)


@query
def holdout_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.holdout_accuracy(_documents(spark, sf_dir), "cat_1", "cat_0", WORDS, trim=(5, 95))


# Taxonomy


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their nations as one tree text per region."""
    nations = tb.table(spark, sf_dir, "nation")
    regions = tb.table(spark, sf_dir, "region")
    child = F.concat(
        F.lit('{"id":"N'), F.col("n_nationkey").cast("string"),
        F.lit('","name":"'), F.col("n_name"), F.lit('"}'),
    )
    children = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_join(F.sort_array(F.collect_list(child)), ",").alias("children")
    )
    return regions.join(children, "r_regionkey", "left").select(
        F.concat(
            F.lit('{"id":"R'), F.col("r_regionkey").cast("string"),
            F.lit('","name":"'), F.col("r_name"),
            F.lit('","children_categories":['), F.coalesce("children", F.lit("")), F.lit("]}"),
        ).alias("value")
    )


@query
def taxonomy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_names(_names(spark, sf_dir))


@query
def enrich_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = tb.table(spark, sf_dir, "customer").join(
        tb.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    items = customers.select(
        F.col("c_custkey").alias("item_id"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("cat_0"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("cat_1"),
        F.col("c_mktsegment").alias("cat_2"),
    )
    return enrich_titles(items, category_names(_names(spark, sf_dir)))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree text per customer: region, nation, customer; regions and nations occur in many texts."""
    places = tb.table(spark, sf_dir, "nation").join(tb.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = tb.table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))

    def category(letter: str, key: str, name: str, *children):
        kids = [F.array(*children).alias("children_categories")] if children else []
        return F.struct(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), *kids)

    tree = category("R", "r_regionkey", "r_name", category("N", "n_nationkey", "n_name", category("C", "c_custkey", "c_name")))
    return rows.select(F.to_json(tree).alias("value"))


@query
def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_tree(_nested(spark, sf_dir)).select(
        "id", "name", "parent", "depth", F.array_join("path", ">").alias("path"), F.array_join("names", ">").alias("names")
    )


@query
def enrich_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under their customer as category."""
    items = tb.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cat_0")
    )
    return enrich_by_ancestors(items, category_tree(_nested(spark, sf_dir)), "cat_0")


# Embeddings, scaling, indexing


@query
def minmax_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vc.as_vector(tb.table(spark, sf_dir, "embeddings"), "embedding", "vector")
    scaled = vc.fit_min_max(df, "vector").transform(df)
    return scaled.select(
        "vec_id", F.posexplode(vector_to_array("scaled")).alias("position", "value")
    ).select("vec_id", "position", F.round("value", 6).alias("value"))


@query
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tb.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array(*[F.col(c).cast("double") for c in (
            "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")]).alias("values"),
    )
    df = vc.as_vector(lines, "values", "vector")
    indexed = vc.fit_vector_index(df, "vector", 100).transform(df)
    values = vector_to_array("indexed")
    return indexed.select(
        "l_orderkey", "l_linenumber",
        *[F.get(values, i).alias(n) for i, n in enumerate(("line", "quantity", "discount", "price"))],
    )


def _embedded(spark: SparkSession, sf_dir: str, size: int, window: int):
    words = with_words(_documents(spark, sf_dir)).select(F.monotonically_increasing_id().alias(ROW), "item_id", "cat_0", "words")
    words = materialize(words, "words")
    model = vc.fit_embeddings(
        words, "words", size, window, min_count=0, partitions=spark.sparkContext.defaultParallelism
    )
    return words, model


@query
def word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, model = _embedded(spark, sf_dir, 20, 3)
    return model.transform(words).select("item_id", vector_to_array("features").alias("vector"))


@query
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, model = _embedded(spark, sf_dir, 5, 3)
    frequent = word_frequent(words)
    return vc.nearest_words(model, frequent, 8)


def word_frequent(words: DataFrame) -> str:
    top = words.select(F.explode("words").alias("w")).groupBy("w").count()
    return top.orderBy(F.desc("count"), "w").first().w


@query
def nb_scaled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, model = _embedded(spark, sf_dir, 20, 5)
    vectors = model.transform(words).select("item_id", "cat_0", F.col("features").alias("vector"))
    vectors = materialize(vectors, "vectors")  # read by the scaler, the learner and the prediction
    scaler = vc.fit_min_max(vectors, "vector", "features")
    scaled = scaler.transform(vectors)
    train, test = random_split(scaled.select("item_id", "cat_0", "features"))
    fitted = ln.fit_classifier(train, "cat_0", ln.naive_bayes("multinomial", 0.2))
    return _categories(fitted.transform(test))


# Learners on vectors


def _categories(predicted: DataFrame) -> DataFrame:
    return predicted.select("item_id", "cat_0", "category")


def _vectors(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    items = _documents(spark, sf_dir) if items is None else items
    items = items.withColumn("title", normalize_title("title"))
    items = materialize(items, "normalised")
    stages = preprocessing_stages({1: Limits(1000, 20)}).fit(items)
    return stages.transform(items)


def _split_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(_vectors(spark, sf_dir).select("item_id", "cat_0", "features"), "vectors")
    return rows.where(in_train()), rows.where(~in_train())


def _holdout(learner: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _split_vectors(spark, sf_dir)
        return _categories(ln.fit_classifier(train, "cat_0", learner()).transform(test))

    return run


def _logistic(family: str) -> Query:
    """Hold-out categories under the full vocabularies, 100 iterations and no penalty."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flagged = _documents(spark, sf_dir).withColumn("_train", in_train())
        features = cl.build_features(flagged, ["cat_0", "_train"], GRAM_LIMITS, train_on="_train")
        model = fit_logistic(features.terms, [Level("cat_0", keep="_train")], family=family).linear()
        found = cl.classify(features.terms.where(~F.col("_train")), model, "cat_0", ["cat_0"])
        return found.select("item_id", "cat_0", F.col("prediction").alias("category"))

    return run


REGISTRY["logreg"] = _logistic("auto")
REGISTRY["logreg_multinomial"] = _logistic("multinomial")
REGISTRY["decision_tree"] = _holdout(lambda: ln.decision_tree(30))
REGISTRY["random_forest_deep"] = _holdout(lambda: ln.random_forest(8, 50))
REGISTRY["nb_ml"] = _holdout(lambda: ln.naive_bayes("bernoulli"))


@query
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed counts, vector index, forest: the tree programs' chain."""
    words = with_words(_documents(spark, sf_dir)).select("item_id", "cat_0", "words")
    chain = Pipeline(
        stages=[
            HashingTF(inputCol="words", outputCol="hashed", numFeatures=1000),
            VectorIndexer(
                inputCol="hashed", outputCol="features", maxCategories=100, handleInvalid="keep"
            ),
        ]
    )
    words = materialize(words, "words")
    rows = chain.fit(words).transform(words).select("item_id", "cat_0", "features")
    train, test = rows.where(in_train()), rows.where(~in_train())
    # Indexed dimensions may have up to 100 categories, so at least as many bins are needed.
    learner = ln.random_forest(5, 100).setMaxBins(128)
    return _categories(ln.fit_classifier(train, "cat_0", learner).transform(test))


@query
def perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split_vectors(spark, sf_dir)
    return _categories(ln.fit_perceptron(train, "cat_0", max_iter=50).transform(test))


@query
def evaluator_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ML evaluator's accuracy next to the aggregated one."""
    train, test = _split_vectors(spark, sf_dir)
    labels = ln.index_labels_model(train, "cat_0")
    fitted = ln.fit_classifier(train, "cat_0", ln.naive_bayes("bernoulli"), labels)
    # a test item with a label unseen in training counts as wrong
    numbered = labels.copy().setHandleInvalid("keep").transform(test)
    predicted = materialize(
        fitted.transform(numbered).select("label", "prediction", "cat_0", "category"), "predicted"
    )
    value = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predicted)
    return accuracy(predicted, "cat_0", "category").withColumn("evaluator", F.lit(value))


@query
def logreg_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logistic regression per language over trimmed rows, each with its own label index."""
    features = cl.build_features(tb.labelled_items(spark, sf_dir), ["cat_0", "cat_1", "price"], GRAM_LIMITS)
    table = cl.mark_trimmed(features.terms, ["cat_0"], *cl.CHILD_TRIM, "_kept")
    model = fit_logistic(table, [Level("cat_1", "cat_0", "_kept")]).linear()
    found = cl.classify_under_parent(features.terms, model, "cat_1", "cat_0", ["cat_0", "cat_1"])
    return found.select("item_id", "cat_0", "cat_1", F.col("prediction").alias("category"))


#: Limits of words, 2-grams and 3-grams, and the number of terms selected among all of them.
SELECT_LIMITS = {1: Limits(300_000, 50), 2: Limits(100_000, 50), 3: Limits(100_000, 50)}
SELECTED = 30_000


@query
def hier_logreg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms selected by chi-square against cat_2 among words, 2-grams and 3-grams without a stop list; logistic
    regression at all levels, the root trimmed too; predictions go down by predicted parent."""
    items = tb.labelled_items(spark, sf_dir)
    features = cl.build_features(items, [*CATS, "price"], SELECT_LIMITS, stop_words=[])
    chosen = select_terms(features.terms, features.vocabulary, "cat_2", SELECTED)
    vocab = features.vocabulary.join(chosen.select("index"), "index")
    vocab = materialize(vocab.withColumn("index", (F.row_number().over(W.orderBy("index")) - 1).cast("int")), "selected")
    terms = item_terms(features.tokens, "terms", vocab, [*CATS, "price"])
    selected = cl.Features(features.tokens, vocab, vocab.count(), terms)
    model = cl.fit_mixed(selected, ("logistic",) * 3, root_trim=(2, 98))
    return items.select("item_id", *CATS).join(cl.cascade(terms, model), "item_id")


@query
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocessing and root model saved, loaded and assembled; predictions before and after."""
    items = materialize(
        _documents(spark, sf_dir).withColumn("title", normalize_title("title")), "normalised"
    )
    stages = preprocessing_stages({1: Limits(1000, 20)}).fit(items)
    fitted = ln.fit_classifier(stages.transform(items), "cat_0", ln.naive_bayes("bernoulli"))
    root = new_path(spark, "models")
    save_model(root, PREPROCESS, stages)
    save_model(root, model_name("cat_0"), fitted)
    loaded = assemble(load_model(root, PREPROCESS), load_model(root, model_name("cat_0")))
    before = assemble(stages, fitted).transform(items).select(
        "item_id", F.col("category").alias("before")
    )
    after = loaded.transform(items).select("item_id", F.col("category").alias("after"))
    return before.join(after, "item_id").withColumn("same", F.col("before") == F.col("after"))


@query
def nb_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Bayes tables saved and loaded score as before."""
    features, model = _flat(spark, sf_dir, "bernoulli")
    path = new_path(spark, "bayes")
    model.save(path)
    loaded = BayesModel.load(spark, path, model.kind)
    return cl.classify(features.terms, loaded, "cat_0", ["cat_0"])
