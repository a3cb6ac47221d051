"""Vocabularies, count vectors and the term table of each item."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.functions.tokens import explode_rows, gram_size, term_runs
from vitrina.operators.lookup import MAX_BROADCAST_ROWS, fits_broadcast, lookup_join
from vitrina.operators.positions import dense_positions
from vitrina.session import materialize


@dataclass(frozen=True)
class Limits:
    """Largest vocabulary and smallest document frequency for one gram size."""

    size: int
    min_df: int = 1


# Limits for words, 2-grams and 3-grams.
GRAM_LIMITS = {1: Limits(60_000, 100), 2: Limits(30_000, 50), 3: Limits(30_000, 50)}

RANK_PARTS = 32
ROW = "row_id"  # numbers the rows of an item_terms table

# How a sparse vector is stored.
SPARSE = T.StructType(
    [
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def term_counts(items: DataFrame, terms: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Per group and term: occurrences ``n`` and items ``df``.

    Repeats are counted inside each row, so one partial aggregation and one shuffle of distinct
    terms are enough; a frequent term arrives as one row per map task.
    """
    exploded = explode_rows(
        items.select(*by, term_runs(terms).alias("_runs")), "_runs", "_run"
    )
    return exploded.groupBy(*by, F.col("_run.term").alias("term")).agg(
        F.sum("_run.tf").alias("n"), F.count(F.lit(1)).alias("df")
    )


def most_frequent(counts: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``size`` most frequent terms per group with their ``rank``; equal counts follow the term.

    Each group is ranked in ``RANK_PARTS`` parts by a hash of the term first. Only the best of each
    part meet in one task, at most ``RANK_PARTS * size`` rows however many terms a group has.
    """
    order = [F.desc("n"), F.col("term")]
    part = F.pmod(F.xxhash64("term"), F.lit(RANK_PARTS)).alias("_part")
    parts = W.partitionBy(*by, "_part").orderBy(*order)
    group = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(*order)
    return (
        counts.select("*", part)
        .withColumn("rank", F.row_number().over(parts))
        .where(F.col("rank") <= size)
        .drop("_part")
        .withColumn("rank", F.row_number().over(group))
        .where(F.col("rank") <= size)
    )


def vocabulary(items: DataFrame, terms: str, size: int, min_df: int = 1) -> DataFrame:
    """``index, term, n, df`` of the most frequent terms."""
    counts = term_counts(items, terms).where(F.col("df") >= min_df)
    return most_frequent(counts, size).select(
        (F.col("rank") - 1).alias("index"), "term", "n", "df"
    )


def gram_vocabulary(
    items: DataFrame, terms: str, limits: dict[int, Limits] | None = None
) -> DataFrame:
    """One vocabulary per gram size, numbered through in gram order: ``index, gram, term, n, df``.

    ``terms`` holds all grams of an item; they are counted in one pass.
    """
    limits = limits or GRAM_LIMITS
    counts = term_counts(items, terms).withColumn("gram", gram_size("term"))
    min_df, size = F.lit(None), F.lit(None)
    for gram, limit in limits.items():
        min_df = F.when(F.col("gram") == gram, limit.min_df).otherwise(min_df)
        size = F.when(F.col("gram") == gram, limit.size).otherwise(size)
    largest = max(limit.size for limit in limits.values())
    best = most_frequent(counts.where(F.col("df") >= min_df), largest, ["gram"])
    # The final numbering sees no more rows than the limits allow.
    order = W.orderBy("gram", "rank")
    return best.where(F.col("rank") <= size).select(
        (F.row_number().over(order) - 1).alias("index"), "gram", "term", "n", "df"
    )


def category_vocabulary(items: DataFrame, terms: str, category: str, size: int = 2000) -> DataFrame:
    """The ``size`` most frequent terms of each category, numbered through over all categories."""
    best = most_frequent(term_counts(items, terms, [category]), size, [category])
    best = materialize(best, "category-terms")  # at most size rows per category, read twice
    sizes = best.groupBy(category).agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy(category).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(category, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    return best.join(offsets, category).select(
        category,
        (F.col("_off") + F.col("rank") - 1).alias("index"),
        "term",
        "n",
        "df",
    )


def large_vocabulary(items: DataFrame, terms: str, size: int, min_df: int = 1) -> DataFrame:
    """``index, term, n, df`` like ``vocabulary``, for sizes that no task should rank and no driver hold.

    A table of how many terms have each count gives the count of the last term that still fits; terms above it are
    in, and with those that tie at it they are numbered over ranges of (count, term). The largest task
    sees a range of the chosen terms. Look terms up with ``item_terms(..., max_terms=0)``, which joins.
    """
    counts = materialize(term_counts(items, terms).where(F.col("df") >= min_df), "term-counts")
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_terms"))  # one row per distinct count
    above = F.sum("_terms").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1))
    last = by_count.select("n", F.coalesce(above, F.lit(0)).alias("_above")).where(F.col("_above") < size).agg(F.min("n")).first()[0]
    chosen = counts.where(F.col("n") >= F.lit(last))
    placed = dense_positions(chosen, [F.desc("n"), F.col("term").asc()], "index")
    return placed.where(F.col("index") < size).select(F.col("index").cast("int").alias("index"), "term", "n", "df")


def vocabulary_sizes(vocab: DataFrame, by: str = "gram") -> DataFrame:
    """Vocabulary size per gram and in total (a null group)."""
    return vocab.rollup(by).agg(F.count(F.lit(1)).alias("terms"))


def count_vectors(
    items: DataFrame,
    terms: str,
    vocab: DataFrame,
    binary: bool = False,
    repeated: bool = False,
    item_id: str = "item_id",
) -> DataFrame:
    """Count vectors in long form: ``item_id, index, value``; zeros have no row.

    ``repeated`` allows a term to have several indices, as in ``category_vocabulary``.
    """
    exploded = explode_rows(items.select(item_id, term_runs(terms).alias("_runs")), "_runs", "_run")
    found = lookup_join(
        exploded.select(item_id, F.col("_run.term").alias("term"), F.col("_run.tf").alias("tf")),
        vocab.select("term", "index") if repeated else vocab.select("term", "index", "df"),
        ["term"],
        salt_on=[item_id],
        frequency=None if repeated else "df",
    )
    value = F.lit(1.0) if binary else F.col("tf").cast("double")
    return found.select(item_id, "index", value.alias("value"))


def item_terms(
    items: DataFrame,
    terms: str | Column,
    vocab: DataFrame,
    keep: Sequence[str],
    item_id: str = "item_id",
    max_terms: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """One row per item: the ``keep`` columns and ``terms array<struct<index, tf>>`` in vocabulary.

    This is the written table that training and scoring read. Items without a known term keep an
    empty array. Rows are numbered in ``row_id`` (taken over if ``items`` has it), so ids may be null or repeated.
    A vocabulary of at most ``max_terms`` terms is broadcast inside an ML vectorizer and nothing is shuffled; a
    larger one is joined.
    """
    row = F.col(ROW) if ROW in items.columns else F.monotonically_increasing_id()
    keep = [c for c in keep if c != ROW]
    counted = items.select(row.alias(ROW), item_id, *keep, (F.col(terms) if isinstance(terms, str) else terms).alias("_terms"))
    if fits_broadcast(vocab, max_terms):
        vectors = to_vectorizer(vocab, "_terms", "_vector", binary=False).transform(counted)
        vectors = vectors.drop("_terms")
        # A written vector is a struct; its two arrays can be read without the vector type.
        plain = [f if f.name != "_vector" else T.StructField("_vector", SPARSE) for f in vectors.schema]
        rows = materialize(vectors, "item-terms", read_as=T.StructType(plain))
        pairs = F.zip_with(
            "_vector.indices",
            "_vector.values",
            lambda i, v: F.struct(i.alias("index"), v.cast("bigint").alias("tf")),
        )
        return rows.select(ROW, item_id, *keep, pairs.alias("terms"))
    if ROW not in items.columns:
        counted = materialize(counted, "numbered")  # both sides of the join below read the same numbers
    exploded = counted.select(
        ROW, F.explode_outer(term_runs("_terms")).alias("_run")
    ).select(ROW, F.col("_run.term").alias("term"), F.col("_run.tf").alias("tf"))
    known = (
        lookup_join(
            exploded.where(F.col("term").isNotNull()),
            vocab.select("term", "index", "df"),
            ["term"],
            frequency="df",
            max_rows=max_terms,
        )
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("index", "tf")).alias("terms"))
    )
    empty = F.array().cast("array<struct<index:int,tf:bigint>>")
    joined = counted.select(ROW, item_id, *keep).join(known, ROW, "left")
    return materialize(
        joined.withColumn("terms", F.coalesce("terms", empty)), "item-terms"
    )


def to_vectorizer(
    vocab: DataFrame, input_col: str, output_col: str, binary: bool = True
) -> CountVectorizerModel:
    """An ML transformer over the vocabulary; the vocabulary is bounded by its size parameter.

    The terms go to the JVM as one text: ``from_vocabulary`` would send them one by one. No term
    holds a line break.
    """
    terms = [row.term for row in vocab.orderBy("index").select("term").collect()]
    utils = vocab.sparkSession.sparkContext._jvm.org.apache.commons.lang3.StringUtils
    model = CountVectorizerModel._create_from_java_class(
        "org.apache.spark.ml.feature.CountVectorizerModel",
        utils.splitPreserveAllTokens("\n".join(terms), "\n"),
    )
    model._set(vocabSize=max(len(terms), 1))
    return model.setInputCol(input_col).setOutputCol(output_col).setBinary(binary)
