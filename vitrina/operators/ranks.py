"""Exact order statistics per group without sorting a whole group.

A group may hold a third of all rows, so no window ever runs over its rows. Instead:

1. a histogram over value buckets is aggregated per group (partial aggregation, tiny shuffle);
2. a window over the histogram finds the one bucket that holds each wanted rank;
3. a bucket that still holds too many rows of different values is divided again, into equal widths
   between its smallest and largest value (texts: by the bytes behind what these two share), until
   it does not or holds one value only;
4. only rows of the final buckets are aggregated by value and ranked inside their bucket.

The first buckets are a fixed monotone function of the value: a relative width of 1/1024 for numbers,
with infinities as buckets of their own, and the first bytes for texts. So the histogram of a group
has some thousands of rows whatever the data size. Rows with a null group form a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.operators.lookup import lookup_join, null_safe_join
from vitrina.session import materialize

WIDTHS = 1024  # buckets per e-fold of the value, and per division of a bucket
MAX_BUCKET_ROWS = 5_000_000
LARGEST_LOG = 711.0  # above the logarithm of the largest finite double
TEXT_BYTES = 2  # of a text, by which a bucket is told or divided


def value_bucket(value: Column) -> Column:
    """Monotone bucket number: equal widths on a logarithmic scale, mirrored for negatives."""
    v = value.cast("double")
    # The logarithm of the smallest positive double is above -746, so numbers are positive.
    magnitude = F.floor((F.least(F.log(F.abs(v)), F.lit(LARGEST_LOG)) + 746.0) * float(WIDTHS))
    return F.when(v == 0, 0).otherwise(F.signum(v) * magnitude).cast("int")


def text_bucket(value: Column, skip: Column) -> Column:
    """Monotone number of the bytes behind the first ``skip`` ones; a text that has ended comes first."""
    bytes_left = F.substring(value.cast("binary"), skip + 1, F.lit(TEXT_BYTES))
    digits = F.rpad(F.hex(bytes_left), 2 * TEXT_BYTES, "0")
    # The length tells an ended text from one that goes on with zero bytes.
    return (F.conv(digits, 16, 10).cast("int") * (TEXT_BYTES + 1) + F.length(bytes_left)).cast("int")


def _shared_bytes(low: Column, high: Column) -> Column:
    """Length of the longest common start of two texts, in bytes."""
    a, b = low.cast("binary"), high.cast("binary")
    shorter = F.least(F.length(a), F.length(b))
    starts = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    same = F.filter(starts, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.size(same)


def _part_of(value: Column, low: Column, high: Column) -> Column:
    share = (value - low).cast("double") / (high - low).cast("double")
    return F.when(low < high, F.floor(share * float(WIDTHS))).otherwise(0).cast("int")


def _ranked(counts: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Rows before each bucket inside its parent bucket."""
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(1))
    running = group.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("before", F.sum("n").over(running) - F.col("n"))


def _holding(buckets: DataFrame) -> DataFrame:
    """Buckets that hold a wanted rank, with those ranks only."""
    here = F.filter(
        "wanted",
        lambda w: (w["rank"] > F.col("before")) & (w["rank"] <= F.col("before") + F.col("n")),
    )
    return buckets.withColumn("wanted", here).where(F.size("wanted") > 0)


def values_at_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ranks: dict[str, Column],
    max_rows: int = MAX_BUCKET_ROWS,
) -> DataFrame:
    """Values at given 1-based ranks of each group.

    ``value`` is a number (NaN counts as missing) or a text, ordered by its bytes. ``ranks`` maps a
    name to an expression over ``total`` (the group's non-null rows) and the ``by`` columns. The
    result has one row per group with ``total``, ``<name>`` (the value) and ``<name>_below`` (rows
    strictly smaller than that value). Ranks outside 1..total give no value. Buckets of more than
    ``max_rows`` rows are divided.
    """
    by = list(by)
    is_text = isinstance(df.schema[value].dataType, T.StringType)
    wanted = F.array(
        *[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]
    )
    v = F.col("_v")
    rows = df.select(*by, F.col(value).alias("_v")).where(v.isNotNull())
    if not is_text:
        rows = rows.where(~F.isnan(v.cast("double")))
    sizes = (F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))

    path = ["_b0"]
    rows = rows.withColumn("_b0", text_bucket(v, F.lit(0)) if is_text else value_bucket(v))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    buckets = _ranked(rows.groupBy(*by, *path).agg(*sizes), by, "_b0")
    buckets = buckets.withColumn("total", F.sum("n").over(group)).withColumn("wanted", wanted)
    # Few rows per group; every rank appears in exactly one bucket.
    hits = materialize(_holding(buckets), "ranks")

    # A division parts the smallest from the largest value, so this ends.
    while (hits.where(F.col("low") < F.col("high")).agg(F.max("n")).first()[0] or 0) > max_rows:
        keys, part = [*by, *path], f"_b{len(path)}"
        low, high = F.col("low"), F.col("high")
        if is_text:
            bounds = hits.select(*keys, _shared_bytes(low, high).alias("_skip"))
            parted = text_bucket(v, F.col("_skip"))
        else:
            bounds = hits.select(*keys, low.alias("_low"), high.alias("_high"))
            parted = _part_of(v, F.col("_low"), F.col("_high"))
        rows = lookup_join(rows, bounds, keys, salt_on=["_v"], null_safe=True)
        rows = rows.withColumn(part, parted).drop("_low", "_high", "_skip")
        divided = _ranked(rows.groupBy(*keys, part).agg(*sizes), keys, part)
        parents = hits.select(*keys, F.col("before").alias("_before"), "total", "wanted")
        divided = null_safe_join(divided, parents, keys).withColumn(
            "before", F.col("before") + F.col("_before")
        )
        hits = materialize(_holding(divided.drop("_before")), "ranks")
        path.append(part)

    keys = [*by, *path]
    picked = (
        lookup_join(
            rows, hits.select(*keys), keys, how="left_semi", salt_on=["_v"], null_safe=True
        )
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parents = hits.select(*keys, F.col("before").alias("_before"), "total", "wanted")
    ranked = null_safe_join(_ranked(picked, keys, "_v"), parents, keys)
    ranked = ranked.withColumn("before", F.col("before") + F.col("_before"))
    found = _holding(ranked)
    outputs = []
    for name in ranks:
        here = F.array_contains(F.transform("wanted", lambda w: w["name"]), name)
        outputs.append(F.max(F.when(here, F.col("_v"))).alias(name))
        outputs.append(F.max(F.when(here, F.col("before"))).alias(f"{name}_below"))
    return found.groupBy(*by).agg(F.max("total").alias("total"), *outputs)
