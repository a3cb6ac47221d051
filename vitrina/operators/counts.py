"""Word and category counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_count(df: DataFrame, text: str) -> DataFrame:
    """Occurrences per word, words being what stands between single spaces.

    Trailing empty words are dropped, inner and leading ones count, as in a Java split.
    """
    words = F.split(F.regexp_replace(F.col(text), " +$", ""), " ")
    words = F.when(F.col(text).rlike("^ +$"), F.array().cast("array<string>")).otherwise(words)
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct categories per level.

    Each level is first reduced to its distinct values with partial aggregation.
    """
    level = F.explode(
        F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("value")) for c in columns])
    )
    return (
        df.select(level.alias("_l"))
        .select("_l.*")
        .distinct()
        .groupBy("level")
        .agg(F.count("value").alias("categories"))
    )


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values (or pairs) of category levels."""
    return df.select(*columns).distinct()
