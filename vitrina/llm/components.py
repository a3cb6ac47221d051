"""Connected components of a table of links by alternating star operations, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.session import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked with the smallest of its neighbourhood; links may repeat."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, is linked with the smallest of them."""
    down = links.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, label) of every vertex of ``links`` (u, v): the smallest vertex of its component.

    Self-links and repeated links are allowed. Each round is written to the shared folder; it ends when a
    round changes nothing.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(links.distinct(), "links")

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = fingerprint(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        last, now = now, materialize(_small_star(_large_star(now)), "links")
        discard(last)
        after = fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct()
    )
