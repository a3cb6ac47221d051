"""Dense positions in a global order, without a window over the whole table.

Rows are dealt to partitions by ranges of the order and sorted there; a row's number inside its partition is
written with it. Counting the partitions gives an offset for each, and offset plus number is the position. No
task sees more than a range of the rows: a value that a third of the rows share is split over ranges as long as
later columns of the order tell its rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrina.operators.lookup import lookup_join
from vitrina.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low bits and the partition above


def dense_positions(
    df: DataFrame, order: Sequence[str | Column], name: str = "position", partitions: int | None = None
) -> DataFrame:
    """Attach the 0-based position of every row in ``order`` (names ascend with nulls first).

    The order should end in a column that tells all rows apart; rows that tie in all of it get positions in any
    order. The result is a written table plus an offset per partition, whose number is bounded by ``partitions``.
    """
    at = "_at"
    keys = [F.col(f"`{c}`").asc_nulls_first() if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    rows = dealt.sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = materialize(rows, "positions")
    part = F.shiftright(at, _ROW_BITS)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_offset") + inside).drop(at, "_part", "_offset")


def group_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "position"
) -> DataFrame:
    """Attach the 0-based position of every row inside its group, whose columns hold no nulls.

    A group with a third of all rows spans many ranges; its first position comes by a join that broadcasts
    the largest groups.
    """
    group = list(group)
    rows = dense_positions(df, [*group, *order], "_global")
    first = rows.groupBy(*group).agg(F.min("_global").alias("_first"), F.count(F.lit(1)).alias("_size"))
    rows = lookup_join(rows, materialize(first, "group-starts"), group, frequency="_size")
    return rows.withColumn(name, F.col("_global") - F.col("_first")).drop("_global", "_first")


def at_positions(positioned: DataFrame, positions: Sequence[int], name: str = "position") -> DataFrame:
    """The rows at given positions; positions outside the table have none."""
    return positioned.where(F.col(name).isin([int(p) for p in positions]))


def between_positions(positioned: DataFrame, first: int, last: int, name: str = "position") -> DataFrame:
    """The rows from position ``first`` to ``last``, ends included."""
    return positioned.where(F.col(name).between(int(first), int(last)))
