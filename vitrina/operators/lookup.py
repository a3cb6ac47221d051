"""Join of a large table with a lookup table, without a hot task.

Up to ``MAX_BROADCAST_ROWS`` counted rows the lookup table is broadcast and the large side is not
shuffled at all. Beyond that there are two ways:

* with known key frequencies, the most frequent keys (as many as may be broadcast) are joined by
  broadcast and only rows with rarer keys are shuffled;
* otherwise both sides are shuffled on the key plus a salt, the lookup side repeated once per salt,
  so that a key which holds a third of the large side is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
SALTS = 32


def fits_broadcast(
    table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, size: Column | None = None
) -> bool:
    """Whether a materialised table has at most ``max_rows`` rows (or sum of ``size`` per row)."""
    if size is None:
        return table.limit(max_rows + 1).count() <= max_rows
    return (table.agg(F.sum(size)).first()[0] or 0) <= max_rows


def _hot_condition(
    table: DataFrame, frequency: str, max_rows: int, size: Column | None
) -> Column:
    """Keys frequent enough, cut at a power of two so that their total size stays within bounds."""
    power = F.floor(F.log2(F.greatest(F.col(frequency).cast("double"), F.lit(1.0)))).cast("int")
    sizes = (
        table.groupBy(power.alias("power"))
        .agg(F.sum(size if size is not None else F.lit(1)).alias("size"))
        .collect()  # at most one row per power of two
    )
    cut, used = 64, 0
    for row in sorted(sizes, key=lambda r: -r.power):
        if used + row.size > max_rows:
            break
        cut, used = row.power, used + row.size
    return power >= cut


def null_safe_join(
    facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Join on equal columns where a null matches a null; ``small`` broadcasts ``table``."""
    keys = {c: f"_key_{i}" for i, c in enumerate(on)}
    renamed = table.withColumnsRenamed(keys)
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in keys.items()])
    return facts.join(F.broadcast(renamed) if small else renamed, same, how).drop(*keys.values())


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt_on: Sequence[str] = (),
    frequency: str | None = None,
    size: Column | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``facts`` to ``table`` (inner, left or left_semi) on equal columns.

    ``table`` should be materialised, since it is measured first. ``frequency`` names its column of
    key frequencies and requires unique keys; the column is not part of the result. ``salt_on`` names
    columns of ``facts`` that vary inside a hot key, such as the item id; without any, all columns
    are hashed. ``null_safe`` lets null keys match each other (not together with ``frequency``).
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    if null_safe and frequency:
        raise ValueError("null_safe and frequency exclude each other")
    on = list(on)
    result = table.drop(frequency) if frequency else table
    if fits_broadcast(table, max_rows, size):
        if null_safe:
            return null_safe_join(facts, result, on, how, small=True)
        return facts.join(F.broadcast(result), on, how)
    if frequency:
        hot = _hot_condition(table, frequency, max_rows, size)
        frequent = F.broadcast(table.where(hot).drop(frequency))  # bounded by max_rows
        rare = table.where(~hot).drop(frequency)
        by_broadcast = facts.join(frequent, on, "left_semi" if how == "left_semi" else "inner")
        by_shuffle = facts.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti").join(
            rare, on, how
        )
        return by_broadcast.unionByName(by_shuffle)
    spread = [F.col(f"`{c}`") for c in (salt_on or facts.columns)]
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_table = result.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if null_safe:
        return null_safe_join(salted_facts, salted_table, [*on, "_salt"], how).drop("_salt")
    return salted_facts.join(salted_table, [*on, "_salt"], how).drop("_salt")
