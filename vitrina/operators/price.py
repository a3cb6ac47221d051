"""Price statistics, exact percentiles and outlier trims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.operators.lookup import lookup_join, null_safe_join
from vitrina.operators.ranks import values_at_ranks
from vitrina.session import materialize

# The outlier band (both ends excluded).
BAND_LOW, BAND_HIGH = 1, 999_999


def outlier_band(df: DataFrame, low: float = BAND_LOW, high: float = BAND_HIGH) -> DataFrame:
    """Rows with ``low < price < high``; a null price fails."""
    return df.where((F.col("price") > low) & (F.col("price") < high))


def price_stats(df: DataFrame, by: str = "cat_1") -> DataFrame:
    """Spread, mean and range of the price per category."""
    return df.groupBy(by).agg(
        F.stddev("price").alias("stddev_price"),
        F.mean("price").alias("mean_price"),
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
        F.avg("price").alias("avg_price"),
        F.stddev_pop("price").alias("stddev_pop_price"),
    )


def _position(tile: float) -> Column:
    return F.lit(tile / 100.0) * (F.col("total") + F.lit(1.0))


def _name(tile: float) -> str:
    return "p" + f"{tile:g}".replace(".", "_")


def percentiles(
    df: DataFrame,
    tiles: Sequence[float],
    by: Sequence[str] = (),
    value: str = "price",
    interpolate: bool = True,
) -> DataFrame:
    """Exact percentiles on the (count + 1) basis, one row per group with ``n`` and ``p<tile>``.

    ``position = tile/100 * (n + 1)``. Its whole part is a 1-based rank, its fraction interpolates
    towards the next value (or not, with ``interpolate=False``). Positions before the first or
    after the last rank give the smallest or largest value. Groups without a value have no row; rows
    with a null group form a group. An infinite lower value is not interpolated.
    """
    by = list(by)
    ranks: dict[str, Column] = {}
    for tile in tiles:
        whole = F.floor(_position(tile))
        first, last = F.lit(1), F.col("total")
        ranks[f"{_name(tile)}_lo"] = F.least(F.greatest(whole, first), last)
        if interpolate:
            ranks[f"{_name(tile)}_hi"] = F.least(F.greatest(whole + 1, first), last)
    found = values_at_ranks(df, by, value, ranks)
    outputs = []
    for tile in tiles:
        low = F.col(f"{_name(tile)}_lo")
        if interpolate:
            position = _position(tile)
            inside = (F.floor(position) > 0) & (F.floor(position) < F.col("total"))
            share = F.when(inside, position - F.floor(position)).otherwise(F.lit(0.0))
            high = F.col(f"{_name(tile)}_hi")
            stays = (share == 0) | (low == high) | (F.abs(low) == float("inf"))
            low = F.when(stays, low).otherwise(low + share * (high - low))
        outputs.append(low.alias(_name(tile)))
    return found.select(*by, F.col("total").alias("n"), *outputs)


def with_bounds(
    df: DataFrame, bounds: DataFrame, by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Attach per-group bounds.

    Bounds of the whole set are a single row: its values become literals, so that a filter on them
    reaches the scan. Bounds of groups are written and looked up; a null group has bounds as well.
    """
    if by:
        bounds = materialize(bounds, "bounds")
        return lookup_join(df, bounds, by, how, salt_on=["item_id"], null_safe=True)
    row = bounds.first()
    if row is None and how == "inner":
        return df.where(F.lit(False)).select("*", *[F.lit(None).alias(c) for c in bounds.columns])
    values = {f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in bounds.schema}
    return df.select("*", *[value.alias(name) for name, value in values.items()])


def trim_bounds(df: DataFrame, bottom: float, top: float, by: Sequence[str] = ()) -> DataFrame:
    """``_low`` and ``_high`` per group."""
    return percentiles(df, [bottom, top], by).select(
        *by, F.col(_name(bottom)).alias("_low"), F.col(_name(top)).alias("_high")
    )


def trim_by_percentile(
    df: DataFrame, bottom: float, top: float, by: Sequence[str] = ()
) -> DataFrame:
    """Rows whose price lies between two percentiles of their group, ends included.

    ``by=()`` trims the whole set, ``by=["cat_2"]`` each category on its own, in one job.
    Rows without a price are dropped.
    """
    bounded = with_bounds(df, trim_bounds(df, bottom, top, by), by)
    return bounded.where(F.col("price").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def trim_report(
    df: DataFrame, bottom: float, top: float, by: Sequence[str] = ()
) -> DataFrame:
    """Items, items with a price and items kept by ``trim_by_percentile``, per group."""
    bounded = with_bounds(df, trim_bounds(df, bottom, top, by), by, how="left")
    kept = F.col("price").between(F.col("_low"), F.col("_high"))
    return bounded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count("price").alias("with_price"),
        F.count(F.when(kept, 1)).alias("kept"),
    )


def trim_by_rank(
    df: DataFrame,
    bottom: float,
    top: float,
    by: Sequence[str] = (),
    field: str = "price",
    item_id: str = "item_id",
) -> DataFrame:
    """Rows at 0-based positions ``floor(bottom/100*(n+1)) .. floor(top/100*(n+1))`` of their group.

    Positions follow ``field``, equal values follow ``item_id`` (a number or a text). A group of one
    row, or one where either position is not positive, is returned whole, that is all its rows that
    have a value. Rows without a value have no position.

    Positions are turned into thresholds, so no group is sorted: a row stays when
    ``(field, item_id)`` lies between the pairs found at the two ranks.
    """
    by = list(by)
    rows = df.where(F.col(field).isNotNull())
    k_low, k_high = F.floor(_position(bottom)), F.floor(_position(top))
    ends = values_at_ranks(
        rows,
        by,
        field,
        {
            "low": F.least(k_low + 1, F.col("total")),
            "high": F.least(k_high + 1, F.col("total")),
        },
    ).select(
        *by,
        "total",
        "low",
        "high",
        ((F.col("total") == 1) | (k_low <= 0) | (k_high <= 0)).alias("_whole"),
        (k_low + 1 > F.col("total")).alias("_none"),
        (F.least(k_low + 1, F.col("total")) - F.col("low_below")).alias("_low_nth"),
        (F.least(k_high + 1, F.col("total")) - F.col("high_below")).alias("_high_nth"),
    )
    ends = materialize(ends, "ends")
    pairs = ends.drop("total")
    bounded = with_bounds(rows, pairs, by)
    ids = _tie_thresholds(bounded, by, field, item_id)
    # A group may be missing from the tie table only when it is returned whole.
    if by:
        bounded = with_bounds(rows, null_safe_join(pairs, ids, by, "left"), by)
    else:
        bounded = with_bounds(bounded, ids, by, how="left")
    value = F.col(field)
    above = (value > F.col("low")) | ((value == F.col("low")) & (F.col(item_id) >= F.col("low_id")))
    below = (value < F.col("high")) | (
        (value == F.col("high")) & (F.col(item_id) <= F.col("high_id"))
    )
    return bounded.where(F.col("_whole") | (~F.col("_none") & above & below)).select(*df.columns)


def _tie_thresholds(bounded: DataFrame, by: list[str], field: str, item_id: str) -> DataFrame:
    """Per group, the id of the n-th row among those whose value equals the low or high end."""
    value = F.col(field)
    ends = F.array(
        *[
            F.struct(
                F.lit(end).alias("end"),
                F.col(f"_{end}_nth").alias("nth"),
                (value == F.col(end)).alias("hit"),
            )
            for end in ("low", "high")
        ]
    )
    ties = (
        bounded.where((value == F.col("low")) | (value == F.col("high")))
        .select(*by, item_id, F.explode(F.filter(ends, lambda e: e["hit"])).alias("_e"))
        .select(*by, item_id, F.col("_e.end").alias("_end"), F.col("_e.nth").alias("_nth"))
    )
    found = values_at_ranks(ties, [*by, "_end", "_nth"], item_id, {"nth": F.col("_nth")})
    return found.groupBy(*by).agg(
        F.max(F.when(F.col("_end") == "low", F.col("nth"))).alias("low_id"),
        F.max(F.when(F.col("_end") == "high", F.col("nth"))).alias("high_id"),
    )
