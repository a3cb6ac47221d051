import math
import random

import pytest
from pyspark.sql import functions as F

from vitrina.operators import ranks
from vitrina.operators.price import (
    outlier_band,
    percentiles,
    trim_by_percentile,
    trim_by_rank,
    trim_report,
)
from vitrina.sources.tables import order_items

GOLDEN = {
    "p2": 10627.774, "p5": 25280.7635, "p10": 51494.827,
    "p90": 449749.95, "p95": 475119.6595, "p98": 489701.7194,
}


def nist(values, tile, interpolate=True):
    values, count = sorted(values), len(values)
    position = tile / 100.0 * (count + 1.0)
    whole = math.floor(position)
    if count == 1 or whole <= 0:
        return values[0]
    if whole >= count:
        return values[-1]
    low, high = values[whole - 1], values[whole]
    return low + (position - whole) * (high - low) if interpolate else low


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group with a third of all rows on few prices, tiny groups, negatives and nulls."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        cat = "hot" if i % 3 == 0 else f"c{rng.randint(0, 40)}"
        price = rng.choice([10.0, 10.0, 10.0, 99.5, rng.uniform(-50, 5000), None])
        rows.append((i, cat, price))
    rows += [(9001, "single", 5.0), (9002, "pair", 1.0), (9003, "pair", 2.0), (9004, "none", None)]
    return rows, spark.createDataFrame(rows, "item_id bigint, cat string, price double").cache()


def groups(rows):
    out = {}
    for item, cat, price in rows:
        if price is not None:
            out.setdefault(cat, []).append((price, item))
    return out


def test_golden_percentiles(spark):
    row = percentiles(order_items(spark, "/root/testdata/sf0.01"), [2, 5, 10, 90, 95, 98]).first()
    for name, value in GOLDEN.items():
        assert row[name] == pytest.approx(value, rel=1e-12)


@pytest.mark.parametrize("interpolate", [True, False])
def test_percentiles_equal_brute_force(skewed, interpolate):
    rows, df = skewed
    found = {
        r.cat: r for r in percentiles(df, [0, 5, 50, 95, 100], ["cat"], interpolate=interpolate).collect()
    }
    expected = groups(rows)
    assert set(found) == set(expected)
    for cat, pairs in expected.items():
        prices = [p for p, _ in pairs]
        assert found[cat].n == len(prices)
        for tile in (0, 5, 50, 95, 100):
            assert found[cat][f"p{tile}"] == pytest.approx(nist(prices, tile, interpolate), rel=1e-12)


@pytest.mark.parametrize("max_rows", [1, 20])
def test_divided_buckets_give_the_same_values(spark, max_rows):
    """Values crowded into one relative width of 1/1024, in units from tiny to large."""
    rng = random.Random(5)
    for unit in (1e-9, 1.0, 1e9):
        rows = [(i, "a", unit * (1000 + rng.random() / 10)) for i in range(500)]
        rows += [(i, "b", unit * 1000.05) for i in range(300)] + [(i, "b", -unit * i) for i in range(50)]
        df = spark.createDataFrame(rows, "item_id bigint, cat string, price double")
        wanted = {f"r{k}": F.lit(k) for k in (1, 7, 250, 340)}
        found = ranks.values_at_ranks(df, ["cat"], "price", wanted, max_rows=max_rows).collect()
        for row in found:
            values = sorted(p for _, c, p in rows if c == row.cat)
            for k in (1, 7, 250, 340):
                assert row[f"r{k}"] == values[k - 1]
                assert row[f"r{k}_below"] == sum(v < values[k - 1] for v in values)
        assert len(found) == 2


def test_trims_equal_brute_force(skewed):
    rows, df = skewed
    kept = {r.item_id for r in trim_by_percentile(df, 10, 90, ["cat"]).collect()}
    expected = set()
    for pairs in groups(rows).values():
        prices = [p for p, _ in pairs]
        low, high = nist(prices, 10), nist(prices, 90)
        expected |= {i for p, i in pairs if low <= p <= high}
    assert kept == expected
    report = {r.cat: r for r in trim_report(df, 10, 90, ["cat"]).collect()}
    assert sum(r.kept for r in report.values()) == len(expected)
    assert report["none"].items == 1 and report["none"].kept == 0
    assert trim_report(df, 10, 90).first().items == len(rows)


def test_trim_by_rank_equals_brute_force(skewed):
    rows, df = skewed
    kept = {r.item_id for r in trim_by_rank(df, 10, 90, ["cat"]).collect()}
    expected = set()
    for pairs in groups(rows).values():
        pairs = sorted(pairs)
        low = math.floor(0.1 * (len(pairs) + 1.0))
        high = math.floor(0.9 * (len(pairs) + 1.0))
        if len(pairs) == 1 or low <= 0 or high <= 0:
            expected |= {i for _, i in pairs}
        else:
            expected |= {i for k, (_, i) in enumerate(pairs) if low <= k <= high}
    assert kept == expected


def test_global_trim_by_rank(skewed):
    rows, df = skewed
    pairs = sorted((p, i) for _, i, p in ((c, i, p) for i, c, p in rows) if p is not None)
    low, high = math.floor(0.02 * (len(pairs) + 1.0)), math.floor(0.98 * (len(pairs) + 1.0))
    kept = {r.item_id for r in trim_by_rank(df, 2, 98).collect()}
    assert kept == {i for _, i in pairs[low : high + 1]}


def test_value_bucket_is_monotone(spark):
    values = sorted(random.Random(1).uniform(-1e6, 1e9) for _ in range(2000)) + [1e9, 1e12]
    values = sorted([*values, 0.0, -0.0, 5e-324, -5e-324, 1e-300, 1e-9])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[0] for r in df.orderBy("v").select(ranks.value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_band_excludes_its_ends(spark):
    df = spark.createDataFrame([(p,) for p in (None, 1.0, 1.01, 999998.9, 999999.0)], "price double")
    assert [r.price for r in outlier_band(df).collect()] == [1.01, 999998.9]


def test_infinite_prices_are_smallest_and_largest(spark):
    inf = float("inf")
    rows = [(i, "a", p) for i, p in enumerate([-inf, *map(float, range(1, 9)), inf])] + [(20, "b", inf), (21, "b", inf)]
    df = spark.createDataFrame(rows, "item_id bigint, cat string, price double")
    found = {r.cat: r for r in percentiles(df, [10, 50, 90], ["cat"]).collect()}
    assert (found["a"].p10, found["a"].p50, found["a"].p90) == (-inf, 4.5, inf)
    assert (found["b"].p10, found["b"].p50, found["b"].p90) == (inf, inf, inf)
    assert sorted(r.item_id for r in trim_by_percentile(df, 20, 90, ["cat"]).collect()) == [2, 3, 4, 5, 6, 7, 8, 9, 20, 21]


@pytest.mark.parametrize("max_rows", [1, 20, 10_000])
def test_texts_at_ranks(spark, max_rows):
    """Texts with long shared starts, ended texts, zero bytes and characters of several bytes."""
    rng = random.Random(11)
    texts = ["", "\0", "a", "a\0", "a\0\0", "é", "\U0001f600"]
    texts += [f"LISTING-{rng.randint(0, 3000):06d}" for _ in range(400)] + ["LISTING-000007"] * 50
    df = spark.createDataFrame([(t,) for t in texts], "id string").repartition(3)
    ordered = sorted(texts, key=lambda t: t.encode())
    wanted = [1, 2, 3, 4, 5, 6, 50, 200, len(texts) - 1, len(texts)]
    row = ranks.values_at_ranks(df, [], "id", {f"r{k}": F.lit(k) for k in wanted}, max_rows).first()
    for k in wanted:
        assert row[f"r{k}"] == ordered[k - 1]
        assert row[f"r{k}_below"] == ordered.index(ordered[k - 1])


def test_trim_by_rank_with_text_ids(spark):
    rows = [(f"MLA{i:05d}", "c" if i % 3 else None, float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id string, cat string, price double")
    kept = {r.item_id for r in trim_by_rank(df, 10, 90, ["cat"]).collect()}
    expected = set()
    for cat in ("c", None):
        own = sorted((p, i) for i, c, p in rows if c == cat)
        low, high = (math.floor(t / 100.0 * (len(own) + 1.0)) for t in (10, 90))
        expected |= {i for _, i in own[low : high + 1]}
    assert kept == expected


def test_null_groups_are_groups(spark):
    rows = [(i, None if i % 2 else "c", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "item_id bigint, cat string, price double")
    assert {r.cat: r.n for r in percentiles(df, [10], ["cat"]).collect()} == {None: 50, "c": 50}
    kept = trim_by_percentile(df, 10, 90, ["cat"]).groupBy("cat").count()
    report = {r.cat: (r.items, r.kept) for r in trim_report(df, 10, 90, ["cat"]).collect()}
    assert report == {r.cat: (50, r["count"]) for r in kept.collect()}
