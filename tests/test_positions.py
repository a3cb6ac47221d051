import random

import pytest

from vitrina.operators.positions import at_positions, between_positions, dense_positions, group_positions


@pytest.mark.parametrize("partitions", [None, 1, 13])
def test_positions_equal_a_sort(spark, partitions):
    """One price holds a third of the rows; ties follow the id, nulls come first."""
    rng = random.Random(6)
    rows = [(i, None if i % 50 == 0 else 5.0 if i % 3 == 0 else rng.choice([1.0, 2.5, 9.0, float("inf")])) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "item_id long, price double")
    placed = dense_positions(df, ["price", "item_id"], partitions=partitions)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    found = {r.position: (r.item_id, r.price) for r in placed.collect()}
    assert [found[i] for i in range(2000)] == want
    assert sorted(r.item_id for r in at_positions(placed, [0, 7, 1999, 2000]).collect()) == sorted(want[i][0] for i in (0, 7, 1999))
    assert between_positions(placed, 10, 19).count() == 10


def test_group_positions(spark):
    df = spark.createDataFrame([(i % 4 if i < 100 else 9, 400 - i) for i in range(400)], "g long, v long")
    found = {(r.g, r.position): r.v for r in group_positions(df, ["g"], ["v"]).collect()}
    for g in (0, 1, 2, 3, 9):
        values = sorted(400 - i for i in range(400) if (i % 4 if i < 100 else 9) == g)
        assert [found[g, k] for k in range(len(values))] == values
    assert not dense_positions(df.limit(0), ["v"]).take(1)
