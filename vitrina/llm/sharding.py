"""Sharding by a permutation-filled lookup table.

Shards take turns; each claims the next free slot in its own preference order, until all slots of a
table of prime size are taken. A key's slot is its hash modulo the size, so placing a row is one
look-up in a small broadcast table. When a shard is added or removed, few other keys move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16_381  # prime, over 100 slots per shard for up to 160 shards
MOST_SLOTS = 1_000_003  # what may be broadcast


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _preference(shard: str, slots: int) -> tuple[int, int]:
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for every slot.

    Preferences start at ``offset`` and go on by ``skip``; with a prime size they visit every slot.
    """
    if not is_prime(slots) or not len(shards) < slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime above {len(shards)} and at most {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    at, skip = zip(*(_preference(s, slots) for s in shards), strict=True)
    at = list(at)
    owner = [-1] * slots
    free = slots
    while free:
        for shard, step in enumerate(skip):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text, modulo the size (null: as empty)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots))


def place(
    df: DataFrame,
    key: str,
    shards: Sequence[str],
    slots: int = SLOTS,
    slot_column: str = "slot",
    shard_column: str = "shard",
) -> DataFrame:
    """Every row of ``df`` with its slot and shard; nothing is shuffled.

    Columns named like the two new ones are replaced. Null keys share the slot of the empty text,
    repeated rows get the same shard, an empty table stays empty. The table that is broadcast has
    ``slots`` rows, whatever the size of ``df``.
    """
    table = lookup_table(shards, slots)
    names = F.array(*[F.lit(s) for s in shards])
    owners = df.sparkSession.createDataFrame(
        list(enumerate(table)), "__slot int, __shard int"
    ).select("__slot", names[F.col("__shard")].alias("__name"))
    kept = [c for c in df.columns if c not in (slot_column, shard_column)]
    # the row travels in a struct, so its columns may have any names
    row = F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0)]).alias("__row")
    placed = df.select(row, slot_of(df[key], slots).cast("int").alias("__at"))
    return placed.join(F.broadcast(owners), F.col("__at") == F.col("__slot"), "left").select(
        *[F.col("__row").getField(c).alias(c) for c in kept],
        F.col("__slot").cast("long").alias(slot_column),
        F.col("__name").alias(shard_column),
    )
