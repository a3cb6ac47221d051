"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

The turns of a conversation lie side by side in blocks of BLOCK turn-id columns. ``GROUP BY block, prior node,
ROLLUP(turn 1, ..., turn BLOCK)`` aggregates all prefixes of a block together, and ``grouping`` tells their depth. A
longer conversation goes on in further blocks, keyed by the node in which the block before ended. A node's key is the
exclusive or of two 64-bit hashes of each (position, turn id) on its path, so the key of a block's prior node comes from a
running total over the blocks and needs no walk down the trie.

Sums over subtrees need no walk either. The node's owner is its smallest conversation; a conversation owns a
suffix of its path. If s(c) is the number of bytes on the part of c's path that c does not own, then the bytes saved in the
subtree of a node v are the sum of ``s(c) - bytes above v`` over v's members but its owner, and the leaves below v are
the members that own a leaf. Both are plain sums over members, so a second ROLLUP gives them for all nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrina.operators.lookup import lookup_join
from vitrina.operators.positions import group_positions
from vitrina.session import materialize

BLOCK = 8  # turns, and so sets of key columns, of a block
SPAN = 1024  # blocks under one running total; longer conversations add the totals of their spans
SEGMENT_BYTES = 1 << 16  # of a joined list of ids


def _signed(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, -10).cast("long")


def numbered_turns(df: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, bytes``: position, 128-bit id and UTF-8 bytes of the text of every turn.

    Turns are ordered by turn, nulls first; turns that tie follow the MD5 of their role and text. Null roles and texts are
    empty. Rows without a conv_id belong to no conversation and take no part. Repeated rows are repeated turns.
    Texts are not shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return group_positions(turns, ["conv_id"], ["turn", "said"], "pos").select(
        "conv_id", "pos", _signed(F.substring("said", 1, 16)).alias("a"), _signed(F.substring("said", 17, 16)).alias("b"), "bytes"
    )


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, n`` of all conversations that have a turn."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def graft_heads(turns: DataFrame, every: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns and all conversation ids: conversation c takes the first h original turns of
    conversation ``c - c % every`` (all if fewer, none if absent) and then its own after its first h, where
    h is ``crc32(decimal c) % longest``. A conversation may end up without a turn.

    A head has fewer than ``longest`` turns, so it travels as a short list.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % longest
    convs = materialize(conversations_of(turns), "conversations")
    heads = turns.where(F.col("pos") < longest - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("head"))
    heads = heads.withColumnRenamed("conv_id", "base")
    with_base = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    grafted = with_base.join(heads, "base", "left").select(
        "conv_id", "n", h.alias("h"), F.coalesce(F.slice("head", 1, F.greatest(h, F.lit(1)).cast("int")), F.array().cast("array<struct<pos:long,a:long,b:long,bytes:long>>")).alias("head")
    )
    grafted = grafted.withColumn("head", F.when(F.col("h") > 0, F.col("head")).otherwise(F.slice("head", 1, 0)))
    grafted = materialize(grafted, "heads")
    taken = grafted.select("conv_id", F.explode("head").alias("_t")).select("conv_id", "_t.*")
    shift = grafted.select("conv_id", "n", (F.size("head") - F.col("h")).cast("long").alias("shift"))
    own = lookup_join(turns.where(F.col("pos") >= h), shift, ["conv_id"], frequency="n")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "a", "b", "bytes")
    return taken.unionByName(own), convs.select("conv_id")


def _blocks(turns: DataFrame, convs: DataFrame, block: int, span: int) -> tuple[DataFrame, DataFrame]:
    """Block rows with the key of their prior node, and per conversation its length, bytes and last node."""
    slot = F.col("pos") % block
    ids = turns.withColumn("x", F.xxhash64(F.lit(1), "pos", "a", "b")).withColumn("y", F.xxhash64(F.lit(2), "b", "pos", "a"))
    columns = [F.max(F.when(slot == j, F.col(c))).alias(f"{c}{j}") for j in range(block) for c in ("a", "b", "n")]
    totals = [F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("turns")]
    rows = ids.withColumnRenamed("bytes", "n").groupBy("conv_id", F.floor(F.col("pos") / block).alias("block")).agg(*columns, *totals)
    rows = materialize(rows.withColumn("span", F.floor(F.col("block") / span)), "blocks")

    def running(df: DataFrame, by: list[str], at: str) -> DataFrame:
        before = W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        sums = {"px": F.bit_xor("x"), "py": F.bit_xor("y"), "above": F.sum("bytes")}
        return df.withColumns({c: F.coalesce(s.over(before), F.lit(0).cast("long")) for c, s in sums.items()})

    spans = rows.groupBy("conv_id", "span").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes"), F.sum("turns").alias("turns"))
    spans = materialize(spans, "spans")
    starts = running(spans, ["conv_id"], "span").where("span > 0")
    starts = materialize(starts.select("conv_id", "span", F.col("px").alias("sx"), F.col("py").alias("sy"), F.col("above").alias("sb")), "span-starts")
    inside = lookup_join(running(rows, ["conv_id", "span"], "block"), starts, ["conv_id", "span"], how="left", salt_on=["block"])
    zero = F.lit(0).cast("long")
    keyed = inside.withColumns({
        "px": F.col("px").bitwiseXOR(F.coalesce("sx", zero)), "py": F.col("py").bitwiseXOR(F.coalesce("sy", zero)),
        "above": F.col("above") + F.coalesce("sb", zero),
    })
    whole = spans.groupBy("conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes"), F.sum("turns").alias("turns"))
    last = ["x", "y", "bytes", "turns"]
    whole = convs.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in last])
    whole = materialize(whole, "whole")
    slots = [f"{c}{j}" for j in range(block) for c in ("a", "b", "n")]
    turnless = whole.where("turns = 0").select("conv_id", zero.alias("block"), *[F.lit(None).cast("long").alias(c) for c in slots], *[zero.alias(c) for c in ("px", "py", "above")])
    return keyed.select(*turnless.columns).unionByName(turnless), whole


def _rollup(rows: DataFrame, measures: str, block: int) -> DataFrame:
    """All nodes: keys of the node and of its parent, depth, bytes of the last text and above it, and ``measures``.

    ROLLUP gives each prefix of a block one group. Groups that end in an absent turn are no nodes, and the empty
    prefix of a later block is the last node of the block before.
    """
    turns = ", ".join(f"(a{j}, b{j}, n{j})" for j in range(block))
    level = " + ".join(f"(1 - grouping(a{j}))" for j in range(block))
    real = " AND ".join(f"(grouping(a{j}) = 1 OR a{j} IS NOT NULL)" for j in range(block))
    keys = ", ".join(f"a{j}, b{j}, n{j}" for j in range(block))
    groups = rows.sparkSession.sql(
        f"SELECT block, px, py, above, {keys}, CAST({level} AS INT) AS level, {measures} FROM {{rows}} "
        f"GROUP BY block, px, py, above, ROLLUP({turns}) HAVING {real} AND (block = 0 OR {level} > 0)",
        rows=rows,
    )
    at = [F.col("block") * block + j for j in range(block)]

    def key(prior: str, *parts) -> Column:
        value = F.col(prior)
        for part in parts:
            value = value.bitwiseXOR(part)
        return value

    zero = F.lit(0).cast("long")
    x = [F.when(F.col("level") > j, F.xxhash64(F.lit(1), at[j], f"a{j}", f"b{j}")).otherwise(zero) for j in range(block)]
    y = [F.when(F.col("level") > j, F.xxhash64(F.lit(2), f"b{j}", at[j], f"a{j}")).otherwise(zero) for j in range(block)]

    def but_last(parts: list[Column]) -> list[Column]:
        return [F.when(F.col("level") > j + 1, p).otherwise(zero) for j, p in enumerate(parts)]

    nothing = F.lit(None).cast("long")
    own = F.coalesce(*[F.when(F.col("level") == j + 1, F.col(f"n{j}")) for j in range(block)], zero)
    top = F.col("level") == 0
    sizes = [F.coalesce(f"n{j}", zero) for j in range(block)]
    inner = {"block", "px", "py", "above", "level", *keys.split(", ")}
    return groups.select(
        key("px", *x).alias("x"), key("py", *y).alias("y"),
        F.when(top, nothing).otherwise(key("px", *but_last(x))).alias("parent_x"),
        F.when(top, nothing).otherwise(key("py", *but_last(y))).alias("parent_y"),
        (F.col("block") * block + F.col("level")).alias("depth"), own.alias("bytes"),
        (F.col("above") + sum(sizes[1:], sizes[0]) - own).alias("above"),
        *[c for c in groups.columns if c not in inner],
    )


ENDS = "x long, y long, ends_sha256 string"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, conv_id) rows become joined runs of ids of one node, in parts of bounded length."""
    names = ["x", "y", "first", "ids"]
    node, first, parts, size = None, 0, [], 0
    out: list[tuple] = []
    for batch in batches:
        for x, y, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if node != (x, y) or size > SEGMENT_BYTES:
                if parts:
                    out.append((*node, first, ",".join(parts)))
                node, first, parts, size = (x, y), c, [], 0
            parts.append(str(c))
            size += len(parts[-1]) + 1
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out) if out else [[]] * 4, strict=True)), schema=_SEGMENT)
        out = []
    if parts:
        out.append((*node, first, ",".join(parts)))
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out), strict=True)), schema=_SEGMENT)


_SEGMENT = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGEST = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments of one node after the other; only the state of a hash is kept."""
    node, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for x, y, _, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if node != (x, y):
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = (x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict(dict(zip(_DIGEST.names, zip(*out) if out else [[]] * 3, strict=True)), schema=_DIGEST)
        out = []
    if state:
        yield pa.RecordBatch.from_pydict({"x": [node[0]], "y": [node[1]], "ends_sha256": [state.hexdigest()]}, schema=_DIGEST)


def end_digests(whole: DataFrame) -> DataFrame:
    """``x, y, ends_sha256``: SHA-256 of the ascending, comma-joined ids of the conversations that end at a node.

    Ids are sorted over ranges, so a node where a third of all conversations end is sorted and joined by many tasks; one
    task then only streams its segments through the hash.
    """
    order = ["x", "y", "conv_id"]
    ranges = whole.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = ranges.mapInArrow(_segments, "x long, y long, first long, ids string")
    return segments.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(_digests, ENDS)


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row per node of the trie of all conversations, the textless root included.

    ``turns`` has conv_id, pos (0, 1, ... in each conversation), a, b (the turn's id) and bytes; ``convs`` lists all
    conv_ids, also of conversations without a turn, which are members of the root only. Returns conv_id (the smallest
    member), depth, parent_conv_id (root: null), n_convs (members), n_children, n_leaves (childless nodes in the subtree, the
    node included), saved_tokens (sum over the subtree of ``(n_convs - 1) * bytes of the last text``) and ends_sha256
    (of the ids of members that end here; of the empty string if none does). No conversations: no rows.
    """
    rows, whole = _blocks(turns, convs, block, span)
    lengths = lookup_join(rows, whole.select("conv_id", "turns", (F.col("turns") + 1).alias("_size")), ["conv_id"], frequency="_size")
    lengths = materialize(lengths, "block-rows")
    found = _rollup(lengths, "min(conv_id) AS conv_id, max(turns) AS longest", block)
    owned = found.groupBy("conv_id").agg(
        F.min_by("above", "depth").alias("shared"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf")
    )
    about = whole.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "bytes").alias("shared"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"), (F.col("turns") + 1).alias("_size")
    )
    members = lookup_join(lengths.drop("turns"), materialize(about, "owners"), ["conv_id"], frequency="_size")
    measures = "min(conv_id) AS conv_id, count(1) AS n_convs, sum(leaf) AS n_leaves, sum(shared) AS _shared, min_by(shared, conv_id) AS _owner"
    nodes = _rollup(members, measures, block)
    saved = F.col("_shared") - F.col("_owner") - (F.col("n_convs") - 1) * F.col("above")
    nodes = nodes.select("x", "y", "parent_x", "parent_y", "depth", "conv_id", "n_convs", "n_leaves", saved.alias("saved_tokens"))
    nodes = materialize(nodes, "nodes")

    kids = nodes.where("parent_x is not null").groupBy(F.col("parent_x").alias("x"), F.col("parent_y").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = end_digests(whole)
    nodes = nodes.join(kids, ["x", "y"], "left").join(ends, ["x", "y"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
    })
    nodes = materialize(nodes, "trie")
    parents = nodes.where("n_children > 0").select(
        F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_size")
    )
    return lookup_join(nodes, parents, ["parent_x", "parent_y"], how="left", frequency="_size").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
