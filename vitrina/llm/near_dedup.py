"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of word shingles with a minwise signature. Documents with equal sets are one vertex. A
chosen-path tree branches every vertex by a few selected minwise positions: vertices that agree at a
chosen position meet in a child node. Nodes that are small are compared exhaustively, larger ones are cut into overlapping bands of
like set sizes first, and what is still large branches again by positions that the node's own path selects, in so many independent trees that two sets at the threshold miss
each other with the wanted probability only; what is still large at the end is compared exhaustively as well. Large nodes whose members
agree so much that all trees would compare more pairs than there are, are compared exhaustively at once.

Groups of copies never cost all their pairs. A first pass pairs the members of a node with one pivot only,
the one whose sketch has the node's most frequent values (of a family of copies, the original). Confirmed links are joined to
components; afterwards only pairs of different components are looked for. Members of a node of many tiles first try their
likeliest links only, and what these join is one component as well, before all pairs that are left are looked for. Jaccard distance is a
metric, so a vertex that may link with a neighbour of the pivot is itself at half the similarity or more to the pivot: only
such vertices are compared with the pivot's component, and those without a link to the pivot among themselves.
Sketches only suggest pairs: every link is confirmed on the full shingle sets. Pairs that a tile suggests stay together, so
that a set is sent once per tile and not once per pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from vitrina.llm.components import components
from vitrina.llm.words import find_words, join_hashes, mix, small_batches, word_hashes
from vitrina.operators.lookup import lookup_join
from vitrina.session import discard, materialize

SHINGLE = 5
BATCH_BYTES = 1 << 20  # of text whose shingles are held at once
THRESHOLD = 75  # per cent
POSITIONS = 256  # minwise positions of a sketch, of a byte each
MISS = 1e-6  # of two sets at the threshold; a quarter each at the roots, in the trees below a node, by their sketches and by a pivot's
SMALL = 4096  # members up to which a node is compared exhaustively, in tiles
TILE = 128  # members on a side of a tile
PROBE = 1024  # members of a node among which each one looks for its likeliest links first
PROBES = 2  # likeliest links of a member
CONFIRM = 1 << 18  # shingles of the sets that are confirmed together, but for two sets that have more
DEPTH = 4
BRANCHES = 1.6  # expected children of a node: over 4/3, so that paths of linked sets outnumber those cut
DENSITY = 8  # positions of a sketch by which a pivot is chosen
RING = 2 * THRESHOLD - 100  # per cent: least similarity to a pivot of what links with a neighbour of the pivot
_NODE = ["node", "digest", "inner", "label", "n"]
CLASS = 1.34  # sizes of a class are within this factor, over 100 / THRESHOLD: linked sets are of one class or of neighbouring ones
BROADCAST_IDS = 500_000  # wanted documents up to which their ids are broadcast

ROOTS = math.ceil(math.log(MISS / 4) / math.log(1 - THRESHOLD / 100))  # positions at which the roots of all trees branch


def tree_survival(agreement: float, depth: int = DEPTH) -> float:
    """Chance that two members of a node with this agreement of sketches meet ``depth`` levels below it, in one tree."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - (1 - agreement * meet) * (1 - (BRANCHES - 1) * agreement * meet)
    return meet


def agreements(share: float) -> list[float]:
    """Chance of each number of agreeing positions of two sketches whose sets have this similarity."""
    return [math.comb(POSITIONS, k) * share**k * (1 - share) ** (POSITIONS - k) for k in range(POSITIONS + 1)]


def tree_miss(trees: int) -> float:
    """Chance that two sets at the threshold, both in a large node, meet at the end of none of its trees, which share the sketches."""
    return sum(x * (1 - tree_survival(k / POSITIONS)) ** trees for k, x in enumerate(agreements(THRESHOLD / 100)))


TREES = next(n for n in range(1, 1000) if tree_miss(n) <= MISS / 4)  # independent trees below a large node
DENSE = TREES ** (-1 / DEPTH) / BRANCHES  # mean agreement in a node from which its trees hold more pairs than itself

_PRINT = "doc_id long, n_shingles long, digest binary, roots binary, sketch binary"
_SEEDS = mix(np.arange(1, ROOTS + POSITIONS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts shorter than a shingle are one of their own."""
    words = find_words(texts)
    hashes, first = word_hashes(words), words.texts
    rolled = join_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            run = np.sort(rolled[a : b - SHINGLE + 1])
            out.append(run[np.append(True, run[1:] != run[:-1])])
        else:
            out.append(join_hashes(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _minwise(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes at the roots (set x ROOTS) and sketches (set x POSITIONS, a byte each); no set is empty."""
    every = np.concatenate(sets)
    firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        out[:, k] = np.minimum.reduceat((every ^ (seed >> np.uint64(7))) * seed, firsts)
    out = mix(out)
    nodes = mix(out[:, :ROOTS] + np.arange(1, ROOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return nodes, (out[:, ROOTS:] & np.uint64(255)).astype(np.uint8)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, most=BATCH_BYTES):
        sets = shingle_sets(batch.column("text"))
        some = [i for i, s in enumerate(sets) if len(s)]
        digests, roots, sketches = ([None] * len(sets) for _ in range(3))
        for at in range(0, len(some), 256):
            rows = some[at : at + 256]
            for i, root, sketch in zip(rows, *_minwise([sets[i] for i in rows]), strict=True):
                digests[i], roots[i], sketches[i] = _digest(sets[i]), root.tobytes(), sketch.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, roots, sketches)]],
            names=["doc_id", "n_shingles", "digest", "roots", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, most=BATCH_BYTES):
        sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["digest", "shingles"],
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vertex and root node."""
    for batch in batches:
        nodes = np.frombuffer(b"".join(batch.column("roots").to_pylist()), np.int64).reshape(-1, ROOTS)
        for k in range(ROOTS):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[:, k]), batch.column("digest"), batch.column("n")], names=["node", "digest", "n"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of agreeing positions of each member's sketch and its pivot's."""
    for batch in batches:
        share = (_sketches(batch.column("s")) == _sketches(batch.column("sketch"))).mean(axis=1)
        kept = [c for c in batch.schema.names if c not in ("s", "sketch")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(share)], names=[*kept, "share"])


def _pivots(nodes: DataFrame) -> DataFrame:
    """Per node the member whose sketch has the most frequent values, by DENSITY positions."""
    values = nodes.select("node", "digest", *[F.substring("sketch", 1 + k * POSITIONS // DENSITY, 1).alias(f"s{k}") for k in range(DENSITY)])
    entries = values.select("node", "digest", F.posexplode(F.array(*[f"s{k}" for k in range(DENSITY)])).alias("k", "value"))
    counts = entries.groupBy("node", "k", "value").agg(F.count(F.lit(1)).alias("n"))
    score = entries.join(counts, ["node", "k", "value"]).groupBy("node", "digest").agg(F.sum("n").alias("score"))
    return score.groupBy("node").agg(F.max(F.struct("score", "digest")).alias("best")).select("node", F.col("best.digest").alias("pivot"))


def _children(trees: int):
    """Members of large nodes with each child node that the node's path selects, in so many trees that begin there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("node").to_numpy().view(np.uint64)
            sketch = _sketches(batch.column("sketch"))
            for tree in range(trees):
                nodes = mix(own + np.uint64(tree) * np.uint64(0x0A942042E4DD58B5)) if tree else own
                pick = mix(nodes + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(8)
                step = mix(pick) % np.uint64(POSITIONS - 1) + np.uint64(1)
                second = (mix(step + nodes) >> np.uint64(11)) * 2.0**-53 < BRANCHES - 1
                for branch, some in ((0, np.arange(len(nodes))), (1, np.flatnonzero(second))):
                    at = ((pick + step * np.uint64(branch)) % np.uint64(POSITIONS)).astype(np.int64)[some]
                    child = mix(mix(nodes[some]) + sketch[some, at].astype(np.uint64) * np.uint64(2) + np.uint64(branch + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *[batch.column(c).take(pa.array(some)) for c in _NODE[1:]]], names=_NODE)

    return run


def _dense_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose trees would compare more pairs than the node has, by DENSITY positions."""
    values = [F.substring("sketch", 1 + k * POSITIONS // DENSITY, 1) for k in range(DENSITY)]
    entries = nodes.select("node", "size", F.posexplode(F.array(*values)).alias("k", "value"))
    counts = entries.groupBy("node", "size", "k", "value").agg(F.count(F.lit(1)).alias("n"))
    share = F.sum(F.col("n").cast("double") * F.col("n")) / (DENSITY * F.first("size").cast("double") * F.first("size"))
    return counts.groupBy("node").agg(share.alias("share")).where(F.col("share") >= DENSE).select("node")


def _cut(pairs: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``pairs`` (rows of two members) in parts whose members have ``most`` shingles together at most, or of one pair."""
    if len(pairs) == 1 or sizes[np.unique(pairs)].sum() <= most:
        yield pairs
        return
    side = int(len(np.unique(pairs[:, 1])) > len(np.unique(pairs[:, 0])))
    order = np.argsort(pairs[:, side], kind="stable")
    yield from _cut(pairs[order[: len(order) // 2]], sizes, most)
    yield from _cut(pairs[order[len(order) // 2 :]], sizes, most)


_TILE = "digests array<binary>, pairs binary"


def _suggest(least: float, most: int):
    """Pairs of different components that agree in enough positions, of two chunks of a node; around a pivot only those of
    its component as it was first (inner) with others. A row holds the members of such pairs, sorted, and the pairs as
    positions among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, rows = [], []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                own = left.values
                other = own if not right.is_valid else right.values
                x, y = (_sketches(side.field("sketch")) for side in (own, other))
                near = np.stack([(y == row).mean(axis=1) for row in x]) >= least
                m, n = (side.field("n").to_numpy() for side in (own, other))
                near &= 100 * np.minimum.outer(m, n) >= THRESHOLD * np.maximum.outer(m, n)
                if own is other:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                p, q = (side.field("label").to_pylist() for side in (own, other))
                e, f = (side.field("inner").to_pylist() for side in (own, other))  # around a pivot only, else null
                wanted = [(k, m) for k, m in zip(i, j, strict=True) if p[k] != q[m] and (e[k] is None or e[k] != f[m])]
                if not wanted:
                    continue
                digests = [*own.field("digest").to_pylist(), *other.field("digest").to_pylist()]
                for part in _cut(np.array(wanted) + [0, len(own)], np.concatenate([m, n]), most):
                    members = sorted({digests[k] for k in part.ravel()})
                    at = {digest: k for k, digest in enumerate(members)}
                    tiles.append(members)
                    found = sorted(sorted((at[digests[k]], at[digests[m]])) for k, m in part)
                    rows.append(np.array(found, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.list_(pa.binary())), pa.array(rows, pa.binary())], names=["digests", "pairs"])

    return run


def _likeliest(least: float):
    """For each member of a chunk the pairs that ``_suggest`` would find in it with the best agreement, PROBES at most;
    around a pivot for members outside its component only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for chunk in batch.column("members"):
                own = chunk.values
                x, n = _sketches(own.field("sketch")), own.field("n").to_numpy()
                digests, inner = own.field("digest").to_pylist(), own.field("inner").to_pylist()
                _, label = np.unique(np.array([x.hex() for x in own.field("label").to_pylist()]), return_inverse=True)
                core = np.array([bool(i) for i in inner])
                for i in np.flatnonzero(~core):
                    may = (label != label[i]) & (100 * np.minimum(n, n[i]) >= THRESHOLD * np.maximum(n, n[i]))
                    at = np.flatnonzero(may if inner[i] is None else may & core)
                    share = (x[at] == x[i]).mean(axis=1)
                    for k in np.argsort(-share, kind="stable")[:PROBES]:
                        if share[k] >= least:
                            one, two = sorted((digests[i], digests[at[k]]))
                            a.append(one)
                            b.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _probes(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Likeliest links (a, b) in nodes of more than a tile, which are cut into chunks by chance."""
    large = members.where(F.col("size") > TILE)
    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("size") / PROBE))
    entry = F.struct("digest", "inner", "label", "n", "sketch")
    chunks = large.join(sketches, "digest").groupBy("node", part.alias("part")).agg(F.collect_list(entry).alias("members"))
    return chunks.select("members").mapInArrow(_likeliest(least_agreement()), "a binary, b binary").distinct()


def _size_class() -> Column:
    return F.floor(F.log("n") / math.log(CLASS))


def _bands(members: DataFrame) -> DataFrame:
    """Members of each node by bands of two neighbouring classes of size: any two sets that link share a band."""
    band = F.explode(F.array(_size_class(), _size_class() - 1))
    rows = members.withColumn("band", band)
    return rows.select(F.xxhash64(F.lit("band"), "node", "band").alias("node"), *_NODE[1:])


def _tiles(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Every two chunks of a node whose sets are of one class of size or of neighbouring ones, and every chunk with itself
    (right is null). A node that fits a tile is one chunk."""
    cut = members.withColumn("class", F.when(F.col("size") <= TILE, F.lit(0).cast("long")).otherwise(_size_class()))
    parts = cut.groupBy("node", "class").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    following = parts.select("node", (F.col("class") - 1).alias("class"), F.col("parts").alias("more"))
    cut = cut.join(parts, ["node", "class"]).withColumn("part", F.pmod(F.xxhash64("digest"), "parts"))
    entry = F.struct("digest", "inner", "label", "n", "sketch")
    chunks = cut.join(sketches, "digest").groupBy("node", "class", "parts", "part").agg(F.collect_list(entry).alias("members"))
    chunks = materialize(chunks, "chunks")
    same = F.transform(F.sequence("part", F.col("parts") - 1), lambda x: F.struct(F.col("class").alias("class"), x.alias("part")))
    above = F.when(F.col("more").isNull(), F.expr("array_remove(array(0L), 0L)")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("more") - 1))
    others = F.concat(same, F.transform(above, lambda x: F.struct((F.col("class") + 1).alias("class"), x.alias("part"))))
    left = chunks.join(following, ["node", "class"], "left").select(
        "node", F.col("members").alias("left"), F.col("class").alias("own_class"), F.col("part").alias("own_part"), F.explode(others).alias("other")
    )
    left = left.select("node", "left", "other.class", "other.part", F.expr("other.class = own_class and other.part = own_part").alias("own"))
    own = left.where("own").select("left", F.lit(None).cast(left.schema["left"].dataType).alias("right"))
    right = chunks.select("node", "class", "part", F.col("members").alias("right"))
    return own.unionByName(left.where("not own").join(right, ["node", "class", "part"]).select("left", "right"))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
        keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _confirm_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the pairs of each tile, whose members come with their full sets."""
    for batch in batches:
        u, v = [], []
        for entries, pairs in zip(batch.column("members"), batch.column("pairs"), strict=True):
            members = entries.values
            order = np.argsort(members.field("at").to_numpy())
            digests, shingles = members.field("digest"), members.field("shingles")
            sets = [np.frombuffer(shingles[int(k)].as_buffer(), np.uint64) for k in order]
            for a, b in np.frombuffer(pairs.as_buffer(), np.int32).reshape(-1, 2):
                if _linked(sets[a], sets[b]):
                    u.append(digests[int(order[a])].as_py())
                    v.append(digests[int(order[b])].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def least_agreement(share: float = THRESHOLD / 100) -> float:
    """Agreement of two sketches that sets as alike as ``share`` fall below with a quarter of MISS at most."""
    below = 0.0
    for k, x in enumerate(agreements(share)):
        below += x
        if below > MISS / 4:
            return k / POSITIONS
    return 1.0


class _Join:
    """Vertices of one corpus and the steps that need its texts."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        wide = materialize(self.docs.mapInArrow(_prints, _PRINT), "wide")
        self.vertices = materialize(
            wide.where("digest is not null")
            .groupBy("digest")
            .agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")),
            "vertices",
        )
        self.prints = materialize(wide.select("doc_id", "n_shingles", "digest"), "prints")
        discard(wide)

    def _full_sets(self, wanted: DataFrame) -> DataFrame:
        """The full sets (digest, shingles) of the ``wanted`` digests, written."""
        wanted_ids = materialize(wanted.join(self.vertices.select("digest", "doc"), "digest"), "wanted")
        few = wanted_ids.count() <= BROADCAST_IDS
        ids, wanted = wanted_ids.select("doc"), wanted_ids.select("digest")
        texts = self.docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
        sets = materialize(texts.mapInArrow(_sets, "digest binary, shingles binary").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles")), "sets")
        discard(wanted_ids)
        return sets

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links (u, v) among ``pairs`` (a, b), by the full sets of the documents that occur in them."""
        pairs = materialize(pairs, "pairs")
        sets = self._full_sets(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct())
        left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
        rows = pairs.join(left, "a").join(right, "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y")
        links = materialize(rows.mapInArrow(_confirm, "u binary, v binary"), "confirmed")
        discard(pairs, sets)
        return links

    def confirmed_tiles(self, tiles: DataFrame) -> DataFrame:
        """Links (u, v) among the pairs of ``tiles`` (digests, pairs). A member's set is joined once per tile, so rows grow with
        the members of tiles and not with their pairs."""
        tiles = materialize(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
        entries = tiles.select("tile", F.posexplode("digests").alias("at", "digest"))
        sets = self._full_sets(entries.select("digest").distinct())
        members = entries.join(sets, "digest").groupBy("tile").agg(F.collect_list(F.struct("at", "digest", "shingles")).alias("members"))
        rows = members.join(tiles.select("tile", "pairs"), "tile").select("members", "pairs")
        links = materialize(rows.mapInArrow(_confirm_tiles, "u binary, v binary").distinct(), "confirmed")
        discard(tiles, sets)
        return links


def _near(nodes: DataFrame, pivots: DataFrame) -> DataFrame:
    """Members (digest) of each node with their agreement with its pivot, if at half the similarity of a link or more."""
    own = nodes.join(pivots, "node").where("digest = pivot").select("node", "pivot", F.col("sketch").alias("s"), F.col("n").alias("m"))
    low, high = F.least("n", "m"), F.greatest("n", "m")
    rows = nodes.join(own, "node").where((F.col("digest") != F.col("pivot")) & (100 * low >= RING * high))
    rows = rows.select("node", "pivot", "digest", (100 * low >= THRESHOLD * high).alias("sized"), "sketch", "s")
    schema = "node long, pivot binary, digest binary, sized boolean, share double"
    return rows.mapInArrow(_agreement, schema).where(F.col("share") >= least_agreement(RING / 100))


def _open_nodes(members: DataFrame) -> DataFrame:
    """Nodes whose members are not all of one component."""
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return sizes.where("low <> high").select("node", "size")


def _contracted(members: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Members under the label of the largest component among their component and those that ``links`` (u, v) join it with.

    Components of one label are all linked with that component, so this joins nothing that is not linked; what it leaves
    apart is looked for among all pairs.
    """
    for end in ("u", "v"):
        now = labels.select(F.col("digest").alias(end), F.col("now").alias(f"{end}_now"))
        links = links.join(now, end, "left").withColumn(f"{end}_now", F.coalesce(f"{end}_now", end))
    ends = links.where("u_now <> v_now").select(F.col("u_now").alias("label"), F.col("v_now").alias("other"))
    both = materialize(ends.unionByName(ends.select(F.col("other").alias("label"), F.col("label").alias("other"))).distinct(), "meeting")
    sizes = materialize(labels.groupBy("now").agg(F.count(F.lit(1)).alias("n")), "component-sizes")
    met = lookup_join(both, sizes.withColumnRenamed("now", "other"), ["other"], "left", salt_on=["label"])
    best = met.groupBy("label").agg(F.max(F.struct(F.coalesce("n", F.lit(1)).alias("m"), F.col("other").alias("to"))).alias("best"))
    own = lookup_join(best.select("label", "best.*"), sizes.withColumnRenamed("now", "label"), ["label"], "left")
    own = own.withColumn("n", F.coalesce("n", F.lit(1)))
    moved = materialize(own.where("m > n or m = n and to > label").select("label", "to"), "moved")
    named = lookup_join(members, moved, ["label"], "left", salt_on=["digest"])
    return named.withColumn("label", F.coalesce("to", "label")).select(*_NODE)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when ``100 * intersection >= 75 * union`` of their distinct 5-word shingles (A-Z lower-cased, words
    between ASCII white space); a text of fewer words is one shingle; null texts and texts without words link with nothing.
    component_id is the smallest doc_id reachable, kept tells whether it is the row's own. Rows with a
    null doc_id link too; a component of such rows only has a null id and they are kept. Rows that repeat a doc_id are answered each. Other columns are ignored.
    """
    join = _Join(docs)
    members = join.vertices.mapInArrow(_members, "node long, digest binary, n long")
    several = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = members.join(several.select("node"), "node").join(join.vertices.select("digest", "sketch"), "digest")
    met = materialize(met.select("node", "digest", "sketch", "n"), "members")
    pivots = materialize(_pivots(met), "pivots")
    near = materialize(_near(met, pivots), "near")
    enough = near.where(F.col("sized") & (F.col("share") >= least_agreement()))
    links = join.confirmed(enough.select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct())
    labels = components(links).select(F.col("vertex").alias("digest"), F.col("label").alias("now"))

    # what is left of each node without the pivot's neighbours, and these with those around them
    star = links.select(F.col("u").alias("pivot"), F.col("v").alias("digest"))
    rest = met.select("node", "digest").join(pivots, "node").where("digest <> pivot").join(star, ["pivot", "digest"], "left_anti")
    around = near.select("pivot", "digest").unionByName(pivots.select("pivot", F.col("pivot").alias("digest"))).distinct()
    cores = labels.select(F.col("digest").alias("pivot"), F.col("now").alias("core"))  # nothing links with a neighbour of a pivot that has none
    hubs = around.join(cores, "pivot").select(F.xxhash64(F.lit("hub"), "pivot").alias("node"), "digest", "core")
    parted = rest.select("node", "digest", F.lit(None).cast("binary").alias("core")).unionByName(hubs)
    named = parted.join(labels, "digest", "left").withColumn("label", F.coalesce("now", "digest"))
    named = materialize(named.select("node", "digest", (F.col("core") == F.col("label")).alias("inner"), "label"), "parted")
    sketches, sizes = join.vertices.select("digest", "sketch"), join.vertices.select("digest", "n")
    live = materialize(named.join(_open_nodes(named), "node").join(sizes, "digest").select("size", *_NODE), "open")
    discard(met, pivots, near)
    done = live.where(F.col("size") <= SMALL)
    crowded = live.where(F.col("size") > SMALL)
    if crowded.take(1):
        bands = _bands(crowded)
        live = materialize(bands.join(_open_nodes(bands), "node").select("size", *_NODE), "open")
        done = done.unionByName(live.where(F.col("size") <= SMALL))
        crowded = live.where(F.col("size") > SMALL)
        dense = F.broadcast(materialize(_dense_nodes(crowded.join(sketches, "digest")), "dense"))
        done = done.unionByName(crowded.join(dense, "node", "left_semi").select(*done.columns))
        live = crowded.join(dense, "node", "left_anti").select(*done.columns)
    for level in range(DEPTH):
        large = live.where(F.col("size") > SMALL)
        if not large.take(1):
            break
        # a written table is read in pieces of equal size, so members of a crowded node are many tasks' work
        large = materialize(large.join(sketches, "digest"), "large")
        below = large.mapInArrow(_children(1 if level else TREES), "node long, digest binary, inner boolean, label binary, n long")
        below = materialize(below, "children")
        live = materialize(below.join(_open_nodes(below), "node").select("size", *_NODE), "open")
        discard(large, below)
        done = done.unionByName(live.where(F.col("size") <= SMALL))
    else:
        done = done.unionByName(live.where(F.col("size") > SMALL))
    probed = join.confirmed(_probes(done, sketches))
    if probed.take(1):
        named = materialize(_contracted(done.select(*_NODE), labels, probed), "contracted")
        done = named.join(_open_nodes(named), "node").select("size", *_NODE)
    # nodes of the same members have the same tiles
    more_links = join.confirmed_tiles(_tiles(done, sketches).mapInArrow(_suggest(least_agreement(), CONFIRM), _TILE).distinct())

    known = labels.select(F.col("digest").alias("u"), F.col("now").alias("v"))  # stands for the links found before
    final = components(known.unionByName(probed).unionByName(more_links)).withColumnRenamed("vertex", "digest")
    named = join.vertices.select("digest", "doc").join(final, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    ids = named.join(smallest, "label").select("digest", "component_id")
    prints = join.prints.select("doc_id", "n_shingles", "digest")
    linked = prints.where("digest is not null").join(ids, "digest")
    alone = prints.where("digest is null").withColumn("component_id", F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def with_digest(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (text) with a digest of their shingle set as __digest."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([_digest(s) for s in shingle_sets(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, "__digest"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("__digest", BinaryType())]))
