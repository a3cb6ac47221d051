"""Exact top-k search by inner product with KD-trees per shard.

Vectors are packed into shards of bounded size, one row each, with a KD-tree built by median splits
and tight bounding boxes. A search is best-first: the bound of a box is the largest ``q*x`` any
point inside could have, and it ends when the best bound left cannot reach the query's k-th score.
The first round searches every query in its own shard. Its k-th score is then propagated to all
other shards, which blocks of queries visit tile by tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import materialize

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF = 512
EXACT = 2**52  # inner products below it are exact in doubles

_SHARD = "shard long, width int, ids binary, vectors binary, boxes binary, tree binary"
_FIRST = "home long, own long, query_id long, width int, query binary, floor long, found array<struct<score:long,vec_id:long>>"
_BLOCK = "block long, width int, homes binary, owns binary, qids binary, queries binary, floors binary"
_FOUND = "home long, own long, query_id long, score long, vec_id long"


class Tree:
    """KD-tree over ``vectors``: node i holds rows nodes[0, i] to nodes[1, i] of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(vectors))
        first, last, left, low, high = [0], [len(vectors)], [-1], [], []
        node = 0
        while node < len(first):
            a, b = first[node], last[node]
            rows = vectors[order[a:b]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            axis = int(np.argmax(high[-1] - low[-1]))
            if b - a > leaf and high[-1][axis] > low[-1][axis]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, axis], half)]
                left[node] = len(first)
                first += [a, a + half]
                last += [a + half, b]
                left += [-1, -1]
            node += 1
        self.order = order
        self.nodes = np.array([first, last, left], np.int64)
        self.boxes = np.stack([np.array(low), np.array(high)])


class Shard:
    """A packed shard, ready for searches."""

    def __init__(self, row: dict):
        width = row["width"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
        self.boxes = np.frombuffer(row["boxes"], np.float64).reshape(2, -1, width)
        self.nodes = np.frombuffer(row["tree"], np.int64).reshape(3, -1)
        self.largest = np.abs(self.boxes).max()

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each node and query, the largest inner product that the node's box allows."""
        return self.boxes[1] @ np.maximum(queries, 0).T + self.boxes[0] @ np.minimum(queries, 0).T

    def exact_for(self, queries: np.ndarray) -> Shard:
        """Itself, or a copy that computes in whole numbers of any size."""
        if np.abs(queries).max() * self.largest * queries.shape[1] < EXACT:
            return self
        wide = object.__new__(Shard)
        wide.__dict__ = self.__dict__ | {"vectors": whole(self.vectors), "boxes": whole(self.boxes)}
        return wide

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None, own: int = -1) -> list[tuple[int, int]]:
        """Best (score, id) of a query, none below ``floor``; ``own``: the query's row in this shard."""
        first, last, left = self.nodes
        best: list[tuple[int, int]] = []
        least = -np.inf if floor is None else floor
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:  # an equal score may win by its smaller id
            node = heapq.heappop(heap)[1]
            if left[node] >= 0:
                for child in (left[node], left[node] + 1):
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = first[node], last[node]
            scores = self.vectors[a:b] @ query
            best += [(int(scores[i]), int(self.ids[a + i])) for i in np.flatnonzero(scores >= least) if a + i != own]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                least = max(least, best[-1][0])
        return best


def whole(x: np.ndarray) -> np.ndarray:
    """Doubles as Python's whole numbers."""
    return np.array([int(v) for v in x.ravel()], dtype="O").reshape(x.shape)


def as_long(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, x))


def _pack(scale: float, shard_rows: int):
    def packed(shard: int, rows: list) -> pd.DataFrame:
        ids, vectors = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
        tree = Tree(vectors)
        parts = (ids[tree.order], vectors[tree.order], tree.boxes, tree.nodes)
        row = [shard, vectors.shape[1], *(np.ascontiguousarray(x).tobytes() for x in parts)]
        return pd.DataFrame([row], columns=["shard", "width", "ids", "vectors", "boxes", "tree"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, waiting = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for key, vector in zip(batch["id"], batch["vector"], strict=True):
                scaled = np.floor(scale * np.asarray(vector, np.float64))
                rows = waiting.setdefault(len(scaled), [])
                rows.append((key, scaled))
                if len(rows) == shard_rows:
                    yield packed(shard, waiting.pop(len(scaled)))
                    shard += 1
        for rows in waiting.values():
            yield packed(shard, rows)
            shard += 1

    return run


def _own_shard(divisor: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                shard = Shard(row)
                at = np.flatnonzero(shard.ids % divisor == 0)
                out = []
                if len(at):
                    queries = shard.vectors[at]
                    exact = shard.exact_for(queries)
                    if exact is not shard:
                        queries = whole(queries)
                    bounds = exact.bounds(queries)
                    for i, own in enumerate(at):
                        best = exact.search(queries[i], bounds[:, i], k, None, own)
                        floor = best[-1][0] if len(best) == k and best[-1][0] > -(2**63) else None
                        found = [{"score": as_long(s), "vec_id": v} for s, v in best]
                        out.append((row["shard"], own, shard.ids[own], row["width"], shard.vectors[own].tobytes(), floor if floor is None else as_long(floor), found))
                frame = pd.DataFrame(out, columns=["home", "own", "query_id", "width", "query", "floor", "found"])
                yield frame.astype({"floor": "Int64"})

    return run


def _block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Queries of one width, up to BLOCK_ROWS of them, as one row."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    waiting: dict[int, list[pd.DataFrame]] = {}

    def packed(width: int, rows: pd.DataFrame, block: int) -> pd.DataFrame:
        floors = rows["floor"].fillna(-(2**63)).astype(np.int64)
        row = [block, width, *(rows[c].to_numpy(np.int64).tobytes() for c in ("home", "own", "query_id")), b"".join(rows["query"]), floors.to_numpy().tobytes()]
        return pd.DataFrame([row], columns=["block", "width", "homes", "owns", "qids", "queries", "floors"])

    for batch in batches:
        for width, rows in batch.groupby("width"):
            rows = pd.concat([*waiting.pop(width, []), rows])
            while len(rows) >= BLOCK_ROWS:
                yield packed(width, rows[:BLOCK_ROWS], block)
                rows, block = rows[BLOCK_ROWS:], block + 1
            waiting[width] = [rows]
    for width, rows in waiting.items():
        if len(rows[0]):
            yield packed(width, rows[0], block)
            block += 1


def _visit(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                shard = Shard(row)
                queries = np.frombuffer(row["queries"], np.float64).reshape(-1, row["width"])
                homes, owns, qids, floors = (np.frombuffer(row[c], np.int64) for c in ("homes", "owns", "qids", "floors"))
                exact = shard.exact_for(queries)
                if exact is not shard:
                    queries = whole(queries)
                bounds = exact.bounds(queries)
                out = []
                for i in np.flatnonzero((homes != row["shard"]) & (bounds[0] >= floors)):
                    floor = int(floors[i]) if floors[i] > -(2**63) else None
                    out += [(homes[i], owns[i], qids[i], as_long(s), v) for s, v in exact.search(queries[i], bounds[:, i], k, floor)]
                yield pd.DataFrame(out, columns=["home", "own", "query_id", "score", "vec_id"])

    return run


def top_k(df: DataFrame, id_column: str, vector_column: str, query_divisor: int, k: int = 5, scale: float = 256.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` highest integer inner products for every row whose id ``query_divisor`` divides.

    Components become ``floor(scale * x)``. Returns query_id, rank (from 1), vec_id, score; equal scores
    go to the smaller id. Candidates are all rows but the query's own. Rows with a null id, a
    null or empty vector, or a null or non-finite component take no part; vectors of different lengths
    are not compared. Rows that repeat an id are rows of their own: each is a candidate, and each
    that is a query returns its own ranks. Scores too large for exact doubles are computed as
    whole numbers; beyond a long they are returned as its largest or smallest value.
    """
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("vector"),
    ).where(
        "id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    parts = max(1, -(-rows.count() // shard_rows))
    shards = materialize(rows.repartition(parts).mapInPandas(_pack(scale, shard_rows), _SHARD), "knn_shards")
    first = materialize(shards.repartition("shard").mapInPandas(_own_shard(query_divisor, k), _FIRST), "knn_first")
    n_blocks = max(1, -(-first.count() // BLOCK_ROWS))
    queries = first.select("home", "own", "query_id", "width", "query", "floor")
    blocks = materialize(queries.repartition(n_blocks).mapInPandas(_block, _BLOCK), "knn_blocks")
    tiles = blocks.select("block", "width").join(shards.select("shard", "width"), "width").drop("width")
    visits = tiles.join(shards, "shard").join(blocks.drop("width"), "block")
    visits = visits.repartition(max(1, n_blocks * parts), "block", "shard")
    far = visits.mapInPandas(_visit(k), _FOUND)
    near = first.select("home", "own", "query_id", F.inline("found"))
    order = Window.partitionBy("home", "own").orderBy(F.desc("score"), "vec_id")
    return (
        near.unionByName(far)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
