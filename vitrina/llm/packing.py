"""Conflict-constrained best-fit packing of documents into training sequences.

Rows are spread evenly over packing units of bounded size, whatever their keys; copies of a cluster in
different units cannot meet in a bin. In a unit, the longest pieces go first. Bins are ordered by residual
capacity; each carries a bitmap of its sources and of its duplicate clusters. The search begins at the smallest
residual that holds the piece and goes on to successors until a bin shares neither source nor cluster: the tightest
compatible bin. Every range of residuals knows which sources all of its bins have, so ranges without a compatible
bin are passed over at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.session import materialize

CAPACITY = 2048
UNIT_ROWS = 16_384
PLACED = "doc_id long, source string, piece long, first_token long, n_tokens long, bin_id string, position long, bin_offset long"


class Bins:
    """Bins by residual capacity; ``common`` is a tree of the sources that all bins of a range have."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.by_residual: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # source bitmap -> bins
        self.common = [-1] * (2 * self.leaves)  # -1: no bin, all bits set
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.residual: list[int] = []

    def _update(self, residual: int) -> None:
        mask = -1
        for key in self.by_residual[residual]:
            mask &= key
        node = self.leaves + residual
        self.common[node] = mask
        while node > 1:
            node //= 2
            mask = self.common[2 * node] & self.common[2 * node + 1]
            if self.common[node] == mask:
                break
            self.common[node] = mask

    def _put(self, number: int) -> None:
        self.by_residual[self.residual[number]].setdefault(self.sources[number], []).append(number)
        self._update(self.residual[number])

    def _take(self, number: int) -> None:
        group = self.by_residual[self.residual[number]]
        bins = group[self.sources[number]]
        bins.remove(number)
        if not bins:
            del group[self.sources[number]]
        self._update(self.residual[number])

    def _successor(self, residual: int, source: int) -> int | None:
        """Smallest residual, at least the given one, at which some bin lacks the source."""
        if residual > self.capacity:
            return None
        node = self.leaves + residual
        while self.common[node] & source:
            while node & 1:
                node //= 2
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node *= 2
            if self.common[node] & source:
                node += 1
        return node - self.leaves

    def place(self, size: int, source: int, cluster: int) -> int:
        """Number of the bin that takes the piece: the tightest compatible one, the oldest of equals, or a new one."""
        at = self._successor(size, source)
        while at is not None:
            fit = [
                number
                for sources, bins in self.by_residual[at].items()
                if not sources & source
                for number in bins
                if not self.clusters[number] & cluster
            ]
            if fit:
                number = min(fit)
                self._take(number)
                break
            at = self._successor(at + 1, source)
        else:
            number = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        self.residual[number] -= size
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if self.residual[number]:
            self._put(number)
        return number


def pack_unit(sizes: np.ndarray, sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, first token, tokens, bin) of every piece; rows longer than a bin are cut at its capacity."""
    pieces = [(min(capacity, int(n) - at), row, at // capacity, at) for row, n in enumerate(sizes) for at in range(0, max(1, int(n)), capacity)]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    of_source: dict = {}
    of_cluster: dict = {}
    copies = Counter(clusters)  # a cluster of one row needs no bit: its pieces share a source already
    bins = Bins(capacity)
    out = []
    for size, row, piece, at in pieces:
        source = 1 << of_source.setdefault(sources[row], len(of_source))
        cluster = 1 << of_cluster.setdefault(clusters[row], len(of_cluster)) if copies[clusters[row]] > 1 else 0
        out.append((row, piece, at, size, bins.place(size, source, cluster)))
    return out


def _pack(capacity: int, unit_rows: int):
    def packed(unit: int, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["doc_id"].tolist()
        places = pack_unit(rows["size"].to_numpy(), rows["source"].tolist(), rows["cluster"].tolist(), capacity)
        filled: dict[int, list[int]] = {}
        out = []
        for row, piece, at, size, number in places:
            state = filled.setdefault(number, [0, 0])
            out.append((ids[row], rows["source"].iat[row], piece, at, size, f"{unit}-{number}", state[0], state[1]))
            state[0], state[1] = state[0] + 1, state[1] + size
        return pd.DataFrame(out, columns=[x.split()[0] for x in PLACED.split(", ")]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        unit, waiting = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            waiting.append(batch.astype({"doc_id": "Int64"}))
            while sum(map(len, waiting)) >= unit_rows:
                rows = pd.concat(waiting, ignore_index=True)
                yield packed(unit, rows[:unit_rows].reset_index(drop=True))
                waiting, unit = [rows[unit_rows:]], unit + 1
        rows = pd.concat(waiting, ignore_index=True) if waiting else []
        if len(rows):
            yield packed(unit, rows)

    return run


def pack(items: DataFrame, size: Column, cluster: Column, capacity: int = CAPACITY, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Every piece of every row of ``items`` (doc_id, source) with its bin, position and offset in the bin.

    No bin holds two pieces of one source or one duplicate cluster, nor more than ``capacity`` tokens. Rows longer than a bin
    are cut; every token is placed once. A null or zero size is a piece of 0 tokens, a null source is a source of its own,
    a null cluster is that of the row only. Repeated rows are packed each, an empty table gives no rows.
    Which rows share a unit, and so the bins, follows the written order of the rows.
    """
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(cluster.cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id())).alias("cluster"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "packing")
    units = max(1, -(-rows.count() // unit_rows))
    # the hash of the row's number spreads equal keys as evenly as all others
    spread = rows.repartition(units, F.xxhash64("row")).sortWithinPartitions("row")
    return spread.select("doc_id", "source", "cluster", "size").mapInPandas(_pack(capacity, unit_rows), PLACED)


def word_count(text: Column) -> Column:
    """Words between ASCII white space and one end of text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def exact_cluster(text: Column) -> Column:
    """Cluster of texts that are equal but for case and white space."""
    return F.md5(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ").cast("binary"))
