"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping patterns. A region of a text within ``e`` edits of a pattern of ``m``
bytes shares at least ``m - q + 1 - q * e`` of its q-grams, on diagonals that lie within ``e`` of
each other. So shared q-grams are counted in overlapping diagonal bands; regions that reach the
bound are kept and verified by a banded alignment. Patterns come in two lengths: the long ones bear more edits,
the short ones begin so often that an exact excerpt of SURE bytes holds one, wherever it begins. Items too short for
q-grams are matched exactly, as whole words in a row. Texts are only mapped, never shuffled; the
patterns are broadcast, in as many parts as their size needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.words import LOWER, PIECE, find_words, join_hashes, mix, small_batches, text_bytes, word_hashes

Q = 10
PATTERNS = ((120, 60), (66, 11))  # bytes of a pattern and from one's begin to the next's
SURE = 66 + 11 - 1  # normalised bytes of an item from which an exact copy is always found
EDITS_PER_BYTE = 1 / 15
LEAST = 24  # items of fewer normalised bytes are matched exactly, as whole words
PART_BYTES = 2 << 20  # benchmark text that is broadcast at a time
BATCH_BYTES = 1 << 20  # of text whose q-gram hits are held at once
SLICE = 1 << 16  # q-gram hits counted at a time, and those up to the end of the last one's text
_FILTER_BITS = 20

_SPACE = np.ones(256, bool)
_SPACE[0x30:0x3A] = _SPACE[0x41:0x5B] = _SPACE[0x61:0x7B] = _SPACE[0x80:] = False
FOUND = "item_id long, edits long, patterns long, first_byte long"


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins: small letters, anything but letters and digits one space."""
    data, starts = text_bytes(texts)
    low = LOWER[data]
    if len(data) > 1:  # capitals of Latin-1 in UTF-8
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][after] += 0x20
    space = _SPACE[data]
    low[space] = 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inner = starts[:-1][starts[:-1] < len(data)]
    keep[inner] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], kept[starts]


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the q bytes at every position."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    eight = np.ascontiguousarray(windows).view(np.uint64).ravel()
    return eight[: len(data) - Q + 1] * np.uint64(0x9E3779B97F4A7C15) + eight[Q - 8 :] * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Patterns:
    """Patterns of a part of the benchmark and an index of their q-grams."""

    items: np.ndarray
    texts: list[bytes]
    edits: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    at: np.ndarray  # first posting of each key
    pattern: np.ndarray
    offset: np.ndarray
    filter: np.ndarray
    brief: dict[int, tuple[np.ndarray, list[tuple[int, bytes]]]]  # items under LEAST by number of words: sorted hashes, items

    @staticmethod
    def build(items: list[int], texts: list[str]) -> Patterns:
        owner, pieces, short = [], [], []
        data, starts = normalised(pa.array(texts, pa.string()))
        for item, a, b in zip(items, starts[:-1], starts[1:], strict=True):
            text = data[a:b].tobytes().strip()
            if len(text) < LEAST:
                if text:
                    short.append((item, text))
                continue
            cuts = set()
            for size, stride in PATTERNS:
                last = max(0, len(text) - size)
                cuts |= {(begin, min(begin + size, len(text))) for begin in (*range(0, last, stride), last)}
            for begin, end in sorted(cuts):
                owner.append(item)
                pieces.append(text[begin:end])
        edits = np.array([int(len(x) * EDITS_PER_BYTE) for x in pieces], np.int64)
        needed = np.array([len(x) - Q + 1 for x in pieces], np.int64) - Q * edits
        codes = [grams(np.frombuffer(x, np.uint8)) for x in pieces]
        every = np.concatenate([np.zeros(0, np.uint64), *codes])
        sort = np.argsort(every, kind="stable")
        pattern = np.repeat(np.arange(len(pieces)), [len(c) for c in codes]).astype(np.int64)
        offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in codes]])
        keys, at = np.unique(every[sort], return_index=True)
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[mix(keys) >> np.uint64(64 - _FILTER_BITS)] = True
        return Patterns(np.array(owner, np.int64), pieces, edits, np.maximum(needed, 1), keys, np.append(at, len(every)), pattern[sort], offset[sort], table, _brief(short))


def _brief(items: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, list[tuple[int, bytes]]]]:
    out = {}
    for n in {x.count(b" ") + 1 for _, x in items}:
        own = [x for x in items if x[1].count(b" ") + 1 == n]
        codes = join_hashes(word_hashes(find_words(pa.array([x for _, x in own], pa.binary()).cast(pa.string()))), n)[::n]
        sort = np.argsort(codes, kind="stable")
        out[n] = codes[sort], [own[i] for i in sort]
    return out


def alignment(pattern: bytes, region: bytes, edits: int) -> int | None:
    """Fewest edits that turn the pattern into a part of the region, or None if over ``edits``.

    The region holds one diagonal band, so every row of the alignment is computed over it at once; runs of
    insertions are a running minimum.
    """
    if pattern in region:
        return 0
    if not edits:
        return None
    text = np.frombuffer(region, np.uint8)
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)  # it may begin anywhere
    for i, byte in enumerate(pattern):
        step = np.minimum(row[1:] + 1, row[:-1] + (text != byte))
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - steps) + steps
        if row.min() > edits:
            return None
    return int(row.min())


def matches(texts: pa.Array, p: Patterns) -> dict[int, dict[int, list[int]]]:
    """For each text with a match, by item: fewest edits, patterns matched, first byte in the normalised text.

    Texts are matched BATCH_BYTES at a time; bands are counted from the first byte of all.
    """
    out: dict[int, dict[int, list[int]]] = {}
    rows = before = 0
    whole = pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], names=["text"])
    for part in small_batches(iter([whole]), most=BATCH_BYTES):
        data, starts = normalised(part.column("text"))
        out |= {rows + i: items for i, items in _match(data, starts, before, p).items()}
        rows, before = rows + part.num_rows, before + len(data)
    return out


def _match(data: np.ndarray, starts: np.ndarray, before: int, p: Patterns) -> dict[int, dict[int, list[int]]]:
    position, key = [], []
    for begin in range(0, len(data), PIECE):
        codes = grams(data[begin : begin + PIECE + Q - 1])
        some = np.flatnonzero(p.filter[mix(codes) >> np.uint64(64 - _FILTER_BITS)])
        number = np.searchsorted(p.keys, codes[some])
        number = np.minimum(number, len(p.keys) - 1)
        same = p.keys[number] == codes[some]
        position.append(some[same] + begin)
        key.append(number[same])
    position = np.concatenate([np.zeros(0, np.int64), *position])
    key = np.concatenate([np.zeros(0, np.int64), *key])
    text = np.searchsorted(starts, position, "right") - 1
    inside = position + Q <= starts[text + 1]
    position, key, text = position[inside], key[inside], text[inside]
    out: dict[int, dict[int, list[int]]] = {}
    # few hits of a text cannot reach any bound, whichever pattern they belong to
    least = int(p.needed.min(initial=1 << 30))
    number = np.bincount(text, minlength=len(starts))
    some = number[text] >= least
    position, key, text = position[some], key[some], text[some]
    begin = 0
    while begin < len(key):  # a text is never divided: its hits count together
        upto = int(np.searchsorted(text, text[min(begin + SLICE, len(text)) - 1], "right"))
        _count_bands(data, starts, before, position[begin:upto], key[begin:upto], text[begin:upto], p, out)
        begin = upto
    if p.brief:
        _whole_words(data, starts, p, out)
    return out


def _whole_words(data, starts, p: Patterns, out: dict) -> None:
    """Items under LEAST bytes that occur as whole words in a row, by the first place in each text."""
    words = find_words(pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)))
    hashes = word_hashes(words)
    text = np.repeat(np.arange(len(starts) - 1), words.counts())
    for n, (keys, items) in p.brief.items():
        codes = join_hashes(hashes, n)
        first = np.searchsorted(keys, codes)
        same = (keys[np.minimum(first, len(keys) - 1)] == codes) & (text[: len(codes)] == text[n - 1 :])
        run = np.flatnonzero(same)
        _, once = np.unique(text[run] * len(keys) + first[run], return_index=True)
        for i in run[once]:
            d, begin = int(text[i]), int(words.begins[i])
            passage = data[begin : int(words.ends[i + n - 1])].tobytes()
            for k in range(int(first[i]), int(np.searchsorted(keys, codes[i], "right"))):
                item, own = items[k]
                if own == passage:
                    known = out.setdefault(d, {}).setdefault(item, [0, set(), begin - int(starts[d])])
                    known[0], known[2] = 0, min(known[2], begin - int(starts[d]))
                    known[1].add((n, k))


def _count_bands(data, starts, before: int, position, key, text, p: Patterns, out: dict) -> None:
    if not len(key):
        return
    n = p.at[key + 1] - p.at[key]
    hit = np.repeat(np.arange(len(key)), n)
    posting = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + p.at[key][hit]
    pattern, offset = p.pattern[posting], p.offset[posting]
    diagonal = before + position[hit] - offset
    width = p.edits[pattern] + 1
    lower = np.floor_divide(diagonal, width)
    # each hit counts in two bands of twice the width, so any run of diagonals lies within one
    doc = np.concatenate([text[hit], text[hit]])
    who = np.concatenate([pattern, pattern])
    band = np.concatenate([lower, lower - 1])
    sort = np.lexsort((band, who, doc))
    doc, who, band = doc[sort], who[sort], band[sort]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (who[1:] != who[:-1]) | (band[1:] != band[:-1])]))
    count = np.diff(np.append(new, len(doc)))
    reach = new[count >= p.needed[who[new]]]
    for i in reach:
        d, w = int(doc[i]), int(who[i])
        item, edits = int(p.items[w]), int(p.edits[w])
        begin = max(int(starts[d]), int(band[i]) * (edits + 1) - edits - before)
        end = min(int(starts[d + 1]), (int(band[i]) + 2) * (edits + 1) + len(p.texts[w]) + edits - before)
        found = alignment(p.texts[w], data[begin:end].tobytes(), edits)
        if found is not None:
            known = out.setdefault(d, {}).setdefault(item, [found, set(), begin - int(starts[d])])
            known[0], known[2] = min(known[0], found), min(known[2], begin - int(starts[d]))
            known[1].add(w)


def pattern_parts(benchmark: DataFrame) -> Iterator[Patterns]:
    """Patterns of the benchmark (item_id, text), in parts of about PART_BYTES, which is what the driver holds.

    Null items and those without a letter or digit have none.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // PART_BYTES)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect() if parts > 1 else rows.collect()
        built = Patterns.build([r["item_id"] for r in own], [r["text"] for r in own])
        if len(built.keys) or built.brief:
            yield built


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row (doc_id, item_id, edits, patterns, first_byte) for every text that holds a passage of an item.

    edits: fewest edits of a matching pattern; patterns: how many of the item's patterns match; first_byte: about where the
    first begins in the normalised text. Texts are read whole; null and empty ones match nothing; rows that repeat are
    reported each, a null doc_id stays null; empty tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for patterns in pattern_parts(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(patterns)
        found = rows.mapInArrow(_report(held), f"doc_id long, {FOUND}")
        out = found if out is None else out.unionByName(found)
    return rows.limit(0).mapInArrow(_nothing, f"doc_id long, {FOUND}") if out is None else out


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    return iter(())


def _report(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [
                (i, item, edits, len(which), first)
                for i, items in sorted(matches(batch.column("text"), patterns.value).items())
                for item, (edits, which, first) in sorted(items.items())
            ]
            index, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            ids = batch.column("doc_id").take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in rest]], names=["doc_id", "item_id", "edits", "patterns", "first_byte"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark, with all their columns, unshuffled."""

    def unmatched(patterns):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, text):
                keep = np.ones(batch.num_rows, bool)
                keep[list(matches(batch.column(text), patterns.value))] = False
                yield batch.filter(pa.array(keep))

        return run

    text = docs.columns.index("text")
    for patterns in pattern_parts(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(patterns)
        docs = docs.mapInArrow(unmatched(held), docs.schema)
    return docs
