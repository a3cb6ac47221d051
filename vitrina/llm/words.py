"""Vectorised words of Arrow text columns: 64-bit word hashes without Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21  # bytes hashed at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

WHITE = np.ones(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False  # words are runs of anything but ASCII white space

LETTERS = np.zeros(256, bool)  # words are runs of ASCII letters and non-ASCII bytes
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(LOWER.astype(np.uint64) + np.uint64(1))  # a value per byte, equal for A-Z and a-z
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other (null: empty), and where each begins."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begins = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), begins - begins[0]
    return np.frombuffer(data, np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: int | str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, a row at least: a task's memory depends on neither
    the number of rows that arrive at once nor their lengths, but for a single text's."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of a batch: where each begins and ends in ``data``, and each text's first word."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    texts: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.texts)


def find_words(texts: pa.Array, kind: np.ndarray = WHITE) -> Words:
    data, starts = text_bytes(texts)
    inside = kind[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]  # a word never reaches into the next text
    end[cuts - 1] = inside[cuts - 1]
    begins = np.flatnonzero(begin)
    return Words(data, begins, np.flatnonzero(end) + 1, np.searchsorted(begins, starts))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash per word, blind to the case of A-Z; equal words get equal hashes anywhere."""
    out = np.empty(len(words.begins), np.uint64)
    done = 0
    while done < len(out):
        at = int(words.begins[done])
        upto = max(done + 1, int(np.searchsorted(words.ends, at + PIECE, "right")))
        piece = words.data[at : int(words.ends[upto - 1])]
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * up[: len(piece)], out=sums[1:])
        b, e = words.begins[done:upto] - at, words.ends[done:upto] - at
        out[done:upto] = (sums[e] - sums[b]) * down[b]
        done = upto
    return mix(out)


def join_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` neighbouring hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = hashes[:size].copy()
    for k in range(1, n):
        total *= _M2
        total += hashes[k : k + size]
    return mix(total + np.uint64(n))
