"""Cross-tokenizer alignment by pointer jumping.

A text is encoded by a byte-level BPE (A) and by a piece BPE (B); both tokenise the same bytes, a
space and the text. Every token points to the token of the other side that overlaps it and reaches
farthest right; where both end together, to B's token, which points to itself. Doubling all pointers at once
(``succ = succ[succ]``) takes every token of a batch to the last token of its component in a logarithmic number
of steps. The terminals label the groups: runs of tokens between neighbouring byte offsets at which both sides end.

A link is a pair of an A and a B token that end together: the last tokens of a group, since no token is empty.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.words import small_batches
from vitrina.operators.lookup import lookup_join
from vitrina.session import materialize

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 1 << 21  # texts aligned at a time; a longer text is a batch of its own

Batches = Iterator[pa.RecordBatch]


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: encodes texts, and knows the bytes of each of its tokens."""

    def __init__(self, encode: Callable[[list[str]], list], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)

    def spells(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == data


#: The split pattern of the byte-level pre-tokenizer (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAME_CLASSES = "\u0250"  # every version of Unicode classes the characters below alike, so both libraries split alike


def merge_ranks(a_json: str, spelled: list[bytes]) -> dict[bytes, int] | None:
    """Bytes of all tokens with their ids, if the tokenizer is a plain byte-level BPE whose ids follow its merges."""
    spec = json.loads(a_json)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or spec.get("normalizer") or any(model.get(x) for x in odd):
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    singles = [i for name, i in model["vocab"].items() if len(name) == 1]
    if ids != sorted(set(ids)) or len(singles) != 256 or max(singles) >= min(ids, default=256):
        return None
    return {spelled[i]: i for i in (*singles, *ids)}


def load_sides(a_json: str, b_model: bytes) -> tuple[Side, Side]:
    """Both tokenizers from the contents of their files; special tokens inside texts are plain text.

    A plain byte-level BPE is also loaded as ranks of merges: texts of Latin letters are encoded with these, which gives
    the same ids at a third of the cost; all others go through the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(a_json)
    a.encode_special_tokens = True
    of = byte_characters()
    names = sorted(a.get_vocab().items(), key=lambda x: x[1])
    spelled = [b""] * (names[-1][1] + 1)
    for name, i in names:
        spelled[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()

    b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
    pieces = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.vocab_size())
    ]

    ranks = merge_ranks(a_json, spelled)
    quick = None
    if ranks:  # the same merges by a faster library
        import tiktoken

        quick = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_a(texts: list[str]) -> list:
        out = [quick.encode_ordinary(" " + t) if quick and max(t, default="") < SAME_CLASSES else None for t in texts]
        slow = [i for i, ids in enumerate(out) if ids is None]
        for i, code in zip(slow, a.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = code.ids
        return out

    return Side(encode_a, spelled), Side(lambda texts: b.encode(texts, num_threads=1), pieces)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For every A token, then every B token, the B token in which its component ends.

    Both arrays are the strictly increasing ends of tokens that cover the same bytes.
    """
    n = len(a_ends)
    over = np.searchsorted(b_ends, a_ends)  # the B token over an A token's last byte
    back = np.searchsorted(a_ends, b_ends)
    farther = a_ends[back] > b_ends if n else np.zeros(0, bool)
    succ = np.concatenate([n + over, np.where(farther, back, n + np.arange(len(b_ends)))])
    while True:
        jumped = succ[succ]
        if np.array_equal(jumped, succ):
            return succ - n
        succ = jumped


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


ALIGNED = ("a_ids", "b_ids", "a_sizes", "b_sizes")


def _aligner(a_json, b_model, column: str):
    """Batches with a text column become batches with ALIGNED in its place, all other columns as they are."""

    def run(batches: Batches) -> Batches:
        a, b = load_sides(a_json.value, b_model.value)
        for batch in small_batches(batches, column, BATCH_BYTES):
            texts = batch.column(column).to_pylist()
            at = [i for i, t in enumerate(texts) if t]
            a_ids, b_ids = [[]] * len(texts), [[]] * len(texts)
            asked = [texts[i] for i in at]
            for i, text, x, y in zip(at, asked, a.encode(asked), b.encode(asked), strict=True):
                data = b" " + text.encode()
                if a.spells(x, data) and b.spells(y, data):
                    a_ids[i], b_ids[i] = x, y
            n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
            flat_a, flat_b = (np.array([t for x in ids for t in x], np.int64) for ids in (a_ids, b_ids))
            ends = terminals(np.cumsum(a.lengths[flat_a]), np.cumsum(b.lengths[flat_b]))
            own, group = np.unique(ends, return_inverse=True)
            a_sizes = np.bincount(group[: len(flat_a)], minlength=len(own))
            b_sizes = np.bincount(group[len(flat_a) :], minlength=len(own))
            groups = np.diff(np.searchsorted(own, np.concatenate([[0], np.cumsum(n_b)])))
            others = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others]
                + [_lists(flat_a, n_a), _lists(flat_b, n_b), _lists(a_sizes, groups), _lists(b_sizes, groups)],
                names=[*others, *ALIGNED],
            )

    return run


def _read(df: DataFrame, text: str, keep: dict, tokenizer_a: str, model_b: str):
    """The rows to align under names of their own, the aligner, and the kept names."""
    context = df.sparkSession.sparkContext
    a_json = context.broadcast(Path(tokenizer_a).read_text(encoding="utf-8"))  # sizes do not depend on the data
    b_model = context.broadcast(Path(model_b).read_bytes())
    rows = df.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text}`").alias("__text"))
    return rows, _aligner(a_json, b_model, "__text")


def _fields(rows: DataFrame, more: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"]
    return ", ".join([*kept, more])


def align(df: DataFrame, keep: dict, text: str = "text", tokenizer_a: str = TOKENIZER_A, model_b: str = MODEL_B) -> DataFrame:
    """Per row: the ``keep`` columns (name: expression), ``a_ids``, ``b_ids`` and per group the number of A and of B
    tokens in it (``a_sizes``, ``b_sizes``).

    Both tokenizers read a space and the text; their files are read on the driver and broadcast. Null and empty texts,
    and texts that a tokenizer does not spell byte by byte, have four empty arrays. Repeated rows and null ids stay
    rows of their own; an empty table gives no rows. A text is encoded whole, however long. Nothing is shuffled.
    """
    rows, run = _read(df, text, keep, tokenizer_a, model_b)
    return rows.mapInArrow(run, _fields(rows, ", ".join(f"{c} array<int>" for c in ALIGNED)))


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the number of values per row."""
    counts = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def _summaries(batches: Batches) -> Batches:
    """Aligned batches: counts, a digest of the groups, and each row's distinct links with how often they occur."""
    texts: dict[str, np.ndarray] = {}

    def spelled(ids: np.ndarray, sep: str) -> np.ndarray:
        if not len(ids):
            return np.zeros(0, object)
        size = int(ids.max()) + 1
        if len(texts.get(sep, ())) < size:
            texts[sep] = np.array([f"{i}{sep}" for i in range(2 * size)], object)
        return texts[sep][ids]

    for batch in batches:
        a, n_a = _offsets(batch.column("a_ids"))
        b, n_b = _offsets(batch.column("b_ids"))
        a_sizes, n_groups = _offsets(batch.column("a_sizes"))
        b_sizes, _ = _offsets(batch.column("b_sizes"))
        a_last, b_last = np.cumsum(a_sizes) - 1, np.cumsum(b_sizes) - 1

        # a1,a2|b1;a3|b2,b3; in the order of groups
        shown = np.empty(len(a) + len(b), object)
        at_a = np.arange(len(a)) + np.repeat(b_last + 1 - b_sizes, a_sizes)
        at_b = np.arange(len(b)) + np.repeat(a_last + 1, b_sizes)
        shown[at_a], shown[at_b] = spelled(a, ","), spelled(b, ",")
        shown[at_a[a_last]], shown[at_b[b_last]] = spelled(a[a_last], "|"), spelled(b[b_last], ";")
        digests, done = [], 0
        for n in (n_a + n_b).tolist():
            groups = "".join(shown[done : done + n].tolist())[:-1]
            digests.append(hashlib.sha256(groups.encode()).hexdigest() if n else "")
            done += n

        row = np.repeat(np.arange(batch.num_rows), n_groups)
        link_a, link_b = a[a_last], b[b_last]
        order = np.lexsort((link_a, link_b, row))
        row, link_a, link_b = row[order], link_a[order], link_b[order]
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(link_a) != 0) | (np.diff(link_b) != 0)
        first = np.flatnonzero(new)
        distinct = np.bincount(row[first], minlength=batch.num_rows)
        others = [c for c in batch.schema.names if c not in ALIGNED]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in others]
            + [pa.array(x) for x in (n_a, n_b, n_groups, n_groups)]
            + [pa.array(digests, pa.string())]
            + [_lists(x, distinct) for x in (link_a[first], link_b[first], np.diff(np.append(first, len(row))))],
            names=[*others, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_a", "link_b", "times"],
        )


SUMMARY = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link_a array<int>, link_b array<int>, times array<int>"


def summaries(df: DataFrame, keep: dict, text: str = "text", tokenizer_a: str = TOKENIZER_A, model_b: str = MODEL_B) -> DataFrame:
    """Per row: the ``keep`` columns, counts of tokens, groups and links, ``groups_sha256`` over ``a1,a2|b1;a3|b2,b3``
    ('' without tokens), and the row's distinct links in three arrays.

    The alignment of ``align`` goes straight into its summary, so token ids are never written.
    """
    rows, run = _read(df, text, keep, tokenizer_a, model_b)
    return rows.mapInArrow(lambda batches: _summaries(run(batches)), _fields(rows, SUMMARY))


def _links(summary: DataFrame) -> DataFrame:
    one = F.explode(F.arrays_zip("link_a", "link_b", "times")).alias("_l")
    return summary.select("__row", one).select("__row", "_l.link_a", "_l.link_b", "_l.times")


def link_counts(summary: DataFrame) -> DataFrame:
    """``link_a, link_b, n`` (links of the whole corpus), ``rows`` (that hold one), ``best`` (no A id is linked with the
    B id more often; ties included). The number of rows is bounded by the two vocabularies."""
    counts = _links(summary).groupBy("link_a", "link_b").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts, "link-counts")
    top = counts.groupBy("link_b").agg(F.max("n").alias("top"))
    return materialize(counts.join(top, "link_b").select("link_a", "link_b", "n", "rows", (F.col("n") == F.col("top")).alias("best")), "links")


def corpus_links(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_a: str = TOKENIZER_A, model_b: str = MODEL_B,
                 max_rows: int = 1_000_000) -> DataFrame:
    """Per row: id, counts of tokens, groups and links, ``n_best`` (links that are their B id's most frequent ones in the
    corpus), ``count_sum`` (their counts, summed over links) and ``groups_sha256``.

    The table of link counts is broadcast up to ``max_rows`` rows; beyond that its most frequent links are, and
    only rarer ones are shuffled. Rows without tokens have zeros. Null and repeated ids stay rows of their own.
    """
    found = summaries(df, {"doc_id": F.col(f"`{doc_id}`").cast("long")}, text, tokenizer_a, model_b)
    found = materialize(found.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    known = lookup_join(_links(found), link_counts(found), ["link_a", "link_b"], frequency="rows", max_rows=max_rows)
    times = F.col("times").cast("long")
    sums = known.groupBy("__row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.join(sums, "__row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
