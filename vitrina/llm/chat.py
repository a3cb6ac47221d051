r"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts every control
string gets a backslash after its first character (one more if some follow it already), so markers
occur nowhere else and the way back is exact. Conversations are sorted across partitions; a
segment, the turns of one conversation that meet in a partition (up to SEGMENT_CHARS), is rendered
whole and encoded once with offsets. The assistant's spans are intersected with the sorted token spans by
binary search. Turn ends are token boundaries of the tokenizer, so segments encode as their whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SEGMENT_CHARS = 1 << 20
START, END = "<|im_start|>", "<|im_end|>"

_CONTROL = re.compile(r"([<\[])(\\*)(\||/s>|s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])(\\*)\\(\||/s>|s>|INST\]|/INST\])")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

SEGMENT = (
    "conv_id long, part int, segment long, n_turns long, formatted string, token_ids array<int>, loss_mask array<int>,"
    "loss_from array<int>, loss_to array<int>"
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, str]:
    """What precedes the text of a turn, and the escaped text."""
    role = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{START}{escape(role)}\n", escape(text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted segment."""
    roles = {"\\\\": "\\", "\\n": "\n"}
    return [
        (re.sub(r"\\\\|\\n", lambda m: roles[m[0]], unescape(role)), unescape(text))
        for role, text in _TURN.findall(formatted)
    ]


def loss_tokens(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask of the tokens that meet a span, and the part of each such token inside its span.

    Both are sorted; the tokens of a span are found by binary search. A token that reaches over the
    edge of a span counts, with its inner part only.
    """
    mask = np.zeros(len(offsets), np.int32)
    start, end = [], []
    for a, b in spans:
        lo, hi = np.searchsorted(offsets[:, 1], a, "right"), np.searchsorted(offsets[:, 0], b, "left")
        mask[lo:hi] = 1
        start.append(np.maximum(offsets[lo:hi, 0], a))
        end.append(np.minimum(offsets[lo:hi, 1], b))
    empty = [np.zeros(0, np.int64)]
    return mask, np.concatenate(empty + start), np.concatenate(empty + end)


def _segments(tokenizer_json: str, loss_role: str, segment_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json.value)
        tokenizer.encode_special_tokens = True
        part = TaskContext.get().partitionId()
        ready: list[tuple] = []
        count, key, pieces, spans, size, turns = 0, None, [], [], 0, 0

        def close() -> None:
            if turns:
                ready.append((key, count, turns, "".join(pieces), spans))

        def encoded() -> pd.DataFrame:
            out = []
            codes = tokenizer.encode_batch([x[3] for x in ready], add_special_tokens=False)
            for (conv, number, n, text, loss), code in zip(ready, codes, strict=True):
                offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                mask, start, end = loss_tokens(offsets, np.array(loss, np.int64).reshape(-1, 2))
                out.append((conv, part, number, n, text, code.ids, mask, start, end))
            ready.clear()
            frame = pd.DataFrame(out, columns=["conv_id", "part", "segment", "n_turns", "formatted", "token_ids", "loss_mask", "loss_from", "loss_to"])
            return frame.astype({"conv_id": "Int64"})

        for batch in batches:
            convs = batch["conv_id"].astype("Int64")
            for conv, role, text in zip(convs, batch["role"], batch["text"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if not turns or conv != key or size >= segment_chars:
                    close()
                    count, key, pieces, spans, size, turns = count + 1, conv, [], [], 0, 0
                    if sum(len(x[3]) for x in ready[-64:]) >= segment_chars or len(ready) >= 256:
                        yield encoded()
                head, body = render(role, text)
                if role == loss_role:
                    spans.append((size + len(head), size + len(head) + len(body)))
                pieces += [head, body, END, "\n"]
                size += len(head) + len(body) + len(END) + 1
                turns += 1
        close()
        if ready:
            yield encoded()

    return run


def format_conversations(df: DataFrame, tokenizer: str = TOKENIZER, loss_role: str = "assistant", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Formatted segments with token ids, loss mask and the character spans under the mask.

    Needs conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, then
    role and text (nulls first), null texts and roles are empty, a null conv_id is a conversation
    of its own, repeated rows are repeated turns. An empty table gives no rows. ``(part, segment)``
    orders the segments of a conversation; only one that is longer than a segment, or meets the border
    of two partitions, has several. ``tokenizer`` is read on the driver and broadcast (its size does not depend on the data).
    """
    turns = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    vocabulary = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    return ordered.mapInPandas(_segments(vocabulary, loss_role, segment_chars), SEGMENT)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams the segments of one conversation after another; only hash states are kept."""
    columns = [x.split()[0] for x in DIGEST.split(", ")]
    state = None

    def done() -> list:
        key, n, turns, chars, loss, formatted, tokens, masked = state
        return [key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens, masked]

    for batch in batches:
        out = []
        for row in batch.astype({"conv_id": "Int64"}).to_dict("records"):
            key = None if row["conv_id"] is pd.NA else row["conv_id"]
            if state is None or state[0] != key:
                if state is not None:
                    out.append(done())
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            text = row["formatted"]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            runs, at = [], 0
            for a, b in zip(row["loss_from"], row["loss_to"], strict=True):
                a = max(a, at)  # tokens that share a character overlap
                if a < b and runs and runs[-1][1] == a:
                    runs[-1][1] = b
                elif a < b:
                    runs.append([a, b])
                at = max(at, b)
            said = "".join(unescape(text[a:b]) for a, b in runs)  # a marker lies between two runs
            state[3] += len(said)
            state[4].update(said.encode())
            state[5] += len(text)
            state[6] += len(row["token_ids"])
            state[7] += int(np.sum(row["loss_mask"]))
        yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
    if state is not None:
        yield pd.DataFrame([done()], columns=columns).astype({"conv_id": "Int64"})


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, what reading its formatted segments and loss spans back gives."""
    order = ["conv_id", "part", "segment"]
    return segments.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(_digest, DIGEST)
