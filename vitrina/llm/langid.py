"""Language identification as mixture inference.

A document is a mixture of languages: every word comes from one of them, with the likelihood of its byte
trigrams. Expectation-maximisation estimates the proportions; the set of languages grows, in order of
their proportions, as long as the penalised likelihood does. Trigram counts of all labelled rows make the model:
languages x BUCKETS numbers, independent of the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.words import LETTERS, LOWER, Words, find_words, small_batches

BUCKETS = 1 << 16
PENALTY = 3.0  # log-likelihood units per further language and log of the number of words
ROUNDS = 6
SMOOTHING = 0.5
UNKNOWN = "und"
_WORDS_AT_ONCE = 1 << 18
BATCH_BYTES = 1 << 20  # of text whose trigrams are held at once


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around every byte of a word, each word's first, and each text's first."""
    data = words.data
    low = np.where(LETTERS[data], LOWER[data], np.uint8(0x20)).astype(np.uint32)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.begins] += 1
    np.subtract.at(inside, words.ends, 1)
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(words.texts), np.int64)
    before = low[at - 1]
    after = low[np.minimum(at + 1, len(low) - 1)]
    firsts = np.searchsorted(at, words.begins)
    before[firsts] = 0x20
    after[np.append(firsts[1:], len(at)) - 1] = 0x20
    code = (before << 16) | (low[at] << 8) | after
    buckets = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    return buckets, firsts, np.append(firsts, len(at))[words.texts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in small_batches(batches, most=BATCH_BYTES):
        buckets, _, texts = _trigrams(find_words(batch.column("text"), LETTERS))
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(langs)), np.diff(texts))
        for lang in set(langs):
            found = np.bincount(buckets[(langs == lang)[of]], minlength=BUCKETS)
            counts[lang] = counts[lang] + found if lang in counts else found
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())],
            names=["lang", "bucket", "n"],
        )


@dataclass
class LanguageModel:
    """Log-likelihoods (bucket x language) of the languages in ``names``, in alphabetical order."""

    names: list[str]
    logs: np.ndarray


def learn(labelled: DataFrame) -> LanguageModel:
    """Counts the trigrams of all rows (text, lang) whose text and lang are not null."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    names = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    table[found["bucket"], found["lang"].map({x: i for i, x in enumerate(names)})] += found["n"]
    return LanguageModel(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def _fit(scaled: np.ndarray, allowed: np.ndarray, firsts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation and the log of the mixture's likelihood per text."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.diff(np.append(firsts, len(of)))[:, None]
    for _ in range(ROUNDS):
        part = share.astype(np.float32)[of] * scaled
        part /= part.sum(axis=1, keepdims=True) + np.float32(1e-30)
        share = np.add.reduceat(part, firsts, dtype=np.float64) / n
        share /= share.sum(axis=1, keepdims=True) + 1e-300
    total = np.log((share.astype(np.float32)[of] * scaled).sum(axis=1) + np.float32(1e-30))
    return share, np.add.reduceat(total, firsts, dtype=np.float64)


def mixtures(likelihoods: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Proportions of the languages (text x language) from word log-likelihoods (word x language).

    ``firsts`` has each text's first word; every text has a word.
    """
    languages = likelihoods.shape[1]
    n = np.diff(np.append(firsts, len(likelihoods)))
    of = np.repeat(np.arange(len(firsts)), n)
    scaled = np.exp(likelihoods - likelihoods.max(axis=1, keepdims=True))
    full, _ = _fit(scaled, np.ones((len(firsts), languages)), firsts, of)
    order = np.argsort(-full, axis=1, kind="stable")
    alone = np.add.reduceat(likelihoods - likelihoods.max(axis=1, keepdims=True), firsts, dtype=np.float64)
    share = np.zeros_like(full)
    best = alone.argmax(axis=1)
    share[np.arange(len(n)), best] = 1
    score = alone.max(axis=1) - PENALTY * np.log(n + 1)
    open_ = np.ones(len(n), bool)
    for size in range(2, languages + 1):
        rank = np.argsort(order, axis=1)
        chosen = np.flatnonzero(open_)
        if not len(chosen):
            break
        of_open = open_[of]
        moved = np.cumsum(open_) - 1
        starts = np.concatenate([[0], np.cumsum(n[chosen])[:-1]])
        fitted, logs = _fit(scaled[of_open], (rank[chosen] < size).astype(float), starts, moved[of[of_open]])
        logs -= PENALTY * size * np.log(n[chosen] + 1)
        better = logs > score[chosen]
        share[chosen[better]], score[chosen[better]] = fitted[better], logs[better]
        open_[:] = False
        open_[chosen[better]] = True
    return share


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=BATCH_BYTES):
            words = find_words(batch.column("text"), LETTERS)
            buckets, firsts, _ = _trigrams(words)
            n_words = words.counts()
            names = np.full(len(n_words), UNKNOWN, dtype=object)
            scores = np.zeros(len(n_words))
            texts = np.flatnonzero((n_words > 0) & _lettered(batch.column("text"), words))
            ends = np.append(firsts, len(buckets))
            at = 0
            while at < len(texts) and len(model.names):  # a run of texts at a time, to bound memory
                total = np.cumsum(n_words[texts[at:]])
                upto = at + max(1, int(np.searchsorted(total, _WORDS_AT_ONCE)))
                some = texts[at:upto]
                likely = np.concatenate([_likelihoods(model, buckets, ends, words.texts[i], words.texts[i + 1]) for i in some])
                starts = np.concatenate([[0], np.cumsum(n_words[some])[:-1]])
                share = mixtures(likely, starts)
                names[some] = np.array(model.names, dtype=object)[share.argmax(axis=1)]
                scores[some] = np.clip(share.max(axis=1), 0, 1)
                at = upto
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"],
            )

    return run


def _likelihoods(model: LanguageModel, buckets: np.ndarray, ends: np.ndarray, first: int, last: int) -> np.ndarray:
    """Word log-likelihoods of words first to last."""
    a, b = ends[first], ends[last]
    return np.add.reduceat(model.logs[buckets[a:b]], ends[first:last] - a, axis=0)


def _lettered(texts: pa.Array, words: Words) -> np.ndarray:
    """Whether a text has a letter; only texts without ASCII letters are looked at one by one."""
    ascii_letter = np.concatenate([[0], np.cumsum(LETTERS[:128][np.minimum(words.data, 127)] & (words.data < 128))])
    starts = np.append(words.begins, len(words.data))
    found = np.zeros(len(texts), bool)
    for i, (a, b) in enumerate(zip(words.texts[:-1], words.texts[1:], strict=True)):
        if b > a:
            first, last = starts[a], words.ends[b - 1]
            found[i] = ascii_letter[last] > ascii_letter[first] or any(c.isalpha() for c in texts[i].as_py())
    return found


def identify(df: DataFrame, model: LanguageModel, keep: dict[str, Column]) -> DataFrame:
    """Columns ``keep`` of every row of ``df`` (text), with lang_pred and score.

    score is the proportion of the predicted language. Null texts, texts without a letter, and all texts of a model that
    has learned nothing are ``und`` with score 0. Equal proportions go to the alphabet. Repeated rows are answered
    each, an empty table stays empty, whole texts are read whatever their length.
    """
    rows = df.select(*[c.alias(n) for n, c in keep.items()], F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_predict(model), f"{schema}, lang_pred string, score double")


def crc_remainder(column: Column, modulus: int) -> Column:
    """CRC-32 of a value's text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
