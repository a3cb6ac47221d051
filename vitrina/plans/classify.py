"""Flat and hierarchical classification with Naive Bayes tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.operators.bayes import ROOT, ROW, TABLES, BayesModel, Level, fit_bayes, numbered, predict
from vitrina.operators.evaluate import accuracy
from vitrina.operators.logistic import BLOCK_CELLS, fit_logistic
from vitrina.operators.price import trim_bounds, with_bounds
from vitrina.operators.split import in_train
from vitrina.operators.vocabulary import Limits, gram_vocabulary, item_terms
from vitrina.plans.preprocess import terms_of, with_terms, with_words
from vitrina.session import materialize

LEVELS = ("cat_0", "cat_1", "cat_2")
CHILD_TRIM = (5, 95)  # fixed value: percentiles kept below the root


@dataclass
class Features:
    """Terms, vocabulary and per-item known terms, read by every fit and score.

    Words, vocabulary and known terms are written tables; ``tokens`` derives the terms of each item
    from its words, so n-grams are never stored.
    """

    tokens: DataFrame
    vocabulary: DataFrame
    size: int
    terms: DataFrame


def build_features(
    items: DataFrame,
    keep: Sequence[str],
    limits: dict[int, Limits] | None = None,
    stop_words: Sequence[str] | None = None,
    ngram_source: str = "raw",
    version: str | None = "v4",
    plain: bool = False,
    train_on: str | None = None,
) -> Features:
    """Vocabulary and item terms. ``train_on`` names a boolean column: the vocabulary then comes
    from those items only."""
    limits = limits or {1: Limits(60_000, 5)}
    words = with_words(items, version=version, plain=plain).select("item_id", *keep, "words")
    # The text rules cost most; their result is written once for the two passes that follow. Rows get a
    # number there, since item ids may be null or repeated.
    words = materialize(words.withColumn(ROW, F.monotonically_increasing_id()), "words")
    terms = terms_of("words", tuple(limits), stop_words, ngram_source)
    tokens = words.select(ROW, "item_id", *keep, terms.alias("terms"))
    known = tokens.where(F.col(train_on)) if train_on else tokens
    vocab = materialize(gram_vocabulary(known, "terms", limits), "vocabulary")
    return Features(tokens, vocab, vocab.count(), item_terms(tokens, "terms", vocab, keep))


def new_item_terms(items: DataFrame, features: Features, **options) -> DataFrame:
    """Terms of items that have neither category nor price, under a fitted vocabulary."""
    tokens = with_terms(items.select("item_id", "title"), **options)
    return item_terms(tokens, "terms", features.vocabulary, [])


def mark_trimmed(
    items: DataFrame, by: Sequence[str], bottom: float, top: float, name: str
) -> DataFrame:
    """Attach a flag: the price lies between two percentiles of its group (ends included)."""
    joined = with_bounds(items, trim_bounds(items, bottom, top, by), by, how="left")
    kept = F.coalesce(F.col("price").between(F.col("_low"), F.col("_high")), F.lit(False))
    return joined.withColumn(name, kept).drop("_low", "_high")


def fit_flat(features: Features, target: str, kind: str = "bernoulli", smoothing: float = 1.0,
             keep: str | None = None) -> BayesModel:
    """One model over all values of ``target``."""
    return fit_bayes(
        features.terms, [Level(target, keep=keep)], features.size, kind, smoothing
    )


def fit_hierarchy(
    features: Features,
    levels: Sequence[str] = LEVELS,
    trim: tuple[float, float] | None = CHILD_TRIM,
    root_trim: tuple[float, float] | None = None,
    kind: str = "bernoulli",
    smoothing: float = 1.0,
) -> BayesModel:
    """A root model for the first level and one model per parent category below it.

    Each child set is trimmed by the price percentiles of its parent category; the root is trimmed
    only on request. All models of all levels come out of one grouped aggregation.
    """
    return fit_bayes(*_planned(features, levels, trim, root_trim), features.size, kind, smoothing)


def _planned(
    features: Features, levels: Sequence[str], trim: tuple[float, float] | None, root_trim: tuple[float, float] | None
) -> tuple[DataFrame, list[Level]]:
    """Item terms with a flag per trimmed level, and the levels."""
    table = features.terms
    plan: list[Level] = []
    for depth, target in enumerate(levels):
        parent = levels[depth - 1] if depth else None
        tiles = trim if depth else root_trim
        keep = f"_kept_{depth}" if tiles else None
        if tiles:
            table = mark_trimmed(table, [parent] if parent else [], *tiles, keep)
        plan.append(Level(target, parent, keep))
    return table, plan


BAYES, LOGISTIC = "bayes", "logistic"


def fit_mixed(
    features: Features,
    learners: Sequence[str] = (BAYES, BAYES, LOGISTIC),
    levels: Sequence[str] = LEVELS,
    trim: tuple[float, float] | None = CHILD_TRIM,
    root_trim: tuple[float, float] | None = None,
    smoothing: float = 1.0,
    max_iter: int = 100,
    reg: float = 0.0,
    block_cells: int = BLOCK_CELLS,
) -> BayesModel:
    """A hierarchy whose levels have a learner each: Bernoulli Bayes or logistic regression.

    Both end in the same tables (a class scores its intercept and the gains of its terms), so ``cascade`` routes
    rows by predicted parent through all levels, and the model is saved and loaded like one of Bayes only.
    Levels of one learner are fitted together.
    """
    if len(learners) != len(levels) or set(learners) - {BAYES, LOGISTIC}:
        raise ValueError(f"one learner per level, {BAYES!r} or {LOGISTIC!r}: {learners!r}")
    table, plan = _planned(features, levels, trim, root_trim)
    table = materialize(table, "planned")
    by = {kind: [lv for lv, chosen in zip(plan, learners, strict=True) if chosen == kind] for kind in (BAYES, LOGISTIC)}
    fitted = []
    if by[BAYES]:
        fitted.append(fit_bayes(table, by[BAYES], features.size, "bernoulli", smoothing))
    if by[LOGISTIC]:
        fitted.append(fit_logistic(table, by[LOGISTIC], max_iter, reg, block_cells=block_cells).linear())
    if len(fitted) == 1:
        return fitted[0]
    return BayesModel("bernoulli", *[getattr(fitted[0], t).unionByName(getattr(fitted[1], t)) for t in TABLES])


def classify(
    terms: DataFrame, model: BayesModel, target: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Flat prediction."""
    return predict(terms, model, target, carry=carry)


def classify_under_parent(
    terms: DataFrame, model: BayesModel, target: str, parent: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Prediction by the model of each item's own, known parent category."""
    return predict(terms, model, target, F.col(parent), carry)


def cascade(
    terms: DataFrame, model: BayesModel, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Predict level by level: each prediction picks the model of the next level.

    ``item_id`` and one ``predicted_<level>`` column per level; as many rows as ``terms`` has, also where
    item ids are null or repeated.
    """
    terms = numbered(terms)
    table = terms.select(ROW, "item_id", "terms")
    done: list[str] = []
    for depth, level in enumerate(levels):
        parent = F.coalesce(F.col(done[-1]), F.lit(ROOT)) if depth else None
        found = predict(table, model, level, parent, carry=[ROW, *done], by_row=depth > 0)
        name = f"predicted_{level}"
        found = found.select(ROW, "item_id", *done, F.col("prediction").alias(name))
        done.append(name)
        # Written per level: the next level reads it twice at most and never repeats this one.
        found = materialize(found, f"cascade-{level}")
        # By the size of its files alone a table of a million rows would be broadcast.
        table = terms.select(ROW, "terms").join(found.hint("merge"), ROW)
    return found.drop(ROW)


def holdout_accuracy(
    items: DataFrame,
    target: str,
    parent: str | None,
    limits: dict[int, Limits] | None = None,
    train: float = 0.9,
    trim: tuple[float, float] | None = None,
    kind: str = "bernoulli",
) -> DataFrame:
    """Train on a share of the items and measure on the rest, one model per parent category.

    With ``trim``, items outside their parent's price percentiles take part in neither.
    """
    keep = [c for c in (parent, target) if c]
    flagged = items.withColumn("_train", in_train(train=train))
    features = build_features(flagged, [*keep, "price", "_train"], limits, train_on="_train")
    table = features.terms
    if trim:
        table = mark_trimmed(table, [parent] if parent else [], *trim, "_in")
        table = table.where(F.col("_in"))
    model = fit_bayes(table, [Level(target, parent, "_train")], features.size, kind)
    test = table.where(~F.col("_train"))
    key = F.col(parent) if parent else None
    predicted = predict(test, model, target, key, carry=keep)
    return accuracy(predicted, target, by=[parent] if parent else [])
