"""Logistic regressions of all parent categories of all levels, fitted together.

Items become blocks: the term numbers and labels of some items of one model, at most ``block_cells`` terms
together, so a parent with a third of all items has many blocks. A model of at most ``ALONE`` blocks is fitted inside
a task. All others take their steps together: one job per step evaluates every block of every unfinished
model, adds gradients up inside tasks, sums them by model and lets each model take its own L-BFGS step with its
own line search and its own end. The number of jobs is that of the slowest model, however many parents there are.

As in Spark ML the L-BFGS state of models of up to ``DRIVER_WEIGHTS`` weights, some 22 numbers per weight, stays on the driver, of so
many models at a time as keep to that bound together; the next ones begin as others end. Gradients are summed by slices of
``SLICE`` weights in tasks, so the driver gets each sum once, and blocks never travel. States of larger models are a table,
which is written and read in every step; only the last step's is kept on disk.

The result has the layout of ``bayes.BayesModel``: a class scores its intercept plus the gains of the item's terms.
Adding the same number to a term's weights for all classes of a model changes no prediction, so the
smallest weight of each term is taken off; gains are then never negative, as scoring by matched cells needs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrina.operators.bayes import ROW, BayesModel, Level, _class_lists, numbered
from vitrina.operators.lookup import lookup_join
from vitrina.session import discard, materialize, shuffle_clean_up

BLOCK_CELLS = 1 << 20
ALONE = 16  # blocks up to which a model is fitted inside one task
MOST_PARTS = 512  # tasks that such models are dealt to
MEMORY = 10  # pairs of steps and gradient changes that L-BFGS keeps
TRIES = 40  # evaluations of one line search
DRIVER_WEIGHTS = 1_000_000  # weights of the models whose states the driver holds at once
SLICE = 1 << 15  # weights of a part of a gradient that is summed in a task
BROADCAST_WEIGHTS = 8_000_000  # weights of unfinished models sent to every task; more are joined

Batches = Iterator[pa.RecordBatch]


# One model, without Spark


@dataclass
class Block:
    """Items of one model: labels, and where each item's terms begin and end in ``columns``."""

    labels: np.ndarray
    starts: np.ndarray
    columns: np.ndarray

    def evaluate(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the log losses and its gradient; the last row of ``weights`` holds the intercepts.

        A single column is the binomial model of label 1, several are one per label.
        """
        at = self.columns.astype(np.intp)  # converted once, not in every gather and count
        sizes = np.diff(self.starts)
        some = np.flatnonzero(sizes)  # items with a term: their cells follow each other without a gap
        margins = np.empty((len(self.labels), weights.shape[1]))
        for k in range(weights.shape[1]):
            margins[:, k] = weights[-1, k]
            if len(some):
                margins[some, k] += np.add.reduceat(np.ascontiguousarray(weights[:-1, k])[at], self.starts[some])
        if weights.shape[1] == 1:
            z, y = margins[:, 0], self.labels
            loss = float(np.sum(np.logaddexp(0.0, z) - y * z))
            rest = (0.5 * (1.0 + np.tanh(0.5 * z)) - y)[:, None]
        else:
            top = margins.max(axis=1, keepdims=True)
            total = np.log(np.exp(margins - top).sum(axis=1, keepdims=True)) + top
            rows = np.arange(len(self.labels))
            loss = float(np.sum(total[:, 0] - margins[rows, self.labels]))
            rest = np.exp(margins - total)
            rest[rows, self.labels] -= 1.0
        gradient = np.empty_like(weights)
        for k in range(weights.shape[1]):
            gradient[:-1, k] = np.bincount(at, np.repeat(rest[:, k], sizes), len(weights) - 1)
        gradient[-1] = rest.sum(axis=0)
        return loss, gradient


@dataclass
class Fit:
    """State of one model between evaluations: the point reached, the direction and the step being tried.

    Weights belong to terms divided by their standard deviation, as in Spark ML; the penalty spares the
    intercepts. The step must meet the weak Wolfe conditions.
    """

    items: int
    scale: np.ndarray
    point: np.ndarray
    reg: float
    tol: float
    max_iter: int
    value: float | None = None
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 0.0
    low: float = 0.0
    high: float = np.inf
    tries: int = 0
    iterations: int = 0
    reason: str = ""
    steps: list = field(default_factory=list)
    changes: list = field(default_factory=list)
    values: list = field(default_factory=list)

    @classmethod
    def begin(cls, counts: np.ndarray, labels: np.ndarray, family: str, reg: float, tol: float, max_iter: int) -> Fit:
        """``counts``: items that hold each term; ``labels``: items of each label."""
        n = int(labels.sum())
        deviation = np.sqrt(counts / n * (n - counts) / max(n - 1, 1))
        scale = np.divide(1.0, deviation, out=np.zeros(len(counts)), where=deviation > 0)
        binomial = family == "binomial" or (family == "auto" and len(labels) == 2)
        point = np.zeros((len(counts) + 1, 1 if binomial else len(labels)))
        logs = np.log(labels)
        point[-1] = logs[1] - logs[0] if binomial else logs - logs.mean()
        return cls(n, scale, point, reg, tol, max_iter)

    def tried(self) -> np.ndarray:
        return self.point if self.direction is None else self.point + self.step * self.direction

    def weights(self) -> np.ndarray:
        """The tried point for plain terms."""
        out = self.tried().copy()
        out[:-1] *= self.scale[:, None]
        return out

    def advance(self, loss: float, gradient: np.ndarray) -> None:
        """Take in the evaluation of the tried point and choose the next one; ``reason`` says when it is the last."""
        point = self.tried()
        value = loss / self.items + 0.5 * self.reg * float(np.sum(point[:-1] ** 2))
        slopes = gradient / self.items
        slopes[:-1] = slopes[:-1] * self.scale[:, None] + self.reg * point[:-1]
        if self.direction is not None:
            along, new_along = float(np.sum(self.gradient * self.direction)), float(np.sum(slopes * self.direction))
            self.tries += 1
            if not value <= self.value + 1e-4 * self.step * along:
                self.high = self.step
            elif new_along < 0.9 * along:
                self.low = self.step
            else:
                self.low = self.high = self.step
            if self.low < self.high:
                if self.tries >= TRIES:
                    self.reason, self.direction = "line search", None
                    return
                self.step = 2 * self.step if np.isinf(self.high) else 0.5 * (self.low + self.high)
                return
            s, y = point - self.point, slopes - self.gradient
            if float(np.sum(s * y)) > 1e-300:
                self.steps, self.changes = [*self.steps[1 - MEMORY :], s], [*self.changes[1 - MEMORY :], y]
            self.iterations += 1
        self.point, self.value, self.gradient = point, value, slopes
        self.values = [*self.values[-MEMORY:], value]
        if np.abs(slopes).max() <= self.tol:
            self.reason = "gradient"
        elif len(self.values) > MEMORY and self.values[0] - value <= self.tol * abs(value):
            self.reason = "value"
        elif self.iterations >= self.max_iter:
            self.reason = "iterations"
        if self.reason:
            self.direction = None
            return
        self.direction = -self._curved(slopes)
        if float(np.sum(self.direction * slopes)) >= 0:
            self.direction, self.steps, self.changes = -slopes, [], []
        self.step = 1.0 if self.steps else 1.0 / float(np.linalg.norm(slopes))
        self.low, self.high, self.tries = 0.0, np.inf, 0

    def _curved(self, q: np.ndarray) -> np.ndarray:
        """The gradient times the inverse curvature that the kept steps imply."""
        q, shares = q.copy(), []
        pairs = list(zip(self.steps, self.changes, strict=True))
        for s, y in reversed(pairs):
            share = float(np.sum(s * q)) / float(np.sum(s * y))
            q -= share * y
            shares.append(share)
        if pairs:
            s, y = pairs[-1]
            q *= float(np.sum(s * y)) / float(np.sum(y * y))
        for (s, y), share in zip(pairs, reversed(shares), strict=True):
            q += (share - float(np.sum(y * q)) / float(np.sum(s * y))) * s
        return q


# Tables


PACKED = "model int, labels binary, starts binary, columns binary"
_PACKED = pa.schema([("model", pa.int32()), ("labels", pa.binary()), ("starts", pa.binary()), ("columns", pa.binary())])


def _pack(batches: Batches) -> Batches:
    """Rows sorted by (model, part) become one row per block."""
    key, labels, sizes, columns = None, [], [], []

    def block() -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        parts = (np.concatenate(labels).astype(np.int32), starts.astype(np.int64), np.concatenate(columns).astype(np.int32))
        return pa.RecordBatch.from_pydict(
            {"model": [key[0]], **{n: [p.tobytes()] for n, p in zip(_PACKED.names[1:], parts, strict=True)}}, schema=_PACKED
        )

    for batch in batches:
        model, part, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        terms = batch.column(3)
        size = np.diff(terms.offsets.to_numpy())
        values = terms.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = np.flatnonzero((np.diff(model) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(model)], strict=True):
            if a == b:
                continue
            if key != (int(model[a]), int(part[a])):
                if key is not None:
                    yield block()
                key, labels, sizes, columns = (int(model[a]), int(part[a])), [], [], []
            labels.append(label[a:b])
            sizes.append(size[a:b])
            columns.append(values[ends[a] : ends[b]])
    if key is not None:
        yield block()


def _block(batch: pa.RecordBatch, i: int) -> Block:
    kinds = {"labels": np.int32, "starts": np.int64, "columns": np.int32}
    return Block(**{c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in kinds.items()})


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for i in range(batch.num_rows):
        yield int(batch.column("model")[i].as_py()), _block(batch, i)


def _term_counts(batches: Batches) -> Batches:
    for batch in batches:
        for model, block in _blocks(batch):
            index, n = np.unique(block.columns, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), model, np.int32)), pa.array(index), pa.array(n)], names=["model", "index", "n"])


def _localise(batches: Batches) -> Batches:
    """Term numbers become positions among the terms of the model."""
    for batch in batches:
        found = []
        for i, (_, block) in enumerate(_blocks(batch)):
            terms = batch.column("terms")[i].values.to_numpy()
            found.append(np.searchsorted(terms, block.columns).astype(np.int32).tobytes())
        arrays = [batch.column("model"), batch.column("labels"), batch.column("starts"), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=_PACKED.names)


STATE = "model int, active boolean, trial binary, width int, fit binary"
_STATE = pa.schema([("model", pa.int32()), ("active", pa.bool_()), ("trial", pa.binary()), ("width", pa.int32()), ("fit", pa.binary())])


def _state(model: int, fit: Fit) -> pa.RecordBatch:
    """The working row of a model: what its blocks need to know, and the whole state; at the end without the past steps."""
    if fit.reason:
        fit.steps, fit.changes = [], []
    trial = b"" if fit.reason else fit.weights().tobytes()
    row = {"model": [model], "active": [not fit.reason], "trial": [trial], "width": [fit.point.shape[1]], "fit": [pickle.dumps(fit)]}
    return pa.RecordBatch.from_pydict(row, schema=_STATE)


def _begin(family: str, reg: float, tol: float, max_iter: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                fit = Fit.begin(np.array(row["counts"], float), np.array(row["items"], float), family, reg, tol, max_iter)
                yield _state(row["model"], fit)

    return run


def _fit_alone(batches: Batches) -> Batches:
    """Sorted by model, each state followed by the model's blocks: all steps at once."""
    model, fit, blocks = None, None, []

    def done() -> pa.RecordBatch:
        while not fit.reason:
            weights, loss, total = fit.weights(), 0.0, 0.0
            for block in blocks:
                value, gradient = block.evaluate(weights)
                loss, total = loss + value, total + gradient
            fit.advance(loss, total)
        return _state(model, fit)

    for batch in batches:
        states = batch.column("fit")
        for i in range(batch.num_rows):
            if states[i].is_valid:
                if model is not None:
                    yield done()
                model, fit, blocks = batch.column("model")[i].as_py(), pickle.loads(states[i].as_py()), []
            else:
                blocks.append(_block(batch, i))
    if model is not None:
        yield done()


PARTIAL = "model int, loss double, gradient binary"
_PARTIAL = pa.schema([("model", pa.int32()), ("loss", pa.float64()), ("gradient", pa.binary())])


def _evaluate(batches: Batches) -> Batches:
    """Losses and gradients of blocks, added up over neighbouring blocks of a model."""
    model, loss, total = None, 0.0, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"model": [model], "loss": [loss], "gradient": [total.tobytes()]}, schema=_PARTIAL)

    for batch in batches:
        for i, (number, block) in enumerate(_blocks(batch)):
            weights = np.frombuffer(batch.column("trial")[i].as_buffer()).reshape(-1, batch.column("width")[i].as_py())
            value, gradient = block.evaluate(weights)
            if number == model:
                loss, total = loss + value, total + gradient
            else:
                if model is not None:
                    yield done()
                model, loss, total = number, value, gradient
    if model is not None:
        yield done()


def _advance(batches: Batches) -> Batches:
    """Sorted by model, each state followed by its partial gradients; one running sum is kept."""
    model, fit, loss, total = None, None, 0.0, None

    def done() -> pa.RecordBatch:
        fit.advance(loss, total.reshape(fit.point.shape))
        return _state(model, fit)

    for batch in batches:
        for row in batch.to_pylist():
            if row["fit"] is not None:
                if model is not None:
                    yield done()
                model, fit, loss, total = row["model"], pickle.loads(row["fit"]), 0.0, 0.0
            else:
                loss, total = loss + row["loss"], total + np.frombuffer(row["gradient"])
    if model is not None:
        yield done()


SLICED = "model int, slice int, loss double, gradient binary"
_SLICED = pa.schema([("model", pa.int32()), ("slice", pa.int32()), ("loss", pa.float64()), ("gradient", pa.binary())])


def _evaluate_at(weights: Broadcast[dict[int, np.ndarray]], size: int):
    """Losses and gradients of a task's blocks at the models' weights, in slices; the loss goes with the first."""

    def run(batches: Batches) -> Batches:
        sums: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for model, block in _blocks(batch):
                loss, gradient = block.evaluate(weights.value[model])
                if model in sums:
                    loss, gradient = sums[model][0] + loss, sums[model][1] + gradient
                sums[model] = (loss, gradient)
        for model, (loss, gradient) in sums.items():
            flat = gradient.ravel()
            for i, a in enumerate(range(0, len(flat), size)):
                row = {"model": [model], "slice": [i], "loss": [0.0 if i else loss], "gradient": [flat[a : a + size].tobytes()]}
                yield pa.RecordBatch.from_pydict(row, schema=_SLICED)

    return run


def _add_slices(batches: Batches) -> Batches:
    """Sorted by (model, slice): one sum of each."""
    key, loss, total = None, 0.0, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"model": [key[0]], "slice": [key[1]], "loss": [loss], "gradient": [total.tobytes()]}, schema=_SLICED)

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["model"], row["slice"]):
                if key is not None:
                    yield done()
                key, loss, total = (row["model"], row["slice"]), 0.0, 0.0
            loss, total = loss + row["loss"], total + np.frombuffer(row["gradient"])
    if key is not None:
        yield done()


def _fit_on_driver(begun: DataFrame, blocks: DataFrame, sizes: dict[int, int]) -> DataFrame | None:
    """All steps of the models in ``sizes`` (their numbers of weights), whose states the driver holds."""
    spark = begun.sparkSession
    waiting, fits, ended = sorted(sizes), {}, []

    def written(rows: list) -> None:
        ended.append(materialize(spark.createDataFrame(rows, "model int, width int, fit binary"), "ended"))

    while waiting or fits:
        some = []
        while waiting and (not (fits or some) or sum(sizes[m] for m in [*fits, *some, waiting[0]]) <= DRIVER_WEIGHTS):
            some.append(waiting.pop(0))
        if some:
            fits |= {r.model: pickle.loads(r.fit) for r in begun.where(F.col("model").isin(some)).select("model", "fit").collect()}
        weights = spark.sparkContext.broadcast({m: fit.weights() for m, fit in fits.items()})
        partial = blocks.where(F.col("model").isin(list(fits))).mapInArrow(_evaluate_at(weights, SLICE), SLICED)
        sums = partial.repartition("model", "slice").sortWithinPartitions("model", "slice").mapInArrow(_add_slices, SLICED)
        with shuffle_clean_up(spark):
            found = sorted(sums.collect(), key=lambda r: (r.model, r.slice))
        weights.destroy()
        for model, fit in list(fits.items()):
            own = [r for r in found if r.model == model]
            gradient = np.concatenate([np.frombuffer(r.gradient) for r in own])
            fit.advance(sum(r.loss for r in own), gradient.reshape(fit.point.shape))
            if fit.reason:
                state = _state(model, fits.pop(model)).to_pylist()[0]
                written([(model, state["width"], state["fit"])])
    if not ended:
        return None
    whole = ended[0]
    for table in ended[1:]:
        whole = whole.unionByName(table)
    whole = materialize(whole, "ended")
    discard(*ended)
    return whole


CELLS = "model int, index int, label int, weight double, gain double, n long"


def _cells(batches: Batches) -> Batches:
    """Weights of finished models in long form; the intercepts have the index -1."""
    for batch in batches:
        for row in batch.to_pylist():
            fit = pickle.loads(row["fit"])
            weights = fit.weights()
            if weights.shape[1] == 1:
                weights = np.concatenate([np.zeros_like(weights), weights], axis=1)
            index = np.append(np.array(row["terms"], np.int32), -1).astype(np.int32)
            n = np.append(np.array(row["counts"], np.int64), fit.items).astype(np.int64)
            gains = weights - weights.min(axis=1, keepdims=True)
            labels = weights.shape[1]
            for a in range(0, len(index), 1 << 16):
                part = slice(a, a + (1 << 16))
                rows = len(index[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows * labels, row["model"], np.int32)), pa.array(np.repeat(index[part], labels)),
                        pa.array(np.tile(np.arange(labels, dtype=np.int32), rows)), pa.array(weights[part].ravel()),
                        pa.array(gains[part].ravel()), pa.array(np.repeat(n[part], labels)),
                    ],
                    names=["model", "index", "label", "weight", "gain", "n"],
                )


SUMMARY = "model int, items long, terms int, iterations int, loss double, slope double, reason string"


def _summary(batches: Batches) -> Batches:
    for batch in batches:
        for row in batch.to_pylist():
            fit = pickle.loads(row["fit"])
            yield pa.RecordBatch.from_pydict({
                "model": pa.array([row["model"]], pa.int32()), "items": [fit.items], "terms": pa.array([len(fit.scale)], pa.int32()),
                "iterations": pa.array([fit.iterations], pa.int32()), "loss": [fit.value], "slope": [float(np.abs(fit.gradient).max())], "reason": [fit.reason],
            })


@dataclass
class LogisticModels:
    """``classes``: level, model, parent, label, class, items. ``cells``: level, model, index, label, weight, gain, n (items
    that hold the term), intercepts under index -1. ``summary``: level, parent, items, classes, terms, iterations, loss, slope
    (the largest derivative at the end) and reason (gradient, value, iterations, line search; constant: one class)."""

    classes: DataFrame
    cells: DataFrame
    summary: DataFrame

    def linear(self) -> BayesModel:
        """The tables that ``bayes.predict`` and ``classify.cascade`` read."""
        gained = self.cells.where("index >= 0 and gain > 0").groupBy("level", "model", "index").agg(
            F.max("n").alias("frequency"),
            F.collect_list(F.struct("label", F.lit(0).cast("long").alias("seen"), "gain")).alias("cells"),
        )
        start = self.cells.where("index = -1").select("level", "model", "label", F.col("weight").alias("intercept"))
        zero = F.lit(0.0)
        classes = self.classes.join(start, ["level", "model", "label"], "left").select(
            "model", "parent", "label", "class", "items", zero.alias("prior"), F.coalesce("intercept", zero).alias("intercept"),
            zero.alias("slope"), "level",
        )
        classes = materialize(classes, "linear-classes")
        weights = materialize(gained.select("model", "index", "frequency", "cells", "level"), "linear-weights")
        return BayesModel("bernoulli", classes, weights, materialize(_class_lists(classes), "lists"))


def fit_logistic(
    features: DataFrame, levels: Sequence[Level], max_iter: int = 100, reg: float = 0.0, tol: float = 1e-6,
    family: str = "auto", block_cells: int = BLOCK_CELLS,
) -> LogisticModels:
    """One model per parent of every level, from the presence of terms in an ``item_terms`` table.

    ``auto`` is binomial for two classes and multinomial for more. ``reg`` is Spark ML's L2 penalty on standardised
    terms. Items without class or parent, or outside the level's ``keep``, take no part; a parent with one class
    has a constant. A model's weights (its terms times its classes) must fit a task.
    """
    if family not in ("auto", "multinomial"):
        raise ValueError(f"unknown family {family!r}")
    spark = features.sparkSession
    features = numbered(features)
    tables = []
    for level in levels:
        known = level.used & F.col(level.target).isNotNull() & (F.col(level.parent).isNotNull() if level.parent else F.lit(True))
        tables.append(features.where(known).select(
            F.lit(level.target).alias("level"), level.key.cast("string").alias("parent"), F.col(level.target).cast("string").alias("class"),
            ROW, F.col("terms.index").alias("index"),
        ))
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    counted = rows.groupBy("level", "parent", "class").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("index") + 1).alias("cells"))
    own = W.partitionBy("level", "parent")
    classes = counted.select(
        "level", (F.dense_rank().over(W.orderBy("level", "parent")) - 1).alias("model"), "parent",
        (F.row_number().over(own.orderBy(F.desc("items"), "class")) - 1).alias("label"), "class", "items",
        F.count(F.lit(1)).over(own).alias("classes"), F.ceil(F.sum("cells").over(own) / block_cells).cast("int").alias("parts"),
    )
    classes = materialize(classes, "logistic-classes")  # one row per category

    used = classes.where("classes > 1").select("level", "parent", "class", "model", "label", "parts")
    located = lookup_join(rows, used, ["level", "parent", "class"], salt_on=[ROW])
    dealt = located.select(
        "model", F.pmod(F.xxhash64(ROW), F.col("parts")).cast("int").alias("part"), "label", F.col("index").cast("array<int>").alias("index"), ROW
    )
    order = ["model", "part"]
    # Blocks are large and few: by the default number of partitions, or merged to that by their bytes, one task would get most of them.
    number = used.groupBy("model").agg(F.first("parts").alias("parts")).agg(F.sum("parts").cast("int")).first()[0]
    dealt = dealt.repartition(min(max(number or 0, 1), MOST_PARTS), *order)
    packed = dealt.sortWithinPartitions(*order, ROW).select("model", "part", "label", "index").mapInArrow(_pack, PACKED)
    packed = materialize(packed, "packed")

    counts = packed.mapInArrow(_term_counts, "model int, index int, n long").groupBy("model", "index").agg(F.sum("n").alias("n"))
    # at most the vocabulary per model
    terms = counts.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("index", "n"))).alias("_t"))
    labels = classes.where("classes > 1").groupBy("model").agg(F.sort_array(F.collect_list(F.struct("label", "items"))).alias("_l"), F.first("parts").alias("parts"))
    about = labels.join(terms, "model", "left").select(
        "model", "parts", F.col("_l.items").alias("items"), F.coalesce(F.col("_t.index"), F.array().cast("array<int>")).alias("terms"),
        F.coalesce(F.col("_t.n"), F.array().cast("array<bigint>")).alias("counts"),
    )
    about = materialize(about, "model-terms")
    local = packed.join(about.select("model", "terms"), "model").select(*_PACKED.names, "terms").mapInArrow(_localise, PACKED)
    blocks = materialize(local, "blocks")
    discard(packed)

    state = about.select("model", "items", "counts").mapInArrow(_begin(family, reg, tol, max_iter), STATE)
    begun = materialize(state, "begin")
    small = about.where(F.col("parts") <= ALONE).select("model")
    nothing, packs = F.lit(None).cast("binary"), ["labels", "starts", "columns"]
    alone = begun.select("model", F.lit(0).alias("kind"), "fit", *[nothing.alias(c) for c in packs]).unionByName(
        blocks.select("model", F.lit(1).alias("kind"), nothing.alias("fit"), *packs)
    )
    alone = alone.join(F.broadcast(small), "model", "left_semi").repartition(min(max(small.count(), 1), MOST_PARTS), "model")
    alone = alone.sortWithinPartitions("model", "kind").drop("kind")
    finished = [materialize(alone.mapInArrow(_fit_alone, STATE).drop("trial", "active"), "alone")]
    weighed = begun.join(about.where(F.col("parts") > ALONE).select("model"), "model", "left_semi").select(
        "model", (F.length("trial") / 8).cast("long").alias("weights")
    )
    sizes = {r.model: r.weights for r in weighed.where(F.col("weights") <= DRIVER_WEIGHTS).collect()}
    stepped = _fit_on_driver(begun, blocks, sizes)
    finished += [stepped] if stepped is not None else []
    state = begun.join(about.where(F.col("parts") > ALONE).select("model"), "model", "left_semi").where(~F.col("model").isin(list(sizes)))
    last = begun  # written table that ``state`` reads
    while True:
        size = state.where("active").agg(F.sum(F.length("trial") / 8).cast("long")).first()[0]
        if size is None:
            break
        active = state.where("active")
        trial = active.select("model", "trial", "width")
        partial = blocks.join(F.broadcast(trial) if size <= BROADCAST_WEIGHTS else trial, "model").mapInArrow(_evaluate, PARTIAL)
        both = active.select("model", F.lit(0).alias("kind"), "fit", F.lit(None).cast("double").alias("loss"), nothing.alias("gradient")).unionByName(
            partial.select("model", F.lit(1).alias("kind"), nothing.alias("fit"), "loss", "gradient")
        )
        both = both.repartition("model").sortWithinPartitions("model", "kind").drop("kind")
        state = materialize(both.mapInArrow(_advance, STATE), "step")
        ended = state.where(~F.col("active")).drop("trial", "active")
        if ended.select("model").take(1):
            finished.append(materialize(ended, "ended"))
        discard(last)
        last = state
    discard(last, blocks)
    ended = finished[0]
    for table in finished[1:]:
        ended = ended.unionByName(table)
    ended = materialize(ended, "fitted")
    discard(*finished)

    names = classes.select("level", "model").distinct()
    with_terms = ended.join(about, "model").select("model", "fit", "terms", "counts")
    cells = materialize(with_terms.mapInArrow(_cells, CELLS).join(names, "model"), "logistic-cells")
    found = ended.select("model", "fit").mapInArrow(_summary, SUMMARY).drop("items")
    models = classes.groupBy("level", "model", "parent").agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("classes"))
    summary = models.join(found, "model", "left").select(
        "level", "parent", "items", "classes", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("iterations", F.lit(0)).alias("iterations"),
        "loss", "slope", F.coalesce("reason", F.lit("constant")).alias("reason"),
    )
    return LogisticModels(classes.drop("classes", "parts"), cells, materialize(summary, "logistic-summary"))
