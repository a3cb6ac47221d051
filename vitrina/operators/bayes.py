"""Naive Bayes as tables: every model of a hierarchy level is fitted by one grouped aggregation.

A level has a parent column (the model's key; none for the root) and a class column. Two tables hold
all models of all levels:

* ``classes``: level, model, parent, label, class, items, prior, intercept, slope
* ``weights``: level, model, index (of the term), cells ``array<struct<label, seen, gain>>``

``model`` numbers the parents of a level, so that the large joins run on integers. A class scores
``intercept + m * slope + sum of gains`` where ``m`` is the number of known terms of the item (with
repeats for the multinomial kind). Terms never seen in a class are covered by ``slope``, so only
non-zero cells are stored.

Gains are positive. So the winner is either a class with at least one gain or the best class without
any, and scoring needs only the cells that match plus one pass over the parent's class list inside
the row. Items are never multiplied by all classes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrina.functions.tokens import explode_rows
from vitrina.operators.lookup import fits_broadcast, lookup_join
from vitrina.operators.vocabulary import ROW
from vitrina.session import discard, materialize

TABLES = ("classes", "weights", "lists")
ROOT = ""  # the parent key of a root model
MAX_BROADCAST_CELLS = 4_000_000  # sent to every task at once, 12 bytes each and as much again for free room
ROW_COST = 4  # a row of weights takes the room of this many cells
SCORE_DIGITS = 6  # scores are compared after rounding, equal ones go to the lower label


def numbered(features: DataFrame) -> DataFrame:
    """The same rows with a ``row_id``, which ``item_terms`` gives; other tables are written with one."""
    if ROW in features.columns:
        return features
    return materialize(features.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


@dataclass(frozen=True)
class Level:
    """One model per value of ``parent`` over the values of ``target``.

    ``keep`` names a boolean column that says which items the level is trained on.
    """

    target: str
    parent: str | None = None
    keep: str | None = None

    @property
    def key(self) -> Column:
        return F.col(self.parent) if self.parent else F.lit(ROOT)

    @property
    def used(self) -> Column:
        return F.coalesce(F.col(self.keep), F.lit(False)) if self.keep else F.lit(True)


@dataclass
class BayesModel:
    """Fitted tables; ``lists`` holds per model its classes in label order, for scoring."""

    kind: str
    classes: DataFrame
    weights: DataFrame
    lists: DataFrame

    def save(self, path: str) -> None:
        """All tables under one folder, each with one folder per level."""
        for name in TABLES:
            table: DataFrame = getattr(self, name)
            target = f"{path.strip()}/{self.kind}/{name}"
            table.write.mode("overwrite").partitionBy("level").parquet(target)

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: str) -> BayesModel:
        root = f"{path.strip()}/{kind}"
        return cls(kind, *[spark.read.parquet(f"{root}/{name}") for name in TABLES])


def fit_bayes(
    features: DataFrame,
    levels: Sequence[Level],
    vocabulary_size: int,
    kind: str = "bernoulli",
    smoothing: float = 1.0,
) -> BayesModel:
    """Fit every model of every level from an ``item_terms`` table.

    Terms are exploded once and counted per finest category, under an integer key; each level is a
    roll-up of that table. Nothing but the size of the result depends on the number of categories.
    """
    if kind not in ("bernoulli", "multinomial"):
        raise ValueError(f"unknown kind {kind!r}")
    features = numbered(features)
    names = list(dict.fromkeys(c for lv in levels for c in (lv.parent, lv.target) if c))
    used = [f"use_{i}" for i in range(len(levels))]
    flags = [
        (lv.used & F.col(lv.target).isNotNull() & (F.col(lv.parent).isNotNull() if lv.parent else F.lit(True)))
        .cast("int").alias(u)
        for lv, u in zip(levels, used, strict=True)
    ]

    def comparable(df: DataFrame) -> DataFrame:
        """Categories as join keys that match where both are null."""
        keys = {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in names}
        return df.withColumns(keys)


    # One row per finest category with its number and its item count at each level.
    paths = features.select(*names, *flags).groupBy(*names).agg(
        *[F.sum(u).cast("bigint").alias(u) for u in used]
    )
    paths = materialize(
        paths.withColumn("path", F.row_number().over(W.orderBy(*names))), "paths"
    )
    weight = F.lit(1) if kind == "bernoulli" else F.col("_t.tf")
    located = lookup_join(
        comparable(features.select(ROW, *names, *flags, "terms")),
        comparable(paths.select(*names, "path")),
        names,
        salt_on=[ROW],
    )
    cells = materialize(
        explode_rows(located.select("path", *used, "terms"), "terms", "_t")
        .groupBy("path", F.col("_t.index").alias("index"))
        .agg(*[F.sum(F.col(u) * weight).cast("bigint").alias(u) for u in used]),
        "cells",
    )

    lam, size = F.lit(float(smoothing)), F.lit(float(vocabulary_size))
    n, seen = F.col("items"), F.col("seen")
    every = [_known_classes(paths, level, u, lam) for level, u in zip(levels, used, strict=True)]
    every = materialize(_union(every), "known-classes", ["level"])
    known = [every.where(F.col("level") == level.target).drop("level") for level in levels]

    weight_tables = []
    for level, u, table in zip(levels, used, known, strict=True):
        located_paths = paths.select(
            "path", level.key.alias("parent"), F.col(level.target).alias("class")
        ).join(table.select("parent", "class", "model", "label", "items"), ["parent", "class"])
        located_paths = located_paths.select("path", "model", "label", "items")
        counts = (
            lookup_join(
                cells.where(F.col(u) > 0).select("path", "index", F.col(u).alias("c")),
                located_paths,
                ["path"],
            )
            # One distribution for both aggregations; a key has at most one row per category.
            .repartition("model", "index")
            .groupBy("model", "label", "index")
            .agg(F.sum("c").alias("seen"), F.first("items").alias("items"))
            .where(seen > 0)
        )
        if kind == "bernoulli":
            gain = F.log((seen + lam) / (n - seen + lam)) - F.log(lam / (n + lam))
        else:
            gain = F.log((seen + lam) / lam)
        weight_tables.append(
            counts.groupBy("model", "index")
            .agg(
                F.sum("seen").alias("frequency"),
                F.collect_list(F.struct("label", "seen", gain.alias("gain"))).alias("cells"),
            )
            .withColumn("level", F.lit(level.target))
        )
    weights = materialize(_union(weight_tables), "weights", ["level"])

    class_tables = []
    for level, table in zip(levels, known, strict=True):
        seen_cells = (
            weights.where(F.col("level") == level.target)
            .select("model", F.explode_outer("cells").alias("_c"))
            .select("model", "_c.label", "_c.seen")
        )
        if kind == "bernoulli":
            per_class = (
                seen_cells.join(table.select("model", "label", "items"), ["model", "label"])
                .groupBy("model", "label")
                .agg(
                    F.count(F.lit(1)).alias("_seen"),
                    F.sum(F.log((n - seen + lam) / (n + 2 * lam))).alias("_absent"),
                )
            )
            intercept = (
                F.col("prior")
                + (size - F.coalesce("_seen", F.lit(0))) * F.log((n + lam) / (n + 2 * lam))
                + F.coalesce("_absent", F.lit(0.0))
            )
            slope = F.log(lam / (n + lam))
        else:
            per_class = seen_cells.groupBy("model", "label").agg(F.sum("seen").alias("_tokens"))
            intercept = F.col("prior")
            slope = F.log(lam) - F.log(F.coalesce("_tokens", F.lit(0)) + size * lam)
        class_tables.append(
            table.join(per_class, ["model", "label"], "left").select(
                "model", "parent", "label", "class", "items", "prior",
                intercept.alias("intercept"), slope.alias("slope"),
                F.lit(level.target).alias("level"),
            )
        )
    classes = materialize(_union(class_tables), "classes", ["level"])
    return BayesModel(kind, classes, weights, materialize(_class_lists(classes), "lists", ["level"]))


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _known_classes(paths: DataFrame, level: Level, used: str, lam: Column) -> DataFrame:
    """Classes of one level with item count, label (most frequent first), model number and prior."""
    group = W.partitionBy("parent")
    counted = (
        paths.groupBy(level.key.alias("parent"), F.col(level.target).alias("class"))
        .agg(F.sum(used).alias("items"))
        .where(F.col("items") > 0)
    )
    return counted.select(
        F.lit(level.target).alias("level"),
        (F.dense_rank().over(W.orderBy("parent")) - 1).alias("model"),
        "parent",
        "class",
        "items",
        (F.row_number().over(group.orderBy(F.desc("items"), "class")) - 1).alias("label"),
        (
            F.log(F.col("items") + lam)
            - F.log(F.sum("items").over(group) + F.count(F.lit(1)).over(group) * lam)
        ).alias("prior"),
    )


def conditional_weights(model: BayesModel) -> DataFrame:
    """The stored cells in long form: ``level, parent, class, index, seen, gain``."""
    cells = model.weights.select("level", "model", "index", F.explode("cells").alias("_c"))
    cells = cells.select("level", "model", "index", "_c.label", "_c.seen", "_c.gain")
    names = model.classes.select("level", "model", "label", "parent", "class")
    return cells.join(names, ["level", "model", "label"]).select(
        "level", "parent", "class", "index", "seen", "gain"
    )


def predict(
    features: DataFrame,
    model: BayesModel,
    level: str,
    parent: Column | None = None,
    carry: Sequence[str] = (),
    item_id: str = "item_id",
    by_row: bool = False,
    max_cells: int = MAX_BROADCAST_CELLS,
) -> DataFrame:
    """Predicted class of every item at one level.

    ``features`` holds the item id and ``terms``; ``parent`` picks the model of each item (the root
    model if not given). The result has the item id, the ``carry`` columns, ``prediction``, ``label``
    and ``score``; an item whose parent has no model gets nulls.

    Rows are told apart by ``row_id``, so item ids may be null or repeated: as many rows come out as go in.
    The terms are distributed by it once (not again if ``by_row`` says that they are); with broadcast weights both
    aggregations below reuse that distribution. Weights of more than ``max_cells`` cells are scored in passes over
    some models at a time, so neither the driver nor a task holds more of them at once.
    """
    features, keep_row = numbered(features), ROW in carry
    carry = [c for c in carry if c != ROW]
    weights = model.weights.where(F.col("level") == level)
    terms = F.col("terms")
    if model.kind == "bernoulli":
        known = F.size(terms).cast("double")
    else:
        known = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["tf"])
    lists = model.lists.where(F.col("level") == level)
    items = lookup_join(
        features.select(
            ROW, item_id, *carry, (parent if parent is not None else F.lit(ROOT)).alias("parent"),
            known.alias("_m"), "terms",
        ),
        lists.select("parent", "model"),
        ["parent"],
        how="left",
        salt_on=[ROW],
    )
    tokens = items.select(ROW, "model", "terms").where(F.col("model").isNotNull())
    # Labels and gains are all that scoring reads; as arrays of their own a cell takes 12 bytes, as a struct 40.
    scored = weights.select("model", "index", "frequency", F.col("cells.label").alias("labels"), F.col("cells.gain").alias("cell_gains"))
    cost = F.size("labels") + ROW_COST
    sizes = scored.groupBy("model").agg(F.sum(cost).alias("_size"))  # one row per parent category
    before = F.coalesce(F.sum("_size").over(W.orderBy("model").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    passes = sizes.select("model", F.floor(before * 2 / max_cells).cast("int").alias("_pass"))

    def summed_gains(tokens: DataFrame, weights: DataFrame, dealt: bool) -> DataFrame:
        """Per row the sum of gains of each label."""
        found = (
            (tokens if dealt else tokens.repartition(ROW))
            .select(ROW, "model", F.explode_outer("terms").alias("_t"))
            .select(ROW, "model", F.col("_t.index").alias("index"), F.col("_t.tf").alias("tf"))
            .where(F.col("index").isNotNull())
        )
        matched = lookup_join(
            found, weights, ["model", "index"], frequency="frequency", size=cost, max_rows=max_cells
        ).select(ROW, "tf", "cell_gains", F.posexplode("labels").alias("_at", "label"))
        gain = F.get("cell_gains", F.col("_at"))
        if model.kind == "multinomial":
            gain = gain * F.col("tf")
        return (
            matched.groupBy(ROW, "label")
            .agg(F.sum(gain).alias("gain"))
            .groupBy(ROW)
            .agg(F.collect_list(F.struct("label", "gain")).alias("_gains"))
        )

    if fits_broadcast(scored, max_cells, cost):
        gains = summed_gains(tokens, scored, by_row)
    else:
        # An item has one model, so models are scored some at a time, each time with no more weights than may be sent.
        passes = materialize(passes, "passes")
        numbers = [r[0] for r in passes.select("_pass").distinct().orderBy("_pass").collect()]
        dealt = materialize(lookup_join(tokens, passes, ["model"], salt_on=[ROW]), "pass-items", ["_pass"])
        parts = []
        for number in numbers:
            some = scored.join(F.broadcast(passes.where(F.col("_pass") == number).select("model")), "model", "left_semi")
            some = materialize(some, "pass-weights")
            parts.append(materialize(summed_gains(dealt.where(F.col("_pass") == number).drop("_pass"), some, False), "gains"))
            discard(some)
        discard(dealt)
        gains = _union(parts)

    def candidate(cls: Column, gain: Column) -> Column:
        score = cls["intercept"] + F.col("_m") * cls["slope"] + gain
        return F.struct(
            F.round(score, SCORE_DIGITS).alias("score"),
            (-cls["label"]).alias("order"),
            cls["class"].alias("class"),
        )

    without_gain = F.array_max(F.transform("list", lambda cls: candidate(cls, F.lit(0.0))))
    with_gain = F.array_max(
        F.transform("_gains", lambda g: candidate(F.get(F.col("list"), g["label"]), g["gain"]))
    )
    best = F.greatest(without_gain, with_gain)
    summed = items.select(ROW, item_id, *carry, "model", "_m").join(gains, ROW, "left")
    # Class lists join last, so that no shuffle repeats them per item.
    listed = lookup_join(
        summed, lists.select("model", "list"), ["model"], how="left", salt_on=[ROW],
        size=F.size("list"),
    )
    rows = [ROW] if keep_row else []
    return listed.select(*rows, item_id, *carry, best.alias("_best")).select(
        *rows,
        item_id,
        *carry,
        F.col("_best.class").alias("prediction"),
        (-F.col("_best.order")).alias("label"),
        F.col("_best.score").alias("score"),
    )


def _class_lists(classes: DataFrame) -> DataFrame:
    """Per level and model: the parent and its classes in label order."""
    entry = F.struct("label", "class", "intercept", "slope")
    return classes.groupBy("level", "model", "parent").agg(
        F.sort_array(F.collect_list(entry)).alias("list")
    )
