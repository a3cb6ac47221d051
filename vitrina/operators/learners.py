"""Classifiers of Spark ML with the settings used for listings, flat or one per category."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    IndexToString,
    StringIndexer,
    StringIndexerModel,
    UnivariateFeatureSelector,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.operators.price import trim_by_percentile
from vitrina.session import materialize, new_path

COLUMNS = {"featuresCol": "features", "labelCol": "label"}


def naive_bayes(kind: str = "bernoulli", smoothing: float = 1.0) -> NaiveBayes:
    return NaiveBayes(modelType=kind, smoothing=smoothing, **COLUMNS)


def logistic_regression(family: str = "auto", **options) -> LogisticRegression:
    """``auto`` is binomial for two classes and multinomial for more."""
    return LogisticRegression(family=family, **COLUMNS, **options)


def random_forest(depth: int = 5, trees: int = 100, seed: int = 19) -> RandomForestClassifier:
    return RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=seed, **COLUMNS)


def decision_tree(depth: int = 30, seed: int = 19) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed, **COLUMNS)


def index_labels_model(df: DataFrame, target: str) -> StringIndexerModel:
    """Most frequent label first, ties by the alphabet; unknown labels are skipped."""
    return StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip").fit(df)


def fit_classifier(
    df: DataFrame, target: str, learner: Estimator, labels: StringIndexerModel | None = None
) -> PipelineModel:
    """Label index, learner and label decoder as one prediction pipeline.

    Only learner and decoder are part of the result, so that items without a category can be
    scored. With ``labels`` given, its index is used instead of one fitted on ``df``.
    """
    labels = labels or index_labels_model(df, target)
    decoder = IndexToString(inputCol="prediction", outputCol="category", labels=labels.labels)
    fitted = learner.fit(labels.transform(df))
    return PipelineModel(stages=[fitted, decoder])


def fit_perceptron(
    df: DataFrame, target: str, selected: int = 50, block_size: int = 256, seed: int = 19,
    max_iter: int = 100,
) -> PipelineModel:
    """Network with one hidden layer of half the inputs over the best ``selected`` features.

    Labels are indexed first, then features are selected by chi-square, then the network is fitted.
    """
    labels = index_labels_model(df, target)
    labelled = labels.transform(df)
    selector = (
        UnivariateFeatureSelector(
            featuresCol="features", labelCol="label", outputCol="selected",
            selectionMode="numTopFeatures",
        )
        .setFeatureType("categorical")
        .setLabelType("categorical")
        .setSelectionThreshold(selected)
        .fit(labelled)
    )
    inputs = len(selector.selectedFeatures)
    network = MultilayerPerceptronClassifier(
        layers=[inputs, max(inputs // 2, 1), len(labels.labels)], blockSize=block_size,
        featuresCol="selected", labelCol="label", seed=seed, maxIter=max_iter,
    )
    decoder = IndexToString(inputCol="prediction", outputCol="category", labels=labels.labels)
    return PipelineModel(stages=[selector, network.fit(selector.transform(labelled)), decoder])


def _folder(value: str | None) -> str:
    """A group's folder key: never empty, and a null group differs from every text."""
    return "null" if value is None else f"={value}"


def _by_group(df: DataFrame, group: str, name: str) -> DataFrame:
    """Rows written with one folder per group, null and empty ones included.

    The rebalance hint gathers a small group into few files and lets adaptive execution split the
    partition of a dominant one.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("null"))
    rows = df.withColumn("_group", key).hint("rebalance", "_group")
    return materialize(rows, name, ["_group"])


@dataclass
class GroupModels:
    """One pipeline per group; a group with a single class has a constant instead."""

    group: str | None
    target: str
    models: dict[str | None, PipelineModel] = field(default_factory=dict)
    constants: dict[str | None, str] = field(default_factory=dict)

    def transform(self, df: DataFrame, group: str | None = None, threads: int = 4) -> DataFrame:
        """Attach ``category``; every group's rows go through its own pipeline.

        Rows are written once by group, so each pipeline reads its own folder only. The groups are
        scored as separate jobs, a few at a time: one plan over thousands of pipelines would not be
        planned in reasonable time. A null group is a group like any other; rows of groups without a model get
        a null category.
        """
        group = group or self.group
        spark, columns = df.sparkSession, df.columns
        schema = T.StructType([*df.schema.fields, T.StructField("category", T.StringType())])
        rows = _by_group(df, group, "rows-by-group") if group else df
        root = new_path(spark, "scored")

        def write(number: int, scored: DataFrame) -> str:
            path = f"{root}/{number}"
            scored.select(*columns, "category").write.parquet(path)
            return path

        def score(number: int, key: str | None) -> str:
            own = rows.where(F.col("_group") == _folder(key)) if group else rows
            return write(number, self.models[key].transform(own))

        keys = sorted(self.models, key=_folder)
        with ThreadPoolExecutor(max_workers=threads) as pool:
            paths = list(pool.map(score, range(len(keys)), keys))
        if self.constants:
            value = F.create_map(*[F.lit(x) for k, v in self.constants.items() for x in (_folder(k), v)])
            own = rows.where(F.col("_group").isin([_folder(k) for k in self.constants])) if group else rows
            key = F.col("_group") if group else F.lit(_folder(""))
            paths.append(write(len(keys), own.withColumn("category", F.element_at(value, key))))
        if group:
            known = [_folder(k) for k in (*self.models, *self.constants)]
            none = rows.where(~F.col("_group").isin(known))
            paths.append(write(len(keys) + 1, none.withColumn("category", F.lit(None).cast("string"))))
        return spark.read.schema(schema).parquet(*paths)


def fit_per_group(
    df: DataFrame,
    group: str | None,
    target: str,
    learner: Callable[[], Estimator],
    trim: tuple[float, float] | None = (5, 95),
    labels: StringIndexerModel | None = None,
    threads: int = 4,
) -> GroupModels:
    """One model per value of ``group`` for iterative learners, a few fits at a time.

    The rows are trimmed for all groups in one job and written partitioned by group, so each fit
    reads its own folder only and is itself a distributed Spark job. The driver sees the list of
    groups and classes, never rows. Null, empty and odd group names have models of their own; a group in which no
    row has a class has none. ``logistic.fit_logistic`` fits logistic regressions of all groups in one loop.
    """
    kept = trim_by_percentile(df, *trim, by=[group] if group else []) if trim else df
    kept = kept.select(*dict.fromkeys([c for c in (group, target, "features") if c]))
    if group:
        kept = _by_group(kept, group, "group-rows")
        key, folder = F.col(f"`{group}`").cast("string"), F.col("_group")
    else:
        kept = materialize(kept, "group-rows")
        key, folder = F.lit(""), F.lit("")
    classes = (
        kept.groupBy(key.alias("key"), folder.alias("folder"))
        .agg(F.countDistinct(target).alias("classes"), F.min(target).alias("only"))
        .collect()
    )
    result = GroupModels(group, target)
    result.constants = {r.key: r.only for r in classes if r.classes == 1}
    keys = [r.key for r in classes if r.classes > 1]

    def fit(value: str | None) -> PipelineModel:
        rows = kept.where(F.col("_group") == _folder(value)) if group else kept
        return fit_classifier(rows, target, learner(), labels)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        result.models = dict(zip(keys, pool.map(fit, keys), strict=True))
    return result


def fit_levels(
    df: DataFrame,
    levels: Sequence[str],
    learner: Callable[[], Estimator],
    root_trim: tuple[float, float] | None = (2, 98),
    child_trim: tuple[float, float] | None = (5, 95),
    label_scope: str = "global",
    threads: int = 4,
) -> list[GroupModels]:
    """Hierarchical training with an iterative learner at every level.

    ``label_scope="global"`` indexes each level's labels once over the whole set, ``"group"`` per
    parent category.
    """
    fitted = []
    for depth, target in enumerate(levels):
        parent = levels[depth - 1] if depth else None
        labels = index_labels_model(df, target) if label_scope == "global" else None
        trim = child_trim if depth else root_trim
        fitted.append(fit_per_group(df, parent, target, learner, trim, labels, threads))
    return fitted
