"""Accuracy overall and per category, as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(
    predicted: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """``items, correct, accuracy, error`` overall or per group; a null prediction is wrong."""
    right = F.coalesce(F.col(prediction) == F.col(label), F.lit(False)).cast("bigint")
    return (
        predicted.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("items"), F.sum(right).alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("items"))
        .withColumn("error", F.lit(1.0) - F.col("accuracy"))
    )


def accuracy_by_category(
    predicted: DataFrame, label: str, prediction: str = "prediction"
) -> DataFrame:
    """Accuracy over the items of each true category, in one aggregation."""
    return accuracy(predicted, label, prediction, by=[label])
