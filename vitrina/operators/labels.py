"""Label indices: the most frequent label is 0, equal counts follow the alphabet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrina.operators.lookup import lookup_join
from vitrina.session import materialize


def label_index(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``label_index, label, n`` per group; one row per distinct label reaches the window."""
    counts = df.groupBy(*by, F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy(*by) if by else W
    order = group.orderBy(F.desc("n"), F.col("label"))
    return counts.select(*by, (F.row_number().over(order) - 1).alias("label_index"), "label", "n")


def level_indices(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Label indices of several levels, counted over the whole set in one pass."""
    level = F.explode(
        F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("label")) for c in columns])
    )
    return label_index(df.select(level.alias("_l")).select("_l.*"), "label", ["level"])


def index_labels(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Attach the index of ``column``; rows with an unknown label are dropped."""
    table = materialize(
        labels.select(F.col("label").alias(column), F.col("label_index").alias(name)), "labels"
    )
    return lookup_join(df, table, [column])


def decode_labels(df: DataFrame, labels: DataFrame, index: str, name: str) -> DataFrame:
    """Attach the label of an index column."""
    table = materialize(
        labels.select(F.col("label_index").alias(index), F.col("label").alias(name)), "labels"
    )
    return lookup_join(df, table, [index], how="left")


def label_catalogue(labels: DataFrame) -> DataFrame:
    """Number of labels next to each label."""
    everything = W.partitionBy(F.lit(1))
    return labels.select(F.count(F.lit(1)).over(everything).alias("labels"), "label_index", "label")


def one_hot(index: Column, size: int, drop_last: bool = True) -> Column:
    """Indicator array of an index; the last label is all zeros with ``drop_last``."""
    width = size - 1 if drop_last else size
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0)),
    )
