"""Train and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_SHARE = 0.9


def random_split(
    df: DataFrame, train: float = TRAIN_SHARE, seed: int | None = 19
) -> tuple[DataFrame, DataFrame]:
    """Random split; repeatable for the same seed and the same partitions, free with ``None``."""
    left, right = df.randomSplit([train, 1.0 - train], seed=seed)
    return left, right


def in_train(item_id: str = "item_id", train: float = TRAIN_SHARE) -> Column:
    """True for the training share of ids, by hash: independent of partitions and file layout."""
    digest = F.substring(F.md5(F.col(item_id).cast("string")), 1, 8)
    bucket = F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(10_000))
    return bucket < round(train * 10_000)


def keyed_split(
    df: DataFrame, item_id: str = "item_id", train: float = TRAIN_SHARE
) -> tuple[DataFrame, DataFrame]:
    chosen = in_train(item_id, train)
    return df.where(chosen), df.where(~chosen)
