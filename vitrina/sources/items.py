"""Item schemas, scans and binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("cat_0", T.StringType()),
        T.StructField("cat_1", T.StringType()),
        T.StructField("cat_2", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]
)
FLAT_ITEM = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("category", T.StringType())]
)
CATEGORIES = ("cat_0", "cat_1", "cat_2")


def read_items(
    spark: SparkSession, path: str, schema: T.StructType = ITEM, partitions: int | None = None
) -> DataFrame:
    """JSON lines under a path or glob, local or in an object store.

    The schema is given, so no pass is spent on inference. Credentials of an object store belong to
    the session's Hadoop settings or the environment. ``partitions`` shuffles the rows into a fixed
    number of partitions; normally the scan and adaptive execution choose better.
    """
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle the rows only if the scan has fewer partitions than the session has cores.

    A large scan already has more and stays as it is; a small unsplittable file would keep one core
    busy with all the text rules.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def read_untyped(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an inferred schema."""
    return spark.read.json(path)


def parse_items(df: DataFrame, column: str, schema: T.StructType = ITEM) -> DataFrame:
    """Items from a column of JSON text, next to the other columns."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.from_json(column, schema).alias("_item")).select(*others, "_item.*")


def as_items(
    df: DataFrame, schema: T.StructType = ITEM, keep_extra: bool = False
) -> DataFrame:
    """Bind columns by name to an item schema; missing names fail, other columns may stay."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing from {df.columns}")
    bound = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    extra = [c for c in df.columns if c not in schema.names] if keep_extra else []
    return df.select(*extra, *bound)
