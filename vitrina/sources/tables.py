"""Listings derived from the test tables: parts as priced products, documents as long titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.sources.items import spread

# What is appended to a part's name, by p_partkey modulo the length; chosen to meet every title rule.
DECORATIONS = (
    "mm x 30cm", "' hd", "x40cm", " lts.", " kilos!", "/30 20x30", " ml & 5 m",
    "% (12) [7] envío gratis", "w 220v", ",2,3 factura A o B", " grs. Ñandú 4G", ".5 de 3,4",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title, cat_0 (type), cat_1 (type/brand), cat_2 (type/brand/size), price."""
    decoration = F.element_at(
        F.array(*[F.lit(d) for d in DECORATIONS]),
        (F.pmod("p_partkey", F.lit(len(DECORATIONS))) + 1).cast("int"),
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), decoration).alias("title"),
        F.col("p_type").alias("cat_0"),
        F.concat_ws("/", "p_type", "p_brand").alias("cat_1"),
        F.concat_ws("/", "p_type", "p_brand", F.col("p_size").cast("string")).alias("cat_2"),
        F.when(F.pmod("p_partkey", F.lit(17)) != 0, F.col("p_retailprice")).alias("price"),
    )


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part_items`` for text rules. A row takes so few bytes that a scan of millions has one or two partitions."""
    return spread(part_items(spark, sf_dir), "item_id")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title (the whole text), cat_0 (language), cat_1 (language/source), cat_2 (with the
    quality label, ``u`` when there is none), price (length)."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("u"))
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"),
        F.col("text").alias("title"),
        F.col("lang").alias("cat_0"),
        F.concat_ws("/", "lang", "source").alias("cat_1"),
        F.concat_ws("/", F.col("lang"), F.col("source"), quality).alias("cat_2"),
        F.col("n_chars").cast("double").alias("price"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as priced rows under their priority and status."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderpriority").alias("cat_0"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("cat_1"),
        F.col("o_totalprice").alias("price"),
    )


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a small hierarchy: language, language/quality, language/quality/toxicity."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels")
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("u"))
    toxic = F.coalesce(F.col("toxic").cast("string"), F.lit("u"))
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"),
        F.col("text").alias("title"),
        F.col("lang").alias("cat_0"),
        F.concat_ws("/", F.col("lang"), quality).alias("cat_1"),
        F.concat_ws("/", F.col("lang"), quality, toxic).alias("cat_2"),
        F.col("n_chars").cast("double").alias("price"),
    )


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as new items without category or price."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("item_id"), F.col("text").alias("title")
    )


def all_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the tables: part titles, documents and raw pages."""
    parts = part_titles(spark, sf_dir).select(F.lit("part").alias("kind"), "item_id", "title")
    documents = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("item_id"), F.col("text").alias("title")
    )
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("item_id"), F.col("html").alias("title")
    )
    return parts.unionByName(documents).unionByName(pages)
