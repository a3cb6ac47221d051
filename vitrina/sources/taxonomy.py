"""Category names: ingest of a category tree and enrichment of titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.operators.lookup import lookup_join
from vitrina.session import materialize

# An id and the name next to it; the wide form also takes accented letters and spaces.
PLAIN_PAIR = r'"id":"(\w+)","name":"(\w+)"'
WIDE_PAIR = r'"id":"(\w+)","name":"([\wÀ-ÿ\s]+)"'


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of tree text, one row per file."""
    return spark.read.text(path, wholetext=True)


def category_names(trees: DataFrame, text: str = "value", pattern: str = WIDE_PAIR) -> DataFrame:
    """``id, name`` pairs found in JSON text at any depth; of a repeated id the pair furthest into its
    text counts."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("id"),
        F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)).alias("name"),
    )
    found = trees.select(F.posexplode(pairs).alias("_at", "_p")).select(
        "_at", F.col("_p.id").alias("id"), F.col("_p.name").alias("name")
    )
    return found.groupBy("id").agg(
        F.max_by("name", F.struct("_at", "name")).alias("name")
    )


CHILD = "struct<id:string,name:string,children_categories:string>"


def category_tree(trees: DataFrame, text: str = "value") -> DataFrame:
    """``id, name, parent, depth, path, names``: every category of nested JSON texts, of any depth.

    A text is a category or an array of them with ``id``, ``name`` and ``children_categories``. ``path`` holds the
    ids from the root to the category, ``names`` their names. The texts are opened level by level, each level by
    one written table, so there are as many jobs as levels. Nested text has no cycles; of an id that occurs at several
    places the one with the least depth, then the least path and name counts, with its ancestors there. Categories without an id, and
    texts that are not JSON, are left out with all below them.
    """
    whole = F.trim(F.col(text))
    listed = F.when(whole.startswith("["), whole).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    nothing = F.array().cast("array<string>")
    open_ = trees.select(listed.alias("_kids"), nothing.alias("path"), nothing.alias("names"))
    levels = []
    while True:
        child = F.explode(F.from_json("_kids", f"array<{CHILD}>")).alias("_c")
        level = open_.select(child, "path", "names").where("_c.id is not null").select(
            "_c.id", "_c.name", F.element_at("path", -1).alias("parent") if levels else F.lit(None).cast("string").alias("parent"),
            F.lit(len(levels)).alias("depth"), F.concat("path", F.array("_c.id")).alias("path"),
            F.concat("names", F.array(F.coalesce("_c.name", F.lit("")))).alias("names"), F.col("_c.children_categories").alias("_kids"),
        )
        # the same category in many texts is opened once
        level = materialize(level.distinct(), "tree-level")
        if not level.take(1):
            break
        levels.append(level.drop("_kids"))
        open_ = level.where("_kids is not null").select("_kids", "path", "names")
    if not levels:
        return level.drop("_kids")
    found = levels[0]
    for table in levels[1:]:
        found = found.unionByName(table)
    node = F.struct("depth", "path", "names", "name", "parent")
    return found.groupBy("id").agg(F.min(node).alias("_n")).select("id", "_n.name", "_n.parent", "_n.depth", "_n.path", "_n.names")


def enrich_by_ancestors(items: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    """Append the names on the way from the root to an item's category to its title; unknown categories add nothing."""
    table = materialize(tree.select(F.col("id").alias(column), F.array_join("names", " ").alias("_way")), "ways")
    df = lookup_join(items, table, [column], how="left", salt_on=["item_id"])
    return df.withColumn("title", F.concat_ws(" ", "title", "_way")).select(*items.columns)


def enrich_titles(
    items: DataFrame, names: DataFrame, columns: Sequence[str] = ("cat_0", "cat_1", "cat_2")
) -> DataFrame:
    """Append the names of an item's categories to its title, an empty string when unknown."""
    names = materialize(names.select("id", "name"), "category-names")
    df, parts = items, [F.col("title")]
    for i, column in enumerate(columns):
        table = names.select(F.col("id").alias(column), F.col("name").alias(f"_name_{i}"))
        df = lookup_join(df, table, [column], how="left", salt_on=["item_id"])
        parts.append(F.coalesce(F.col(f"_name_{i}"), F.lit("")))
    return df.withColumn("title", F.concat_ws(" ", *parts)).select(*items.columns)
