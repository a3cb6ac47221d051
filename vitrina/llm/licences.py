"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of words is hashed and joined with the positions of the same k-gram in the
templates. A match at word ``p`` of a text and position ``t`` of a template votes for the diagonal
``p - t``; votes are kept as a bitmap of template positions, so repeated rows and partial aggregates
never count twice. Neighbouring diagonals (words put in or left out) are merged, and a span counts when
its bitmap covers enough of the template. The words are compared in the join, so no hash collision counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``gap``: how far apart diagonals are that belong together; ``cover``: share of k-grams needed."""

    label: str
    text: str
    base: bool = False
    gap: int = 2
    cover: float = 0.7


def phrase(label: str, text: str) -> Template:
    """A phrase whose words must stand consecutively."""
    return Template(label, text, base=True, gap=0, cover=1.0)


#: Phrases of the contract, then usual notices and sentences of public licenses.
TEMPLATES = (
    phrase("mit", "mit license"),
    phrase("apache", "apache license"),
    phrase("gpl", "general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
)


def template_grams(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple]:
    """(template, position, first word, second word) of every k-gram; at most 62 per template."""
    rows = []
    for number, template in enumerate(templates):
        words = template.text.split()
        if not K <= len(words) <= 63:
            raise ValueError(f"a template has {K} to 63 words: {template.text!r}")
        rows += [(number, t, *words[t : t + K]) for t in range(len(words) - K + 1)]
    return rows


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """License labels of every row of ``df`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: places of
    the base phrases, the smallest and largest start, labels of base phrases and of all templates,
    and the largest share of a template that was found. Null and empty texts have no words; a null doc_id is
    kept; repeated rows are returned as often as they occur; an empty table stays empty.
    """
    spark = df.sparkSession
    grams = spark.createDataFrame(template_grams(templates), "template int, t int, a string, b string")
    grams = grams.select("template", "t", "a", "b", F.xxhash64("a", "b").alias("h"))
    about = spark.createDataFrame(
        [(i, x.label, x.base, x.gap, x.cover, len(x.text.split()) - K + 1) for i, x in enumerate(templates)],
        "template int, label string, base boolean, gap int, cover double, grams int",
    )
    doc = ["doc_id", "text_hash", "n_words"]
    texts = df.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
    first = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    rolled = texts.select(
        "doc_id", "text_hash", F.size("w").alias("n_words"), F.posexplode(F.concat(first, pairs)).alias("p", "g")
    ).select(*doc, (F.col("p") - 1).alias("p"), F.col("g.a").alias("x"), F.col("g.b").alias("y"))
    same = (F.xxhash64("x", "y") == F.col("h")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
    votes = (
        rolled.join(F.broadcast(grams), same, "left")
        .where("p = -1 or t is not null")
        .select(*doc, "template", (F.col("p") - F.col("t")).alias("diagonal"), F.expr("shiftleft(1L, t)").alias("bit"))
        .groupBy(*doc, "template", "diagonal")
        .agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(about), "template", "left")
    )
    along = Window.partitionBy(*doc, "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("gap")).cast("int"), F.lit(1))
    spans = (
        votes.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(along))
        .groupBy(*doc, "template", "label", "base", "cover", "grams", "span")
        .agg(F.bit_or("bits").alias("bits"), F.min("diagonal").alias("start"), F.sum("n").alias("n"))
        .withColumn("share", F.bit_count("bits") / F.col("grams"))
        .withColumn("found", F.col("share") >= F.col("cover"))
    )
    place = F.when(F.col("base") & F.col("found"), F.col("start"))

    def listed(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    return (
        spans.groupBy(*doc)
        .agg(
            F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("copies"),
            F.count(place).alias("n_base"),
            F.min(place).cast("long").alias("first_word"),
            F.max(place).cast("long").alias("last_word"),
            listed(F.col("base") & F.col("found")).alias("base_labels"),
            listed(F.col("found")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word",
            "base_labels", "labels", "score",
        )
    )
