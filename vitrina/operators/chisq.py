"""Chi-square statistic of a term's presence against a class, from non-zero cells only.

For a binary feature present in ``N_t`` of ``N`` items, with ``n_c`` items of class ``c`` of which
``o_tc`` hold the term and ``p = N_t / N``, the 2 x K contingency statistic is

    (sum over c of o_tc^2 / n_c  -  N * p^2) / (p * (1 - p))

so classes in which a term never occurs need no row. A term present in every item scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.tokens import explode_rows
from vitrina.operators.lookup import lookup_join
from vitrina.session import materialize


def chi_square(features: DataFrame, target: str) -> DataFrame:
    """``index, df, statistic`` per term of an ``item_terms`` table."""
    sizes = materialize(
        features.groupBy(target).agg(F.count(F.lit(1)).alias("n_class")), "class-sizes"
    )
    total = F.lit(float(sizes.agg(F.sum("n_class")).first()[0] or 0))
    cells = (
        explode_rows(features.select(target, "terms"), "terms", "_t")
        .groupBy(target, F.col("_t.index").alias("index"))
        .agg(F.count(F.lit(1)).alias("observed"))
    )
    per_term = (
        lookup_join(cells, sizes, [target], salt_on=["index"])
        .groupBy("index")
        .agg(
            F.sum("observed").alias("df"),
            F.sum(F.col("observed") * F.col("observed") / F.col("n_class")).alias("_sum"),
        )
    )
    share = F.col("df") / total
    statistic = F.when(F.col("df") == total, F.lit(0.0)).otherwise(
        (F.col("_sum") - total * share * share) / (share * (F.lit(1.0) - share))
    )
    return per_term.select("index", "df", statistic.alias("statistic"))


def select_terms(
    features: DataFrame, vocab: DataFrame, target: str, top: int, digits: int = 6
) -> DataFrame:
    """The ``top`` terms by statistic (rounded to ``digits``), equal ones by term.

    A presence feature has the same degrees of freedom for every term, so the statistic orders terms
    as the p-value does, without its underflow to 0.
    """
    scored = vocab.select("index", "term").join(chi_square(features, target), "index")
    return (
        scored.withColumn("statistic", F.round("statistic", digits))
        .orderBy(F.desc("statistic"), "term")
        .limit(top)
    )
