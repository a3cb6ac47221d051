"""Tokens, stop words and n-grams as native array expressions.

The bodies of higher-order functions run once per element. ``bind`` evaluates an expression once and
hands it to the body as a lambda variable, so that a long text is not tokenised again per element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def regex_tokens(text: Column | str) -> Column:
    """Lower-case, split on runs of whitespace, drop empty tokens."""
    return F.filter(F.split(F.lower(_col(text)), r"\s+"), lambda t: F.length(t) >= 1)


def plain_tokens(text: Column | str) -> Column:
    """Lower-case, split at each whitespace character; empty tokens stay, except trailing ones."""
    lowered = F.lower(_col(text))
    return F.when(lowered.rlike(r"^\s+$"), F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(lowered, r"\s+$", ""), r"\s")
    )


def without_stop_words(tokens: Column | str, stop_words: Sequence[str]) -> Column:
    """Tokens outside the list, compared without case; order and repeats stay."""
    listed = sorted({w.lower() for w in stop_words})
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(listed))


def ngrams(tokens: Column | str, n: int) -> Column:
    """Space-joined runs of ``n`` tokens; empty when there are fewer."""
    if n == 1:
        return _col(tokens)
    # A run starts at every token but the last n - 1; cheaper than a slice and a join of it per run.
    empty, unknown = F.array().cast("array<string>"), F.array(F.lit(None).cast("string"))
    return bind(
        _col(tokens),
        lambda a: F.when(F.size(a) < n, empty).otherwise(
            F.coalesce(
                F.transform(
                    F.slice(a, 1, F.greatest(F.size(a) - (n - 1), F.lit(0))),
                    lambda t, i: F.concat_ws(" ", t, *[F.get(a, i + k) for k in range(1, n)]),
                ),
                unknown,
            )
        ),
    )


def gram_size(term: Column | str) -> Column:
    """Number of words in a term; words hold no space, so 1-, 2- and 3-grams never collide."""
    term = _col(term)
    return F.length(term) - F.length(F.replace(term, F.lit(" "), F.lit(""))) + 1


def term_runs(tokens: Column | str) -> Column:
    """Distinct terms of one item with their counts, as ``array<struct<term, tf>>``.

    Sorting inside the row replaces a shuffle on (item, term).
    """
    return bind(
        F.sort_array(_col(tokens)),
        lambda s: bind(
            F.filter(
                F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))),
                lambda i: (F.size(s) > 0)
                & ((i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))),
            ),
            lambda starts: F.transform(
                starts,
                lambda p, j: F.struct(
                    F.get(s, p - 1).alias("term"),
                    (F.coalesce(F.get(starts, j + 1), F.size(s) + 1) - p)
                    .cast("bigint")
                    .alias("tf"),
                ),
            ),
        ),
    )


def explode_rows(df: DataFrame, array: Column | str, name: str) -> DataFrame:
    """One row per element; rows with an empty array vanish.

    ``explode`` on a computed column makes the optimizer push a size test below the projection, which
    evaluates the whole text chain twice. ``explode_outer`` and a null filter do not.
    """
    return df.withColumn(name, F.explode_outer(_col(array))).where(F.col(name).isNotNull())
