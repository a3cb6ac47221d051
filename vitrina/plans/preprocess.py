"""From titles to terms: the preprocessing shared by all classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    CountVectorizer,
    NGram,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.normalize import normalize_title
from vitrina.functions.stopwords import listing_stop_words
from vitrina.functions.tokens import ngrams, plain_tokens, regex_tokens, without_stop_words
from vitrina.operators.vocabulary import GRAM_LIMITS, Limits


def with_words(
    items: DataFrame,
    title: str = "title",
    version: str | None = "v4",
    words: str = "words",
    plain: bool = False,
) -> DataFrame:
    """Attach the tokens of the normalised title (``version=None`` takes the title as it is).

    ``plain`` splits at each whitespace character and keeps empty tokens.
    """
    text = normalize_title(title, version) if version else F.col(title)
    return items.withColumn(words, plain_tokens(text) if plain else regex_tokens(text))


def terms_of(
    words: str,
    grams: Sequence[int] = (1,),
    stop_words: Sequence[str] | None = None,
    ngram_source: str = "raw",
) -> Column:
    """Words without stop words, plus n-grams, as one array.

    ``ngram_source="raw"`` builds n-grams from all words, ``"filtered"`` from the words that remain
    after the stop list.
    """
    listed = listing_stop_words() if stop_words is None else list(stop_words)
    kept = without_stop_words(words, listed) if listed else F.col(words)
    source = {"raw": F.col(words), "filtered": kept}[ngram_source]
    return F.concat(*[kept if n == 1 else ngrams(source, n) for n in grams])


def with_terms(
    items: DataFrame,
    grams: Sequence[int] = (1,),
    stop_words: Sequence[str] | None = None,
    ngram_source: str = "raw",
    version: str | None = "v4",
    plain: bool = False,
) -> DataFrame:
    """Replace the title by its ``terms``."""
    df = with_words(items, version=version, plain=plain)
    terms = terms_of("words", grams, stop_words, ngram_source)
    return df.withColumn("terms", terms).drop("words", "title")


def preprocessing_stages(
    limits: dict[int, Limits] | None = None,
    stop_words: Sequence[str] | None = None,
    keep: Sequence[str] = ("item_id", "title", "cat_0", "cat_1", "cat_2", "price"),
) -> Pipeline:
    """The same steps as ML stages that end in one sparse ``features`` column.

    For learners that need vectors. Titles must be normalised before. Working columns are dropped by
    a SQL projection at the end.
    """
    limits = limits or GRAM_LIMITS
    listed = listing_stop_words() if stop_words is None else list(stop_words)
    stages = [
        RegexTokenizer(inputCol="title", outputCol="words"),
        StopWordsRemover(inputCol="words", outputCol="filtered", stopWords=listed),
    ]
    columns, outputs = {1: "filtered"}, []
    for gram in limits:
        if gram > 1:
            columns[gram] = f"gram{gram}"
            stages.append(NGram(n=gram, inputCol="words", outputCol=columns[gram]))
    for gram, limit in limits.items():
        outputs.append(f"vector{gram}")
        stages.append(
            CountVectorizer(
                binary=True, vocabSize=limit.size, minDF=limit.min_df,
                inputCol=columns[gram], outputCol=outputs[-1],
            )
        )
    stages.append(VectorAssembler(inputCols=outputs, outputCol="features"))
    stages.append(SQLTransformer(statement=f"SELECT {', '.join(keep)}, features FROM __THIS__"))
    return Pipeline(stages=stages)
