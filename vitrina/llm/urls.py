"""URL filter: rules first, then naive Bayes over segmented host names and path tokens.

Names of hosts are words run together. A unigram model of all words on all pages splits them by Viterbi search: the
dictionary words inside a name are found by a join of its substrings with the table of words, so no dictionary is
sent to a task, and each distinct name is split once. Multinomial naive Bayes learns from the pages that a rule
decides and scores distinct hosts and distinct path shapes; pages only look both scores up.

Costs and weights are whole millionths of a nat, so sums do not depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.operators.lookup import lookup_join
from vitrina.session import materialize


class Rule(NamedTuple):
    """Decides a host and all its subdomains where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)

LONGEST = 24  # letters of a dictionary word
MICRO = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no word: markup, and addresses (dots inside), since whole host names are what is to be split.
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|[\p{L}\p{N}-]+\.[\p{L}\p{N}][\p{L}\p{N}.-]*"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Attach ``host`` (after the first ``://``, A-Z lower-cased) and ``path``; null or no ``://``: both empty."""
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    at = F.instr(address, "://")
    rest = F.when(at > 0, address.substr(at + 3, F.length(address))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, or null; equally long ones by name. ``rules`` is a short list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``word, n``: runs of letters in the text of all pages, markup and addresses removed, small letters."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), MARKUP, " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _names(host: str) -> Column:
    """Runs of letters in the labels of a host but its last one (the registry's suffix says nothing about a site)."""
    labels = F.split(F.lower(host), r"\.")
    kept = F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels)
    return F.regexp_extract_all(F.array_join(kept, "."), F.lit(r"(\p{L}+)"))


def _shape(path: str) -> Column:
    """A path with its numbers as 0: there are far fewer shapes than paths."""
    return F.regexp_replace(F.lower(path), r"\p{N}+", "0")


def _shape_tokens(shape: str) -> Column:
    return F.transform(F.regexp_extract_all(shape, F.lit(r"(\p{L}+|0)")), lambda t: F.concat(F.lit("/"), t))


def _micro(value: Column) -> Column:
    return F.round(F.log(value) * MICRO).cast("long")


_SPLIT = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])


def split_name(name: str, known: dict[tuple[int, int], int], new: int, letter: int) -> list[str]:
    """Cheapest split of a name. ``known`` has the costs of dictionary words by (start, end); any other piece
    costs ``new + letter * length``. Equal costs: the longest last piece."""
    best: list[tuple[int, int]] = [(0, 0)]
    ends: dict[int, list[tuple[int, int]]] = {}
    for (i, j), cost in known.items():
        ends.setdefault(j, []).append((i, cost))
    strange = (0, 0)
    for j in range(1, len(name) + 1):
        fresh = (best[j - 1][0] + new + letter, j - 1)
        strange = min((strange[0] + letter, strange[1]), fresh) if j > 1 else fresh
        best.append(min([strange, *((best[i][0] + cost, i) for i, cost in ends.get(j, ()))]))
    words, j = [], len(name)
    while j:
        words.append(name[best[j][1] : j])
        j = best[j][1]
    return words[::-1]


def _splits(new: int, letter: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column("name").to_pylist(), batch.column("found").to_pylist()
            words = [
                split_name(n, {(x["i"], x["i"] + x["size"]): x["cost"] for x in f or ()}, new, letter)
                for n, f in zip(names, found, strict=True)
            ]
            yield pa.RecordBatch.from_pydict({"name": names, "words": words}, schema=_SPLIT)

    return run


def split_names(names: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``name, words``: the Viterbi split of each distinct ``name`` under the unigram table ``words`` (word, n).

    A word of n among N costs ``ln(N / n)``, an unknown piece ``ln(N / 10) + length * ln(10)`` (N: 10 at least).
    Dictionary words of more than ``longest`` letters are not looked for; unknown pieces have any length.
    """
    total = max(words.agg(F.sum("n")).first()[0] or 0, 10)
    at = F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("name") - F.col("at") + 1))).alias("size")
    parts = names.select("name", at).select("name", "at", sizes)
    parts = parts.select("name", (F.col("at") - 1).alias("i"), "size", F.col("name").substr(F.col("at"), F.col("size")).alias("word"))
    uses = parts.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))  # once per word: the join below has no hot key
    inside = materialize(uses.join(words, "word").select("word", (-_micro(F.col("n") / F.lit(float(total)))).alias("cost"), "uses"), "dictionary")
    found = lookup_join(parts, inside, ["word"], frequency="uses").groupBy("name").agg(F.collect_list(F.struct("i", "size", "cost")).alias("found"))
    run = _splits(round(math.log(total / 10) * MICRO), round(math.log(10) * MICRO))
    return names.join(found, "name", "left").select("name", "found").mapInArrow(run, "name string, words array<string>")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (the rule's, else the method's), host_words and score (log odds
    of ``allow``; the method allows from 0 on).

    Naive Bayes learns from all pages that a rule decides, with one added to every count; tokens without such a page
    do not count. Without any, all scores are 0. Null urls have an empty host and path and are judged by
    the prior; null html has no words. Repeated rows and null ids stay rows; an empty table gives no rows.
    """
    parts = with_parts(pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url")))
    parts = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    base = materialize(parts.select("page_id", "host", "path", "_rule.rule", F.col("_rule.verdict").alias("known")), "urls")

    allowed, blocked = (F.sum((F.col("known") == v).cast("long")) for v in ("allow", "block"))
    counts = [F.coalesce(allowed, F.lit(0)).alias("allowed"), F.coalesce(blocked, F.lit(0)).alias("blocked"), F.count(F.lit(1)).alias("pages")]
    hosts = materialize(base.groupBy("host").agg(*counts).withColumn("names", _names("host")), "hosts")
    shapes = materialize(base.groupBy(_shape("path").alias("shape")).agg(*counts).withColumn("tokens", _shape_tokens("shape")), "shapes")

    words = materialize(word_counts(pages, html), "words")
    names = hosts.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    names = materialize(names, "names")
    split = materialize(split_names(names.select("name"), words).join(names, "name"), "splits")
    one = hosts.select("host", F.posexplode("names").alias("at", "name"))
    said = lookup_join(one, split, ["name"], frequency="uses").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("said"))
    spelled = F.flatten(F.transform("said", lambda x: x["words"]))
    empty = F.array().cast("array<string>")
    hosts = hosts.join(said, "host", "left").withColumn("tokens", F.coalesce(spelled, empty)).drop("said", "names")
    hosts = materialize(hosts, "host-words")

    both = hosts.select("allowed", "blocked", F.explode("tokens").alias("token")).unionByName(shapes.select("allowed", "blocked", F.explode("tokens").alias("token")))
    seen = both.groupBy("token").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.count(F.lit(1)).alias("uses"))
    seen = materialize(seen.where("allowed + blocked > 0"), "token-counts")
    a, b, v = seen.agg(F.coalesce(F.sum("allowed"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0)), F.count(F.lit(1))).first()
    odds = (F.col("allowed") + 1) / F.lit(float(a + v or 1)) / ((F.col("blocked") + 1) / F.lit(float(b + v or 1)))
    weights = materialize(seen.select("token", _micro(odds).alias("weight"), "uses"), "weights")

    def scored(table: DataFrame, key: str, name: str) -> DataFrame:
        tokens = lookup_join(table.select(key, F.explode("tokens").alias("token")), weights, ["token"], frequency="uses")
        return table.join(tokens.groupBy(key).agg(F.sum("weight").alias("_sum")), key, "left").withColumn(name, F.coalesce("_sum", F.lit(0))).drop("_sum")

    host_scores = scored(hosts, "host", "host_score").select("host", "host_score", F.array_join("tokens", " ").alias("host_words"), "pages")
    shape_scores = scored(shapes, "shape", "path_score").select("shape", "path_score", "pages")
    n_allowed, n_blocked = hosts.agg(F.coalesce(F.sum("allowed"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = round((math.log(n_allowed + 1) - math.log(n_blocked + 1)) * MICRO)

    rows = lookup_join(base.withColumn("shape", _shape("path")), materialize(host_scores, "host-scores"), ["host"], frequency="pages")
    rows = lookup_join(rows, materialize(shape_scores, "shape-scores"), ["shape"], frequency="pages")
    score = F.lit(prior).cast("long") + F.col("host_score") + F.col("path_score")
    verdict = F.coalesce("known", F.when(score >= 0, F.lit("allow")).otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_words", (score / F.lit(float(MICRO))).alias("score"))
