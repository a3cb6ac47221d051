import random

from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from vitrina.functions.normalize import PUNCTUATION, RULE_SETS, SOME_MEASURE, SOME_PAIR, UNITS, accent_table, normalize_title
from vitrina.functions.normalize import java_trim, strip_accents
from vitrina.functions.stopwords import language_stop_words, listing_stop_words, load_stop_words
from vitrina.functions.tokens import (
    gram_size,
    ngrams,
    plain_tokens,
    regex_tokens,
    term_runs,
    without_stop_words,
)

V4 = [
    ("12 12,3 12.3", "NUMBER NUMBER NUMBER 12 NUMBER"),
    ("20/30 20x30", "NUMBER x NUMBER NUMBER x NUMBER"),
    ("1,2,3", "NUMBER NUMBER NUMBER"),
    ("Cámara Ñandú 4G 4K", "camara nandu 4g 4k"),
    ("Envío gratis factura A o B zapato", "  zapato"),
    ("27mm 27mm 27mm", "NUMBER milimetros NUMBER milimetros NUMBER milimetros"),
    ("TV 32' 50%", "tv NUMBER pulgadas NUMBER porciento "),
    ("5 ml 3 m", "NUMBER mililitros NUMBER metros"),
    ("20x40cm", "NUMBER x NUMBER centimetros"),
    ("a_b", "a_b"),
]
SAMPLE = "Set 12 vasos 350ml & bandeja 20x40cm 100% vidrio 3 m (caja)"
SAMPLE_V4 = (
    "set NUMBER vasos NUMBER mililitros y bandeja NUMBER x NUMBER centimetros NUMBER porciento vidrio "
    "NUMBER metros caja "
)


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_golden_titles(spark):
    titles = [t for t, _ in V4] + [SAMPLE]
    assert column(spark, titles, normalize_title("s")) == [e for _, e in V4] + [SAMPLE_V4]


def test_versions_differ_as_documented(spark):
    assert column(spark, ["20/30 m"], normalize_title("s", "v4_sheet")) == ["NUMBER / NUMBER m"]
    assert column(spark, ["20/30 (5cm)"], normalize_title("s", "v3")) == ["20/30 5cm "]
    assert column(spark, ["pack 12 u / 3"], normalize_title("s", "v2")) == ["pack NUMBER u NUMBER "]
    assert column(spark, ["cable 3 m usb"], normalize_title("s", "v1")) == ["cable3 metrosusb"]


def test_null_title_stays_null(spark):
    assert column(spark, [None], normalize_title("s")) == [None]


def test_fast_rules_equal_plain_rules(spark):
    """The digit look-ahead, literal and character-map short cuts change no result."""
    rng = random.Random(7)
    alphabet = "  12 34 x.,%&'\"()[]:!/mlcgwv°éñ\t\n+-_kilogrs"
    titles = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    for version, rules in RULE_SETS.items():
        plain = F.lower("s") if version == "v1" else java_trim(F.lower("s"))
        plain = strip_accents(plain)
        for pattern, replacement in rules:
            if pattern == PUNCTUATION:
                pattern = r"[^\w\s\+'\"/]"
            plain = F.regexp_replace(
                plain, F.lit(pattern.replace(r"(?=\d)", "")), F.lit(replacement)
            )
        assert column(spark, titles, normalize_title("s", version)) == column(spark, titles, plain)


def test_unit_rules_run_only_where_a_measure_is_found(spark):
    """In texts without one no unit rule changes anything, and the expression passes the rules over there."""
    rng = random.Random(11)
    titles = ["".join(rng.choice("  1 23 x/.,%'mlcgwv°\n") for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in titles], "s string")
    for guard, rules in ((SOME_MEASURE, RULE_SETS["v4"][: len(UNITS) + 1]), (SOME_PAIR, RULE_SETS["v4"][len(UNITS) + 1 : len(UNITS) + 3])):
        assert 0 < df.where(F.col("s").rlike(guard)).count() < len(titles)
        for pattern, replacement in rules:
            changed = F.regexp_replace("s", F.lit(pattern), F.lit(replacement)) != F.col("s")
            assert df.where(~F.col("s").rlike(guard) & changed).count() == 0
    plan = df.select(normalize_title("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN") >= 2 + 1


def test_trim_equals_its_rule_before_line_ends(spark):
    texts = [a + " \tx y" + b for a in ("", " ", "\x00\n") for b in ("", " \n", " \u0085", "\x00\u2028", " \u2029 ", "\r\n")] + ["", " ", "\n\u0085"]
    rule = F.regexp_replace("s", r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    assert column(spark, texts, java_trim(F.col("s"))) == column(spark, texts, rule)


def test_accent_table_is_complete():
    source, target = accent_table()
    assert len(source) == len(target) == len(set(source))
    assert dict(zip(source, target, strict=True))["ñ"] == "n"


def test_tokenisers_equal_ml(spark):
    texts = ["  A b  c", "", "  ", "x", "a b  ", "Uno\tdos\ntres", "á É"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    df = RegexTokenizer(inputCol="s", outputCol="r").transform(df)
    df = Tokenizer(inputCol="s", outputCol="p").transform(df)
    for row in df.select("r", "p", regex_tokens("s").alias("r2"), plain_tokens("s").alias("p2")).collect():
        assert row.r == row.r2
        assert row.p == row.p2


def test_stop_words_and_ngrams_equal_ml(spark):
    words = listing_stop_words()
    df = spark.createDataFrame(
        [(["La", "funda", "para", "para", "samsung", "GRATIS", "/"],), (["a"],), ([],)], "w array<string>"
    )
    df = StopWordsRemover(inputCol="w", outputCol="f", stopWords=words).transform(df)
    for n in (2, 3):
        df = NGram(n=n, inputCol="w", outputCol=f"g{n}").transform(df)
    rows = df.select(
        "f", "g2", "g3",
        without_stop_words("w", words).alias("f_"), ngrams("w", 2).alias("g2_"), ngrams("w", 3).alias("g3_"),
    ).collect()
    assert all(r.f == r.f_ and r.g2 == r.g2_ and r.g3 == r.g3_ for r in rows)
    assert rows[0].f == ["funda", "samsung"]


def test_stop_word_lists(spark, tmp_path):
    words = listing_stop_words()
    assert len(words) == len(set(words))
    for word in ("cuanta", "muchisimos", "trabajais", "sabemos", "ningun", "oferta", "/", "cómo", "aquel"):
        assert word in words
    assert "celular" not in words
    assert "the" in language_stop_words("english")
    (tmp_path / "list.txt").write_text("uno\ndos\n\n")
    assert load_stop_words(spark, str(tmp_path / "list.txt")) == ["uno", "dos"]


def test_term_runs_count_repeats(spark):
    df = spark.createDataFrame([("b a b c a b",), ("",)], "s string")
    rows = [r[0] for r in df.select(term_runs(regex_tokens("s"))).collect()]
    assert [(t.term, t.tf) for t in rows[0]] == [("a", 2), ("b", 3), ("c", 1)]
    assert rows[1] == []
    assert column(spark, ["a", "a b", "a b c"], gram_size("s")) == [1, 2, 3]


def test_ngrams_of_short_null_and_partly_null_rows(spark):
    rows = [([],), (["a"],), (["a", "b"],), (["a", "b", "c", "d"],), (["a", None, "c"],), ([None, None, "x"],), (None,)]
    df = spark.createDataFrame(rows, "words array<string>")
    plan = df.select(ngrams("words", 2))._jdf.queryExecution().analyzed().toString()
    assert "array_join" not in plan  # a join of a slice per run took twice as long
    found = [tuple(r) for r in df.select(ngrams("words", 2), ngrams("words", 3)).collect()]
    assert found == [
        ([], []), ([], []), (["a b"], []), (["a b", "b c", "c d"], ["a b c", "b c d"]), (["a", "c"], ["a c"]), (["", "x"], ["x"]),
        ([None], [None]),
    ]
