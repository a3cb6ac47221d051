"""The same queries as SQL for DuckDB, written independently of the Spark code.

Differences in method are deliberate: percentiles rank every row, Naive Bayes scores every item
against every class with the full formula, and title rules work on captured boundaries, since the
regex engine has no look-behind.
"""

from __future__ import annotations

from vitrina.functions.normalize import BOILERPLATE, OLD_UNITS, UNITS
from vitrina.operators.vocabulary import GRAM_LIMITS
from vitrina.sources.tables import DECORATIONS

CATS = ("cat_0", "cat_1", "cat_2")
WORDS = {1: (60_000, 5)}
GRAMS = {1: (60_000, 5), 2: (30_000, 5), 3: (30_000, 5)}

# The English stop words of Spark's own list, so that no session is needed here.
# The Spanish list with words of the trade, apart from the library's own.
LISTING = """
+ / a aca ahi ajena ajenas ajeno ajenos al algo algun alguna algunas alguno algunos alla alli ambos
ampleamos ante antes aquel aquella aquellas aquello aquellos aqui arriba asi atras aun aunque bajo
bastante bien cabe cada casi cierta ciertas cierto ciertos combo como con conmigo conseguimos
conseguir consigo consigue consiguen consigues contigo contra cual cuales cualquier cualquiera
cualquieras cuan cuando cuanta cuantas cuanto cuantos cómo de dejar del demas demasiada demasiadas
demasiado demasiados dentro desde donde el ella ellas ello ellos empleais emplean emplear empleas
empleo en encima entonces entre envio era eramos eran eras eres es esa esas ese eso esos esta estaba
estado estais estamos estan estar estas este esto estos estoy etc factura fin fue fueron fui fuimos
garantia gratis gtia gueno ha hace haceis hacemos hacen hacer haces hacia hago hasta incluso intenta
intentais intentamos intentan intentar intentas intento ir jamas junto juntos la largo las lo los
mas me menos mi mia mias mientras mio mios mis misma mismas mismo mismos modo mucha muchas muchisima
muchisimas muchisimo muchisimos mucho muchos muy nada ni ningun ninguna ningunas ninguno ningunos no
nos nosotras nosotros nuestra nuestras nuestro nuestros nunca oferta os otra otras otro otros para
parecer pero poca pocas poco pocos podeis podemos poder podria podriais podriamos podrian podrias
por porque primero promo promocion puede pueden puedo pues que querer quien quienes quienesquiera
quienquiera quiza quizas sabe sabeis sabemos saben saber sabes se segun ser si siempre siendo sin
sino so sobre sois solamente solo somos soy sta su super sus suya suyas suyo suyos tal tales tambien
tampoco tan tanta tantas tanto tantos te teneis tenemos tener tengo ti tiempo tiene tienen toda
todas todo todos tomar trabaja trabajais trabajamos trabajan trabajar trabajas trabajo tras tu tus
tuya tuyo tuyos ultimo un una unas uno unos usa usais usamos usan usar usas uso usted ustedes va
vais valor vamos van varias varios vaya verdad verdadera vosotras vosotros voy vuestra vuestras
vuestro vuestros y ya yo
""".split()

ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if
or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {text(pattern)}, {text(replacement)}, 'g')"


# Items

PART_ITEMS = """part_items AS (
  SELECT p_partkey AS item_id,
    p_name || ' ' || p_size::VARCHAR || CASE p_partkey % {n} {whens} END AS title,
    p_type AS cat_0, p_type || '/' || p_brand AS cat_1,
    p_type || '/' || p_brand || '/' || p_size::VARCHAR AS cat_2,
    CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price
  FROM part)""".format(
    n=len(DECORATIONS),
    whens=" ".join(f"WHEN {i} THEN {text(d)}" for i, d in enumerate(DECORATIONS)),
)
DOC_ITEMS = """doc_items AS (
  SELECT d.doc_id AS item_id, d.text AS title, lang AS cat_0, lang || '/' || source AS cat_1,
    lang || '/' || source || '/' || coalesce(quality::VARCHAR, 'u') AS cat_2,
    n_chars::DOUBLE AS price
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ORDER_ITEMS = """order_items AS (
  SELECT o_orderkey AS item_id, o_orderpriority AS cat_0,
    o_orderpriority || '/' || o_orderstatus AS cat_1, o_totalprice AS price
  FROM orders)"""
ALL_TITLES = """all_titles AS (
  SELECT 'part' AS kind, item_id, title FROM part_items
  UNION ALL SELECT 'document', doc_id, text FROM documents
  UNION ALL SELECT 'page', page_id, html FROM pages)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# Titles


def _plain(title: str, trim: bool) -> str:
    expr = f"lower({title})"
    if trim:
        expr = rx(expr, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return rx(f"strip_accents({expr})", r"[^\x00-\x7F]", "")


def _units(expr: str, left: str, right: str, added: str, space: str = r"[\s]") -> str:
    for spellings, word, after_x in UNITS:
        start = f"(^|[{left}{'x' if after_x else ''}])"
        expr = rx(
            expr, rf"{start}(\d+) {{0,2}}(?:{'|'.join(spellings)})({right})", rf"\1\2{added}{word}\3"
        )
    return expr


def _tail(expr: str, lone_slash: bool) -> str:
    expr = rx(expr, r"[^\w\s\+'\"/]", " ")
    if lone_slash:
        expr = rx(expr, r"\s/\s", " ")
    return rx(expr, r"\s+", " ")


def normalize_v4(title: str, slash: str = "x", phrases: tuple[str, ...] = BOILERPLATE) -> str:
    left, right = r"\s(\[:", r"$|\s|\.$|\.\s|%|!|\)|\]"
    start = f"(^|[{left}])"
    expr = rx(_plain(title, trim=True), r"(\s)", r"\1\1")
    expr = rx(expr, rf"{start}(\d+)(?:'|''|\")({right})", r"\1\2 pulgadas\3")
    expr = _units(expr, left, right, " ")
    expr = rx(expr, rf"{start}\d+/\d+({right}|,\s)", rf"\1NUMBER {slash} NUMBER\2")
    expr = rx(expr, rf"{start}\d+x\d+({right}|,\s)", r"\1NUMBER x NUMBER\2")
    expr = f"replace({expr}, ',', ',,')"
    expr = rx(expr, rf"(^|[{left},.])\d+({right}|,)", r"\1NUMBER\2")
    expr = f"replace(replace({expr}, '&', ' y '), '%', ' porciento ')"
    expr = _tail(expr, lone_slash=False)
    for phrase in phrases:
        expr = f"replace({expr}, {text(phrase)}, '')"
    return expr


def normalize_v3(title: str) -> str:
    space = r"[\s\x01]"
    inch_right = rf"$|{space}|\.$|\.{space}"
    right = inch_right + "|!|%"
    expr = rx(_plain(title, trim=True), r"(\s)", r"\1\1")
    expr = rx(expr, rf"(^|{space})(\d+)(?:'|''|\")({inch_right})", "\\1\\2\x01pulgadas\\3")
    expr = _units(expr, r"\s\x01", right, "\x01")
    expr = rx(expr, rf"(^|{space})\d+x\d+({right}|,{space})", "\\1NUMBER\x01x\x01NUMBER\\2")
    expr = f"replace({expr}, ',', ',,')"
    expr = rx(expr, rf"(^|{space}|,|\.)\d+({right}|,)", r"\1NUMBER\2")
    expr = f"replace({rx(expr, r'(\s)\s', r'\1')}, ',,', ',')"
    expr = rx(expr, r"\x01", " ")
    expr = f"replace(replace({expr}, '&', ' y '), '%', ' porciento ')"
    return _tail(expr, lone_slash=True)


def normalize_v2(title: str) -> str:
    space = r"[\s\x01]"
    expr = rx(_plain(title, trim=True), r"(\s)", r"\1\1")
    expr = rx(expr, rf"(^|{space})(\d+)(?:''|\")($|{space})", "\\1\\2\x01pulgadas\\3")
    for spellings, word in OLD_UNITS:
        end = r"\s\x01" if word == "litros" else r" \x01"
        expr = rx(
            expr,
            rf"(^|{space})(\d+) {{0,2}}(?:{'|'.join(spellings)})($|[{end}])",
            f"\\1\\2\x01{word}\\3",
        )
    number = rf"(^|{space})(?:\d+|\d+\.\d+|\d+,\d+)($|{space}|\.$|\.{space}|,{space})"
    expr = rx(expr, number, "\\1NUMBER\x02\\2")
    expr = rx(expr, r"(\s)\s", r"\1")
    expr = rx(expr, r"[\x01\x02]", " ")
    return _tail(expr, lone_slash=True)


def normalize_v1(title: str) -> str:
    expr = rx(_plain(title, trim=False), r"(?:^| )(\d+)(?:''|\")", r"\1 pulgadas")
    for spellings, word in OLD_UNITS:
        expr = rx(expr, rf"(?:^| )(\d+) ?(?:{'|'.join(spellings)})(?:$| )", rf"\1 {word}")
    return expr


def _titles(expr: str) -> str:
    return with_ctes(
        PART_ITEMS, ALL_TITLES, select=f"SELECT kind, item_id, {expr} AS title FROM all_titles"
    )


# Tokens


def tokens(title: str) -> str:
    return f"list_filter(string_split_regex(lower({title}), '\\s+'), lambda t: length(t) >= 1)"


def _in_list(words: list[str]) -> str:
    return "[" + ", ".join(text(w.lower()) for w in sorted(words)) + "]"


def words_cte(items: str, version: str | None = "v4", keep: tuple[str, ...] = CATS) -> str:
    title = normalize_v4("title") if version else "title"
    columns = ", ".join(("item_id", *keep))
    return f"words AS MATERIALIZED (SELECT {columns}, {tokens(title)} AS words FROM {items})"


def without(words: str, listed: list[str]) -> str:
    return f"list_filter({words}, lambda t: NOT list_contains({_in_list(listed)}, lower(t)))"


def grams(n: int) -> str:
    if n == 1:
        return "words"
    return (
        f"list_transform(range(1, len(words) - {n - 2}), "
        f"lambda i: array_to_string(words[i:i + {n - 1}], ' '))"
    )


def terms_cte(sizes, stop: bool = True) -> str:
    parts = []
    for n in sizes:
        source = without("words", LISTING) if n == 1 and stop else grams(n)
        parts.append(f"SELECT item_id, {n} AS gram, unnest({source}) AS term FROM words")
    return (
        "terms AS MATERIALIZED (SELECT item_id, gram, term, count(*) AS tf FROM ("
        + " UNION ALL ".join(parts)
        + ") GROUP BY ALL)"
    )


def vocab_cte(limits: dict[int, tuple[int, int]], source: str = "terms") -> str:
    size = " ".join(f"WHEN {g} THEN {s}" for g, (s, _) in limits.items())
    min_df = " ".join(f"WHEN {g} THEN {m}" for g, (_, m) in limits.items())
    return f"""vocab AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY gram, n DESC, term) - 1)::INTEGER AS index, gram, term, n, df
  FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY n DESC, term) AS place
        FROM (SELECT gram, term, sum(tf)::BIGINT AS n, count(*) AS df FROM {source} GROUP BY ALL)
        WHERE df >= CASE gram {min_df} END)
  WHERE place <= CASE gram {size} END)"""


KNOWN = "known AS MATERIALIZED (SELECT item_id, index, tf FROM terms JOIN vocab USING (gram, term))"


def pipeline(items_cte: str, items: str, limits, version: str | None = "v4") -> list[str]:
    return [items_cte, words_cte(items, version), terms_cte(limits), vocab_cte(limits), KNOWN]


def murmur_ctes(buckets: int) -> list[str]:
    """Buckets of all distinct terms by Murmur3 (32 bits, seed 42) over their UTF-8 bytes, four at a time."""
    two32, c1, c2 = 2**32, 0xCC9E2D51, 0x1B873593

    def turned(x: str, r: int) -> str:
        return f"({x} * {2**r} % {two32} + {x} // {2 ** (32 - r)})"

    word = "substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2)"
    rest = "substr(h, 8 * (n // 4) + 5, 2) || substr(h, 8 * (n // 4) + 3, 2) || substr(h, 8 * (n // 4) + 1, 2)"

    def number(digits: str) -> str:
        return f"cast('0x' || {digits} as ubigint)::hugeint"

    return [
        "m0 AS (SELECT term, hex(encode(term)) AS h, length(hex(encode(term))) // 2 AS n FROM (SELECT DISTINCT term FROM terms))",
        f"m1 AS (SELECT term, n, list_transform(range(n // 4), lambda i: {number(word)} * {c1} % {two32}) AS k, "
        f"CASE WHEN n % 4 > 0 THEN {number(rest)} * {c1} % {two32} ELSE 0::hugeint END AS t FROM m0)",
        f"m2 AS (SELECT term, n, list_transform(k, lambda x: {turned('x', 15)} * {c2} % {two32}) AS k, {turned('t', 15)} * {c2} % {two32} AS t FROM m1)",
        f"m3 AS (SELECT term, xor(xor(list_reduce(list_prepend(42::hugeint, k), lambda a, x: ({turned('xor(a, x)', 13)} * 5 + {0xE6546B64}) % {two32}), t), n::hugeint) AS h FROM m2)",
        f"m4 AS (SELECT term, xor(h, h // 65536) * {0x85EBCA6B} % {two32} AS h FROM m3)",
        f"m5 AS (SELECT term, xor(h, h // 8192) * {0xC2B2AE35} % {two32} AS h FROM m4)",
        "m6 AS (SELECT term, xor(h, h // 65536) AS h FROM m5)",
        f"hashed AS MATERIALIZED (SELECT term, (((h - CASE WHEN h >= {2**31} THEN {two32} ELSE 0 END) % {buckets} + {buckets}) % {buckets})::INTEGER AS bucket FROM m6)",
    ]


def _token_query(expr: str, version: str | None = "v4") -> str:
    return with_ctes(
        DOC_ITEMS,
        words_cte("doc_items", version),
        select=f"SELECT item_id, array_to_string({expr}, '|') AS tokens FROM words",
    )


def _vocab_query(gram: int) -> str:
    limits = {gram: (GRAM_LIMITS[gram].size, GRAM_LIMITS[gram].min_df)}
    return with_ctes(
        DOC_ITEMS, words_cte("doc_items"), terms_cte(limits), vocab_cte(limits),
        select="SELECT index, term, n, df FROM vocab",
    )


LIMITS = {g: (limit.size, limit.min_df) for g, limit in GRAM_LIMITS.items()}


# Prices


def percentile_cte(name: str, source: str, by: list[str], tiles, interpolate: bool = True) -> str:
    group = f"PARTITION BY {', '.join(by)}" if by else ""
    columns = [*by, "c AS n"]
    for t in tiles:
        position = f"({t / 100.0!r}::DOUBLE * (c + 1.0::DOUBLE))"
        low = f"greatest(1, least(c, floor({position})))"
        at_low = f"max(price) FILTER (WHERE rn = {low})"
        value = at_low
        if interpolate:
            at_high = f"max(price) FILTER (WHERE rn = greatest(1, least(c, floor({position}) + 1)))"
            value = (
                f"CASE WHEN floor({position}) > 0 AND floor({position}) < c THEN "
                f"{at_low} + ({position} - floor({position})) * ({at_high} - {at_low}) "
                f"ELSE {at_low} END"
            )
        columns.append(f"{value} AS p{t:g}")
    grouping = ", ".join([*by, "c"])
    return f"""{name} AS (
  SELECT {', '.join(columns)} FROM (
    SELECT *, row_number() OVER ({group} ORDER BY price) AS rn, count(*) OVER ({group}) AS c
    FROM {source} WHERE price IS NOT NULL) GROUP BY {grouping})"""


def _percentile_query(items_cte: str, items: str, by: list[str], tiles, interpolate=True) -> str:
    def shown(t):
        return f"round(p{t:g}, 6) AS p{t:g}" if interpolate else f"p{t:g}"

    columns = ", ".join([*by, "n", *[shown(t) for t in tiles]])
    return with_ctes(
        items_cte, percentile_cte("p", items, by, tiles, interpolate),
        select=f"SELECT {columns} FROM p",
    )


def _trim_query(items_cte: str, items: str, by: list[str], low, high, columns: str) -> str:
    on = " AND ".join(f"i.{c} = p.{c}" for c in by) or "true"
    return with_ctes(
        items_cte, percentile_cte("p", items, by, (low, high)),
        select=f"SELECT {columns} FROM {items} i JOIN p ON {on} "
        f"WHERE i.price BETWEEN p{low:g} AND p{high:g}",
    )


def _rank_trim_query(items_cte: str, items: str, by: str, low, high, columns: str) -> str:
    def place(t):
        return f"floor({t / 100.0!r}::DOUBLE * (c + 1.0::DOUBLE))"

    return with_ctes(
        items_cte,
        select=f"""SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY price, item_id) - 1 AS place,
    count(*) OVER (PARTITION BY {by}) AS c FROM {items} WHERE price IS NOT NULL)
WHERE c = 1 OR {place(low)} <= 0 OR {place(high)} <= 0
  OR place BETWEEN {place(low)} AND {place(high)}""",
    )


LINE_ITEMS = """line_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS item_id, l_returnflag AS cat_0, l_quantity AS price
  FROM lineitem)"""


# Naive Bayes

TRAIN = "(('0x' || substr(md5(item_id::VARCHAR), 1, 8))::BIGINT % 10000 < 9000)"


def model_ctes(suffix: str, train: str, parent: str, target: str, multinomial: bool = False) -> list[str]:
    """Classes and the full weight of every (class, term) cell, zeros included.

    ``train`` holds item_id and the category columns. The weight of a present term and, for the
    Bernoulli kind, the sum of all absent terms are taken from the textbook formulas.
    """
    count = "sum(tf)" if multinomial else "count(*)"
    ctes = [
        f"""cls{suffix} AS MATERIALIZED (
  SELECT parent, class, n,
    row_number() OVER (PARTITION BY parent ORDER BY n DESC, class) - 1 AS label,
    ln(n + 1) - ln(sum(n) OVER (PARTITION BY parent) + count(*) OVER (PARTITION BY parent)) AS prior
  FROM (SELECT {parent} AS parent, {target} AS class, count(*) AS n FROM {train} GROUP BY ALL))""",
        f"""cell{suffix} AS MATERIALIZED (
  SELECT {parent} AS parent, {target} AS class, index, {count}::DOUBLE AS seen
  FROM {train} JOIN known USING (item_id) GROUP BY ALL)""",
    ]
    if multinomial:
        ctes.append(f"""base{suffix} AS MATERIALIZED (
  SELECT c.*, ln(1.0) - ln(coalesce(s.all_seen, 0) + (SELECT count(*) FROM vocab)) AS zero,
    prior AS empty
  FROM cls{suffix} c LEFT JOIN (SELECT parent, class, sum(seen) AS all_seen FROM cell{suffix}
    GROUP BY ALL) s USING (parent, class))""")
    else:
        ctes.append(f"""base{suffix} AS MATERIALIZED (
  SELECT c.*, ln(1.0 / (n + 1.0)) AS zero,
    prior + ((SELECT count(*) FROM vocab) - coalesce(s.cells, 0)) * ln((n + 1.0) / (n + 2.0))
      + coalesce(s.absent, 0) AS empty
  FROM cls{suffix} c LEFT JOIN (
    SELECT e.parent, e.class, count(*) AS cells, sum(ln((n - seen + 1.0) / (n + 2.0))) AS absent
    FROM cell{suffix} e JOIN cls{suffix} k ON e.parent = k.parent AND e.class = k.class
    GROUP BY ALL) s USING (parent, class))""")
    return ctes


def score_ctes(suffix: str, items: str, multinomial: bool = False) -> list[str]:
    """``pred<suffix>``: the best class of every row of ``items(item_id, parent)``."""
    tf = "k.tf" if multinomial else "1.0"
    if multinomial:
        present = "ln(seen + 1.0)"
    else:
        present = "(ln((seen + 1.0) / (n - seen + 1.0)) - ln(1.0 / (n + 1.0)))"
    return [
        f"""score{suffix} AS MATERIALIZED (
  SELECT item_id, parent, class, label, round(empty + m * zero + coalesce(gain, 0), 6) AS score
  FROM (SELECT i.item_id, i.parent, b.class, b.label, b.empty, b.zero, coalesce(s.m, 0) AS m
        FROM {items} i JOIN base{suffix} b ON i.parent = b.parent
        LEFT JOIN (SELECT k.item_id, sum({tf}) AS m FROM known_items k GROUP BY 1) s
          ON s.item_id = i.item_id)
  LEFT JOIN (
    SELECT i.item_id, e.class, sum({tf} * {present}) AS gain
    FROM {items} i JOIN known_items k ON k.item_id = i.item_id
    JOIN cell{suffix} e ON e.parent = i.parent AND e.index = k.index
    JOIN cls{suffix} c ON c.parent = e.parent AND c.class = e.class
    GROUP BY ALL) USING (item_id, class))""",
        f"""pred{suffix} AS MATERIALIZED (
  SELECT item_id, parent, class AS prediction, label::INTEGER AS label, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label) AS place
    FROM score{suffix}) WHERE place = 1)""",
    ]


SAME_ITEMS = "known_items AS (SELECT * FROM known)"


def flat_ctes(multinomial: bool = False, score: bool = True) -> list[str]:
    ctes = [
        *pipeline(DOC_ITEMS, "doc_items", WORDS),
        SAME_ITEMS,
        *model_ctes("0", "words", "''", "cat_0", multinomial),
    ]
    if score:
        ctes.append("root_items AS (SELECT item_id, '' AS parent FROM words)")
        ctes += score_ctes("0", "root_items", multinomial)
    return ctes


def _model_query(multinomial: bool) -> str:
    if multinomial:
        gain = "ln(seen + 1.0)"
    else:
        gain = "ln((seen + 1.0) / (cls0.n - seen + 1.0)) - ln(1.0 / (cls0.n + 1.0))"
    return with_ctes(
        *flat_ctes(multinomial, score=False),
        select=f"SELECT class, term, round({gain}, 6) AS gain FROM cell0 "
        "JOIN cls0 USING (parent, class) JOIN vocab USING (index)",
    )


PREDICTED = "SELECT w.item_id, w.cat_0, prediction, label, score FROM words w JOIN pred0 USING (item_id)"
EVALUATED = (
    "count(*) AS items, sum((prediction = cat_0)::INTEGER)::BIGINT AS correct, "
    "avg((prediction = cat_0)::INTEGER) AS accuracy, "
    "1.0::DOUBLE - avg((prediction = cat_0)::INTEGER) AS error"
)


def hierarchy_ctes(items_cte: str, items: str, limits) -> list[str]:
    ctes = [*pipeline(items_cte, items, limits), SAME_ITEMS]
    ctes += model_ctes("0", "words", "''", "cat_0")
    for depth in (1, 2):
        parent, target = CATS[depth - 1], CATS[depth]
        ctes.append(percentile_cte(f"p{depth}", items, [parent], (5, 95)))
        ctes.append(
            f"train{depth} AS MATERIALIZED (SELECT i.* EXCLUDE (title) FROM {items} i "
            f"JOIN p{depth} p ON i.{parent} = p.{parent} WHERE i.price BETWEEN p.p5 AND p.p95)"
        )
        ctes += model_ctes(str(depth), f"train{depth}", parent, target)
    return ctes


def cascade_ctes() -> list[str]:
    ctes = ["root_items AS (SELECT item_id, '' AS parent FROM words)"]
    ctes += score_ctes("0", "root_items")
    for depth in (1, 2):
        ctes.append(
            f"next{depth} AS (SELECT item_id, prediction AS parent FROM pred{depth - 1})"
        )
        ctes += score_ctes(str(depth), f"next{depth}")
    return ctes


CASCADE = (
    "SELECT w.item_id, a.prediction AS predicted_cat_0, b.prediction AS predicted_cat_1, "
    "c.prediction AS predicted_cat_2 FROM words w LEFT JOIN pred0 a USING (item_id) "
    "LEFT JOIN pred1 b USING (item_id) LEFT JOIN pred2 c USING (item_id)"
)


def _hier_model_query() -> str:
    selects = [
        f"SELECT '{CATS[d]}' AS level, parent, class, label::INTEGER AS label, n AS items, "
        f"round(empty, 6) AS intercept FROM base{d}"
        for d in range(3)
    ]
    return with_ctes(
        *hierarchy_ctes(DOC_ITEMS, "doc_items", GRAMS), select=" UNION ALL ".join(selects)
    )


_NESTED = """WITH used AS (
  SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tree AS (
  SELECT DISTINCT 'R' || r_regionkey AS id, r_name AS name, NULL::VARCHAR AS parent, 0 AS depth, 'R' || r_regionkey AS path, r_name AS names FROM used
  UNION ALL SELECT DISTINCT 'N' || n_nationkey, n_name, 'R' || r_regionkey, 1, 'R' || r_regionkey || '>N' || n_nationkey, r_name || '>' || n_name FROM used
  UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || n_nationkey, 2, 'R' || r_regionkey || '>N' || n_nationkey || '>C' || c_custkey,
    r_name || '>' || n_name || '>' || c_name FROM used)
"""

LABELLED = (
    "labelled AS MATERIALIZED (SELECT d.doc_id AS item_id, text AS title, lang AS cat_0, "
    "lang || '/' || coalesce(quality::VARCHAR, 'u') AS cat_1, lang || '/' || coalesce(quality::VARCHAR, 'u') "
    "|| '/' || coalesce(toxic::VARCHAR, 'u') AS cat_2 FROM documents d LEFT JOIN labels USING (doc_id))"
)


def _grouped_query() -> str:
    """Size, classes and terms of the models of three levels."""
    parts = []
    for target, parent in zip(CATS, ("''", "cat_0", "cat_1"), strict=True):
        parts.append(
            f"SELECT '{target}' AS level, {parent} AS parent, count(DISTINCT w.item_id) AS items, "
            f"count(DISTINCT {target}) AS classes, CASE WHEN count(DISTINCT {target}) > 1 THEN count(DISTINCT index) "
            f"ELSE 0 END::INTEGER AS terms, true AS beats_priors FROM words w LEFT JOIN known USING (item_id) "
            f"WHERE {target} IS NOT NULL GROUP BY ALL"
        )
    return with_ctes(*pipeline(LABELLED, "labelled", GRAMS), select=" UNION ALL ".join(parts))


def _holdout_query(target: str, parent: str | None, trim: bool) -> str:
    key = parent or "''"
    ctes = [DOC_ITEMS]
    ctes.append(words_cte("doc_items"))
    ctes += [
        terms_cte(WORDS),
        f"train_terms AS (SELECT * FROM terms WHERE {TRAIN})",
        vocab_cte(WORDS, "train_terms"),
        KNOWN,
        SAME_ITEMS,
    ]
    source = "SELECT item_id, cat_0, cat_1, cat_2 FROM doc_items"
    if trim:
        ctes.append(percentile_cte("p", "doc_items", [parent], (5, 95)))
        source = (
            f"SELECT i.item_id, i.cat_0, i.cat_1, i.cat_2 FROM doc_items i JOIN p "
            f"ON i.{parent} = p.{parent} WHERE i.price BETWEEN p5 AND p95"
        )
    ctes.append(f"kept AS MATERIALIZED ({source})")
    ctes.append(f"train AS MATERIALIZED (SELECT * FROM kept WHERE {TRAIN})")
    ctes.append(f"test AS MATERIALIZED (SELECT *, {key} AS parent FROM kept WHERE NOT {TRAIN})")
    ctes += model_ctes("0", "train", key, target)
    ctes += score_ctes("0", "test")
    right = f"coalesce((prediction = {target})::INTEGER, 0)"
    columns = (
        f"count(*) AS items, sum({right})::BIGINT AS correct, avg({right}) AS accuracy, "
        f"1.0::DOUBLE - avg({right}) AS error"
    )
    group = f"{parent}, " if parent else ""
    tail = f" GROUP BY {parent}" if parent else ""
    return with_ctes(
        *ctes,
        select=f"SELECT {group}{columns} FROM test LEFT JOIN pred0 USING (item_id){tail}",
    )


def _category_ctes() -> list[str]:
    return [
        DOC_ITEMS,
        words_cte("doc_items"),
        terms_cte((1,), stop=False),
        """best AS (
  SELECT *, row_number() OVER (ORDER BY cat_0, place) - 1 AS index FROM (
    SELECT *, row_number() OVER (PARTITION BY cat_0 ORDER BY n DESC, term) AS place FROM (
      SELECT cat_0, term, sum(tf)::BIGINT AS n, count(*) AS df
      FROM terms JOIN words USING (item_id) GROUP BY ALL)) WHERE place <= 2000)""",
    ]


def _cellphones_query(plain: str, english: list[str]) -> str:
    filtered = without(plain, english)
    limits = {1: (1000, 20), 2: (1000, 20)}
    return with_ctes(
        DOC_ITEMS,
        percentile_cte("p", "doc_items", ["cat_1"], (10, 90)),
        "words AS MATERIALIZED (SELECT i.item_id, i.cat_1, "
        f"{filtered} AS words FROM doc_items i JOIN p ON i.cat_1 = p.cat_1 "
        "WHERE i.price BETWEEN p.p10 AND p.p90)",
        terms_cte(limits, stop=False),
        vocab_cte(limits),
        KNOWN,
        SAME_ITEMS,
        *model_ctes("0", "words", "''", "cat_1"),
        "root_items AS (SELECT item_id, '' AS parent FROM words)",
        *score_ctes("0", "root_items"),
        select="SELECT w.item_id, w.cat_1, prediction, label, score FROM words w "
        "JOIN pred0 USING (item_id)",
    )


def _chi_square_query() -> str:
    """Full 2 x K tables: observed against expected, present and absent."""
    return with_ctes(
        *pipeline(DOC_ITEMS, "doc_items", WORDS),
        "sizes AS (SELECT cat_2 AS class, count(*)::DOUBLE AS n FROM words GROUP BY 1)",
        "total AS (SELECT count(*)::DOUBLE AS all_items FROM words)",
        "cell AS (SELECT index, cat_2 AS class, count(*)::DOUBLE AS o FROM known "
        "JOIN words USING (item_id) GROUP BY ALL)",
        """stat AS (SELECT index, df, CASE WHEN df = all_items THEN 0.0 ELSE
  sum((o - n * df / all_items) * (o - n * df / all_items) / (n * df / all_items)
    + (o - n * df / all_items) * (o - n * df / all_items) / (n - n * df / all_items)) END AS statistic
  FROM (SELECT v.index, v.df, s.n, t.all_items, coalesce(c.o, 0) AS o
        FROM vocab v CROSS JOIN sizes s CROSS JOIN total t
        LEFT JOIN cell c ON c.index = v.index AND c.class = s.class)
  GROUP BY index, df, all_items)""",
        select="SELECT term, stat.df, round(statistic, 6) AS statistic FROM stat "
        "JOIN vocab USING (index) ORDER BY round(statistic, 6) DESC, term LIMIT 1000",
    )


# Taxonomy

NAMES = """names AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation)"""


def oracle_sql() -> dict[str, str]:
    part_columns = "i.item_id, i.title, i.cat_0, i.cat_1, i.cat_2, i.price"
    order_columns = "i.item_id, i.cat_0, i.cat_1, i.price"
    english = ENGLISH
    plain = (
        "CASE WHEN regexp_matches(lower(title), '^\\s+$') THEN [] ELSE "
        "string_split_regex(regexp_replace(lower(title), '\\s+$', ''), '\\s') END"
    )
    sql = {
        "json_items": with_ctes(
            PART_ITEMS, select="SELECT item_id, title, cat_0, cat_1, cat_2, price FROM part_items"
        ),
        "json_scan": with_ctes(
            PART_ITEMS, select="SELECT title, cat_0, cat_1, cat_2, price FROM part_items"
        ),
        "word_counts": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split("
        "regexp_replace(text, ' +$', ''), ' ')) AS word FROM documents "
        "WHERE NOT regexp_matches(text, '^ +$')) GROUP BY word",
        "normalize_v1": _titles(normalize_v1("title")),
        "normalize_v2": _titles(normalize_v2("title")),
        "normalize_v3": _titles(normalize_v3("title")),
        "normalize_v4": _titles(normalize_v4("title")),
        "normalize_v4_sheet": _titles(normalize_v4("title", "/", ())),
        "tokens": with_ctes(
            DOC_ITEMS,
            select=f"SELECT item_id, array_to_string({tokens('title')}, '|') AS tokens FROM doc_items",
        ),
        "tokens_plain": with_ctes(
            DOC_ITEMS,
            select=f"SELECT item_id, array_to_string({plain}, '|') AS tokens FROM doc_items",
        ),
        "stopwords_es": _token_query(without("words", LISTING)),
        "stopwords_en": _token_query(without("words", english), version=None),
        "ngrams_1": _token_query(grams(1)),
        "ngrams_2": _token_query(grams(2)),
        "ngrams_3": _token_query(grams(3)),
        "ngrams_filtered": with_ctes(
            DOC_ITEMS,
            f"words AS (SELECT item_id, {without(plain, english)} AS words FROM doc_items)",
            select=f"SELECT item_id, array_to_string({grams(2)}, '|') AS tokens FROM words",
        ),
        "vocab_words": _vocab_query(1),
        "vocab_2gram": _vocab_query(2),
        "vocab_3gram": _vocab_query(3),
        "vocab_sizes": with_ctes(
            *pipeline(DOC_ITEMS, "doc_items", LIMITS)[:-1],
            select="SELECT gram, count(*) AS terms FROM vocab GROUP BY ROLLUP (gram)",
        ),
        "vocab_per_category": with_ctes(
            *_category_ctes(), select="SELECT cat_0, index, term, n, df FROM best"
        ),
        "vector_per_category": with_ctes(
            *_category_ctes(),
            select="SELECT item_id, index, 1.0::DOUBLE AS value FROM terms JOIN best USING (term)",
        ),
        "count_vector": with_ctes(
            *pipeline(DOC_ITEMS, "doc_items", {1: (60_000, 100)}),
            select="SELECT item_id, index, tf::DOUBLE AS value FROM known",
        ),
        "assembled_vector": with_ctes(
            *pipeline(DOC_ITEMS, "doc_items", LIMITS),
            select="SELECT item_id, index, 1.0::DOUBLE AS value FROM known",
        ),
        "vectorizer_ml": with_ctes(
            *pipeline(DOC_ITEMS, "doc_items", {1: (60_000, 100)}),
            select="SELECT w.item_id, count(k.index) AS terms, coalesce(sum(k.tf), 0)::DOUBLE AS total "
            "FROM words w LEFT JOIN known k USING (item_id) GROUP BY w.item_id",
        ),
        "hashing_tf": with_ctes(
            DOC_ITEMS, words_cte("doc_items"), terms_cte((1,), stop=False), *murmur_ctes(20_000),
            select="SELECT item_id, bucket AS index, sum(tf)::BIGINT AS tf FROM terms JOIN hashed USING (term) GROUP BY ALL",
        ),
        "nb_hashed_grams": with_ctes(
            DOC_ITEMS, words_cte("doc_items", None), terms_cte((1, 2), stop=False), *murmur_ctes(20_000),
            "known AS MATERIALIZED (SELECT item_id, (bucket + CASE gram WHEN 1 THEN 20000 ELSE 0 END)::INTEGER AS index, "
            "sum(tf)::BIGINT AS tf FROM terms JOIN hashed USING (term) GROUP BY ALL)",
            "vocab AS (SELECT unnest(range(40000))::INTEGER AS index)",
            SAME_ITEMS, *model_ctes("0", "words", "''", "cat_0", True),
            "root_items AS (SELECT item_id, '' AS parent FROM words)", *score_ctes("0", "root_items", True),
            select=PREDICTED,
        ),
        "chisq_select": _chi_square_query(),
        "label_index": with_ctes(
            PART_ITEMS,
            select="SELECT (row_number() OVER (ORDER BY n DESC, label) - 1)::INTEGER AS label_index, "
            "label, n FROM (SELECT cat_1 AS label, count(*) AS n FROM part_items GROUP BY 1)",
        ),
        "label_index_levels": with_ctes(
            DOC_ITEMS,
            select="SELECT level, (row_number() OVER (PARTITION BY level ORDER BY n DESC, label) - 1)"
            "::INTEGER AS label_index, label, n FROM ("
            + " UNION ALL ".join(
                f"SELECT '{c}' AS level, {c} AS label, count(*) AS n FROM doc_items GROUP BY {c}"
                for c in CATS
            )
            + ")",
        ),
        "label_decode": with_ctes(
            PART_ITEMS,
            "l AS (SELECT cat_1, (row_number() OVER (ORDER BY count(*) DESC, cat_1) - 1)::INTEGER "
            "AS label FROM part_items GROUP BY cat_1)",
            select="SELECT item_id, label, cat_1 AS category FROM part_items JOIN l USING (cat_1)",
        ),
        "label_catalogue": with_ctes(
            PART_ITEMS,
            select="SELECT count(*) OVER () AS labels, (row_number() OVER (ORDER BY count(*) DESC, "
            "cat_0) - 1)::INTEGER AS label_index, cat_0 AS label FROM part_items GROUP BY cat_0",
        ),
        "one_hot": with_ctes(
            PART_ITEMS,
            "l AS (SELECT cat_0, row_number() OVER (ORDER BY count(*) DESC, cat_0) - 1 AS label "
            "FROM part_items GROUP BY cat_0)",
            select="SELECT item_id, array_to_string(list_transform(range(0, (SELECT count(*) - 1 "
            "FROM l)), lambda i: (i = label)::INTEGER), '|') AS one_hot "
            "FROM part_items JOIN l USING (cat_0)",
        ),
        "distinct_categories": with_ctes(
            PART_ITEMS,
            select=" UNION ALL ".join(
                f"SELECT '{c}' AS level, count(DISTINCT {c}) AS categories FROM part_items"
                for c in CATS
            ),
        ),
        "distinct_category": with_ctes(PART_ITEMS, select="SELECT DISTINCT cat_2 FROM part_items"),
        "distinct_pairs": with_ctes(
            PART_ITEMS, select="SELECT DISTINCT cat_0, cat_1 FROM part_items"
        ),
        "price_statistics": with_ctes(
            PART_ITEMS,
            select="SELECT cat_1, round(stddev_samp(price), 6) AS stddev_price, "
            "round(avg(price), 6) AS mean_price, round(max(price), 6) AS max_price, "
            "round(min(price), 6) AS min_price, round(avg(price), 6) AS avg_price, "
            "round(stddev_pop(price), 6) AS stddev_pop_price FROM part_items GROUP BY cat_1",
        ),
        "trim_counts": with_ctes(
            PART_ITEMS, percentile_cte("p", "part_items", ["cat_1"], (5, 95)),
            select="SELECT i.cat_1, count(*) AS items, count(price) AS with_price, "
            "count(*) FILTER (WHERE price BETWEEN p5 AND p95) AS kept "
            "FROM part_items i LEFT JOIN p ON i.cat_1 = p.cat_1 GROUP BY i.cat_1",
        ),
        "percentile_global": _percentile_query(
            ORDER_ITEMS, "order_items", [], (2, 5, 10, 90, 95, 98)
        ),
        "percentile_groups": _percentile_query(
            PART_ITEMS, "part_items", ["cat_2"], (5, 10, 90, 95)
        ),
        "percentile_lower": _percentile_query(
            ORDER_ITEMS, "order_items", ["cat_1"], (5, 10, 90, 95), interpolate=False
        ),
        "trim_global_2_98": _trim_query(ORDER_ITEMS, "order_items", [], 2, 98, order_columns),
        "trim_parent_5_95": _trim_query(PART_ITEMS, "part_items", ["cat_1"], 5, 95, part_columns),
        "trim_cat_10_90": _trim_query(PART_ITEMS, "part_items", ["cat_2"], 10, 90, part_columns),
        "trim_documents_10_90": _trim_query(
            DOC_ITEMS, "doc_items", ["cat_1"], 10, 90, "i.item_id, i.cat_0, i.cat_1, i.cat_2, i.price"
        ),
        "trim_rank_range": _rank_trim_query(
            PART_ITEMS, "part_items", "cat_1", 10, 90, "item_id, title, cat_0, cat_1, cat_2, price"
        ),
        "trim_rank_ties": _rank_trim_query(
            LINE_ITEMS, "line_items", "cat_0", 5, 95, "item_id, cat_0, price"
        ),
        "priced_category": with_ctes(
            PART_ITEMS,
            select="SELECT * FROM part_items WHERE cat_0 = 'ECONOMY' AND price IS NOT NULL",
        ),
        "first_items": with_ctes(
            PART_ITEMS,
            select="SELECT * FROM part_items ORDER BY price DESC NULLS LAST, item_id LIMIT 100",
        ),
        "price_band": with_ctes(
            PART_ITEMS, select="SELECT * FROM part_items WHERE price > 1 AND price < 999999"
        ),
        "split_keyed": with_ctes(
            DOC_ITEMS, select=f"SELECT item_id, {TRAIN} AS train FROM doc_items"
        ),
        "nb_bernoulli_model": _model_query(multinomial=False),
        "nb_multinomial_model": _model_query(multinomial=True),
        "nb_classes": with_ctes(
            *flat_ctes(score=False),
            select="SELECT class, label::INTEGER AS label, n AS items, round(prior, 6) AS prior, "
            "round(empty, 6) AS intercept, round(zero, 6) AS slope FROM base0",
        ),
        "nb_predict": with_ctes(*flat_ctes(), select=PREDICTED),
        "nb_predict_multinomial": with_ctes(*flat_ctes(multinomial=True), select=PREDICTED),
        "nb_model_roundtrip": with_ctes(*flat_ctes(), select=PREDICTED),
        "nb_new_items": with_ctes(
            *pipeline(DOC_ITEMS, "doc_items", WORDS),
            *model_ctes("0", "words", "''", "cat_0"),
            "turns AS MATERIALIZED (SELECT conv_id * 100000 + turn AS item_id, '' AS parent, "
            f"{without(tokens(normalize_v4('text')), LISTING)} AS words "
            "FROM conversations)",
            "turn_terms AS (SELECT item_id, 1 AS gram, term, count(*) AS tf FROM "
            "(SELECT item_id, unnest(words) AS term FROM turns) GROUP BY ALL)",
            "known_items AS MATERIALIZED (SELECT item_id, index, tf FROM turn_terms "
            "JOIN vocab USING (gram, term))",
            *score_ctes("0", "turns"),
            select="SELECT item_id, prediction, label, score FROM pred0",
        ),
        "nb_hier_model": _hier_model_query(),
        "nb_cascade": with_ctes(
            *hierarchy_ctes(DOC_ITEMS, "doc_items", GRAMS), *cascade_ctes(), select=CASCADE
        ),
        "vocab_million": with_ctes(
            DOC_ITEMS,
            words_cte("doc_items"),
            terms_cte((1, 2, 3)),
            select="SELECT (row_number() OVER (ORDER BY n DESC, term) - 1)::INTEGER AS index, term, n, df FROM "
            "(SELECT term, sum(tf)::BIGINT AS n, count(*) AS df FROM terms GROUP BY ALL) ORDER BY n DESC, term LIMIT 1000000",
        ),
        "count_vector_million": with_ctes(
            *pipeline(DOC_ITEMS, "doc_items", {1: (1_000_000, 20)}),
            select="SELECT item_id, index, tf::DOUBLE AS value FROM known",
        ),
        "taxonomy_tree": _NESTED + "SELECT id, name, parent, depth, path, names FROM tree",
        "enrich_ancestors": _NESTED + "SELECT o_orderkey AS item_id, o_orderpriority || coalesce(' ' || replace(names, '>', ' '), '') "
        "AS title, 'C' || o_custkey AS cat_0 FROM orders LEFT JOIN tree ON id = 'C' || o_custkey",
        "nb_cascade_repeated": with_ctes(
            *hierarchy_ctes(DOC_ITEMS, "doc_items", GRAMS),
            *cascade_ctes(),
            f"found AS ({CASCADE})",
            select="SELECT CASE WHEN item_id % 10 <> 0 THEN item_id % 50 END AS item_id, predicted_cat_0, "
            "predicted_cat_1, predicted_cat_2, count(*) AS n FROM found GROUP BY ALL",
        ),
        "mixed_cascade": with_ctes(
            *hierarchy_ctes(DOC_ITEMS, "doc_items", GRAMS),
            *cascade_ctes(),
            f"found AS ({CASCADE})",
            select="SELECT item_id, predicted_cat_0, predicted_cat_1, "
            "CASE WHEN predicted_cat_2 IS NOT NULL THEN true END AS leaf_is_child FROM found",
        ),
        "logreg_grouped": _grouped_query(),
        "price_positions": "SELECT l_orderkey * 10 + l_linenumber AS item_id, l_quantity AS price, "
        "row_number() OVER (ORDER BY l_quantity, l_orderkey * 10 + l_linenumber) - 1 AS position FROM lineitem",
        "nb_hier_parts": with_ctes(
            *hierarchy_ctes(PART_ITEMS, "part_items", {1: (1000, 2), 2: (1000, 2)}),
            *cascade_ctes(),
            select=CASCADE,
        ),
        "nb_under_parent": with_ctes(
            *hierarchy_ctes(DOC_ITEMS, "doc_items", WORDS),
            "own AS (SELECT item_id, cat_1 AS parent FROM words)",
            *score_ctes("2", "own"),
            select="SELECT w.item_id, w.cat_1, w.cat_2, prediction, label, score "
            "FROM words w LEFT JOIN pred2 USING (item_id)",
        ),
        "nb_cellphones": _cellphones_query(plain, english),
        "accuracy_total": with_ctes(
            *flat_ctes(), select=f"SELECT {EVALUATED} FROM words JOIN pred0 USING (item_id)"
        ),
        "accuracy_per_category": with_ctes(
            *flat_ctes(),
            select=f"SELECT cat_0, {EVALUATED} FROM words JOIN pred0 USING (item_id) GROUP BY cat_0",
        ),
        "holdout_flat": _holdout_query("cat_0", None, trim=False),
        "holdout_by_group": _holdout_query("cat_1", "cat_0", trim=True),
        "taxonomy_names": with_ctes(
            NAMES,
            select="SELECT id, name FROM names WHERE regexp_full_match(name, '[\\wÀ-ÿ\\s]+')",
        ),
        "enrich_title": with_ctes(
            NAMES,
            select="SELECT c_custkey AS item_id, c_name || ' ' || coalesce(r.name, '') || ' ' || "
            "coalesce(n.name, '') || ' ' AS title, 'R' || n_regionkey AS cat_0, "
            "'N' || c_nationkey AS cat_1, c_mktsegment AS cat_2 FROM customer "
            "JOIN nation ON c_nationkey = n_nationkey LEFT JOIN names r ON r.id = 'R' || n_regionkey "
            "LEFT JOIN names n ON n.id = 'N' || c_nationkey",
        ),
        "minmax_embeddings": """WITH e AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS position
  FROM embeddings),
b AS (SELECT position, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1)
SELECT vec_id, position::INTEGER AS position,
  round(CASE WHEN hi = lo THEN 0.5 ELSE (v - lo) / (hi - lo) END, 6) AS value
FROM e JOIN b USING (position)""",
        "vector_index": with_ctes(
            *[
                f"x_{name} AS (SELECT v, count(*) OVER () AS k, "
                f"row_number() OVER (ORDER BY v = 0 DESC, v) - 1 AS place "
                f"FROM (SELECT DISTINCT {column}::DOUBLE AS v FROM lineitem))"
                for name, column in _INDEXED.items()
            ],
            select="SELECT l_orderkey, l_linenumber, "
            + ", ".join(
                f"CASE WHEN x_{name}.k <= 100 THEN x_{name}.place::DOUBLE ELSE x_{name}.v END "
                f"AS {name}"
                for name in _INDEXED
            )
            + " FROM lineitem "
            + " ".join(
                f"JOIN x_{name} ON x_{name}.v = {column}" for name, column in _INDEXED.items()
            ),
        ),
    }
    return sql


_INDEXED = {
    "line": "l_linenumber",
    "quantity": "l_quantity",
    "discount": "l_discount",
    "price": "l_extendedprice",
}
