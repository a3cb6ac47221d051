"""Alignment, prefix trie and URL filter against brute force and SQL on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vitrina.checks.compare import duck_rows, spark_rows
from vitrina.llm import align, trie, urls
from vitrina.llm.oracle import oracle_sql
from vitrina.llm.queries import REGISTRY
from vitrina.operators.positions import dense_positions

# --- alignment ---


def tokenizers():
    from pathlib import Path

    return align.load_sides(Path(align.TOKENIZER_A).read_text(encoding="utf-8"), Path(align.MODEL_B).read_bytes())


def plain_groups(text, a, b):
    """Groups by walking both token lists, one token at a time."""
    if not text:
        return []
    x, y = list(a.encode([text])[0]), list(b.encode([text])[0])
    data = b" " + text.encode()
    if b"".join(a.pieces[i] for i in x) != data or b"".join(b.pieces[i] for i in y) != data:
        return []
    groups, left, right, at, bt, i, j = [], [], [], 0, 0, 0, 0
    while i < len(x) or j < len(y):
        if at <= bt and i < len(x):
            left.append(x[i])
            at += len(a.pieces[x[i]])
            i += 1
        else:
            right.append(y[j])
            bt += len(b.pieces[y[j]])
            j += 1
        if at == bt:
            groups.append((left, right))
            left, right = [], []
    return groups


def plain_alignment(rows):
    a, b = tokenizers()
    groups = [(i, plain_groups(t, a, b)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, gs in groups for g in gs)
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, gs in groups:
        links = [(x[-1], y[-1]) for x, y in gs]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((
            i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(counts[p] == top[p[1]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if gs else "",
        ))
    return sorted(out, key=str)


TEXTS = [
    (1, "Hello there, tokenizers!"), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n\n\t"), (6, "日本語🙂 café naïve ﷽"), (7, "▁ the piece's own sign"),
    (8, "<s> </s> <|endoftext|> <0x41> <unk>"), (9, "a\x00b\x1f\x7f"), (1, "Hello there, tokenizers!"), (None, "no id"), (10, "x" * 3000), (11, "word " * 5000),
]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_alignment(spark, monkeypatch, most):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in TEXTS], "doc_id long, text string, n_a int, `__text` string")
    found = sorted([tuple(r) for r in align.corpus_links(df, max_rows=most).collect()], key=str)
    assert found == plain_alignment(TEXTS)
    by_id = {r[0]: r for r in found}
    assert by_id[7][1:] == (0, 0, 0, 0, 0, 0, "") and by_id[2][7] == by_id[3][7] == ""
    assert not align.corpus_links(df.limit(0)).take(1)


def test_alignment_of_documents(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    found = sorted([tuple(r) for r in REGISTRY["op11_alignment"](spark, sf_dir).collect()], key=str)
    assert found == plain_alignment(rows)


def test_aligned_tokens_spell_the_text(spark):
    from pyspark.sql import functions as F

    a, b = tokenizers()
    df = spark.createDataFrame([(i, t) for i, t in TEXTS], "doc_id long, text string")
    for row in align.align(df, {"doc_id": F.col("doc_id"), "text_again": F.col("text")}).collect():
        if row.a_ids:
            assert b"".join(a.pieces[i] for i in row.a_ids) == b"".join(b.pieces[i] for i in row.b_ids) == b" " + row.text_again.encode()
        assert sum(row.a_sizes) == len(row.a_ids) and sum(row.b_sizes) == len(row.b_ids) and len(row.a_sizes) == len(row.b_sizes)


def test_pointer_jumping_finds_long_chains():
    n = 5000  # tokens of two bytes, shifted against each other by one: one component
    a = np.append(np.arange(1, 2 * n, 2), 2 * n)
    assert set(align.terminals(a, np.arange(2, 2 * n + 1, 2)).tolist()) == {n - 1}
    same = np.arange(1, 10)
    assert align.terminals(same, same).tolist() == [*range(9), *range(9)]
    assert not len(align.terminals(same[:0], same[:0]))


def test_both_ways_of_encoding_agree():
    from pathlib import Path

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(align.TOKENIZER_A)
    slow.encode_special_tokens = True
    a, _ = tokenizers()
    assert align.merge_ranks(Path(align.TOKENIZER_A).read_text(encoding="utf-8"), a.pieces)
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices(" \t\n\r\x0b\x0c\x1c\x85\xa0ab'1sd", k=30)) for _ in range(3000)]
    texts += [" ".join(rng.choices(["can't", "it's", "I'LL", "thé", "2024", "  ", "\n\n", "<|endoftext|>", "ﬁ", "日本"], k=9)) for _ in range(500)]
    assert a.encode(texts) == [x.ids for x in slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]


# --- trie ---


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    members, built = defaultdict(list), {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, 5 * int(c / 5)
        built[c] = own.get(base, [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, saved, leaves = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(
        [(
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest(),
        ) for p, m in members.items()],
        key=str,
    )


def chats(seed):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "x"), (100, 1, "user", "a"), (101, 1, "user", "a"), (102, None, None, None)]
    for c in rng.sample(range(-20, 60), 40):
        for t in range(rng.choice([1, 2, 3, 12, 17])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é🙂", None, ""])))
    return rows + rows[-3:]


@pytest.mark.parametrize("block, span", [(8, 1024), (2, 2)])
def test_trie(spark, monkeypatch, block, span):
    monkeypatch.setattr(trie, "SEGMENT_BYTES", 4)
    rows = chats(block)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n long, pos int")
    turns, convs = trie.graft_heads(trie.numbered_turns(df))
    found = sorted([tuple(r) for r in trie.prefix_trie(turns, convs, block, span).collect()], key=str)
    assert found == plain_trie(rows)
    turns, convs = trie.graft_heads(trie.numbered_turns(df.limit(0)))
    assert not trie.prefix_trie(turns, convs).take(1)


def test_trie_sql_agrees_with_plain(spark):
    rows = chats(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = con.sql(f"select {', '.join(names)} from ({oracle_sql()['op12_prefix_trie']})").fetchall()
    assert sorted(found, key=str) == plain_trie(rows)


def test_positions_of_turns_meet_over_partitions(spark):
    df = spark.createDataFrame([(i % 3, i // 3) for i in range(600)], "g long, i long")
    rows = dense_positions(df, ["g", "i"], partitions=7).collect()
    assert [(r.g, r.i) for r in sorted(rows, key=lambda r: r.position)] == sorted((i % 3, i // 3) for i in range(600))


# --- URL filter ---

PAGES = [
    (1, "https://WWW.Example.com/en/x?y=/fr/#z", "<p>free bets now free casino</p>"), (2, "http://a.example.com/en/1", "<style>nothing</style><p>bets casino win</p>"),
    (3, "http://notexample.com/en/1", None), (4, "http://shop.net/es/9", "win win free"), (5, "http://shop.net/de/9", ""), (6, None, "free"), (7, "no scheme", "x"),
    (8, "http://example.com", "<!-- gone --> visible"), (9, "http://user:pw@casinofreebets.org:80/Casino/2024?q", "casino.example.com is no word"),
    (None, "ftp://com/", "<script>var bets</script>"), (10, "http://netz.net/fr/" + "a" * 3000 + "/12", "a a"), (11, "://", ""), (1, "https://freewin.info/free-casino/77/3", "É été"),
    (12, "x://y://z/en/", "z"), (13, "http://été.example.net/fr/", "été été"),
]


@pytest.mark.parametrize("rows", [PAGES, PAGES[5:7], []])
def test_urls(spark, rows):
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id bigint, url varchar, html varchar)")
    if rows:
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert spark_rows(urls.judge(df)) == duck_rows(con, oracle_sql()["op13_urls"])


def test_rules(spark):
    df = spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string")
    found = {(r.page_id, r.host): r for r in urls.judge(df).collect()}
    assert found[1, "www.example.com"].rule == "www.example.com/en/" and found[1, "www.example.com"].verdict == "allow"
    assert found[1, "www.example.com"].path == "/en/x" and found[2, "a.example.com"].rule == "example.com/en/"
    assert found[3, "notexample.com"].rule == "com/" and found[4, "shop.net"].verdict == "block" and found[5, "shop.net"].rule is None
    assert (found[6, ""].path, found[7, ""].path, found[8, "example.com"].rule) == ("", "", None)
    assert found[9, "user:pw@casinofreebets.org:80"].path == "/Casino/2024"


def test_names_are_split_into_known_words():
    ln = {"free": 100, "bets": 120, "freeb": 900, "casino": 90}
    name = "freebetscasinoq"
    known = {(i, i + len(w)): c for w, c in ln.items() for i in range(len(name)) if name.startswith(w, i)}
    assert urls.split_name(name, known, 300, 400) == ["free", "bets", "casino", "q"]
    assert urls.split_name("zzzz", {}, 300, 400) == ["zzzz"] and urls.split_name("", {}, 1, 1) == []


def test_bayes_learns_words_of_host_names(spark):
    """Held-out names made of words that rules have judged in other names."""
    good, bad = ["garden", "school", "river", "music", "paper"], ["casino", "bets", "poker", "jackpot", "bonus"]
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words, top = (good, "com") if i % 2 else (bad, "net")
        rows.append((i, f"http://{''.join(rng.sample(words, 2))}.{top}/{'fr' if top == 'net' else 'a'}/{i}", " ".join(good + bad)))
    rows += [(1000 + i, f"http://{a}{b}.org/{i}", "") for i, (a, b) in enumerate([(x, y) for x in good for y in good if x != y])]
    rows += [(2000 + i, f"http://{a}{b}.org/{i}", "") for i, (a, b) in enumerate([(x, y) for x in bad for y in bad if x != y])]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i].verdict == ("allow" if i < 2000 else "block") for i in found if i >= 1000)
    assert found[1000].host_words == "garden school"
