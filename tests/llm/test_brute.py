"""Operators that SQL cannot express, against brute force on small tables."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vitrina.llm import decontaminate, langid, near_dedup, ngram_lm, packing
from vitrina.llm.components import components
from vitrina.llm.eliasfano import EliasFano
from vitrina.llm.queries import REGISTRY
from vitrina.llm.words import find_words, word_hashes
from vitrina.session import materialize

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def documents(sf_dir):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf_dir}/documents.parquet'").fetchall()


# --- words ---


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a b\tA", None, "", "  x ", "é🙂 a", "\x0b\x0ca\x00b" * 3, "ab", "cd"]
    found = find_words(pa.array(texts))
    assert found.counts().tolist() == [len(words(t)) for t in texts]
    hashes = word_hashes(found)
    flat = [w for t in texts for w in words(t)]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert all((a == b) == (x == y) for (a, x), (b, y) in combinations(zip(hashes.tolist(), flat, strict=True), 2))


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["alpha beta " * 50, "x" * 500, "beta alpha"])
    whole = word_hashes(find_words(texts))
    monkeypatch.setattr("vitrina.llm.words.PIECE", 16)
    assert (word_hashes(find_words(texts)) == whole).all()
    sliced = word_hashes(find_words(texts.slice(2)))
    assert sliced.tolist() == [whole[1], whole[0]]


# --- Elias-Fano ---


@pytest.mark.parametrize("universe", [1, 2, 100, 10_000, 10**9])
def test_elias_fano(universe):
    rng = np.random.default_rng(universe)
    values = np.unique(rng.integers(0, universe, 300))
    sequence = EliasFano.build(values, universe)
    assert (sequence.values() == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, 300)])
    at = {int(v): i for i, v in enumerate(values)}
    assert sequence.find(asked).tolist() == [at.get(int(x), -1) for x in asked]
    steps = np.sort(rng.integers(0, universe, 300))
    assert (EliasFano.build(steps, universe).values() == steps).all()
    assert not len(EliasFano.build(values[:0], universe).values())


# --- language model ---


def brute_scores(rows, order, weights):
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    texts = [[*words(t), None] for _, t in rows]
    counts = Counter()
    for text, out in zip(texts, held, strict=True):
        if not out:
            for n in range(1, order + 1):
                counts.update(tuple(text[k : k + n]) for k in range(len(text) - n + 1))
    n_tokens = sum(len(t) for t, out in zip(texts, held, strict=True) if not out)
    v = sum(len(g) == 1 for g in counts)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.5) / (n_tokens + 0.5 * (v + 1))
        k = weights[len(gram)]
        return (counts[gram] + k * p(gram[1:])) / (counts[gram[:-1]] + k)

    out = []
    for (i, _), text, is_held in zip(rows, texts, held, strict=True):
        base = sum(math.log10(p((w,))) for w in text)
        model = sum(math.log10(p(tuple(text[max(0, k - order + 1) : k + 1]))) for k in range(len(text)))
        out.append((i, is_held, len(text), sum(counts[(w,)] > 0 for w in text), n_tokens, base, model))
    return out


def close(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-4, abs=1e-3)


def test_long_runs_of_one_high_part_are_halved(monkeypatch):
    run = np.arange(7, 5007, 2)
    values = np.concatenate([run, [1 << 40]])
    built = EliasFano.build(values, (1 << 40) + 1)
    calls, low = [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, i: calls.append(len(i)) or low(self, i))
    asked = np.arange(5020)
    found = built.find(asked)
    assert found.tolist() == [(x - 7) // 2 if x % 2 and 7 <= x < 5007 else -1 for x in range(5020)]
    assert built.find(np.array([1 << 40])).tolist() == [len(run)]
    assert len(calls) < 25  # one by one they would be as many as the run has elements


@pytest.mark.parametrize(("order", "block"), [(1, 50), (2, 1 << 20), (3, 40), (3, 1 << 20)])
def test_lm(spark, monkeypatch, order, block):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 60)
    rows = [(i, " ".join(f"w{(i * k) % 5}" for k in range(i % 9))) for i in range(40)]
    rows += [(None, "W0 w1"), (7, "w0 w1 w0 w1"), (7, "w0 w1 w0 w1"), (90, None), (91, " \n"), (92, "un seen"), (93, "w1 " * 100)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").coalesce(2)
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block)
    held = langid.crc_remainder(df["doc_id"], 5) == 1
    found = ngram_lm.score_texts(df, held, order)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), r[2], r[5])
    close(sorted((tuple(r) for r in found.select(names).collect()), key=key), sorted(brute_scores(rows, order, ngram_lm.WEIGHTS), key=key))
    assert not ngram_lm.score_texts(df.limit(0), held, order).take(1)


def test_lm_blocks_that_follow_each_other_share_messages(spark, monkeypatch):
    """With many shards messages are not blocks times shards, and every block still gets its own totals."""
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 9))) for i in range(120)] + [(None, "w0 w1"), (7, "w0 w1 w0 w1"), (92, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for name, value in (("SHARD_TOKENS", 60), ("BLOCK_TOKENS", 40), ("FEW_SHARDS", 2)):
        monkeypatch.setattr(ngram_lm, name, value, raising=False)
    tables = {}

    def written(df, name, *args):
        table = materialize(df, name, *args)
        tables.setdefault(name, []).append(table)
        return table

    monkeypatch.setattr(ngram_lm, "materialize", written)
    held = langid.crc_remainder(df["doc_id"], 5) == 1
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), r[2], r[5])
    found = ngram_lm.score_texts(df, held, 3).select(names).collect()
    close(sorted(map(tuple, found), key=key), sorted(brute_scores(rows, 3, ngram_lm.WEIGHTS), key=key))
    blocks = tables["lm_blocks"][0].count()
    for answers in tables["lm_answers"]:
        sent = answers.where("block >= 0")
        assert blocks > 10 and sent.count() * 3 < blocks * sent.select("shard").distinct().count()


def test_lm_beats_its_base_on_held_out_texts(spark, sf_dir):
    rows = REGISTRY["op5_lm"](spark, sf_dir).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    expected = {r[0]: r for r in brute_scores([r[:2] for r in documents(sf_dir)], ngram_lm.ORDER, ngram_lm.WEIGHTS)}
    for r in rows:
        close([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))], [expected[r["doc_id"]]])


# --- near duplicates ---


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    meet = {}
    for i, s in enumerate(sets):
        for x in s:
            meet.setdefault(x, []).append(i)
    pairs = {(a, b) for group in meet.values() if len(group) < 400 for a, b in combinations(group, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return sorted((doc, len(sets[i]), smallest[find(i)], doc == smallest[find(i)]) for i, (doc, _) in enumerate(rows))


def found_components(df):
    return sorted(tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def copies(rng, text, n, change):
    w = text.split()
    out = []
    for _ in range(n):
        own = list(w)
        for k in range(change):
            own[int(rng.integers(len(own)))] = f"new{rng.integers(10**9)}"
        out.append(" ".join(own))
    return out


def corpus():
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 5000, n))
    shared = prose(60)
    texts = [prose(120) for _ in range(60)] + [f"{prose(150)} {shared} {prose(150)}" for _ in range(150)]
    texts += copies(rng, prose(200), 150, 1) + copies(rng, prose(200), 80, 4) + [texts[3]] * 40 + copies(rng, shared, 60, 1)
    texts += ["", "one two", "ONE two", "one  two", "a b c d", "a b c e", None, " "]
    return [(1000 + 3 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [1024, 4])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    assert found_components(df) == brute_components(rows)


def test_near_duplicates_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    rows = corpus()[::2]
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


@pytest.mark.parametrize("probe", [8, 1024])
def test_near_duplicates_after_likeliest_links(spark, monkeypatch, probe):
    """Members of many tiles, most of them joined by their likeliest links; the rest is found by all pairs."""
    monkeypatch.setattr(near_dedup, "TILE", 4)
    monkeypatch.setattr(near_dedup, "PROBE", probe)
    rows = corpus()
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


@pytest.mark.parametrize("dense", [near_dedup.DENSE, 2.0])
def test_near_duplicates_chained_to_a_large_family(spark, monkeypatch, dense):
    """Every second text links with one other of the family only; exhaustive or, without dense nodes, by trees."""
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "SMALL", 64)
    rng = np.random.default_rng(9)
    base, texts = [f"t{x}" for x in rng.integers(0, 5000, 200)], []
    new = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
    for _ in range(300):
        k = int(rng.integers(0, 90))
        linked = base[:k] + new(8) + base[k + 8 :]  # 12 of 196 shingles differ
        k = int(rng.integers(100, 180))
        texts += [" ".join(linked), " ".join(linked[:k] + new(20) + linked[k + 20 :])]  # 24 more
    rows = [(i, t) for i, t in enumerate([" ".join(base), *texts])]
    found = found_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[0] for r in found if r[2] != 0] == []


@pytest.mark.parametrize("most", [near_dedup.CONFIRM, 1000])
def test_pairs_of_a_family_below_the_threshold_never_become_rows(spark, monkeypatch, most):
    """Texts that are all just below the threshold: no step joins sets to each of their pairs."""
    seen, confirmed = [], near_dedup._Join.confirmed
    monkeypatch.setattr(near_dedup._Join, "confirmed", lambda self, pairs: seen.append(pairs.count()) or confirmed(self, pairs))
    monkeypatch.setattr(near_dedup, "CONFIRM", most)
    rng = np.random.default_rng(3)
    prose = " ".join(f"t{x}" for x in rng.integers(0, 5000, 200))
    rows = list(enumerate(copies(rng, prose, 160, 4)))
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)
    assert max(seen) <= near_dedup.ROOTS * len(rows)  # by pairs it were 9,424


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_cut_pairs_are_whole_and_bounded(most):
    sizes = np.arange(1, 21)
    pairs = np.array(list(combinations(range(20), 2)))
    parts = list(near_dedup._cut(pairs, sizes, most))
    assert sorted(tuple(p) for part in parts for p in part) == [tuple(p) for p in pairs]
    assert all(len(part) == 1 or sizes[np.unique(part)].sum() <= most for part in parts)


def test_trees_reach_the_stated_miss():
    assert near_dedup.tree_miss(near_dedup.TREES) + (1 - near_dedup.THRESHOLD / 100) ** near_dedup.ROOTS <= near_dedup.MISS / 2


@pytest.mark.parametrize("share", [near_dedup.THRESHOLD / 100, near_dedup.RING / 100])
def test_sketches_miss_no_more_than_stated(share):
    least = near_dedup.least_agreement(share)
    below = [math.comb(256, k) * share**k * (1 - share) ** (256 - k) for k in range(257) if k / 256 < least]
    assert 0 < sum(below) <= near_dedup.MISS / 4


def test_near_duplicates_on_documents(spark, sf_dir):
    rows = [r[:2] for r in documents(sf_dir)]
    found = REGISTRY["op6_near_dedup"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(tuple(r) for r in found.collect()) == brute_components(rows)


def test_near_duplicates_cases(spark):
    schema = "doc_id long, text string"
    text = "one two three four five six"
    rows = near_dedup.near_duplicates(spark.createDataFrame([(None, text), (None, None), (4, text), (4, text), (5, None)], schema)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [
        ("4", "4", True), ("4", "4", True), ("5", "5", True), ("None", "4", False), ("None", "None", True),
    ]
    assert not near_dedup.near_duplicates(spark.createDataFrame([], schema)).take(1)


def test_a_task_holds_the_shingles_and_hits_of_little_text():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i:06d}" for i in range(200_000)])
    passages = [" ".join(rng.choice(words, 60)) for _ in range(200)]
    texts = [" ".join([*rng.choice(words, 2000), passages[i % 200], passages[i % 7]]) for i in range(400)]  # 7 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    word_hashes(find_words(pa.array(["tables of powers"])))
    held = SimpleNamespace(value=decontaminate.Patterns.build(list(range(200)), passages))
    for step, rows, most in ((near_dedup._prints, 400, 32), (near_dedup._sets, 400, 32), (decontaminate._report(held), None, 128)):
        tracemalloc.start()
        found = 0
        for part in step(iter([batch])):
            found += part.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == rows or rows is None and found >= 400
        assert peak < most << 20


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 102), (101, 102), (7, 7), (100, 103), (300, 299)]
    df = spark.createDataFrame(links, "u long, v long")
    found = {r["vertex"]: r["label"] for r in components(df).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100), 299: 299, 300: 299}


# --- decontamination ---


def benchmark_rows(sf_dir):
    return duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()


def plain(text):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower()))


def test_contaminated_documents(spark, sf_dir):
    """Whole items are found by plain search too; every other match must lie within the edit budget."""
    docs, items = documents(sf_dir), benchmark_rows(sf_dir)
    expected = {(d, i) for d, t, *_ in docs for i, x in items if plain(x) in plain(t)}
    found = {(r["doc_id"], r["item_id"]): r for r in REGISTRY["op7_decontaminate"](spark, sf_dir).collect()}
    assert expected and expected <= set(found)
    for d, i in set(found) - expected:
        text, item = plain(dict((r[0], r[1]) for r in docs)[d]), plain(dict(items)[i])
        assert any(item[k : k + 20] in text for k in range(len(item) - 19))


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pattern, text = (bytes(rng.integers(97, 100, n).tolist()) for n in (12, int(rng.integers(0, 25))))
        distance = brute_distance(pattern, text)
        for budget in (0, 2, 12):
            assert decontaminate.alignment(pattern, text, budget) == (distance if distance <= budget else None)


def test_edited_passages(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(n))
    items = [(i, prose(30).capitalize() + ".") for i in range(20)] + [(90, None), (91, ""), (92, "short"), (3, prose(5))]
    docs, expected = [], set()
    for i, text in items[:20]:
        letters = list(text)
        for k in rng.choice(len(letters), 5, replace=False):
            letters[k] = "" if k % 2 else "#z"
        docs.append((i, f"{prose(40)}\n{''.join(letters).upper()} {prose(10)}"))
        docs.append((100 + i, prose(60)))
        docs.append((200 + i, text[:60]))  # too little of the item
        expected.add((i, i))
    docs += [(300, None), (301, ""), (302, "x"), (None, items[5][1]), (303, items[6][1]), (303, items[6][1])]
    docs.append((304, prose(20000) + items[7][1] + prose(20000)))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()]
    assert set(rows) == expected | {(None, 5), (303, 6), (304, 7)}
    assert rows.count((303, 6)) == 2
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter(d for d, _ in docs if not (d in range(20) or d in (None, 303, 304)))
    assert not decontaminate.contaminated(df.limit(0), bench).take(1)
    assert not decontaminate.contaminated(df, bench.limit(0)).take(1)
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def test_benchmark_in_parts(spark, monkeypatch, sf_dir):
    whole = {(r["doc_id"], r["item_id"], r["edits"]) for r in REGISTRY["op7_decontaminate"](spark, sf_dir).collect()}
    monkeypatch.setattr(decontaminate, "PART_BYTES", 2000)
    parts = {(r["doc_id"], r["item_id"], r["edits"]) for r in REGISTRY["op7_decontaminate"](spark, sf_dir).collect()}
    assert whole == parts


@pytest.mark.parametrize("step", [1, 7, 100, 1000])
def test_slices_of_hits_lose_no_text(monkeypatch, step):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    prose = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(n))
    items = [prose(30) for _ in range(10)]
    patterns = decontaminate.Patterns.build(list(range(10)), items)
    texts = pa.array([f"{prose(i % 5)} {items[i % 10]} {prose(3)}" if i % 3 else prose(20) for i in range(60)])
    whole = decontaminate.matches(texts, patterns)
    assert set(whole) == {i for i in range(60) if i % 3}
    monkeypatch.setattr(decontaminate, "SLICE", step)
    assert decontaminate.matches(texts, patterns) == whole


@pytest.mark.parametrize("n", [20, 30, 55])
def test_exact_excerpts_are_found_wherever_they_begin(n):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(n))
    item, other = prose(n), prose(30)
    patterns = decontaminate.Patterns.build([7, 8], [item, other])
    assert decontaminate.SURE < 80 <= len(item)
    cuts = [item[k : k + decontaminate.SURE] for k in range(len(item) - decontaminate.SURE + 1)]
    found = decontaminate.matches(pa.array([f"{prose(12)} {x} {prose(12)}" for x in cuts]), patterns)
    assert {d: set(x) for d, x in found.items()} == {d: {7} for d in range(len(cuts))}


def test_short_items_are_matched_as_whole_words():
    import pyarrow as pa

    items = [(1, "Yes!"), (2, "forty-two"), (3, "the Nile"), (4, "..."), (5, "forty two"), (6, "a b c d e f g h i j k")]
    patterns = decontaminate.Patterns.build(*map(list, zip(*items, strict=True)))
    texts = ["yes", "yesterday", "The\nNILE.", "the nile delta and the nile", "lathe niles", "the", "Nile", "say forty  two, yes", "forty twos", None, "", "a b c d e f g h i j k", "a b c d e f g h i j kl", "forty", "two"]
    found = decontaminate.matches(pa.array(texts), patterns)
    assert {d: set(x) for d, x in found.items()} == {0: {1}, 2: {3}, 3: {3}, 7: {1, 2, 5}, 11: {6}}
    assert found[3][3][2] == 0 and found[7][5][2] == 4


# --- language identification ---


def test_langid_on_documents(spark, sf_dir):
    langs = {r[0]: r[2] for r in documents(sf_dir)}
    rows = REGISTRY["op10_langid"](spark, sf_dir).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_langid_mixtures(spark, sf_dir):
    docs = documents(sf_dir)
    text = {lang: next(t for _, t, x, _ in docs if x == lang and len(t) > 3000)[:3000] for lang in ("en", "de", "fr")}
    model = langid.learn(spark.createDataFrame([(t, x) for _, t, x, _ in docs], "text string, lang string"))
    rows = [
        (1, text["en"]), (2, text["de"] + " " + text["fr"][:1200]), (3, None), (4, ""), (5, "123 — …"), (6, text["fr"] * 40), (6, text["de"]),
        (None, text["en"]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, model, {"doc_id": df["doc_id"]}).collect()]
    assert [x[:2] for x in found] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "fr"), (6, "de"), (None, "en")]
    assert found[0][2] > 0.95 and 0.6 < found[1][2] < 0.85 and found[2][2] == 0
    assert not langid.identify(df.limit(0), model, {"doc_id": df["doc_id"]}).take(1)


def test_langid_without_anything_to_learn_from(spark):
    model = langid.learn(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string"))
    df = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert langid.identify(df, model, {"doc_id": df["doc_id"]}).first()["lang_pred"] == "und"


def test_mixture_is_a_maximum():
    rng = np.random.default_rng(4)
    logs = rng.normal(size=(400, 3)).astype(np.float32) * 2
    share = langid.mixtures(logs, np.array([0, 250]))
    for part, found in ((logs[:250], share[0]), (logs[250:], share[1])):
        value = lambda s: np.log(np.exp(part) @ s + 1e-300).sum()  # noqa: B023,E731
        used = found > 0
        for i, j in combinations(np.flatnonzero(used), 2):
            for step in (0.05, -0.05):
                moved = found.copy()
                moved[i] += step
                moved[j] -= step
                if moved.min() >= 0:
                    assert value(moved) <= value(found) + 0.5


# --- packing ---


def brute_pack(sizes, sources, clusters, capacity):
    pieces = [(min(capacity, n - at), r, at // capacity, at) for r, n in enumerate(sizes) for at in range(0, max(1, n), capacity)]
    bins, out = [], []
    for size, row, piece, at in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        fit = [(free, i) for i, (free, s, c) in enumerate(bins) if free >= size and free and sources[row] not in s and clusters[row] not in c]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append((capacity, set(), set()))
        free, s, c = bins[i]
        bins[i] = (free - size, s | {sources[row]}, c | {clusters[row]})
        out.append((row, piece, at, size, i))
    return out


@pytest.mark.parametrize(("capacity", "n_sources"), [(1, 3), (20, 4), (64, 9), (100, 2)])
def test_best_fit(capacity, n_sources):
    rng = np.random.default_rng(capacity)
    sizes = rng.integers(0, 3 * capacity // 2 + 1, 250)
    sources = [int(x) if x else None for x in rng.integers(0, n_sources, 250)]
    clusters = rng.integers(0, 60, 250).tolist()
    assert packing.pack_unit(sizes, sources, clusters, capacity) == brute_pack(sizes.tolist(), sources, clusters, capacity)


def check_packed(rows, capacity, sizes, sources, clusters):
    placed, filled = Counter(), {}
    for r in rows:
        placed[r["doc_id"]] += r["n_tokens"]
        filled.setdefault(r["bin_id"], []).append(r)
    assert placed == Counter(sizes)
    for pieces in filled.values():
        assert sum(p["n_tokens"] for p in pieces) <= capacity
        assert len({p["source"] for p in pieces}) == len(pieces) == len({clusters[p["doc_id"]] for p in pieces})
        at = 0
        for p in sorted(pieces, key=lambda p: p["position"]):
            assert p["bin_offset"] == at and p["source"] == sources[p["doc_id"]]
            at += p["n_tokens"]


def test_a_shard_answers_in_one_batch():
    """Batches grow with the shards, not with blocks times shards; totals are those of all blocks."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sent = [(shard, block, np.unique(rng.integers(0, 50, 20).astype(np.uint64))) for shard in (3, 7) for block in range(40)]
    counts = [rng.integers(0, 4, len(k)).astype(np.uint32) for _, _, k in sent]
    rows = [
        {"shard": s, "block": b, "order": 1, "keys": ngram_lm._planes(np.diff(k, prepend=np.uint64(0))), "counts": ngram_lm._planes(c)}
        for (s, b, k), c in zip(sent, counts, strict=True)
    ]
    got = list(ngram_lm._totals(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(got) == 2
    answers = {(r["shard"], r["block"]): r for batch in got for r in batch.to_pylist()}
    for shard in (3, 7):
        total = Counter()
        for (s, _, k), c in zip(sent, counts, strict=True):
            if s == shard:
                total.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
        for s, b, k in sent:
            if s == shard:
                assert ngram_lm._from_planes(answers[s, b]["totals"], np.uint64).tolist() == [total[x] for x in k.tolist()]
        assert answers[shard, -1]["trained"] == sum(n > 0 for n in total.values())


def test_only_repeated_clusters_take_bits(monkeypatch):
    """The bitmaps of bins are as wide as the number of repeated clusters, not as the unit."""
    seen = []
    place = packing.Bins.place
    monkeypatch.setattr(packing.Bins, "place", lambda self, size, source, cluster: (seen.append(cluster), place(self, size, source, cluster))[1])
    clusters = [f"own {i}" for i in range(500)] + ["twice", "twice"]
    placed = packing.pack_unit(np.full(502, 3), ["a"] * 251 + ["b"] * 251, clusters, 8)
    assert max(seen).bit_length() == 1 and len(placed) == 502
    bins = [p[4] for p in placed if p[0] >= 500]
    assert bins[0] != bins[1]


def test_packed_documents(spark, sf_dir):
    docs = documents(sf_dir)
    rows = REGISTRY["op2_packing"](spark, sf_dir).collect()
    sizes = {d: len(words(t)) + 1 for d, t, *_ in docs}
    clusters = {d: re.sub(r"\s+", " ", (t or "").lower()) for d, t, *_ in docs}
    check_packed(rows, packing.CAPACITY, sizes, {d: s for d, _, _, s in docs}, clusters)


def test_packing_cases(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a", 5, "x"), (1, "a", 5, "x"), (2, None, None, None), (3, None, 0, None), (None, "b", 25, "x"), (4, "b", -3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, bin_id int, piece string")
    found = packing.pack(df, F.col("bin_id"), F.col("piece"), capacity=10, unit_rows=4).collect()
    assert Counter(r["doc_id"] for r in found) == {1: 2, 2: 1, 3: 1, None: 3, 4: 1}
    assert sum(r["n_tokens"] for r in found) == 35
    assert not packing.pack(df.limit(0), F.col("bin_id"), F.col("piece")).take(1)


# --- pipeline ---


def test_pipeline(spark, sf_dir):
    docs = documents(sf_dir)
    lettered = [(d, t) for d, t, *_ in docs if t and any(c.isalpha() for c in t)]
    single = {r[0] for r in brute_components(lettered) if r[3]}
    leaked = {r["doc_id"] for r in REGISTRY["op7_decontaminate"](spark, sf_dir).select("doc_id").collect()}
    kept = {d: t for d, t in lettered if d in single - leaked}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    sizes = {d: len(words(t)) + 1 for d, t in kept.items()}
    clusters = {d: re.sub(r"\s+", " ", t.lower()) for d, t in kept.items()}
    check_packed(rows, packing.CAPACITY, sizes, {d: s for d, _, _, s in docs}, clusters)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, tmp_path):
    text = "one two three four five six seven"
    rows = [
        (1, text, "en", "s", 1, 5), (1, text, "en", "s", 1, 6), (2, text, "en", "s", 1, 7), (None, text, None, None, None, 8), (3, None, "en", "s", 0, 9),
        (4, "", "en", "s", 0, 9), (5, "12 34", "en", "s", 0, 9), (6, "other words entirely", "en", "s", 0, None), (1, "not the same text at all", "en", "s", 0, 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter([(1, text), (None, text), (1, rows[-1][1]), (6, rows[7][1])])
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, empty, sf_dir).take(1)
