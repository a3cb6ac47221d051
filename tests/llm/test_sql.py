"""Cases that the given tables do not have, against the same SQL as the registered queries."""

import duckdb
import pytest

from vitrina.checks.compare import duck_rows, spark_rows
from vitrina.llm import chat, licences, sharding, topk, warc
from vitrina.llm.oracle import oracle_sql

SQL = oracle_sql()


def duck(sql, **tables):
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return duck_rows(con, sql)


LICENSE_TEXTS = [
    (1, "MIT License. mit license, and MIT\nlicense"),
    (2, None),
    (3, ""),
    (4, "  ...  "),
    (5, "Licensed under the Apache License, Version 2.0."),
    (5, "Licensed under the Apache License, Version 2.0."),
    (None, "the GNU general public license (general  public-license)"),
    (6, "mit"),
    (7, "licensed\x00under THE very apache license version 2 0 ÉTÉ mit-licensé"),
    (8, "you may not use this file except in plain compliance with the license " * 300),
    (9, "general public mit license public license"),
]


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, "x", "mit") for i, t in LICENSE_TEXTS], "doc_id long, text string, label string, w string")
    found = spark_rows(licences.scan(df))
    assert found == duck(SQL["op4_licenses"], documents=("doc_id bigint, text varchar", LICENSE_TEXTS))
    by_id = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert (by_id[1]["n_base"], by_id[1]["first_word"], by_id[1]["last_word"]) == (3, 0, 5)
    assert by_id[8]["n_base"] == 0 and by_id[8]["labels"] == "apache"
    assert not licences.scan(df.limit(0)).take(1)


TURNS = [
    (1, 2, "assistant", "a < b <| </s> <\\| [INST][/INST]"),
    (1, 1, "user", None),
    (1, 1, None, "tie"),
    (2, 1, "assistant", ""),
    (2, 1, "assistant", ""),
    (3, 0, "a\\n\nb<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nno"),
    (4, 5, "assistant", "<"),
    (4, 6, "assistant", "\\|<|endoftext|>"),
    (4, 7, "assistant", "日本語🙂 \n\n"),
    (None, 1, "assistant", "no id"),
    (5, None, "assistant", "first"),
    (5, 0, "assistant", "x" * 5000),
]


@pytest.mark.parametrize("segment_chars", [1 << 20, 1])
def test_chat(spark, segment_chars):
    rows = [*TURNS, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, segment long")
    segments = chat.format_conversations(df, segment_chars=segment_chars)
    digests = chat.conversation_digests(segments)
    sql = SQL["op3_chat"].replace("order by turn, role, text", "order by turn nulls first, role, text")
    tables = {"conversations": ("conv_id bigint, turn bigint, role varchar, text varchar", TURNS)}
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert spark_rows(digests.select(names)) == duck(sql, **tables)
    assert not chat.conversation_digests(chat.format_conversations(df.limit(0))).take(1)


def test_escape_is_reversible():
    for text in ("", "<|", "<\\|", "<\\\\|im_end|>", "</s><s>[INST][/INST]", "<", "|", "<<||"):
        shown = chat.escape(text)
        assert "<|" not in shown and "[INST]" not in shown and "</s>" not in shown
        assert chat.unescape(shown) == text


def test_mask_covers_assistant_tokens_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good day")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert len(row["loss_mask"]) == len(row["token_ids"])
    text = "".join(row["formatted"][a:b] for a, b in zip(row["loss_from"], row["loss_to"], strict=True))
    assert text == "good day" and 0 < sum(row["loss_mask"]) < 5


VECTORS = [
    (0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
    (6, [None, 1.0]), (7, []), (50, [1e12, -1e12]), (100, [1.0, 1.0]), (101, [0.1]), (150, [0.2]), (8, [0.0, 0.0]), (9, [0.0, 0.0]),
]


@pytest.mark.parametrize("shard_rows", [3, 1000])
def test_topk(spark, shard_rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in VECTORS], "vec_id long, embedding array<double>, score long")
    found = spark_rows(topk.top_k(df, "vec_id", "embedding", 50, shard_rows=shard_rows))
    sql = SQL["op1_topk"].replace("as bigint) as score", "as hugeint) as score")
    names, rows = duck(sql, embeddings=("vec_id bigint, embedding double[]", VECTORS))
    wide = [r for r in rows if abs(r[2]) >= 2**53]
    assert [r for r in found[1] if abs(r[2]) < 2**53] == [r for r in rows if r not in wide]
    assert found[0] == names and len(found[1]) == len(rows)
    assert not topk.top_k(df.limit(0), "vec_id", "embedding", 50).take(1)


def test_topk_of_repeated_ids(spark):
    df = spark.createDataFrame([(50, [1.0]), (50, [2.0]), (1, [3.0])], "vec_id long, embedding array<double>")
    rows = topk.top_k(df, "vec_id", "embedding", 50, scale=1.0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in rows) == [(1, 1, 3), (1, 1, 6), (2, 50, 2), (2, 50, 2)]


def test_topk_trees_prune(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) + 10 * (i % 7)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = spark_rows(topk.top_k(df, "vec_id", "embedding", 50, shard_rows=700))
    assert found == duck(SQL["op1_topk"], embeddings=("vec_id bigint, embedding float[]", rows))


PAGES = [
    (5, "http://a/", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://b/\r\nX: y", None), (9, "u", ""), (None, "u", "<p>x</p>"),
    (7, "u", "é🙂\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (8, "u", "z" * 300000),
]


def test_warc(spark):
    df = spark.createDataFrame([(*r, "q") for r in PAGES], "page_id long, url string, html string, digest string")
    archives = warc.archive_pages(df)
    found = warc.read_archives(archives)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert spark_rows(found.select(names)) == duck(SQL["op9_warc"], pages=("page_id bigint, url varchar, html varchar", PAGES))
    payloads = {r["page_id"]: r["payload"] for r in found.where("record_type = 'response'").collect()}
    assert payloads == {3: "<p>x</p>", 4: "", 7: PAGES[5][2], 8: PAGES[6][2]}
    assert not warc.read_archives(warc.archive_pages(df.limit(0))).take(1)


def test_warc_members_are_gzip_files_and_can_be_normalised_again(spark):
    import gzip

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    row = warc.archive_pages(df.coalesce(1)).first()
    with warc._opened(row["archive"], "read") as f:
        whole = gzip.decompress(f.read())
    assert whole.count(b"WARC-Type: ") == len(PAGES) == row["records"]
    with warc._opened(row["archive"], "read") as f:
        assert b"".join(warc.inflated_records(f)) == whole


def test_revisits_refer_to_records_of_the_archives(spark):
    df = spark.createDataFrame(PAGES * 2, "page_id long, url string, html string").repartition(5)
    archives = warc.archive_pages(df)
    ids, referred = set(), set()
    for row in archives.collect():
        with warc._opened(row["archive"], "read") as f:
            for record in warc.inflated_records(f):
                headers, _ = warc.split_record(record)
                ids.add(headers["WARC-Record-ID"])
                referred.add(headers.get("WARC-Refers-To"))
    assert len(ids) == 2 * len(PAGES) and len(referred) > 2 and referred - {None} <= ids
    assert warc.read_archives(archives).rdd.getNumPartitions() == archives.count()


def test_warc_repeated_rows_and_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.archive_pages(df, least_bytes=1)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows) == [
        (1, "response", None), (1, "revisit", 1), (2, "response", None), (3, "response", None),
    ]


def test_sharding_moves_few_keys(spark):
    before = sharding.lookup_table([f"s{i}" for i in range(20)], 2003)
    after = sharding.lookup_table([f"s{i}" for i in range(19)], 2003)
    counts = [before.count(i) for i in range(20)]
    assert max(counts) - min(counts) <= 1
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.15 * 2003


def test_sharding_of_columns_with_any_names(spark):
    df = spark.createDataFrame([(1, 2, 3, "x", 5, "s")], "doc_id long, `__slot` int, `__at` int, `__name` string, `__row` int, `a.b` string")
    row = sharding.place(df, "doc_id", ["a", "b"], 101).first().asDict()
    assert (row["__slot"], row["__at"], row["__name"], row["__row"], row["a.b"]) == (2, 3, "x", 5, "s") and row["shard"] in "ab"
    assert sharding.place(spark.createDataFrame([(1,)], "slot long"), "slot", ["a"], 101).columns == ["slot", "shard"]


def test_sharding_cases(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (2, 8)], "doc_id long, slot int")
    rows = sharding.place(df, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(rows) == 4 and {r["shard"] for r in rows} <= {"a", "b", "c"}
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert not sharding.place(df.limit(0), "doc_id", ["a"], 101).take(1)
    for bad in (100, 1):
        with pytest.raises(ValueError):
            sharding.lookup_table(["a"], bad)
