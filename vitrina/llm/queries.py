"""Registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import align, chat, decontaminate, langid, licences, near_dedup, ngram_lm, packing, sharding, topk, trie, urls, warc

SHARDS = tuple(f"shard-{i:03d}" for i in range(128))
CONTROL_TURN = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest inner products of every 50th vector, over all vectors."""
    found = topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_divisor=50, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 words; no two of one source or with equal texts in one."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_count(F.col("text")), packing.exact_cluster(F.col("text")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, and of one made of control strings."""
    columns = ["conv_id", "turn", "role", "text"]
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(*columns).unionByName(own)
    found = chat.conversation_digests(chat.format_conversations(rows))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of four fifths of them."""
    held = langid.crc_remainder(F.col("doc_id"), 5) == 1
    return ngram_lm.score_texts(_table(spark, sf_dir, "documents"), held)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the items."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through monolithic and normalised archives, read back."""
    archives = warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = _table(spark, sf_dir, "documents")
    held = langid.crc_remainder(F.col("doc_id"), 3) == 1
    model = langid.learn(docs.where(~held))
    return langid.identify(docs, model, {"doc_id": F.col("doc_id").cast("long"), "held_out": held})


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over all documents, with corpus-wide counts of linked ids."""
    return align.corpus_links(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that neighbours share their first turns."""
    turns, convs = trie.graft_heads(trie.numbered_turns(_table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, convs)


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by rules and by naive Bayes over segmented hosts and paths."""
    return urls.judge(_table(spark, sf_dir, "pages"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_topk, op2_packing, op3_chat, op4_licenses, op5_lm, op6_near_dedup, op7_decontaminate, op8_sharding, op9_warc, op10_langid,
              op11_alignment, op12_prefix_trie, op13_urls)
}
