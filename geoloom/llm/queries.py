"""The queries that apply this subpackage's operators to the corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, fingerprints, licenses, lines, minhash, shards, tokens, toxicity
from .common import documents, scratch


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The production size of a shard: compressed text, so some hundred MB of rows.
SHARD_BYTES = 32 << 20


#: Arrivals that the table is appended in.
ARRIVALS = 3


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table through the store: arrivals by range of ids, each compacted until no run is due, then read back.

    The store is new and this query's own, so what a compaction replaces may go at once.
    """
    docs = documents(spark, sf_dir)
    store = shards.ShardStore(spark, scratch(spark, "shards"), target_bytes=SHARD_BYTES, small_rows=4_000)
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / ARRIVALS for k in range(1, ARRIVALS)], 0.01)))
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce((F.col("doc_id") > c).cast("int"), F.lit(0))
    for k in range(len(cuts) + 1):
        store.append(docs.filter(part == k))
        while store.compact():
            store.vacuum(keep=1, older_than=0)
    return store.read().select("doc_id", "lang", "source", F.char_length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(documents(spark, sf_dir))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-ids")
    tokens.write(documents(spark, sf_dir), out, tokenizer_path())
    return tokens.digests(spark, out)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, chain).withColumnRenamed("rejected", "toxic")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(documents(spark, sf_dir), percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_bpe": op2_bpe,
        "op3_line_dedup": op3_line_dedup,
        "op4_token_output": op4_token_output,
        "op5_chat": op5_chat,
        "op6_toxicity": op6_toxicity,
        "op7_minhash": op7_minhash,
        "op8_decontamination": op8_decontamination,
        "op9_fingerprints": op9_fingerprints,
        "op10_licenses": op10_licenses,
    }


_OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, s.keeper IS NULL OR s.keeper = k.doc_id AS keep FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""


_OP1_SQL = "SELECT doc_id, lang, source, length(text) AS text_chars, md5(text) AS text_md5 FROM documents"

_OP5_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY place) AS l, count(*) AS n FROM r GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, n)) AS i FROM c)),
k AS (SELECT min(conv_id) AS conv_id FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l)
SELECT r.conv_id, r.place, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
FROM r JOIN k ON r.conv_id = k.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": _OP1_SQL,
        "op5_chat": _OP5_SQL,
        "op3_line_dedup": _OP3_SQL,
    }
