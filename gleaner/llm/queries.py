"""One query for each operator of this folder, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import editprint, langid, mix, oracles, packing, pii, secrets, simhash, topk, transcripts, urls
from gleaner.llm.common import table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.integral(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op4_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, model, carry=[F.col("doc_id"), held_out.alias("held_out")])


def op5_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return transcripts.parse(messages, transcripts.train(messages))


def op6_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.compare_edits(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=4), most=4)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_frame(spark, URL_RULES)).drop("url")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda x: x["plain"])
    counts = [pii.count(plain, k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(plain), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = secrets.joined(F.col("spans"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


QUERIES = {f.__name__: f for f in (op1_bestfit_packing, op2_source_mix, op3_pivot_topk, op4_compression_langid, op5_transcript_turns, op6_edit_fingerprints, op7_simhash_dedup, op8_url_filter, op9_pii_spans, op10_secret_scan)}
ORACLES = {"op2_source_mix": oracles.OP2, "op3_pivot_topk": oracles.OP3, "op8_url_filter": oracles.OP8, "op10_secret_scan": oracles.OP10}
