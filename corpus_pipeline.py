"""From raw documents to packed training sequences.

Each stage reads what the one before it kept, from Parquet. All but the last return the columns of documents:
language ID drops what it rejects; SimHash near-dedup keeps one document of each group; PII puts
placeholders for identifiers; mixing repeats or drops documents to meet the sources' target weights; packing
gives each piece of what is left its place in a sequence, and returns the masked texts' pieces themselves:
the texts of a bin in order of `offset` are its sequence, nothing else is needed to write it out.

What a stage wrote is deleted once the next one has written its own; the folder of the result goes when the
application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import langid, mix, packing, pii, simhash
from gleaner.llm.common import drop, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Dictionaries from the labelled documents; those that no language compresses clearly best go.

    Null texts and texts without a letter go; repeated rows go or stay together; an empty table, or one without labels, leaves none."""
    return langid.keep(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked by a similarity of 0.8 or more of their five-word shingles the one with the least doc_id stays.

    All texts without a word are one group; of wholly repeated rows one stays; null ids come first; an empty table stays empty."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placeholders for plain and disguised identifiers, and n_chars counted anew. Every row stays; null texts stay null."""
    return pii.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks. Documents without a word weigh nothing and come as often as their source's
    whole turns; a null source is a source; repeated rows are taken one by one; an empty table stays empty."""
    return mix.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin, length, offset, doc_id, digest, copy, start, size, text) of every piece. Null texts and texts without a word have none;
    rows of equal id and text are copies; an empty table gives no rows."""
    return packing.pack_texts(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Compression, fingerprints and best fit have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
        drop(before)
        before = docs
    return docs
