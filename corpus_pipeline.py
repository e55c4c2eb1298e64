"""A corpus pipeline over ``documents``: each stage reads what the one before wrote to the shared folder.

Language ID drops what it rejects, line de-duplication rewrites texts, the simhash stage keeps one document
of each group of near copies, decontamination drops documents with benchmark passages, and BPE writes token
ids, checked by decoding. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm import bpe, decontaminate, language_id, line_dedup, near_copies
from loadweave.llm.common import table
from loadweave.llm.queries import TOKENIZER
from loadweave.session import materialise


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null and empty texts and those without letters go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that one of a smaller id has; n_chars follows the text."""
    kept = line_dedup.dedup(docs).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: SimHash fingerprints of three-word shingles that
    differ in at most two bits, as op7 links them, or five-word shingles of Jaccard similarity 0.8 or more.

    Most pairs that similar differ in 5 to 11 bits of a 64-bit fingerprint, so the sets are compared as well."""
    return near_copies.keep_first(docs, distance=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids of whole texts, and what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), TOKENIZER, decoded="decoded", give_back=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontaminate", decontaminated),
    ("bpe", encoded),
]

#: Kneser-Ney decisions and BPE have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
