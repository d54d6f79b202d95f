"""A corpus pipeline: each stage works on all documents that the one before it kept.

A stage takes (spark, docs, sf_dir), docs with the columns of ``documents`` (doc_id, text, lang, source,
n_chars), and returns a DataFrame; all but the last return those columns again. Null and empty texts, repeated rows,
empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.llm import decontaminate, language, near_dups, packing, pii
from affinia.llm.common import documents, free, mark, table, tokenizer_path, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language model rejects: without text or a letter, or too far from any
    language. The label column lang stays as it is."""
    own = docs.select(*COLUMNS)
    model = language.fit(own.filter(F.col("doc_id").isNotNull() & ~language.held_out()))
    return language.keep_identified(own, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8."""
    return near_dups.drop_near_duplicates(docs.select(*COLUMNS), shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold eight consecutive words of a benchmark item."""
    docs = docs.select(*COLUMNS)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=8)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data under the session's key; n_chars follows the new text."""
    new = pii.replace_pii(docs.select(*COLUMNS), pii.session_key(spark)).drop("pii_kinds")
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("packing", packed),
]

#: Language models, signatures and tokenizers are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again; what a stage needed goes then."""
    docs = documents(spark, sf_dir)
    begin = mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        free(spark, begin, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
