"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret scans, SentencePiece.

Each stage takes the documents that the stage before kept and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm import decontaminate, langid, pieces, secrets, simhash
from rankframe.llm.common import read_table
from rankframe.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is accepted as one of the languages learned from the labelled ones."""
    ensure_checkpoint_dir(spark)
    found = langid.identify(docs.select(*COLUMNS), langid.train(docs))
    return found.filter("language.accepted").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask; ``n_chars`` counts the new text."""
    hidden = secrets.redact(secrets.scan(docs.select(*COLUMNS)))
    changed = F.size("spans") > 0
    return hidden.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text back."""
    return pieces.encode_decode(docs, pieces.default_model())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("sentencepiece", sentencepiece),
]

# The stages rest on learned models, XXH64 fingerprints and a vocabulary file, which SQL cannot express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Rows of the last stage over the ``documents`` of ``sf_dir``. The stages' tables go to ``folder``, a new one that all executors share and that the
    caller removes when the rows are no longer read (default: a fresh one under the checkpoint folder)."""
    folder = folder or f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
