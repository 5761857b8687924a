"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir``, one new folder a run; a stage's input goes once its output is written. A stage takes ``(spark, docs, sf_dir)``; all but
the last return the columns of ``documents``. Null and empty texts pass the filters (they are
neither toxic nor copies of anything); rows without a doc_id do too. Tables that the stages
train on are read from ``sf_dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import mixing
from sheaf.llm.line_dedup import WORD, dedup_lines
from sheaf.llm.minhash_dedup import NearDup, drop_near_duplicates
from sheaf.llm.packing import pack
from sheaf.llm.queries import vocabulary
from sheaf.llm.toxicity import learn, tag
from sheaf.session import drop_path, ensure_checkpoint_dir, ship_package
from sheaf.sources.tables import load_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the trained tagger scores 0.5 or more."""
    ship_package(spark)
    tagger = learn(docs, load_table(spark, sf_dir, "labels"))
    return tag(docs, tagger, keep=True).where("score < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines that many sources share, and documents that consisted of nothing else."""
    ship_package(spark)
    out = dedup_lines(docs, "source")
    left = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    out = out.where((F.col("n_removed") == 0) | left)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity 0.8 or more)."""
    ship_package(spark)
    return drop_near_duplicates(docs, NearDup(percent=80, width=5))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their source's rate."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens: a row per piece."""
    ship_package(spark)
    return pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_near_dedup", minhash_near_dedup),
    ("mixing", mixing_to_weights), ("best_fit_packing", best_fit_packing)]

#: SQL expresses neither the trained tagger, the sketches nor the packing; tests/llm/test_pipeline.py checks what the
#: stages drop and how the rows are packed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = load_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
