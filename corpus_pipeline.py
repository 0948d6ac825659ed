"""Corpus pipeline over ``documents``: quality, line dedup, near-dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes a stage's rows as Parquet
below the checkpoint folder and hands the reread table to the next one.  All but the last return the
columns of ``docs``.

Null texts are empty: the classifier scores them, they have no lines, shingles or windows, and pack as
the one closing token.  Very long texts are read whole in every stage.  Rows alike in id and text share
decisions; of rows with one id the near-dedup keeps one, rows without id pass it.  Ties of copies go to the
smallest id.  Empty tables give empty tables.  Further columns travel along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import decontam, linededup, neardup, packing, quality
from ripplegraph.llm.common import KEY, row_key, table
from ripplegraph.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    stats = materialize(quality.document_statistics(docs.withColumn(KEY, row_key("doc_id", "text")), keep=KEY), "statistics")
    scored = quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")), keep=KEY)
    rejected = materialize(scored.filter(F.col("score") < quality.THRESHOLD).select(KEY).distinct(), "rejected")
    return docs.withColumn(KEY, row_key("doc_id", "text")).join(rejected, KEY, "left_anti").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source leave its documents; a document that has nothing else keeps them, as copies are the next stage's work."""
    out = linededup.dedup_lines(docs, host="source", spare=True)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("decontamination", leak_stage),
    ("best-fit packing", packing_stage),
]
#: The classifier and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
