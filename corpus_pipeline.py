"""Corpus pipeline over the training-data operators; see STAGES.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its output is written as Parquet and read again as the next stage's input.
All but the last return the columns of documents. A row is a document: rows that
share a doc_id share the fate that the id has in a stage; rows without an id
are scored, cut and kept like any other, but are not dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltcast.llm import bpe, decontam, jaccard_join, line_dedup, logistic, quality_model
from voltcast.session import scratch_path


def _training() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below its cut go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_model.fit(logistic.labelled_sample(docs, labels, "doc_id", "text", "quality", _training()))
    return quality_model.keep(docs, model)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of each group of fuzzy copies of a line, the first occurrence stays; n_chars follows the text."""
    return line_dedup.dedup(docs, removed=None).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def stage_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each near-duplicate component, the document with the smallest id stays."""
    return jaccard_join.representatives(docs)


def stage_decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain an item go."""
    return decontam.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every document that is left, and the text decoded from them."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", stage_quality),
    ("line dedup", stage_lines),
    ("n-gram Jaccard join", stage_copies),
    ("benchmark decontamination", stage_decontam),
    ("BPE encoding and decoding", stage_bpe),
]

#: The classifier, the line groups and the tokenizer are not expressible in SQL; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
