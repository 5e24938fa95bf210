"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns what goes on; run() writes each stage's result to the shared folder
and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import mixing, near_dup, pieces, quality_knn, secrets
from lanewise.llm.frames import free_prefix, quoted
from lanewise.llm.queries import PIECE_MODEL
from lanewise.llm.samples import fold
from lanewise.llm.storage import Scratch


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  It learns from the labels of four folds of five."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    p = free_prefix(docs, "quality_")
    judged = quality_knn.predict(docs, model, score=f"{p}score", predicted=f"{p}predicted")
    return judged.where(f"{p}predicted = 1").select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.drop_near_duplicates(docs, Scratch(spark, "pipeline-near"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars set anew."""
    return secrets.redact(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture draws."""
    return mixing.sampled(docs, Scratch(spark, "pipeline-mix"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """The documents' ids beside their columns other than the text."""
    found = pieces.encode(docs, pieces.load(model), check=True)
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents of sf_dir."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    scratch.drop(*[name for name, _ in STAGES[:-1]])
    return docs


#: The classifier and the mixture can't be expressed in SQL; tests hold run() against its stages done plainly.
ORACLE_SQL = None
