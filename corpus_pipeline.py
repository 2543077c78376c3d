"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` with ``docs`` its predecessor's rows; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlake.llm import lines, minhash, mixing, packing, quality
from trafficlake.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more. Labels of every fold are learnt from here."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = quality.score_quality(docs, labels, held_out=-1, keep=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those with nothing left go."""
    kept = lines.remove_repeated_lines(docs, keep=("lang", "source", "n_chars"))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    kept = kept.where(~((F.col("n_removed") > 0) & (F.trim("text") == ""))).withColumn("n_chars", size.cast("long"))
    return kept.select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates (five words, similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix_sources(docs, keep=("text", "lang", "source", "n_chars")).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Classifier, near-duplicate search and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
