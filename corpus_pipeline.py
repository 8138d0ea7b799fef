"""The corpus pipeline: stages over documents, each written before the next.

Quality rules drop what they reject; of each group of near-duplicates the least
document stays; personal data is masked; sources are mixed to their targets, as
slots of packed blocks (a row for each piece of a document in a slot); these pieces
are segmented. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import _shared, mixing, near, personal, quality, segment


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own text."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five-word shingles at a similarity of 0.8 or more; documents without a group stay."""
    kept = near.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__doc")).distinct().hint("shuffle_hash")
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__doc"]), "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked, and n_chars to match."""
    return personal.mask_personal(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slots of the mix, a row for each piece of a document in one, as often as the mix takes it."""
    return mixing.remix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return segment.sample_segmentations(docs, k=2)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", mix_sources),
    ("segmentation", encode),
]

#: SQL can't express perturbed search over a lattice of pieces; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _shared.written(docs, f"stage{k}")
    return docs
