"""The queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixity, mixing, near, neighbours, oracles, personal, quality, repeats, segment, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_remove_repeats", oracles.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


@_query("op4_repetition_quality", oracles.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).drop("n_covered_words", "longest_repeat")


@_query("op5_url_terms", oracles.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


@_query("op7_projected_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.find_personal(_table(spark, sf_dir, "documents")))


@_query("personal_base", oracles.PERSONAL_BASE)
def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2: its base spans."""
    return op2(spark, sf_dir).drop("spans")


@_query("op6_super_minhash", oracles.OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


@_query("op10_sampled_segmentations")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample_segmentations(_table(spark, sf_dir, "documents"))


@_query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op3_packed_mix", oracles.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query("op8_merkle_fixity", oracles.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(_table(spark, sf_dir, "pages"))
