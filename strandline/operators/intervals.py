"""Joins of times and intervals.

Intervals meet in an equi-join on buckets of time; a pair is kept in the first
bucket both lie in, so each pair comes once and nothing is compared across the
whole of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: float) -> DataFrame:
    """Pairs with equal keys whose closed intervals touch. Column names other than keys must differ."""
    a = left.filter(F.col(l[0]) <= F.col(l[1])).withColumn("__b", F.explode(_buckets(F.col(l[0]), F.col(l[1]), width)))
    b = right.filter(F.col(r[0]) <= F.col(r[1])).withColumn("__b", F.explode(_buckets(F.col(r[0]), F.col(r[1]), width)))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)
    return a.join(b, [*keys, "__b"]).filter((F.col(l[1]) >= F.col(r[0])) & (F.col(l[0]) <= F.col(r[1])) & (F.col("__b") == first)).drop("__b")


def edge_distance(t: Column, start: Column, end: Column) -> Column:
    """0 within a closed interval, else the distance to its nearer edge."""
    return F.when((t >= start) & (t <= end), 0.0).otherwise(F.least(F.abs(t - start), F.abs(t - end)))


def nearest_interval(times: DataFrame, cues: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """For each row of times (with an id column `at` and a time `t`): the nearest cue within reach, first in order on ties.

    cues need start, end, ord, and any columns to carry; rows without a cue have nulls.
    """
    wide = cues.withColumn("__s", F.col("start") - reach).withColumn("__e", F.col("end") + reach)
    points = times.withColumn("__p", F.col("t"))
    met = overlap_join(points, wide, keys, ("t", "__p"), ("__s", "__e"), max(reach * 2, 1e-9)).withColumn("distance", edge_distance(F.col("t"), F.col("start"), F.col("end")))
    carried = [c for c in cues.columns if c not in keys]
    best = met.filter(F.col("distance") <= reach).groupBy(*keys, "at").agg(F.min_by(F.struct("distance", *carried), F.struct("distance", "ord")).alias("hit"))
    return times.join(best, [*keys, "at"], "left").select(*times.columns, "hit.*")


def nearest_point(times: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """For each (at, t): the sample nearest in time, the earlier on ties, by two sorts of both sides.

    samples need s_t and the columns to carry, the least of which counts among samples of one time. Both
    windows run on from a key's first row: one that looks ahead to its last row reads the rest for each row.
    """
    carried = [c for c in samples.columns if c not in keys]
    both = times.select(*keys, "at", "t", F.lit(1).alias("__q"), F.lit(None).cast(samples.select(F.struct(*carried)).schema[0].dataType).alias("__s")).unionByName(
        samples.select(*keys, F.lit(None).cast("long").alias("at"), F.col("s_t").alias("t"), F.lit(0).alias("__q"), F.struct(*carried).alias("__s"))
    )
    least = F.col("__s").desc()
    last = lambda *order: F.last("__s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order, least).rowsBetween(Window.unboundedPreceding, 0))
    back, ahead = last("t", "__q"), last(F.col("t").desc(), F.col("__q").desc())
    rows = both.withColumn("__back", back).withColumn("__ahead", ahead).filter("__q = 1")
    closer = F.when(F.col("__back").isNull(), F.col("__ahead")).when(F.col("__ahead").isNull(), F.col("__back"))
    closer = closer.when(F.col("__ahead.s_t") - F.col("t") < F.col("t") - F.col("__back.s_t"), F.col("__ahead")).otherwise(F.col("__back"))
    return rows.withColumn("__hit", closer).select(*keys, "at", "t", "__hit.*")


def chunk_at(times: DataFrame, chunks: DataFrame, keys: list[str], width: float) -> DataFrame:
    """The first chunk (by idx) whose closed interval holds each time; chunks have from, to, idx."""
    points = times.withColumn("__p", F.col("t"))
    met = overlap_join(points, chunks, keys, ("t", "__p"), ("from", "to"), width).groupBy(*keys, "at").agg(F.min("idx").alias("idx"))
    return times.join(met, [*keys, "at"], "left").select(*times.columns, "idx")


def recovered_chunk(times: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The first position whose chunk ends after each time, else the last position. Chunks follow one another in order of pos.

    One sort of both sides: a chunk's end stands before equal times, so the next end after a time is that of its chunk.
    """
    both = times.select(*keys, F.struct(*times.columns).alias("__row"), F.col("t").alias("__t"), F.lit(1).alias("__q"), F.lit(None).cast("long").alias("pos")).unionByName(
        chunks.select(*keys, F.lit(None).cast(times.select(F.struct(*times.columns)).schema[0].dataType).alias("__row"), F.col("to").alias("__t"), F.lit(0).alias("__q"), F.col("pos").cast("long"))
    )
    ahead = Window.partitionBy(*keys).orderBy("__t", "__q", "pos").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("__next", F.first("pos", ignorenulls=True).over(ahead)).withColumn("__last", F.max("pos").over(Window.partitionBy(*keys)))
    return found.filter("__q = 1 AND __last IS NOT NULL").select("__row.*", F.coalesce("__next", "__last").alias("pos"))


def gaps(points: DataFrame, bounds: DataFrame, widest: float) -> DataFrame:
    """Gaps over widest between neighbouring points (film_id, n, t), the film's ends among them (bounds: film_id, from, to).

    Returns film_id, n (of the point before, 0 for the start), left, right, gap and
    slots, how many picks would fill it.
    """
    w = Window.partitionBy("film_id").orderBy("t", "n")
    both = points.select("film_id", "n", "t").unionByName(bounds.select("film_id", F.lit(0).cast("long").alias("n"), F.col("from").alias("t")))
    g = both.withColumn("right", F.lead("t").over(w)).join(bounds.select("film_id", "to"), "film_id").withColumn("right", F.coalesce("right", "to")).withColumn("gap", F.col("right") - F.col("t"))
    return g.filter(F.col("gap") > widest).select("film_id", "n", F.col("t").alias("left"), "right", "gap", F.greatest(F.lit(1), F.ceil(F.col("gap") / widest) - 1).cast("long").alias("slots"))
