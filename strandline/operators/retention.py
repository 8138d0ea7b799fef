"""Cache entries, their age, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def expired(last: Column, now: Column, ttl_seconds: float) -> Column:
    """True once the age reaches the limit."""
    return (F.unix_micros(now) - F.unix_micros(last)) >= int(ttl_seconds * 1_000_000)


def status(entries: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """Entries (key, kind, running, last_access, prepared, modified, bytes) with age and whether they go: only remote ones that don't run."""
    last = F.coalesce("last_access", "prepared", "modified")
    return entries.withColumn("last", last).withColumn("goes", expired(last, now, ttl_seconds) & (F.col("kind") == "url") & ~F.col("running"))


def summary(rows: DataFrame) -> DataFrame:
    """Counts and bytes of all entries and of those that go."""
    return rows.agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.count_if("goes").alias("gone"), F.coalesce(F.sum(F.when(F.col("goes"), F.col("bytes"))), F.lit(0)).alias("gone_bytes"))


def running(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """Jobs (path, status, pid) with running: a status that says so, and a process that is alive (pid)."""
    up = alive.select("pid").distinct().withColumn("__up", F.lit(True))
    said = F.lower(F.coalesce("status", F.lit(""))).isin("running", "running-untracked")
    return jobs.join(up, "pid", "left").withColumn("running", said & F.coalesce("__up", F.lit(False))).drop("__up")


def candidates(registry: DataFrame, folders: DataFrame, roots: DataFrame) -> DataFrame:
    """Cache folders to look at: those of the registry (path), roots (path) with a source record, and their children with one.

    folders: path, parent, has_record. Each once.
    """
    recorded = folders.filter("has_record")
    own = recorded.join(roots.select("path").distinct(), "path", "left_semi").select("path")
    below = recorded.join(roots.select(F.col("path").alias("parent")).distinct(), "parent", "left_semi").select("path")
    return registry.select("path").filter("path is not null and path <> ''").union(own).union(below).distinct()


def cleanup(entries: DataFrame, now: Column, ttl_seconds: float, dry_run: bool) -> DataFrame:
    """What a sweep does to each expired entry whose media exist: deleted, would-delete, or skipped with a reason.

    entries: path, kind, running, last_access, prepared, modified, bytes, and
    last_access_now, which the record says once it is locked (null: as before).
    """
    if ttl_seconds <= 0:
        raise ValueError("the time to live must be positive")
    was = F.coalesce("last_access", "prepared", "modified")
    due = entries.filter(expired(was, now, ttl_seconds) & F.col("bytes").isNotNull() & (F.col("kind") == "url"))
    again = ~expired(F.coalesce("last_access_now", was), now, ttl_seconds)
    reason = F.when(again, "recently-reactivated").when(F.col("running"), "generation-running")
    return due.select("path", reason.alias("reason"), F.when(reason.isNotNull(), "skipped").otherwise("would-delete" if dry_run else "deleted").alias("action"), F.when(reason.isNull(), F.col("bytes")).otherwise(0).alias("freed"))


def newest(entries: DataFrame, by: str, most: int, keys: list[str]) -> DataFrame:
    """The most lately used entries of each key, which a cache of that size keeps."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return entries.withColumn("__p", place).filter(F.col("__p") <= most).drop("__p")
