"""Background jobs as streaming queries: one of a name at a time, and their state as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE = "job string, id string, status string, phase string, batch long, rows double, error string"


def started(spark: SparkSession, name: str, start: Callable[[], StreamingQuery]) -> tuple[StreamingQuery, bool]:
    """The running query of that name and False, or a new one and True."""
    for q in spark.streams.active:
        if q.name == name:
            return q, False
    return start(), True


def state(spark: SparkSession, queries: list[StreamingQuery]) -> DataFrame:
    """A row a job: running, complete or failed, with its phase and last batch."""
    rows = []
    for q in queries:
        error = q.exception()
        last = q.lastProgress or {}
        status = "running" if q.isActive else "failed" if error else "complete"
        rows.append((q.name, str(q.id), status, q.status["message"] if q.isActive else status, last.get("batchId"), float(last.get("numInputRows", 0)), str(error)[:500] if error else None))
    return spark.createDataFrame(rows, STATE)
