"""Readers' state over streams: high-water marks, cursors and expiry."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

REWIND, BACK = 30.0, 60.0


def next_mark(mark: float | None, t: float) -> tuple[float, float, float]:
    """What to inject for a position: (from, to, new mark). A rewind of more than REWIND starts BACK before it."""
    if mark is None or t < mark - REWIND:
        low = max(0.0, t - BACK)
        return low, t, t
    return min(mark, t), t, max(mark, t)


class HighWater(StatefulProcessor):
    """Keeps the position up to which each film's cues have been injected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._mark = handle.getValueState("mark", "mark double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self._mark.get()[0] if self._mark.exists() else None
        out = []
        for pdf in rows:
            for t in pdf.sort_values("t")["t"]:
                low, high, mark = next_mark(mark, float(t))
                out.append((key[0], low, high, mark))
        if out:
            self._mark.update((mark,))
        yield pd.DataFrame(out, columns=["film_id", "low", "high", "mark"])

    def close(self) -> None:
        pass


class Cursor(StatefulProcessor):
    """Hands out the chunks of a film in order, as they appear; a new generation finds its place by the time last seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._at = handle.getValueState("at", "cursor long, generation string, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor, generation, last = self._at.get() if self._at.exists() else (0, None, 0.0)
        out = []
        for pdf in rows:
            for r in pdf.sort_values(["generation", "pos"]).itertuples():
                if generation is not None and r.generation != generation and r.to <= last:
                    continue
                if generation is not None and r.generation != generation:
                    cursor = r.pos
                if r.pos < cursor and r.generation == generation:
                    continue
                generation, cursor, last = r.generation, r.pos + 1, float(r.to)
                out.append((key[0], r.generation, int(r.pos), float(r.to)))
        self._at.update((int(cursor), generation, last))
        yield pd.DataFrame(out, columns=["film_id", "generation", "pos", "to"])

    def close(self) -> None:
        pass


def injected(positions: DataFrame, film: str = "film_id") -> DataFrame:
    """Stream of windows to inject for a stream of positions (film_id, t)."""
    return positions.select(F.col(film).alias("film_id"), "t").groupBy("film_id").transformWithStateInPandas(HighWater(), "film_id long, low double, high double, mark double", "Append", "None")


def handed_out(chunks: DataFrame) -> DataFrame:
    """Stream of chunks in reading order for a stream of (film_id, generation, pos, to)."""
    return chunks.groupBy("film_id").transformWithStateInPandas(Cursor(), "film_id long, generation string, pos long, to double", "Append", "None")


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts of events (ts, film_id) in windows of a width, with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "film_id").agg(F.count("*").alias("n"))
