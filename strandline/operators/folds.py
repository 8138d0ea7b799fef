"""Selections that depend on order, as folds over a film's sorted array.

The accumulator is an array of what has been kept, so the fold stays in the JVM;
it is meant for films that keep up to some hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def spaced(rows: Column, gap: float, strength: str = "strength") -> Column:
    """From structs in order of t: keep those gap apart; a closer one replaces the last if it is stronger."""

    def step(kept: Column, x: Column) -> Column:
        near = (F.size(kept) > 0) & (x["t"] - F.try_element_at(kept, F.lit(-1))["t"] < gap)
        put = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(x))
        return F.when(~near, F.array_append(kept, x)).when(x[strength] > F.try_element_at(kept, F.lit(-1))[strength], put).otherwise(kept)

    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def suppressed(rows: Column, gap: float, most: int) -> Column:
    """From structs in order of preference: keep those at least gap from all kept, up to most."""

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: F.abs(y["t"] - x["t"]) < gap)
        return F.when((F.size(kept) >= most) | clash, kept).otherwise(F.array_append(kept, x))

    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def rolled_up(rows: Column) -> Column:
    """Cues (start, end, text) in order: equal texts join; a text that goes on from the last replaces it. The first start stays."""

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        grows = (x["text"] == last["text"]) | x["text"].startswith(F.concat(last["text"], F.lit(" ")))
        joined = F.struct(last["ord"].alias("ord"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), x["text"].alias("text"))
        put = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(joined))
        return F.when((F.size(kept) > 0) & grows, put).otherwise(F.array_append(kept, x))

    return F.aggregate(rows, F.slice(rows, 1, 0), step)
