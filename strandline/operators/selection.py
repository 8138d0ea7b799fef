"""Keyframe picks and adaptive chunks of one film: serial within a film, films in parallel.

Each pick depends on those before it (its diversity term), and each chunk on the
end of the last, so a film is worked through by one task; its arrays are small.
"""

from __future__ import annotations

import sys
import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.text import opening
from strandline.operators.intervals import nearest_interval
from strandline.options import Options, profile

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

SLACK = 0.001


@dataclass
class Pick:
    """A chosen time with the segment it stands for."""

    time: float
    score: float
    reason: str
    left: float
    right: float
    event: float = math.nan


def at_floor(x: np.ndarray, q: float) -> float:
    """The floor-index quantile, 0 of nothing."""
    return float(np.sort(x)[int(math.floor((len(x) - 1) * q))]) if len(x) else 0.0


def clip(x: float, low: float, high: float) -> float:
    """x within bounds; what isn't a number stays."""
    return low if x < low else high if x > high else x


def greater(x: float, y: float) -> float:
    """The greater one; what isn't a number, if either isn't."""
    return x if x >= y or x != x else y


def first_most(x: Sequence[float]) -> int:
    """Where the largest value stands, the first of equal ones, or the first that isn't a number."""
    at = 0
    for k, v in enumerate(x):
        if v != v:
            return k
        if v > x[at]:
            at = k
    return at


class Film:
    """Columns of one film's samples in order of time, and its cues.

    Stretches of samples are ranges of places. Most hold a few samples, so scores are worked out
    one by one, on lists; columns are arrays where order or rounding of sums is numpy's.
    """

    COLUMNS = ("t", "change", "r", "g", "b", "luma", "contrast", "edge", "quality", "island", "regional", "motion", "audio")

    def __init__(self, samples: pd.DataFrame | dict[str, np.ndarray], cues: np.ndarray, options: Options) -> None:
        """tiles: lists of structs with r, g, b, or one array of samples by tiles by colours."""
        n = len(samples["t"]) if "t" in samples else 0
        array = {c: np.asarray(samples[c], float) if c in samples else np.zeros(n) for c in self.COLUMNS}
        for c, x in array.items():
            setattr(self, c, x.tolist())
        tiles = samples["tiles"] if "tiles" in samples and n else np.zeros((n, 0, 3))
        self.tiles = tiles if isinstance(tiles, np.ndarray) else np.array([[[t["r"], t["g"], t["b"]] for t in row] for row in tiles], float)
        self.low = np.asarray(samples["low"], bool).tolist() if "low" in samples else [False] * n
        self.rgb = np.stack([array["r"], array["g"], array["b"]], 1)
        self.lumas, self.changes = array["luma"], array["change"]
        self.at = [x if x == x else math.inf for x in self.t]
        self.o = options
        self.known: dict[tuple[int, int], tuple] = {}
        near, reach = np.full(n, np.inf), options.anchor_distance
        times = array["t"]
        for a, b in cues:  # beyond its reach a cue adds nothing
            lo, hi = bisect_left(self.at, min(a, b) - reach - SLACK), bisect_right(self.at, max(a, b) + reach + SLACK)
            t = times[lo:hi]
            near[lo:hi] = np.minimum(near[lo:hi], np.where((t >= a) & (t <= b), 0.0, np.minimum(abs(t - a), abs(t - b))))
        self.cue = np.where(near <= reach, 1 - near / reach, 0.0).tolist() if n else []

    def span(self, a: float, b: float, inside: Sequence[int] | None = None) -> range:
        """Samples from a to b, of a stretch of samples if one is given."""
        lo, hi = bisect_left(self.at, a - SLACK), bisect_right(self.at, b + SLACK)
        if inside is not None:
            lo, hi = (max(lo, inside[0]), min(hi, inside[-1] + 1)) if len(inside) else (0, 0)
        return range(lo, hi)

    def useful(self, i: Sequence[int]) -> Sequence[int]:
        low = self.low
        return [k for k in i if not low[k]] or i

    def nearest(self, t: float) -> int:
        """The sample nearest in time, the first of equally near ones."""
        k = bisect_left(self.at, t)
        if k == len(self.at) or k and abs(self.at[k - 1] - t) <= abs(self.at[k] - t):
            k -= 1
        while k and abs(self.at[k - 1] - t) <= abs(self.at[k] - t):
            k -= 1
        return k

    def spread(self, i: Sequence[int], taken: list[float], unit: float) -> list[float]:
        """How far samples lie from what is taken (in order), in units, at most 1."""
        if not taken:
            return [1.0] * len(i)
        out = []
        for k in i:
            t = self.t[k]
            p = bisect_left(taken, t)
            out.append(clip(min(abs(t - x) for x in taken[max(0, p - 1) : p + 1]) / unit, 0.0, 1.0))
        return out

    def traits(self, among: Sequence[int]) -> tuple[float, float, float, float, float]:
        """Mean colour, mean light and largest usual change of samples."""
        run = isinstance(among, range)
        if run and (found := self.known.get((among.start, among.stop))):
            return found
        part = slice(among.start, among.stop) if run else list(among)
        n, x = len(among), self.changes[part]
        colour = np.round(np.add.reduce(self.rgb[part], 0) / n).tolist() if n else [0.0] * 3
        light = float(np.add.reduce(self.lumas[part]) / n) if n else math.nan
        made = (*colour, light, max(1.0, float(x[0]) if n == 1 else at_floor(x, 0.9)))
        if run:
            self.known[among.start, among.stop] = made
        return made

    def typical(self, i: Sequence[int], among: Sequence[int], taken: list[float]) -> list[float]:
        """The representative score of samples i among those of a segment; taken is in order."""
        r, g, b, light, most = self.traits(among)
        out = []
        for k, far in zip(i, self.spread(i, taken, self.o.min_segment)):
            x, y, z = self.r[k] - r, self.g[k] - g, self.b[k] - b
            close = 1 - clip(math.sqrt(x * x + y * y + z * z) / 160, 0.0, 1.0)
            lit = 1 - clip(abs(self.luma[k] - light) / 0.35, 0.0, 1.0)
            moving = clip(self.change[k] / most, 0.0, 1.0)
            out.append(0.42 * self.quality[k] + 0.18 * close + 0.12 * lit + 0.14 * self.cue[k] + 0.08 * far - 0.12 * moving - 0.5 * self.low[k])
        return out

    def best(self, i: Sequence[int], score: list[float], reason: str, left: float, right: float) -> Pick:
        k = first_most(score)
        return Pick(self.t[i[k]], score[k], reason, left, right)

    # segments

    def threshold(self, i: Sequence[int], sensitivity: float) -> float:
        if len(i) < 2:
            return math.inf
        x = np.sort(self.changes[i[1] : i[-1] + 1]).tolist()
        high, most, mid = (x[int(math.floor((len(x) - 1) * q))] for q in (0.75, 0.9, 0.5))
        return min(most, mid + max(1.0, high - mid) * sensitivity)

    def cuts(self, i: Sequence[int], start: float, end: float) -> list[int]:
        level, kept = self.threshold(i, self.o.visual_sensitivity), []
        edge, gap = self.o.min_segment, max(2.0, self.o.min_segment)
        for k in i[1:]:
            if self.change[k] >= level and min(self.t[k] - start, end - self.t[k]) >= edge:
                if not kept or self.t[k] - self.t[kept[-1]] >= gap:
                    kept.append(k)
                elif self.change[k] > self.change[kept[-1]]:
                    kept[-1] = k
        return kept

    def segments(self, i: Sequence[int], start: float, end: float) -> list[tuple[float, float]]:
        """Between cuts, long ones halved at their largest change, breadth first; that order stays."""
        at = [start, *(self.t[k] for k in self.cuts(i, start, end)), end]
        most, out = max(self.o.max_segment, 2 * self.o.min_segment), []
        for first in zip(at, at[1:]):
            todo = deque([first])
            while todo:
                a, b = todo.popleft()
                if b - a <= most:
                    out.append((a, b))
                    continue
                k = self.span(a + self.o.min_segment, b - self.o.min_segment, i)
                cut = self.t[k[first_most(self.change[k.start : k.stop])]] if len(k) else a + (b - a) / 2
                todo.extend(((a, cut), (cut, b)))
        return [(a, b) for a, b in out if b - a >= min(1.0, self.o.min_segment)]

    def segment_pick(self, a: float, b: float, inside: Sequence[int], taken: list[float]) -> Pick | None:
        pad = min(1.5, 0.18 * max(SLACK, b - a))
        for x, y in ((a + pad, b - pad), (a, b)):
            i = self.span(x, y, inside)
            if len(i):
                use = self.useful(i)
                return self.best(use, self.typical(use, i, taken), "segment-representative", a, b)
        return None

    # events

    def events(self, i: Sequence[int], start: float, end: float) -> list[tuple[int, float]]:
        o = self.o
        level = self.threshold(i, o.micro_sensitivity)
        kept: list[tuple[int, float]] = []
        for k in i[1:]:
            heard = self.audio[k] if o.audio_weight > 0 else 0.0
            if not (self.change[k] >= level or self.island[k] >= o.island_threshold or heard >= o.audio_threshold) or not start <= self.t[k] <= end:
                continue
            look = greater(clip(self.change[k] / max(1.0, level), 0.0, 1.4), clip(self.island[k] / max(1.0, o.island_threshold), 0.0, 1.4))
            score = greater(look, heard) + (0.2 * heard if heard > 0 and look > 0.4 else 0.0)
            if not kept or self.t[k] - self.t[kept[-1][0]] >= o.min_micro_gap:
                kept.append((int(k), score))
            elif score > kept[-1][1]:
                kept[-1] = (int(k), score)
        return kept

    def event_pick(self, k: int, strength: float, inside: Sequence[int], taken: list[float]) -> Pick | None:
        a, b = self.t[k], self.t[k] + self.o.micro_lookahead
        i = self.span(a, b, inside)
        if not len(i):
            return None
        i = self.useful(i)
        score = []
        for j, far in zip(i, self.spread(i, taken, self.o.min_micro_gap)):
            late = clip((self.t[j] - a) / max(SLACK, self.o.micro_lookahead), 0.0, 1.0)
            bonus = 0.04 + 0.14 * clip(greater(strength, self.audio[j]) / 1.25, 0.0, 1.0)
            score.append(0.62 * self.quality[j] + 0.18 * self.cue[j] + 0.14 * far + bonus - 0.12 * late - 0.5 * self.low[j])
        p = self.best(i, score, "micro-event", a, 0.0)
        p.right, p.event = min(b, p.time), a
        return p

    # coverage

    def near_target(self, target: float, radius: float, inside: Sequence[int], left: float, right: float) -> tuple[Sequence[int], Sequence[int], list[float]] | None:
        i = self.span(target - radius, target + radius, inside)
        if not len(i):
            return None
        i = self.useful(i)
        among = self.span(left, right, inside)
        return i, among if len(among) else i, [1 - clip(abs(self.t[k] - target) / max(SLACK, radius), 0.0, 1.0) for k in i]

    def boundary_cover(self, chosen: list[Pick], inside: Sequence[int], start: float, end: float) -> list[Pick]:
        o, added = self.o, []
        if o.boundary_gap <= 0 or o.max_boundary_picks <= 0 or not chosen or not len(inside):
            return added
        times = sorted(p.time for p in chosen)
        for left, right, reason in ((start, times[0], "boundary-start"), (times[-1], end, "boundary-end")):
            gap = right - left
            if gap <= o.boundary_gap or len(added) >= o.max_boundary_picks:
                continue
            found = self.near_target(left + gap / 2, min(max(4.0, 0.6 * o.boundary_gap), max(4.0, 0.45 * gap)), inside, left, right)
            if found is None:
                continue
            i, among, central = found
            taken = sorted(p.time for p in (*chosen, *added))
            parts = zip(i, central, self.typical(i, among, taken), self.spread(i, taken, o.boundary_gap))
            score = [1.16 + 0.16 * c + 0.14 * x + 0.08 * self.quality[k] + 0.06 * far + 0.04 * self.cue[k] - 0.18 * self.low[k] for k, c, x, far in parts]
            added.append(self.best(i, score, reason, left, right))
        return added

    def gap_cover(self, chosen: list[Pick], inside: Sequence[int], start: float, end: float) -> list[Pick]:
        o, added = self.o, []
        if o.max_gap <= 0 or not len(inside):
            return added
        anchors = [start, *sorted(p.time for p in chosen), end]
        for left, right in zip(anchors, anchors[1:]):
            gap = right - left
            slots = max(1, math.ceil(gap / o.max_gap) - 1) if gap > o.max_gap else 0
            for s in range(1, slots + 1):
                if len(added) >= o.max_gap_picks:
                    return added
                share = gap / (slots + 1)
                found = self.near_target(left + share * s, min(0.45 * o.max_gap, max(4.0, 0.5 * share)), inside, left, right)
                if found is None:
                    continue
                i, among, central = found
                taken = sorted(p.time for p in (*chosen, *added))
                wide = 0.95 + 0.12 * min(1.5, max(0.0, gap / o.max_gap - 1))
                score = [wide + 0.2 * x + 0.08 * c + 0.08 * self.cue[k] - 0.2 * self.low[k] for k, c, x in zip(i, central, self.typical(i, among, taken))]
                added.append(self.best(i, score, "gap-coverage", left, right))
        return added

    def activity(self, i: Sequence[int], left: float, right: float) -> tuple[list[float], list[float]]:
        """Action and colour of samples in a gap, 0 to 1."""
        part = slice(i.start, i.stop) if isinstance(i, range) else list(i)
        most = lambda x, floor: max(floor, at_floor(np.array([x[k] for k in i]), 0.9))
        change, regional, motion = most(self.change, 45.0), most(self.regional, 35.0), most(self.motion, 0.04)
        unit, island = max(1.0, self.o.color_shift), max(1.0, self.o.island_threshold)
        ends = self.rgb[self.nearest(left)].tolist(), self.rgb[self.nearest(right)].tolist()
        mean = np.round(np.add.reduce(self.rgb[part], 0) / len(i)).tolist()
        action, colour = [], []
        for k in i:
            share = 0.35 * clip(self.change[k] / change, 0.0, 1.0) + 0.35 * clip(self.regional[k] / regional, 0.0, 1.0) + 0.3 * clip(self.motion[k] / motion, 0.0, 1.0)
            action.append(clip(share, 0.0, 1.0))
            away = []
            for r, g, b in (*ends, mean):
                x, y, z = self.r[k] - r, self.g[k] - g, self.b[k] - b
                away.append(math.sqrt(x * x + y * y + z * z))
            near = away[0] if away[0] <= away[1] or away[0] != away[0] else away[1]
            colour.append(greater(greater(clip(self.island[k] / island, 0.0, 1.0), clip(near / unit, 0.0, 1.0)), 0.7 * clip(away[2] / unit, 0.0, 1.0)))
        return action, colour

    def action_cover(self, chosen: list[Pick], inside: Sequence[int], start: float, end: float) -> list[Pick]:
        o, added = self.o, []
        if o.action_gap <= 0 or not len(inside):
            return added
        anchors = [start, *sorted(p.time for p in chosen), end]
        for left, right in zip(anchors, anchors[1:]):
            gap = right - left
            if gap <= o.action_gap or len(added) >= o.max_action_picks:
                continue
            pad = min(4.0, 0.2 * gap)
            i = self.useful(self.span(left + pad, right - pad, inside))
            if not len(i):
                continue
            action, colour = self.activity(i, left, right)
            live = [greater(x, y) for x, y in zip(action, colour)]
            taken = sorted(p.time for p in (*chosen, *added))
            wide = 0.78 + 0.16 * min(2.0, max(0.0, gap / o.action_gap - 1))
            score = [wide + 0.22 * x + 0.12 * self.quality[k] + 0.08 * far + 0.05 * self.cue[k] - 0.2 * self.low[k] for k, x, far in zip(i, live, self.spread(i, taken, o.action_gap))]
            if ok := [j for j, x in enumerate(live) if x >= o.action_min_activity]:
                p = self.best([i[j] for j in ok], [score[j] for j in ok], "", left, right)
                j = ok[first_most([score[j] for j in ok])]
                p.reason = "color-coverage" if colour[j] > action[j] else "action-coverage"
                added.append(p)
        return added

    # the pipeline

    def alike(self, p: Pick, q: Pick) -> bool:
        apart = abs(p.time - q.time)
        if apart > self.o.similar_window:
            return False
        i, j = self.nearest(p.time), self.nearest(q.time)
        limit = max(self.o.similar_distance, self.o.duplicate_distance) if apart <= self.o.duplicate_window else self.o.similar_distance
        far = 0.35 * math.dist((self.r[i], self.g[i], self.b[i]), (self.r[j], self.g[j], self.b[j])) / 255 + 0.06 * abs(self.luma[i] - self.luma[j]) + 0.03 * abs(self.contrast[i] - self.contrast[j]) + 0.02 * abs(self.edge[i] - self.edge[j])
        if far <= limit and self.tiles.shape[1]:
            step = np.sqrt(((self.tiles[i] - self.tiles[j]) ** 2).sum(1)) / 255
            far += 0.42 * step.mean() + 0.12 * step.max()
        return far <= limit

    def distinct(self, picks: list[Pick], most: int) -> list[Pick]:
        kept: list[Pick] = []  # in order of time: only what is near can be too near or alike
        times: list[float] = []
        ranked = sorted((p for p in picks if p.reason == "pinned"), key=lambda p: p.time) + sorted((p for p in picks if p.reason != "pinned"), key=lambda p: -p.score)
        for p in ranked:
            if len(kept) == most:
                break
            gap = 0.01 if p.reason == "pinned" else max(1.0, self.o.min_micro_gap)
            reach = max(gap, self.o.similar_window) + SLACK
            near = kept[bisect_left(times, p.time - reach) : bisect_right(times, p.time + reach)]
            if all(abs(q.time - p.time) >= gap and (p.reason == "pinned" or not self.alike(q, p)) for q in near):
                at = bisect_right(times, p.time)
                times.insert(at, p.time)
                kept.insert(at, p)
        return kept

    def picks(self, start: float, end: float, most: int) -> list[Pick]:
        """All picks of a window."""
        i = self.span(start, end)
        most = max(2, most)
        found = [Pick(t, 1000.0, "pinned", max(start, t - 0.25), min(end, t + 0.25), t) for t in self.o.pins if start - SLACK <= t <= end + SLACK]
        taken = sorted(p.time for p in found)

        def add(p: Pick | None) -> None:
            if p:
                found.append(p)
                insort(taken, p.time)

        for a, b in self.segments(i, start, end):
            add(self.segment_pick(a, b, i, taken))
        for k, strength in sorted(self.events(i, start, end), key=lambda e: -e[1])[: self.o.max_micro]:
            add(self.event_pick(k, strength, i, taken))
        first = self.distinct(found, most)
        edges = self.boundary_cover(first, i, start, end)
        seed = first + edges
        found += edges + self.gap_cover(seed, i, start, end) + self.action_cover(seed, i, start, end)
        if not found and len(i):
            found.append(self.best(i, [self.quality[k] - 0.5 * self.low[k] for k in i], "fallback-quality", start, end))
        return self.distinct(found, most)

    def chunk_end(self, start: float, limit: float, picks: list[Pick]) -> float:
        """Where a chunk that begins at start ends: at the pick that fills it, on a step, within its bounds."""
        o = self.o
        if limit <= start or not picks:
            return limit
        most = max(2, o.max_keyframes)
        target = min(max(o.target_keyframes, 2), most)
        end = limit
        for n in (most, target):
            if len(picks) >= n:
                end = picks[n - 1].right
                break
        end = max(end, min(limit, start + max(0.0, o.min_sheet)))
        return min(limit, start + math.ceil((end - start) / o.sample_step - 1e-9) * o.sample_step)

    def chunks(self, start: float, end: float) -> list[tuple[float, float, list[Pick]]]:
        """Chunks in order, each from the end of the last; a short rest joins the last one."""
        o, out, at = self.o, [], start
        while at < end - 1e-9 and (not o.max_sheets or len(out) < o.max_sheets):
            rest = end - at
            if out and rest < max(0.25, min(1.0, o.sample_step)):
                out[-1] = (out[-1][0], end, out[-1][2])
                break
            limit = min(end, at + o.max_sheet)
            wide = max(o.max_keyframes, o.target_keyframes + 8, math.ceil((limit - at) / o.max_segment) + o.target_keyframes)
            stop = self.chunk_end(at, limit, self.picks(at, limit, wide))
            if stop <= at:
                stop = limit
            out.append((at, stop, self.picks(at, stop, o.max_keyframes)))
            at = stop
        return out


PICKS = "film_id long, chunk long, from double, to double, time double, score double, reason string"


def adaptive_chunks(samples: DataFrame, cues: DataFrame, options: Options = Options()) -> DataFrame:
    """Keyframes of every film's chunks.

    samples: film_id, t, the columns of Film, and tiles (array of r, g, b, luma; of one size) if there are any; cues: film_id, start, end.
    Samples and cues come to a task as one sorted stream, of which it holds a batch and a film.
    """
    numbers = [c for c in Film.COLUMNS if c in samples.columns]
    marked, tiled = "low" in samples.columns, "tiles" in samples.columns
    flat = F.flatten(F.transform("tiles", lambda t: F.array(*(t[c].cast("double") for c in "rgb")))).alias("tiles")
    rank = F.col("n").cast("long") if "n" in samples.columns else F.lit(0).cast("long")  # of samples of one time
    left = samples.select("film_id", F.lit(1).alias("__kind"), rank.alias("__n"), *(F.col(c).cast("double").alias(c) for c in numbers), *["low"] * marked, *[flat] * tiled)
    right = cues.select("film_id", F.lit(0).alias("__kind"), F.col("start").cast("double").alias("t"), F.col("end").cast("double").alias("__end"))

    def film(key: int | None, part: pa.Table) -> list[tuple]:
        column = lambda c: part.column(c).to_numpy()
        first = int(np.searchsorted(column("__kind"), 1))
        if first == len(part):
            return []
        cue = np.stack([column("t")[:first], column("__end")[:first]], 1).astype(float)
        given = {c: column(c)[first:] for c in numbers}
        own = part.slice(first)
        if marked:
            given["low"] = pc.fill_null(own.column("low"), False).to_numpy()
        if tiled:
            whole = pc.list_flatten(own.column("tiles")).to_numpy()
            given["tiles"] = whole.reshape(len(own), len(whole) // (3 * len(own)), 3)
        f = Film(given, cue, options)
        return [(key, n, a, b, p.time, p.score, p.reason) for n, (a, b, picks) in enumerate(f.chunks(f.t[0], f.t[-1]), 1) for p in picks]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

        names, kinds = [c.split()[0] for c in PICKS.split(", ")], [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string()]
        held: list[pa.RecordBatch] = []  # of the last film, which may go on
        for batch in batches:
            keys, rows = batch.column(0), []
            ids, known = pc.fill_null(keys, 0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() == keys[a].as_py():
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    rows += film(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                held = [batch.slice(a, b - a)]
            yield from done(rows)
        if held:
            yield from done(film(held[0].column(0)[0].as_py(), pa.Table.from_batches(held)))

    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given outright, else small films end in one task
    both = left.unionByName(right, allowMissingColumns=True).repartition(n, "film_id")
    return both.sortWithinPartitions("film_id", "__kind", F.col("t").asc_nulls_last(), "__n").mapInArrow(task, PICKS)


def picks_in(samples: DataFrame, cues: DataFrame, windows: DataFrame, options: Options = Options()) -> DataFrame:
    """Keyframes of windows (film_id, chunk, from, to, and pins, an array of times that stay, or null), as adaptive_chunks() gives them."""
    pinned = windows.select("film_id", F.array("chunk", "from", "to").cast("array<double>").alias("w"), F.coalesce("pins", F.array().cast("array<double>")).alias("pins"))
    asked = pinned.groupBy("film_id").agg(F.collect_list(F.struct("w", "pins")).alias("__asked"))

    def film(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in PICKS.split(", ")]
        rows = []
        if len(left):
            left = left.sort_values("t", kind="stable")
            f = Film(left, right[["start", "end"]].to_numpy(float), options)
            for ask in left["__asked"].iloc[0]:
                n, a, b = ask["w"]
                f.o = replace(options, pins=(*options.pins, *map(float, ask["pins"])))
                rows += [(key[0], int(n), a, b, p.time, p.score, p.reason) for p in f.picks(a, b, options.max_keyframes)]
        return pd.DataFrame(rows, columns=columns)

    left = samples.join(asked, "film_id")
    return left.groupBy("film_id").cogroup(cues.select("film_id", "start", "end").groupBy("film_id")).applyInPandas(film, PICKS)


def refined(chunks: DataFrame, samples: DataFrame, cues: DataFrame, windows: DataFrame, options: Options = Options()) -> DataFrame:
    """Keyframes of chunks (PICKS) with those of some chunks picked anew, pins among them (windows as in picks_in())."""
    rest = chunks.join(windows.select("film_id", "chunk").distinct(), ["film_id", "chunk"], "left_anti")
    return rest.select(*(c.split()[0] for c in PICKS.split(", "))).unionByName(picks_in(samples, cues, windows, options))


def focused(samples: DataFrame, cues: DataFrame, windows: DataFrame, detail: str = "balanced", longest: float = 300.0) -> DataFrame:
    """Keyframes of ranges (film_id, chunk, from, to) in more detail; an empty, too long or missing range ends the query."""
    film = samples.groupBy("film_id").agg(F.max("t").alias("__z"))
    w = windows.join(film, "film_id", "left")
    fault = F.when(F.col("__z").isNull(), "there is no such film").otherwise(range_problem(F.col("from"), F.col("to"), F.col("__z"), longest))
    start = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("from"))
    checked = w.select("film_id", "chunk", start.alias("from"), F.least("to", "__z").alias("to"), F.lit(None).cast("array<double>").alias("pins"))
    return picks_in(samples, cues, checked, profile(detail))


def range_problem(start: Column, end: Column, duration: Column, longest: float = 300.0) -> Column:
    """Why a range can't be looked at closely; null if it can."""
    return F.when(end <= start, "the range is empty").when(end - start > longest, "the range is too long").when(end > duration + 0.5, "the range lies beyond the film")


def keyframes(picks: DataFrame, cues: DataFrame, options: Options = Options()) -> DataFrame:
    """Picks of chunks as keyframes: id (K1 on), time and score to 3 decimals, reason, and the cue they lie at or near.

    cues: film_id, start, end, ord, id, text, source.
    """
    w = Window.partitionBy("film_id", "chunk").orderBy("time")
    k = picks.withColumn("at", F.row_number().over(Window.partitionBy("film_id").orderBy("chunk", "time")).cast("long")).withColumn("id", F.format_string("K%d", F.row_number().over(w))).withColumn("t", F.col("time"))
    near = nearest_interval(k.select("film_id", "at", "t"), cues.select("film_id", "start", "end", "ord", F.col("id").alias("cue"), "text", "source"), ["film_id"], options.anchor_distance)
    text = opening(F.col("text"), options.anchor_chars, options.anchor_words)
    anchor = F.when(F.col("cue").isNotNull() & (text != ""), F.struct(F.col("cue").alias("id"), text.alias("text"), F.bround("distance", 2).alias("distance"), F.col("source").alias("source")))
    found = near.select("film_id", "at", anchor.alias("subtitle_anchor"))
    return k.join(found, ["film_id", "at"], "left").select("film_id", "chunk", "id", F.bround("time", 3).alias("time"), F.bround("score", 3).alias("score"), "reason", "subtitle_anchor")


def segment_bounds(samples: DataFrame, options: Options = Options()) -> DataFrame:
    """Segments of every film over its whole length, in the order they are made."""

    def film(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        f = Film(pdf, np.zeros((0, 2)), options)
        bounds = f.segments(range(len(f.t)), f.t[0], f.t[-1])
        return pd.DataFrame([(pdf["film_id"].iloc[0], n, a, b) for n, (a, b) in enumerate(bounds, 1)], columns=["film_id", "ord", "start", "end"])

    return samples.groupBy("film_id").applyInPandas(film, "film_id long, ord long, start double, end double")
