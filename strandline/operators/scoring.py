"""Scores and order statistics of samples, as expressions, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.options import Options


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def floor_quantile(values: Column, q: float) -> Column:
    """Of an array: the element at floor((n - 1) * q) in order; 0 where it is empty."""
    at = F.floor((F.size(values) - 1) * F.lit(q)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.greatest(at, F.lit(1)))).otherwise(0.0)


def rgb_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(3)), F.lit(0.0)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255


def saturation(r: Column, g: Column, b: Column) -> Column:
    high = F.greatest(r, g, b)
    return F.when(high > 0, (high - F.least(r, g, b)) / high).otherwise(0.0)


def quality(options: Options = Options()) -> Column:
    """Of a frame with luma, contrast, edge and saturation."""
    c = F.col
    contrast, edge, color = clamp(c("contrast") / 0.16, 0.0, 1.0), clamp(c("edge") / 0.12, 0.0, 1.0), clamp(c("saturation") / 0.35, 0.0, 1.0)
    detail = F.greatest(contrast, edge)
    light = F.least(clamp((c("luma") - options.low_luma) / 0.18, 0.0, 1.0), clamp((options.high_luma - c("luma")) / 0.18, 0.0, 1.0))
    light = F.when(c("luma") < 0.18, F.greatest(light, detail * 0.55 + color * 0.2)).when(c("luma") > 0.82, F.greatest(light, detail * 0.45)).otherwise(light)
    return clamp(light * 0.4 + contrast * 0.25 + edge * 0.25 + color * 0.1, 0.0, 1.0)


def low_information(options: Options = Options()) -> Column:
    c = F.col
    flat = (c("contrast") < 0.025) & (c("edge") < 0.02)
    return flat & (((c("luma") < options.low_luma) & (c("saturation") < 0.08)) | (c("luma") > options.high_luma))


def useful_else_all(df: DataFrame, flag: str, *keys: str) -> DataFrame:
    """Rows that are not flagged, or all rows of a key where every one is."""
    best = F.min(F.col(flag).cast("int")).over(Window.partitionBy(*keys))
    return df.withColumn("__least", best).filter(F.col(flag).cast("int") == F.col("__least")).drop("__least")


def with_change(samples: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds delta, regional and change against the sample before; 0 on the first of a film.

    samples: film_id, n, r, g, b, luma, contrast, edge, motion, and tiles (array of r, g, b, luma).
    """
    w = Window.partitionBy("film_id").orderBy("n")
    was = samples.withColumn("__was", F.lag(F.struct("r", "g", "b", "luma", "contrast", "edge", "tiles")).over(w))
    step = lambda c: F.abs(F.col(c) - F.col(f"__was.{c}"))
    delta = F.sqrt(step("r") * step("r") + step("g") * step("g") + step("b") * step("b"))
    was = was.withColumn("delta", F.coalesce(delta, F.lit(0.0))).withColumn("regional", F.coalesce(regional_change(F.col("tiles"), F.col("__was.tiles")), F.lit(0.0)))
    change = F.col("delta") + step("luma") * 220 + step("contrast") * 90 + step("edge") * 90 + F.col("motion") * options.motion_weight + F.col("regional") * options.regional_weight
    return was.withColumn("change", F.coalesce(change, F.lit(0.0))).drop("__was")


def visual_distance(a: Column, b: Column) -> Column:
    """Of two samples (structs of r, g, b, luma, contrast, edge and tiles): how different they look."""
    rgb = lambda x, y: F.sqrt((x["r"] - y["r"]) * (x["r"] - y["r"]) + (x["g"] - y["g"]) * (x["g"] - y["g"]) + (x["b"] - y["b"]) * (x["b"] - y["b"])) / 255
    n = F.least(F.size(a["tiles"]), F.size(b["tiles"]))
    step = F.zip_with(F.slice(a["tiles"], 1, n), F.slice(b["tiles"], 1, n), rgb)
    tiles = F.when(n > 0, 0.42 * F.aggregate(step, F.lit(0.0), lambda x, y: x + y) / n + 0.12 * F.array_max(step)).otherwise(0.0)
    return 0.35 * rgb(a, b) + tiles + 0.06 * F.abs(a["luma"] - b["luma"]) + 0.03 * F.abs(a["contrast"] - b["contrast"]) + 0.02 * F.abs(a["edge"] - b["edge"])


def change_threshold(changes: Column, sensitivity: float) -> Column:
    """min(q90, median + max(1, q75 - median) * sensitivity) of an array without the first sample; infinite where it is empty."""
    mid, high = floor_quantile(changes, 0.5), floor_quantile(changes, 0.75)
    level = F.least(floor_quantile(changes, 0.9), mid + F.greatest(F.lit(1.0), high - mid) * sensitivity)
    return F.when(F.size(changes) > 0, level).otherwise(float("inf"))


def thresholds(changed: DataFrame, sensitivity: float) -> DataFrame:
    """film_id and threshold."""
    later = F.collect_list(F.when((F.col("n") > 1) & (F.abs("change") < float("inf")), F.col("change")))
    return changed.groupBy("film_id").agg(change_threshold(later, sensitivity).alias("threshold"))


def color_island(tiles: DataFrame, width: int = 2) -> DataFrame:
    """Least distance of a sample's colour to the mean colours of width samples before and after; 0 at the edges."""
    w = Window.partitionBy("film_id").orderBy("n")
    count = F.count("*").over(Window.partitionBy("film_id"))
    mean = lambda c, a, b: F.bround(F.avg(c).over(w.rowsBetween(a, b)), 0)
    side = lambda a, b: F.sqrt(sum(((F.col(c) - mean(c, a, b)) * (F.col(c) - mean(c, a, b)) for c in ("r", "g", "b")), F.lit(0.0)))
    inside = (F.col("n") > width) & (F.col("n") <= count - width)
    return tiles.withColumn("island", F.when(inside, F.least(side(-width, -1), side(1, width))).otherwise(0.0))


def regional_change(now: Column, before: Column) -> Column:
    """Of two arrays of (r, g, b, luma): .7 of the largest colour step, .25 of the mean one, 120 of the largest step of luma; 0 of nothing."""
    n = F.least(F.size(now), F.size(before))
    pairs = F.arrays_zip(F.slice(now, 1, n).alias("a"), F.slice(before, 1, n).alias("b"))
    step = F.transform(pairs, lambda p: F.sqrt((p["a"]["r"] - p["b"]["r"]) * (p["a"]["r"] - p["b"]["r"]) + (p["a"]["g"] - p["b"]["g"]) * (p["a"]["g"] - p["b"]["g"]) + (p["a"]["b"] - p["b"]["b"]) * (p["a"]["b"] - p["b"]["b"])))
    light = F.transform(pairs, lambda p: F.abs(p["a"]["luma"] - p["b"]["luma"]))
    mean = F.aggregate(step, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 0, F.array_max(step) * 0.7 + mean * 0.25 + F.array_max(light) * 120).when(n == 0, 0.0)
