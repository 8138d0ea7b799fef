"""The arithmetic of a sheet: rows of keyframes, bands, markers and waves, in pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F



@dataclass(frozen=True)
class Sheet:
    """Sizes of a sheet, in pixels but for pixels_per_second and per_row."""

    per_row: int = 4
    most_per_row: int = 6
    pack: bool = True
    frame_width: int = 240
    frame_height: int = 135
    min_band: float = 12.0
    pixels_per_second: float = 4.0

    def __post_init__(self) -> None:
        if min(self.per_row, self.frame_width, self.frame_height) < 1:
            raise ValueError("sizes must be positive")


def per_row(count: Column, sheet: Sheet = Sheet()) -> Column:
    """How many keyframes a row holds: fewest rows, then fewest empty places, then fewest a row."""
    rows = lambda k: F.ceil(count / k)
    options = F.transform(F.sequence(F.lit(sheet.per_row), F.lit(max(sheet.per_row, sheet.most_per_row))), lambda k: F.struct(rows(k).alias("rows"), (rows(k) * k - count).alias("empty"), k.alias("k")))
    return F.when(F.lit(not sheet.pack) | (count <= sheet.per_row), F.lit(sheet.per_row)).otherwise(F.array_min(options)["k"]).cast("long")


def rows_of_keyframes(frames: DataFrame, bounds: DataFrame, sheet: Sheet = Sheet()) -> DataFrame:
    """Keyframes (film_id, time) with their row and place in it, and the row's start and end.

    Rows meet halfway between neighbours; the first begins and the last ends with
    the film (bounds: film_id, from, to). A film without keyframes has one row without a time.
    """
    w = Window.partitionBy("film_id")
    k = bounds.join(frames, "film_id", "left").withColumn("count", F.count("time").over(w)).withColumn("i", F.row_number().over(w.orderBy("time")) - 1)
    k = k.withColumn("per", per_row(F.col("count"), sheet)).withColumn("row", F.floor(F.col("i") / F.col("per")).cast("long"))
    half = lambda other: (F.col("time") + other) / 2
    k = k.withColumn("before", F.lag("time").over(w.orderBy("i"))).withColumn("after", F.lead("time").over(w.orderBy("i")))
    r = Window.partitionBy("film_id", "row").orderBy("i")
    whole = r.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = lambda t: F.greatest(F.col("from"), F.least(F.col("to"), t))
    start = F.first(F.coalesce(half(F.col("before")), F.col("from"))).over(whole)
    end = F.last(F.coalesce(half(F.col("after")), F.col("to"))).over(whole)
    return k.select("film_id", "row", (F.row_number().over(r) - 1).cast("long").alias("place"), "time", inside(start).alias("row_start"), inside(end).alias("row_end"))


def band_width(seconds: Column, sheet: Sheet = Sheet()) -> Column:
    return F.when(seconds <= 0.001, 0.0).otherwise(F.greatest(F.lit(sheet.min_band), seconds * sheet.pixels_per_second))


def placed(rows: DataFrame, left: float, width: float, sheet: Sheet = Sheet()) -> DataFrame:
    """Rows of rows_of_keyframes with the pixels of each frame: x, frame_width, frame_height and band_after, and lead, tail and row_width of its row.

    A row that would be wider than width is scaled; frames stay 96 wide at least, bands at .6 of the least.
    """
    r = Window.partitionBy("film_id", "row").orderBy("place")
    whole = r.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.filter("time is not null").withColumn("next", F.lead("time").over(r))
    lead = F.first(band_width(F.col("time") - F.col("row_start"), sheet)).over(whole)
    tail = F.last(band_width(F.col("row_end") - F.col("time"), sheet)).over(whole)
    band = F.when(F.col("next").isNull(), 0.0).otherwise(band_width(F.greatest(F.lit(0.001), F.col("next") - F.col("time")), sheet))
    rows = rows.withColumn("lead", lead).withColumn("tail", tail).withColumn("band", band).withColumn("count", F.count("*").over(whole))
    asked = F.col("lead") + F.col("count") * sheet.frame_width + F.sum("band").over(whole) + F.col("tail")
    rows = rows.withColumn("scale", F.least(F.lit(1.0), F.lit(float(width)) / asked))
    rows = rows.withColumn("frame_width", F.greatest(F.lit(96), F.floor(F.col("scale") * sheet.frame_width).cast("int")).cast("long"))
    shrunk = lambda c: F.when(F.col(c) > 0, F.greatest(F.lit(sheet.min_band * 0.6), F.col(c) * F.col("scale"))).otherwise(0.0)
    rows = rows.withColumns({c: shrunk(c) for c in ("lead", "tail", "band")})
    rows = rows.withColumn("total", F.col("lead") + F.col("count") * F.col("frame_width") + F.sum("band").over(whole) + F.col("tail"))
    begin = F.lit(float(left)) + F.greatest(F.lit(0.0), (F.lit(float(width)) - F.col("total")) / 2)
    past = F.coalesce(F.sum(F.col("frame_width") + F.col("band")).over(r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole_pixels = lambda x: F.bround(x, 0).cast("long")
    return rows.select(
        "film_id", "row", "place", "time", whole_pixels(begin + F.col("lead") + past).alias("x"), "frame_width",
        whole_pixels(F.col("frame_width") * sheet.frame_height / sheet.frame_width).alias("frame_height"), whole_pixels(F.col("band")).alias("band_after"),
        whole_pixels(F.col("lead")).alias("lead"), whole_pixels(F.col("tail")).alias("tail"), whole_pixels(F.col("total")).alias("row_width"),
    )


def _x(t: Column, start: Column, end: Column, x: float, width: float) -> Column:
    return F.lit(float(x)) + (t - start) / F.greatest(F.lit(0.001), end - start) * width


def colour_columns(samples: DataFrame, x: float, width: float) -> DataFrame:
    """Samples of a range (film_id, t, from, to, r, g, b) as columns from left to right: each until the next, the last for a second."""
    inside = samples.filter((F.col("t") >= F.col("from") - 0.001) & (F.col("t") <= F.col("to") + 0.001) & (F.col("to") > F.col("from") + 0.001))
    after = F.lead("t").over(Window.partitionBy("film_id", "from").orderBy("t"))
    cut = lambda t: F.greatest(F.col("from"), F.least(F.col("to"), t))
    rows = inside.withColumn("a", cut(F.col("t"))).withColumn("z", cut(F.coalesce(after, F.col("t") + 1)))
    left = _x(F.col("a"), F.col("from"), F.col("to"), x, width)
    wide = F.greatest(F.lit(1.0), (F.col("z") - F.col("a")) / F.greatest(F.lit(0.001), F.col("to") - F.col("from")) * width + 1)
    return rows.select("film_id", "from", "t", left.cast("int").cast("long").alias("left"), (left + wide).cast("int").cast("long").alias("right"), "r", "g", "b")


def markers(cues: DataFrame, x: float, width: float) -> DataFrame:
    """Cues that touch a range (film_id, start, end, from, to) as bars within it, 4 pixels wide at least."""
    cut = lambda t: F.greatest(F.col("from"), F.least(F.col("to"), t))
    left = _x(cut(F.col("start")), F.col("from"), F.col("to"), x, width)
    right = _x(cut(F.col("end")), F.col("from"), F.col("to"), x, width)
    met = cues.filter((F.col("end") >= F.col("from")) & (F.col("start") <= F.col("to")))
    return met.select("film_id", "from", "start", left.cast("int").cast("long").alias("left"), F.greatest(left + 4, right).cast("int").cast("long").alias("right"))


def wave(levels: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """Levels of a range (film_id, t, level, from, to) as upright lines around the middle."""
    inside = levels.filter((F.col("t") >= F.col("from") - 0.001) & (F.col("t") <= F.col("to") + 0.001))
    middle, amp = F.lit(y + height / 2), F.col("level") * (height / 2)
    return inside.select("film_id", "from", "t", _x(F.col("t"), F.col("from"), F.col("to"), x, width).cast("int").cast("long").alias("x"), (middle - amp).cast("int").cast("long").alias("top"), (middle + amp).cast("int").cast("long").alias("bottom"))


def display_rows(start: Column, end: Column, seconds: float = 30.0) -> Column:
    """Tumbling rows of a range, seconds long (10 at least), the last one shorter; none of an empty range."""
    step = max(10.0, seconds)
    last = F.ceil((end - 0.001 - start) / step) - 1
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda i: F.struct((start + i * step).alias("start"), F.least(end, start + (i + 1) * step).alias("end")))).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def trailing(now: Column, window: float = 90.0) -> Column:
    """The range shown at a position: the last seconds before it, from 0."""
    return F.struct(F.greatest(F.lit(0.0), now - window).alias("start"), now.alias("end"))


def compact(samples: DataFrame) -> DataFrame:
    """Samples as they are sent: delta and change to 2 decimals, luma and quality to 3."""
    return samples.withColumns({c: F.round(c, d) for c, d in (("delta", 2), ("change", 2), ("luma", 3), ("quality", 3))})


