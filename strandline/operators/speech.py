"""Recognised text and sound: filters, merges, bins and transients."""

from __future__ import annotations

import sys
import difflib
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from strandline.functions.text import asr_key, squeeze
from strandline.operators.intervals import nearest_point, overlap_join
from strandline.operators.scoring import floor_quantile
from strandline.options import Options

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package


def usable_segments(rows: DataFrame) -> DataFrame:
    """Recognised segments with text that are neither silence nor loops and have a length. One metric that isn't a number voids all three."""
    metrics = ["no_speech", "logprob", "compression"]
    num = {m: F.col(m).try_cast("double") for m in metrics}
    bad = F.lit(False)
    for m in metrics:
        bad = bad | (F.col(m).isNotNull() & num[m].isNull())
    value = {m: F.when(~bad, num[m]) for m in metrics}
    silent = F.coalesce((value["no_speech"] >= 0.8) & (value["logprob"] <= -1), F.lit(False))
    loop = F.coalesce(value["compression"] > 3, F.lit(False))
    return rows.withColumn("text", squeeze(F.col("text"))).filter((F.col("text") != "") & ~silent & ~loop & (F.col("end") > F.col("start")))


def _segment_key(keys: list[str]) -> list[Column]:
    return [*(F.col(k) for k in keys), asr_key(F.col("text")).alias("__text"), F.bround("start", 1).alias("__start"), F.bround("end", 1).alias("__end")]


def owned(segments: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Segments of overlapping windows, each kept by the window its middle lies in.

    segments: start, end, text, from, to, first_window, last_window. Ends of the
    film own what lies beyond them; equal texts at a tenth of a second come once,
    and not where existing (start, end, text) has them.
    """
    mid = (F.col("start") + F.col("end")) / 2
    touches = (F.col("end") >= F.col("from")) & (F.col("start") <= F.col("to"))
    mine = ((mid >= F.col("from")) | F.col("first_window")) & ((mid < F.col("to")) | F.col("last_window"))
    marked = segments.filter(touches & mine).withColumns({f"__{n}": c for n, c in zip(("text", "start", "end"), _segment_key([]))})
    ids = [*keys, "__text", "__start", "__end"]
    first = F.row_number().over(Window.partitionBy(*ids).orderBy("from", "start", "end", "text"))
    kept = marked.withColumn("__r", first).filter("__r = 1").drop("__r")
    if existing is not None:
        kept = kept.join(existing.select(*_segment_key(keys)).distinct(), ids, "left_anti")
    return kept.select(*segments.columns)


def readings(frames: DataFrame) -> DataFrame:
    """Frames with a column reading: struct(text, confidence) of their boxes, null where no text is left."""
    rows = frames.withColumn("__rows", normal_rows(F.col("boxes")["text"]))
    return rows.withColumn("reading", read_boxes(F.col("boxes"), F.col("__rows"))).drop("__rows")


def read_boxes(boxes: Column, normal: Column) -> Column:
    """struct(text, confidence) of one frame's boxes (text, confidence, x, y, width): plausible ones, top first, equal texts once.

    normal: normal_rows() of their texts. Boxes of one height stay in their order.
    """
    named = F.zip_with(boxes, normal, lambda b, n: F.struct(b["confidence"].alias("confidence"), b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"), n["text"].alias("text"), n["code"].alias("code")))
    enough = lambda b: F.when(b["code"].rlike(r"[㐀-鿿]"), F.length(b["code"]) >= 2).otherwise((F.length(b["code"]) >= 3) & b["code"].rlike("[a-z0-9]"))
    good = F.filter(named, lambda b: (b["confidence"] >= 0.25) & (b["width"] >= 0.035) & ((b["x"] + b["width"] / 2).between(0.12, 0.88)) & enough(b))
    rows = F.array_sort(F.transform(good, lambda b, i: F.struct((-b["y"]).alias("y"), i.alias("i"), b["code"].alias("code"), b["text"].alias("text"), b["confidence"].alias("confidence"))))
    once = F.filter(rows, lambda b, i: ~F.exists(F.slice(rows, 1, i), lambda o: o["code"] == b["code"]))
    mean = F.aggregate(once, F.lit(0.0), lambda a, b: a + b["confidence"]) / F.size(once)
    return F.when(F.size(once) > 0, F.struct(F.array_join(F.transform(once, lambda b: b["text"]), " / ").alias("text"), mean.alias("confidence")))


def with_readings(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Frames (path, ...) with the boxes recognised in their image; none where it has no row in images (path, boxes)."""
    known = images.groupBy("path").agg(F.first("boxes").alias("boxes"))
    none = F.array().cast(images.schema["boxes"].dataType)
    return frames.join(known, "path", "left").withColumn("boxes", F.coalesce("boxes", none))


def burned_in(readings: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Per key, of sampled frames (time, text, confidence, text null where none was read): samples, hits, whether subtitles are burned in, and the first five hits."""
    hit = F.col("text").isNotNull() & (F.col("text") != "")
    example = F.struct("time", "text", F.bround("confidence", 3).alias("confidence"))
    seen = readings.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(hit).alias("hits"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("time"))
    first = readings.filter(hit).withColumn("__p", place).filter("__p <= 5").groupBy(*keys).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    none = F.array().cast(first.schema["examples"].dataType)
    return seen.join(first, keys, "left").select(*keys, "samples", "hits", (F.col("hits") >= least).alias("detected"), F.coalesce("examples", none).alias("examples"))


def plain(text: str) -> str:
    """Compatibility-normalised, case-folded letters and digits."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").casefold() if c.isalnum())


def similarity(a: str, b: str) -> float:
    """1 for equal texts, .78 or more where one holds the other, else the share of matching runs; the best over the parts between slashes."""
    best = 0.0
    others = [q for q in map(plain, b.split("/")) if q]
    for p in filter(None, map(plain, a.split("/"))):
        for q in others:
            if p == q:
                return 1.0
            short, long = sorted((p, q), key=len)
            ratio = 0.78 + 0.22 * len(short) / len(long) if len(short) >= 3 and short in long else difflib.SequenceMatcher(None, p, q).ratio()
            best = max(best, ratio)
    return best


@F.pandas_udf(DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def normalized(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else plain(x))


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("code", StringType())])))
def normal_rows(rows: pd.Series) -> pd.Series:
    """Texts of boxes, compatibility-normalised with single spaces, and as plain() has them."""
    spaced = lambda x: " ".join(unicodedata.normalize("NFKC", x or "").split())
    return rows.map(lambda r: None if r is None else [{"text": spaced(x), "code": plain(x)} for x in r])


def merge_readings(readings: DataFrame, step: float, like: float = 0.78, missed: int = 1) -> DataFrame:
    """Readings (film_id, time, text, confidence) of one caption over several frames as one cue.

    A reading joins an open group if few frames were missed and its text is like
    that of the group's best reading, by confidence and a little for length.
    Groups of one reading below .5 confidence go. One film is one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        done, group = [], None
        for r in pdf.sort_values(["time", "text"], kind="stable").itertuples():
            worth = r.confidence + min(80, len(plain(r.text))) / 800
            if group and r.time - group["last"] <= step * (missed + 1.25) and similarity(r.text, group["text"]) >= like:
                group["last"], group["n"], group["sum"] = r.time, group["n"] + 1, group["sum"] + r.confidence
                if worth > group["worth"]:
                    group["worth"], group["text"] = worth, r.text
                continue
            if group:
                done.append(group)
            group = {"film": r.film_id, "start": r.time, "last": r.time, "text": r.text, "worth": worth, "sum": r.confidence, "n": 1}
        if group:
            done.append(group)
        kept = [g for g in done if g["n"] > 1 or g["sum"] >= 0.5]
        return pd.DataFrame([(g["film"], g["start"], g["last"] + step, g["text"], g["sum"] / g["n"], g["n"]) for g in kept], columns=["film_id", "start", "end", "text", "confidence", "observations"])

    return readings.groupBy("film_id").applyInPandas(fold, "film_id long, start double, end double, text string, confidence double, observations long")


def detection_times(duration: Column) -> Column:
    """Where to look for burned-in text: 20 midpoints within margins, and six times of the first ten minutes; none of a film without length."""
    margin = F.least(F.lit(30.0), duration * 0.03)
    usable = F.greatest(F.lit(0.0), duration - margin * 2)
    mids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.bround(margin + usable * (i + 0.5) / 20, 3))
    fixed = F.array(*(F.lit(x) for x in (60.0, 120.0, 180.0, 300.0, 450.0, 600.0)))
    return F.filter(F.array_sort(F.array_distinct(F.concat(mids, fixed))), lambda t: (t >= 0) & (t < duration))


def audio_bins(pcm: DataFrame, per_bin: int, step: float, options: Options = Options()) -> DataFrame:
    """Loudness of (film_id, i, x), x in 16-bit steps: a bin of per_bin values each step."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x"))) / 32768
    b = pcm.groupBy("film_id", F.floor(F.col("i") / per_bin).cast("long").alias("bin")).agg(rms.alias("rms"))
    energy = F.sqrt("rms") * options.audio_gain
    return b.select("film_id", "bin", F.bround(F.col("bin") * step, 3).alias("t"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), energy)), 4).alias("level"), F.bround(energy, 4).alias("energy"))


def transients(levels: DataFrame, options: Options = Options()) -> DataFrame:
    """How far the loudest energy near each bin stands above the median around it (film_id, bin, energy)."""
    k = int(options.audio_window / options.audio_step), int(options.audio_context / options.audio_step)
    w = Window.partitionBy("film_id").orderBy("bin")
    near, around = F.max("energy").over(w.rangeBetween(-k[0], k[0])), F.collect_list("energy").over(w.rangeBetween(-k[1], k[1]))
    return levels.withColumn("event", F.bround(_transient(near, around, options), 6))


def _transient(peak: Column, around: Column, options: Options) -> Column:
    mid = floor_quantile(around, 0.5)
    floor = F.greatest(F.lit(0.08), floor_quantile(around, 0.9) - mid)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (peak - mid) / floor))
    return F.when(F.least(F.lit(1.0), peak) >= options.audio_min_level, score).otherwise(0.0)


def heard_samples(samples: DataFrame, levels: DataFrame, options: Options = Options()) -> DataFrame:
    """Samples (film_id, at, t) with audio_level and audio_event from levels (film_id, bin, t, energy).

    The levels within the window around a sample count, or the nearest one where
    there is none; the median and the high of those within the context tell what
    stands out. Films without levels have zeros.
    """
    near, wide = max(0.05, options.audio_window), max(2 * max(0.05, options.audio_window), options.audio_context)
    s = samples.withColumn("__a", F.col("t") - wide).withColumn("__z", F.col("t") + wide)
    l = levels.select("film_id", F.col("t").alias("l_t"), F.col("t").alias("l_u"), "energy")
    apart = F.abs(F.col("l_t") - F.col("t"))
    met = overlap_join(s, l, ["film_id"], ("__a", "__z"), ("l_t", "l_u"), 2 * wide).filter(apart <= wide)
    met = met.groupBy("film_id", "at").agg(F.max(F.when(apart <= near, F.col("energy"))).alias("peak"), F.collect_list("energy").alias("around"))
    one = nearest_point(samples.select("film_id", "at", "t"), levels.select("film_id", F.col("t").alias("s_t"), F.col("energy").alias("one")), ["film_id"]).select("film_id", "at", "one")
    rows = samples.join(met, ["film_id", "at"], "left").join(one, ["film_id", "at"], "left")
    peak = F.coalesce("peak", "one")
    around = F.when(F.size("around") > 0, F.col("around")).otherwise(F.array("one"))
    level, event = F.bround(F.least(F.lit(1.0), peak), 4), F.bround(_transient(peak, around, options), 4)
    return rows.select(*samples.columns, F.coalesce(level, F.lit(0.0)).alias("audio_level"), F.coalesce(event, F.lit(0.0)).alias("audio_event"))
