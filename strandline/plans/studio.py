"""Queries over subtitle files, frames, sheets, sources, caches and jobs, made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandline.functions import text as X, timecode as C
from strandline.operators import frames, layout as Y, retention, speech
from strandline.plans.catalogue import register
from strandline.plans.library import PCM_SQL, sound
from strandline.plans.timeline import CLEAN, _collapse, rolling
from strandline.sources import library as L, probes, subtitles, views as V

_T = CLEAN.format("text")
_MS = lambda x: f"round_even({x} * 1000, 0) / 1000"


def _files(rows: DataFrame, line: Column, order: list[str], head: str = "", join: str = "\n\n", last: str = "\r\n") -> DataFrame:
    """One file a film (path, value) of its lines in order."""
    lines = rows.groupBy("film_id").agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return lines.select(F.col("film_id").cast("string").alias("path"), F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), join), F.lit(last)).alias("value"))


def _scanned(cues: DataFrame) -> DataFrame:
    return cues.select(F.col("path").cast("long").alias("film_id"), "ord", F.bround("start", 6).alias("start"), F.bround("end", 6).alias("end"), "text")


def _stamped(sep: str) -> Column:
    point = lambda c: F.replace(C.subtitle_time(F.col(c)), F.lit(","), F.lit(sep))
    return F.concat(point("start"), F.lit(" --> "), point("end"))


@register("srt_scan", f"""WITH {V.CUES_SQL}, c AS (SELECT film_id, ord, {_MS('start')} AS start, {_MS('"end"')} AS "end", {_T} AS text FROM v_cues) SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY ord) AS ord, round_even(start, 6) AS start, round_even("end", 6) AS "end", text FROM c WHERE text <> ''""")
def srt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an SRT file with tags and override blocks, read again."""
    body = F.concat(F.lit("{\\an8}<i>"), X.squeeze(F.col("text")), F.lit("</i>"))
    line = F.concat(F.col("ord").cast("string"), F.lit("\n"), _stamped(","), F.lit("\n"), body)
    return _scanned(subtitles.srt(_files(V.cues(spark, sf_dir), line, ["ord"])))


@register("srt_scan_raw", f"""WITH {V.CUES_SQL}, c AS (SELECT film_id, ord, {_MS('start')} AS start, {_MS('"end"')} AS "end", '<b>' || regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') || '</b>' || chr(10) || style AS text FROM v_cues) SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY start) AS ord, round_even(start, 6) AS start, round_even("end", 6) AS "end", text FROM c""")
def srt_scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a server reads them: tags and line breaks stay, cues come in order of start, here from files in reverse."""
    body = F.concat(F.lit("<b>"), X.squeeze(F.col("text")), F.lit("</b>\n"), F.col("style"))
    rows = V.cues(spark, sf_dir).withColumn("last", -F.col("ord"))
    return _scanned(subtitles.srt(_files(rows, F.concat(F.col("ord").cast("string"), F.lit("\n"), _stamped(","), F.lit("\n"), body), ["last"], last="\n"), clean=False))


_VTT = f"v_vtt AS (SELECT film_id, {_MS('start')} AS start, {_MS('q.end')} AS \"end\", '[' || style || '] ' || x AS x, row_number() OVER (PARTITION BY film_id ORDER BY ord, part) AS k FROM (SELECT *, {_T} AS x, 0 AS part FROM v_cues UNION ALL SELECT film_id, ord, start, \"end\" + 1, style, text, {CLEAN.format(chr(39) + chr(39) + ' || text')} || ' more', 1 FROM v_cues WHERE ord % 2 = 0) q WHERE x <> '')"


@register("vtt_scan", f"""WITH RECURSIVE {V.CUES_SQL}, {_VTT}, {_collapse('v_vtt')} SELECT film_id, i AS ord, round_even(arg_max(s, k), 6) AS start, round_even(arg_max(e, k), 6) AS "end", arg_max(x, k) AS text FROM r WHERE i > 0 GROUP BY film_id, i""")
def vtt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a WebVTT file with voices and rolling captions, read again."""
    line = F.concat(_stamped("."), F.lit(" align:start\n<v "), F.col("style"), F.lit(">"), X.squeeze(F.col("text")))
    return _scanned(subtitles.vtt(_files(rolling(spark, sf_dir).filter(X.clean_cue(F.col("text")) != ""), line, ["ord", "part"], "WEBVTT\n\n")))


@register(
    "ass_scan",
    f"""WITH {V.CUES_SQL}, c AS (SELECT film_id, round_even(start * 100, 0) / 100 AS start, round_even("end" * 100, 0) / 100 AS "end", {_T} AS text FROM v_cues WHERE style <> 'system'),
    k AS (SELECT *, row_number() OVER (PARTITION BY film_id, round_even(start * 10, 0), round_even("end" * 10, 0), text ORDER BY start, "end") AS p FROM c WHERE text <> '')
    SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY start, "end", text) AS ord, round_even(start, 6) AS start, round_even("end", 6) AS "end", text FROM k WHERE p = 1""",
)
def ass_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an ASS file, every line twice, the style system left out, read again."""
    hundredths = lambda c: F.bround(F.col(c) * 100, 0).cast("long")
    stamp = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(hundredths(c) / 360000), F.floor(hundredths(c) / 6000) % 60, F.floor(hundredths(c) / 100) % 60, hundredths(c) % 100)
    line = F.concat(F.lit("Dialogue: 0,"), stamp("start"), F.lit(","), stamp("end"), F.lit(","), F.col("style"), F.lit(",,0,0,0,,{\\pos(1,2)}"), X.squeeze(F.col("text")))
    q = V.cues(spark, sf_dir).withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1))))
    d = _files(q, line, ["ord", "twice"], "[Script Info]\nDialogue: 0,0:00:00.00,0:00:01.00,x,,0,0,0,,no\n[Events]\n", "\n", "\n")
    return _scanned(subtitles.ass(d, exclude="^system$"))


@register(
    "frame_stats",
    f"""WITH {V.PIXELS_SQL}, e AS (SELECT film_id, n, l, abs(l - lead(l) OVER (PARTITION BY film_id, n, y ORDER BY x)) AS dx, abs(l - lead(l) OVER (PARTITION BY film_id, n, x ORDER BY y)) AS dy FROM v_luma),
    d AS (SELECT film_id, n, (sum(coalesce(dx, 0)) + sum(coalesce(dy, 0))) / 24 AS edge FROM e GROUP BY film_id, n),
    m AS (SELECT p1.film_id, p1.n, (sum(abs(p1.r - p2.r)) + sum(abs(p1.g - p2.g)) + sum(abs(p1.b - p2.b))) / 48 / 255::DOUBLE AS motion FROM v_pixel p1 JOIN v_pixel p2 ON p1.film_id = p2.film_id AND p1.n = p2.n + 1 AND p1.i = p2.i GROUP BY p1.film_id, p1.n),
    s AS (SELECT film_id, n, round_even(avg(r), 0) AS r, round_even(avg(g), 0) AS g, round_even(avg(b), 0) AS b, avg(l) AS luma, sqrt(greatest(0.0::DOUBLE, avg(l * l) - avg(l) * avg(l))) AS contrast,
        avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE ELSE 0.0::DOUBLE END) AS saturation,
        round_even(avg(r) FILTER (x < 2 AND y < 2), 0) AS tile_r, avg(l) FILTER (x >= 2 AND y >= 2) AS tile_luma FROM v_luma GROUP BY film_id, n)
    SELECT s.film_id, s.n, r, g, b, round_even(luma, 9) AS luma, round_even(contrast, 9) AS contrast, round_even(edge, 9) AS edge, round_even(saturation, 9) AS saturation, round_even(coalesce(motion, 0), 9) AS motion, tile_r, round_even(tile_luma, 9) AS tile_luma
    FROM s JOIN d USING (film_id, n) LEFT JOIN m USING (film_id, n)""",
)
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of raw frames, with motion and two of the four tiles."""
    s = frames.sampled(V.pixels(spark, sf_dir), 4, 4, 2)
    return s.select("film_id", "n", "r", "g", "b", *(F.bround(c, 9).alias(c) for c in ("luma", "contrast", "edge", "saturation", "motion")), F.col("tiles")[0]["r"].alias("tile_r"), F.bround(F.col("tiles")[3]["luma"], 9).alias("tile_luma"))


_FILMS = 'f AS (SELECT film_id, min(start) - 1 AS a, max("end") AS z, count(*) AS c FROM v_cues GROUP BY film_id)'
_ROWS = f"""{_FILMS}, g AS (SELECT film_id, c, unnest([4, 5, 6]) AS k FROM f), h AS (SELECT film_id, CASE WHEN any_value(c) <= 4 THEN 4 ELSE arg_min(k, ceil(c / k::DOUBLE) * 10000 + (ceil(c / k::DOUBLE) * k - c) * 100 + k) END AS per FROM g GROUP BY film_id),
v_key AS (SELECT q.film_id, start + 0.5::DOUBLE AS t, (row_number() OVER (PARTITION BY q.film_id ORDER BY start) - 1) // per AS row, (row_number() OVER (PARTITION BY q.film_id ORDER BY start) - 1) % per AS place,
    lag(start) OVER (PARTITION BY q.film_id ORDER BY start) + 0.5::DOUBLE AS p, lead(start) OVER (PARTITION BY q.film_id ORDER BY start) + 0.5::DOUBLE AS s, a, z FROM v_cues q JOIN h USING (film_id) JOIN f USING (film_id)),
v_row AS (SELECT film_id, row, greatest(any_value(a), least(any_value(z), coalesce(arg_min((t + p) / 2, place) FILTER (p IS NOT NULL AND place = 0), any_value(a)))) AS row_start,
    greatest(any_value(a), least(any_value(z), CASE WHEN arg_max(coalesce(s, -1), place) < 0 THEN any_value(z) ELSE arg_max((t + coalesce(s, t)) / 2, place) END)) AS row_end FROM v_key GROUP BY film_id, row)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    bounds = q.groupBy("film_id").agg((F.min("start") - 1).alias("from"), F.max("end").alias("to"))
    return Y.rows_of_keyframes(q.select("film_id", (F.col("start") + 0.5).alias("time")), bounds)


@register("sheet_rows", f"WITH {V.CUES_SQL}, {_ROWS} SELECT film_id, row, place, t AS time, round_even(row_start, 6) AS row_start, round_even(row_end, 6) AS row_end FROM v_key JOIN v_row USING (film_id, row)")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes in the rows of a sheet, rows meeting halfway between neighbours."""
    return _keyed(spark, sf_dir).select("film_id", "row", "place", "time", F.bround("row_start", 6).alias("row_start"), F.bround("row_end", 6).alias("row_end"))


_BAND = "CASE WHEN {0} <= 0.001::DOUBLE THEN 0.0::DOUBLE ELSE greatest(12.0::DOUBLE, ({0}) * 4.0::DOUBLE) END"


@register(
    "sheet_layout",
    f"""WITH {V.CUES_SQL}, {_ROWS}, b AS (SELECT film_id, row, place, t, {_BAND.format('coalesce(lead(t) OVER w - t, 0)')} AS band, row_start, row_end FROM v_key JOIN v_row USING (film_id, row) WINDOW w AS (PARTITION BY film_id, row ORDER BY place)),
    c AS (SELECT film_id, row, count(*) AS n, {_BAND.format('min(t) - any_value(row_start)')} AS lead0, {_BAND.format('any_value(row_end) - max(t)')} AS tail0, coalesce(sum(band), 0) AS bands FROM b GROUP BY film_id, row),
    d AS (SELECT *, least(1.0::DOUBLE, 900.0::DOUBLE / (lead0 + n * 240 + bands + tail0)) AS scale FROM c),
    e AS (SELECT *, greatest(96, CAST(floor(240 * scale) AS BIGINT)) AS fw, CASE WHEN lead0 > 0 THEN greatest(7.2::DOUBLE, lead0 * scale) ELSE 0.0::DOUBLE END AS ld, CASE WHEN tail0 > 0 THEN greatest(7.2::DOUBLE, tail0 * scale) ELSE 0.0::DOUBLE END AS tl FROM d),
    u AS (SELECT b.film_id, b.row, place, fw, ld, tl, n, CASE WHEN band > 0 THEN greatest(7.2::DOUBLE, band * scale) ELSE 0.0::DOUBLE END AS bd FROM b JOIN e USING (film_id, row)),
    y AS (SELECT *, ld + n * fw + sum(bd) OVER (PARTITION BY film_id, row) + tl AS total, coalesce(sum(fw + bd) OVER (PARTITION BY film_id, row ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM u)
    SELECT film_id, row, place, CAST(round_even(40 + greatest(0.0::DOUBLE, (900 - total) / 2) + ld + past, 0) AS BIGINT) AS x, fw AS frame_width, CAST(round_even(fw * 135 / 240.0::DOUBLE, 0) AS BIGINT) AS frame_height, CAST(round_even(bd, 0) AS BIGINT) AS band_after, CAST(round_even(total, 0) AS BIGINT) AS row_width FROM y""",
)
def sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each keyframe of a sheet stands, in pixels."""
    return Y.placed(_keyed(spark, sf_dir), 40.0, 900.0).select("film_id", "row", "place", "x", "frame_width", "frame_height", "band_after", "row_width")


_CUT = lambda t: f"greatest(100.0::DOUBLE, least(300.0::DOUBLE, {t}))"
_X = lambda t, w: f"10.0::DOUBLE + ({t} - 100) / 200 * {w}"


@register("colour_columns", f"WITH {V.FRAMES_SQL}, i AS (SELECT *, {_CUT('t')} AS a, {_CUT('coalesce(lead(t) OVER (PARTITION BY film_id ORDER BY t), t + 1)')} AS z FROM v_frame WHERE t >= 99.999::DOUBLE AND t <= 300.001::DOUBLE) SELECT film_id, n, CAST(trunc({_X('a', 800)}) AS BIGINT) AS \"left\", CAST(trunc({_X('a', 800)} + greatest(1.0::DOUBLE, (z - a) / 200 * 800 + 1)) AS BIGINT) AS \"right\", r, g, b FROM i")
def colour_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour band of a range of each film."""
    s = V.frames(spark, sf_dir).withColumn("from", F.lit(100.0)).withColumn("to", F.lit(300.0))
    made = Y.colour_columns(s, 10.0, 800.0)
    return made.join(s.select("film_id", "n", "t"), ["film_id", "t"]).select("film_id", "n", "left", "right", "r", "g", "b")


@register("subtitle_markers", f"""WITH {V.CUES_SQL}, c AS (SELECT film_id, ord, 10.0::DOUBLE + (greatest(4.0::DOUBLE, least(20.0::DOUBLE, start)) - 4) / 16 * 500 AS l, 10.0::DOUBLE + (greatest(4.0::DOUBLE, least(20.0::DOUBLE, "end")) - 4) / 16 * 500 AS r FROM v_cues WHERE "end" >= 4 AND start <= 20) SELECT film_id, ord, CAST(trunc(l) AS BIGINT) AS "left", CAST(trunc(greatest(l + 4, r)) AS BIGINT) AS "right" FROM c""")
def subtitle_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir).withColumn("from", F.lit(4.0)).withColumn("to", F.lit(20.0))
    return Y.markers(q, 10.0, 500.0).join(q.select("film_id", "start", "ord"), ["film_id", "start"]).select("film_id", "ord", "left", "right")


@register("wave_columns", f"WITH {PCM_SQL}, b AS (SELECT film_id, bin, round_even(bin * 0.25::DOUBLE, 3) AS t, round_even(least(1.0::DOUBLE, e), 4) AS level FROM v_bins) SELECT film_id, bin, CAST(trunc(10.0::DOUBLE + (t - 1) / 4 * 300) AS BIGINT) AS x, CAST(trunc(50.0::DOUBLE - level * 25) AS BIGINT) AS top, CAST(trunc(50.0::DOUBLE + level * 25) AS BIGINT) AS bottom FROM b WHERE t >= 0.999::DOUBLE AND t <= 5.001::DOUBLE")
def wave_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sound(spark, sf_dir).withColumn("from", F.lit(1.0)).withColumn("to", F.lit(5.0))
    return Y.wave(b, 10.0, 25.0, 300.0, 50.0).join(b.select("film_id", "t", "bin"), ["film_id", "t"]).select("film_id", "bin", "x", "top", "bottom")


@register("display_rows", f"""WITH {V.CUES_SQL}, f AS (SELECT film_id, max("end") AS now FROM v_cues GROUP BY film_id), w AS (SELECT film_id, greatest(0.0::DOUBLE, now - 25) AS a, now AS z FROM f), r AS (SELECT *, unnest(range(0, CAST(ceil((z - 0.001::DOUBLE - a) / 10) AS BIGINT))) AS row FROM w) SELECT film_id, row, round_even(a + row * 10, 6) AS start, round_even(least(z, a + (row + 1) * 10), 6) AS "end" FROM r""")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling rows of the last seconds before each film's end."""
    f = V.cues(spark, sf_dir).groupBy("film_id").agg(Y.trailing(F.max("end"), 25.0).alias("w"))
    r = f.select("film_id", F.posexplode(Y.display_rows(F.col("w.start"), F.col("w.end"), 10.0)).alias("row", "r"))
    return r.select("film_id", F.col("row").cast("long").alias("row"), F.bround("r.start", 6).alias("start"), F.bround("r.end", 6).alias("end"))


@register("text_colours", f"WITH {V.FRAMES_SQL} SELECT film_id, n, CASE WHEN (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255 > 0.55::DOUBLE THEN 'dark' ELSE 'light' END AS colour FROM v_frame")
def text_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frames(spark, sf_dir).select("film_id", "n", X.text_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


@register("cue_labels", f"WITH {V.CUES_SQL} SELECT film_id, count(*) AS cues, count(*) FILTER (NOT (ord % 3 = 0 OR film_id % 2 = 0)) AS plain, CASE WHEN bool_and(ord % 3 = 0 OR film_id % 2 = 0) THEN 'burned-subtitle-ocr' ELSE 'source-subtitle' END AS label FROM v_cues GROUP BY film_id")
def cue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the cues of each film come from, over a track of recognised cues and a plain one."""
    q = V.cues(spark, sf_dir)
    ocr = (F.col("ord") % 3 == 0) | (F.col("film_id") % 2 == 0)
    both = subtitles.marked(subtitles.together(q.filter(ocr).withColumn("source", F.lit("burned-subtitle-ocr")).withColumn("confidence", F.lit(0.5)), q.filter(~ocr)))
    counts = both.groupBy("film_id").agg(F.count("*").alias("cues"), F.count_if(F.col("source") == "source-subtitle").alias("plain"))
    return counts.join(subtitles.source_label(both, ["film_id"]), "film_id")


@register(
    "burned_in",
    f"""WITH {V.CUES_SQL}, s AS (SELECT film_id, start AS t, text, (ord % 10) / 10::DOUBLE AS c, style = 'user' AS hit FROM v_cues), h AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY t) AS p FROM s WHERE hit AND text <> '')
    SELECT film_id, count(*) AS samples, count(*) FILTER (hit AND text <> '') AS hits, count(*) FILTER (hit AND text <> '') >= 3 AS detected, coalesce((SELECT string_agg(round_even(t, 1)::VARCHAR || ' ' || round_even(c, 3)::VARCHAR, ',' ORDER BY t) FROM h WHERE h.film_id = s.film_id AND p <= 5), '') AS examples FROM s GROUP BY film_id""",
)
def burned_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether subtitles are burned in: frames are the turns, and what users say is read on them."""
    q = V.cues(spark, sf_dir).select("film_id", F.col("start").alias("time"), F.when(F.col("style") == "user", F.col("text")).alias("text"), (F.col("ord") % 10 / 10).alias("confidence"))
    line = F.array_join(F.transform("examples", lambda x: F.concat_ws(" ", F.bround(x["time"], 1).cast("string"), x["confidence"].cast("string"))), ",")
    return speech.burned_in(q, ["film_id"]).select("film_id", "samples", "hits", "detected", line.alias("examples"))


@register(
    "heard_samples",
    f"""WITH {PCM_SQL}, b AS (SELECT film_id, round_even(bin * 0.25::DOUBLE, 3) AS t, round_even(e, 4) AS e FROM v_bins), s AS (SELECT film_id, n, (n % 40) * 0.9::DOUBLE AS t FROM v_samples WHERE n <= 120),
    p AS (SELECT s.film_id, s.n, b.e, abs(b.t - s.t) AS d, b.t AS bt FROM s JOIN b USING (film_id)),
    w AS (SELECT film_id, n, max(e) FILTER (d <= 0.5) AS near, arg_min(e, d * 1000000 + bt) AS one, list_sort(list(e) FILTER (d <= 2)) AS x FROM p GROUP BY film_id, n),
    v AS (SELECT *, coalesce(near, one) AS peak, CASE WHEN len(coalesce(x, [])) > 0 THEN x ELSE [one] END AS y FROM w),
    m AS (SELECT *, y[CAST(floor((len(y) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS mid, y[CAST(floor((len(y) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS high FROM v)
    SELECT film_id, n, round_even(least(1.0::DOUBLE, peak), 4) AS audio_level, CASE WHEN least(1.0::DOUBLE, peak) >= 0.12::DOUBLE THEN round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (peak - mid) / greatest(0.08::DOUBLE, high - mid))), 4) ELSE 0.0::DOUBLE END AS audio_event FROM m""",
)
def heard_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sound at each of some times stands out, the nearest bin where none is near."""
    s = V.samples(spark, sf_dir).filter("n <= 120").select("film_id", F.col("n").alias("at"), (F.col("n") % 40 * F.lit(0.9)).alias("t"))
    return speech.heard_samples(s, sound(spark, sf_dir)).select("film_id", F.col("at").alias("n"), "audio_level", "audio_event")


_PROBE = """'{"format": {"duration": "' || (o_orderkey % 900) || '.5", "size": "' || (o_orderkey * 1000) || '", "format_name": "matroska"}, "streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1280}, {"index": 1, "codec_type": "subtitle", "codec_name": "ass"}]}'"""


def _json(parts: list) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _probe() -> Column:
    k = F.col("o_orderkey")
    return _json(['{"format": {"duration": "', (k % 900).cast("string"), '.5", "size": "', (k * 1000).cast("string"), '", "format_name": "matroska"}, "streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1280}, {"index": 1, "codec_type": "subtitle", "codec_name": "ass"}]}'])


@register("probe_container", "SELECT o_orderkey, o_orderkey % 900 + 0.5::DOUBLE AS duration, o_orderkey * 1000 AS size, 2::BIGINT AS streams, CASE WHEN o_orderkey * 1000 < 1048576 THEN 'the video is small, as an incomplete download is' END AS problem FROM orders")
def probe_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a container probe says of each film, and whether it can be read."""
    d = V.table(spark, sf_dir, "orders").select("o_orderkey", probes.container(_probe()).alias("p"))
    return d.select("o_orderkey", "p.duration", "p.size", F.size("p.streams").cast("long").alias("streams"), probes.video_problem(F.col("p.size"), F.col("p.duration")).alias("problem"))


@register("probe_subtitles", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS streams, CASE WHEN o_orderkey % 3 <> 0 THEN 'und' END AS lang, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 = 0 END AS commentary, CASE WHEN o_orderkey % 3 <> 0 THEN true END AS is_default FROM orders")
def probe_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream probe says; every third one isn't JSON and has no streams."""
    k = F.col("o_orderkey")
    text = _json(['{"streams": [{"index": 2, "codec_name": "SubRip", "tags": {"title": "', F.when(k % 2 == 0, "Signs & Songs").otherwise("Full"), '"}, "disposition": {"default": 1}}, {"index": 3, "codec_name": "ass", "tags": {"language": "de"}}]}'])
    d = V.table(spark, sf_dir, "orders").select("o_orderkey", probes.subtitle_streams(F.when(k % 3 == 0, "{oops").otherwise(text)).alias("s"))
    first = F.get("s", F.lit(0))
    return d.select("o_orderkey", F.size("s").cast("long").alias("streams"), first["lang"].alias("lang"), first["commentary"].alias("commentary"), first["is_default"].alias("is_default"))


@register("probe_remote", "SELECT page_id, 'T' || page_id AS title, url AS webpage_url, page_id % 60 + 0.25::DOUBLE AS duration, 'de,en' AS manual, CASE WHEN page_id % 2 = 0 THEN 'fr' ELSE '' END AS automatic FROM pages")
def probe_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of addresses, and the tracks they offer."""
    k = F.col("page_id")
    text = _json(['{"id": "x", "title": "T', k.cast("string"), '", "webpage_url": "', F.col("url"), '", "duration": ', (k % 60).cast("string"), '.25, "subtitles": {"en": [{"ext": "vtt"}], "de": []}, "automatic_captions": {', F.when(k % 2 == 0, '"fr": []').otherwise(""), "}}"])
    m = V.table(spark, sf_dir, "pages").select(k.alias("key"), probes.remote(text).alias("meta"))
    named = lambda auto: F.array_join(F.array_sort(F.collect_list(F.when(F.col("automatic") == auto, F.col("lang")))), ",")
    t = probes.remote_tracks(m).groupBy("key").agg(named(False).alias("manual"), named(True).alias("automatic"))
    return m.select(F.col("key").alias("page_id"), "key", "meta.title", "meta.webpage_url", "meta.duration").join(t, "key").drop("key")


@register("cached_sources", "SELECT page_id, '/v/' || page_id || '.mkv' AS video_path, CASE WHEN page_id % 4 = 1 THEN '/v/' || page_id || '.srt' END AS subtitle_path, page_id::VARCHAR AS title FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 AND (page_id % 4 <> 1 OR page_id % 7 <> 0)")
def cached_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a record serves: those whose source is the same and whose files are there."""
    p = V.table(spark, sf_dir, "pages").select("page_id", "url")
    k, name = F.col("page_id"), lambda end: F.concat(F.lit("/v/"), F.col("page_id").cast("string"), F.lit(end))
    line = probes.record_line(F.when(k % 3 == 0, "another").otherwise(F.col("url")), name(".mkv"), F.when(k % 4 == 1, name(".srt")), F.lit(""), F.create_map(F.lit("kind"), F.lit("url")), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    known = probes.records(p.select(k.cast("string").alias("path"), F.when(k % 11 == 0, F.concat(line, F.lit(" "))).otherwise(line).alias("value")))
    files = p.filter(k % 5 != 0).select(name(".mkv").alias("path")).unionByName(p.filter(k % 7 != 0).select(name(".srt").alias("path")))
    got = probes.cached(p.select(k.cast("string").alias("path"), F.col("url").alias("source")), known, files)
    return got.select(F.col("path").cast("long").alias("page_id"), "video_path", "subtitle_path", "title")


_FILES = "SELECT doc_id // 10 AS film, doc_id % 10 = 3 AND n_chars % 2 = 0 AS stem_match, lang, '.srt' AS ext, source || '-' || doc_id AS name, doc_id FROM documents"


@register(
    "local_sources",
    f"""WITH f AS ({_FILES}), v AS (SELECT DISTINCT film FROM f), s AS (SELECT film, name FROM f WHERE stem_match), i AS (SELECT film, min(doc_id) AS idx FROM f WHERE film % 3 = 0 AND lang = 'en' GROUP BY film), j AS (SELECT film, coalesce(i.idx, (SELECT min(doc_id) FROM f WHERE f.film = v.film)) AS idx FROM v LEFT JOIN i USING (film) WHERE film % 3 = 0)
    SELECT film, CASE WHEN film % 5 = 0 THEN 'explicit' WHEN s.name IS NOT NULL THEN 'sidecar' WHEN j.idx IS NOT NULL THEN 'embedded' END AS kind, CASE WHEN film % 5 = 0 THEN 'mine.srt' ELSE s.name END AS subtitle, CASE WHEN film % 5 <> 0 AND s.name IS NULL THEN j.idx END AS stream, 'Film ' || film AS title
    FROM v LEFT JOIN s USING (film) LEFT JOIN j USING (film)""",
)
def local_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitle each local film gets: the one named, else a file beside it, else a stream in it."""
    d = V.table(spark, sf_dir, "documents").withColumn("film", F.floor(F.col("doc_id") / 10))
    side = d.select("film", ((F.col("doc_id") % 10 == 3) & (F.col("n_chars") % 2 == 0)).alias("stem_match"), F.lit(False).alias("only_one"), "lang", F.lit(".srt").alias("ext"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"))
    inner = d.filter("film % 3 = 0").select("film", F.col("doc_id").alias("index"), F.lit("subrip").alias("codec"), "lang", *(F.lit(False).alias(c) for c in ("commentary", "is_default", "forced")))
    videos = d.select("film").distinct().withColumn("video", F.concat(F.lit("/films/Film "), F.col("film").cast("string"), F.lit(".mkv"))).withColumn("explicit", F.when(F.col("film") % 5 == 0, "mine.srt"))
    return probes.prepared(videos, side, inner, ("en",))


_NOW = "TIMESTAMP '1998-08-02 00:00:00'"


@register(
    "cache_cleanup",
    f"""WITH e AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'local' ELSE 'url' END AS kind, o_orderkey % 7 = 0 AS run, o_orderdate::TIMESTAMP AS last, CASE WHEN o_orderkey % 5 = 0 THEN {_NOW} END AS again, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(round_even(o_totalprice, 0) AS BIGINT) END AS bytes FROM orders)
    SELECT key, CASE WHEN again IS NOT NULL THEN 'recently-reactivated' WHEN run THEN 'generation-running' END AS reason, CASE WHEN again IS NOT NULL OR run THEN 'skipped' ELSE 'would-delete' END AS action, CASE WHEN again IS NOT NULL OR run THEN 0 ELSE bytes END AS freed
    FROM e WHERE kind = 'url' AND bytes IS NOT NULL AND epoch_us({_NOW}) - epoch_us(last) >= 86400000000""",
)
def cache_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run of a sweep says of each entry."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("timestamp")
    now = F.lit("1998-08-02 00:00:00").cast("timestamp")
    o = V.table(spark, sf_dir, "orders")
    jobs = o.select(k.alias("path"), F.when(k % 7 == 0, "Running").otherwise("complete").alias("status"), k.alias("pid"))
    alive = o.select(k.alias("pid"))
    e = o.select(k.alias("path"), F.when(k % 3 == 0, "local").otherwise("url").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("last_access"), none.alias("prepared"), none.alias("modified"), F.when(k % 5 == 0, now).alias("last_access_now"), F.when(k % 11 != 0, F.bround("o_totalprice", 0).cast("long")).alias("bytes"))
    return retention.cleanup(e.join(retention.running(jobs, alive).select("path", "running"), "path"), now, 86400.0, True).withColumnRenamed("path", "key")


@register("cache_folders", "SELECT DISTINCT 'f' || c_custkey AS path FROM customer WHERE c_custkey % 9 = 0 OR (c_custkey % 2 = 0 AND (c_custkey % 13 = 0 OR c_nationkey IN (3, 5)))")
def cache_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders to look at: registered ones, roots with a record, and children of roots with one."""
    c, name = V.table(spark, sf_dir, "customer"), lambda x: F.concat(F.lit("f"), x.cast("string"))
    k = F.col("c_custkey")
    folders = c.select(name(k).alias("path"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), (k % 2 == 0).alias("has_record"))
    roots = c.filter(k % 13 == 0).select(name(k).alias("path")).unionByName(c.sparkSession.createDataFrame([("n3",), ("n5",)], "path string"))
    return retention.candidates(c.filter(k % 9 == 0).select(name(k).alias("path")), folders, roots)


@register("recent_entries", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS p FROM orders) WHERE p <= 20")
def recent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.newest(V.table(spark, sf_dir, "orders"), "o_totalprice", 20, ["o_custkey"]).select("o_custkey", "o_orderkey")


def shelf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sheets and notes: chunks of ten seconds of each conversation, and a note for every third turn, with a reply to every second of these."""
    q = V.cues(spark, sf_dir)
    idx = F.floor(F.col("start") / 10).cast("long")
    key = F.struct(F.format_string("K%d", F.col("ord")).alias("id"), F.col("start").alias("time"), F.lit(1.0).alias("score"), F.lit("gap-coverage").alias("reason"), F.lit(None).cast("double").alias("event_time"), F.struct(F.when(F.col("ord") % 2 == 0, F.col("style")).alias("text")).alias("subtitle_anchor"))
    s = q.groupBy("film_id", idx.alias("index")).agg(F.sort_array(F.collect_list(F.struct("ord", key.alias("k")))).alias("k"), F.count("*").alias("subtitle_count"))
    pos = F.row_number().over(Window.partitionBy("film_id").orderBy("index")) - 1
    s = s.select("film_id", F.lit("T").alias("title"), "index", (F.col("index") * 10.0).alias("from"), (F.col("index") * 10.0 + 10).alias("to"), F.lit(10.0).alias("duration"), F.transform("k", lambda x: x["k"]).alias("keyframes"), "subtitle_count", F.concat(F.lit("side "), F.col("index").cast("string")).alias("sidecar"), pos.cast("long").alias("pos"))
    reply = F.when(F.col("ord") % 2 == 0, F.array(F.struct(F.lit("R1").alias("id"), F.lit("a").alias("author"), F.lit("yes").alias("text"), F.lit("").alias("created_at")))).otherwise(F.array().cast("array<struct<id:string,author:string,text:string,created_at:string>>"))
    n = q.filter("ord % 3 = 0").select("film_id", F.col("ord").alias("place"), F.format_string("N%d", F.col("ord")).alias("id"), idx.alias("chunk_index"), C.show(F.col("start")).alias("timecode"), F.lit("observation").alias("kind"), F.col("style").alias("text"), reply.alias("replies"))
    return s, n


_CLOCK = lambda x: f"printf('%d:%02d', CAST({x} AS BIGINT) // 60, CAST({x} AS BIGINT) % 60)"


@register(
    "chunk_packets",
    f"""WITH {V.CUES_SQL}, q AS (SELECT *, CAST(floor(start / 10) AS BIGINT) AS idx FROM v_cues), s AS (SELECT film_id, idx, string_agg('K' || ord || ' ' || {_CLOCK('start')} || CASE WHEN ord % 2 = 0 THEN ' "' || style || '"' ELSE '' END, ' | ' ORDER BY ord) AS keys FROM q GROUP BY film_id, idx),
    p AS (SELECT *, row_number() OVER w - 1 AS pos, lead(idx) OVER w AS follows, count(*) OVER (PARTITION BY film_id) AS n FROM s WINDOW w AS (PARTITION BY film_id ORDER BY idx)),
    n AS (SELECT film_id, idx, string_agg('N' || ord || ' ' || {_CLOCK('start')} || ' observation: ' || style || CASE WHEN ord % 2 = 0 THEN chr(10) || '  reply R1: yes' ELSE '' END, chr(10) ORDER BY ord) AS notes FROM q WHERE ord % 3 = 0 GROUP BY film_id, idx)
    SELECT p.film_id, pos, sha256('[chunk]' || chr(10) || 'title: T' || chr(10) || 'chunk: ' || printf('%03d/%03d', p.idx, greatest(0, p.n - 1)) || chr(10) || 'time: ' || {_CLOCK('p.idx * 10')} || '-' || {_CLOCK('p.idx * 10 + 10')} || chr(10) || 'duration_seconds: 10.0' || chr(10) || 'keyframes: ' || keys || chr(10)
      || CASE WHEN follows IS NOT NULL THEN 'next: chunk ' || printf('%03d ', follows) || {_CLOCK('follows * 10')} || '-' || {_CLOCK('follows * 10 + 10')} WHEN p.film_id % 2 = 0 THEN 'next: waiting for the next generated sheet' ELSE 'next: end of available generated sheets' END
      || chr(10) || chr(10) || '[notes]' || chr(10) || coalesce(notes || chr(10), '') || '[/notes]' || chr(10) || chr(10) || 'side ' || p.idx || chr(10) || '[/chunk]') AS digest
    FROM p LEFT JOIN n ON n.film_id = p.film_id AND n.idx = p.idx""",
)
def chunk_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader gets of each chunk; every other film is still being generated."""
    s, n = shelf(spark, sf_dir)
    return L.packets(s.withColumn("running", F.col("film_id") % 2 == 0), n).select("film_id", "pos", F.sha2("packet", 256).alias("digest"))


@register("notes_written", f"WITH {V.CUES_SQL} SELECT film_id, CAST(floor(start / 10) AS BIGINT) AS chunk_index, CAST(floor(start / 10) AS BIGINT) * 10.0::DOUBLE AS a, CASE WHEN ord % 3 = 0 THEN start END AS time_seconds, style AS text, 'user' AS author FROM v_cues")
def notes_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for every turn, put to its chunk."""
    s, _ = shelf(spark, sf_dir)
    asked = V.cues(spark, sf_dir).select("film_id", F.floor(F.col("start") / 10).cast("long").alias("chunk_index"), F.concat(F.lit("  "), F.col("style"), F.lit(" ")).alias("text"), F.when(F.col("ord") % 3 == 0, C.show(F.col("start"))).when(F.col("ord") % 3 == 1, "soon").alias("timecode"), F.lit("user").alias("author"), F.lit("2024-01-01").alias("created_at"))
    return L.new_notes(asked, s).select("film_id", "chunk_index", F.col("chunk_time_range")[0].alias("a"), "time_seconds", "text", "author")


@register("job_reports", "SELECT o_custkey % 50 AS film_id, count(*) AS available, CASE WHEN (o_custkey % 50) % 4 = 0 THEN 'waiting' ELSE 'end' END AS kind, CASE (o_custkey % 50) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'stopped' WHEN 2 THEN 'complete' ELSE 'manifest-available' END AS status FROM orders GROUP BY o_custkey % 50")
def job_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far generation is, and what a reader past the last chunk is told."""
    o = V.table(spark, sf_dir, "orders").withColumn("film_id", F.col("o_custkey") % 50)
    k = F.col("film_id") % 4
    made = o.select("film_id", F.col("o_orderkey").alias("index"))
    jobs = o.select("film_id").distinct().filter(k != 3).select("film_id", F.when(k == 2, "complete").otherwise("running").alias("status"), F.lit(None).cast("string").alias("phase"), F.col("film_id").alias("pid"), F.lit("a\nb").alias("log"))
    alive = o.filter(k == 0).select(F.col("film_id").alias("pid")).distinct()
    return L.job_report(jobs, alive, made).select("film_id", "available", "kind", "status")
