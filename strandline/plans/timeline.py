"""Queries over timelines: change, cuts, events, colours, joins of cues and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandline.functions import text as X, timecode as C
from strandline.operators import folds, intervals as I, scoring as S, selection, speech
from strandline.options import Options
from strandline.plans.catalogue import register
from strandline.sources import subtitles, views as V

O = Options()
CHANGE = V.FRAMES_SQL + """,
v_change AS (SELECT * FROM v_frames)
"""


def _limit(name: str, sensitivity: float) -> str:
    q = lambda p: f"list_sort(list(change) FILTER (n > 1))[CAST(floor((count(*) FILTER (n > 1) - 1) * {p}::DOUBLE) AS BIGINT) + 1]"
    return f"{name} AS (SELECT film_id, CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'infinity'::DOUBLE ELSE least({q(0.9)}, {q(0.5)} + greatest(1.0::DOUBLE, {q(0.75)} - {q(0.5)}) * {sensitivity}::DOUBLE) END AS threshold FROM v_change GROUP BY film_id)"


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_change(V.frames(spark, sf_dir))


@register("change_signal", f"WITH {CHANGE} SELECT film_id, n, round_even(change, 6) AS change FROM v_change")
def change_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir).select("film_id", "n", F.bround("change", 6).alias("change"))


@register("change_threshold", f"WITH {CHANGE}, {_limit('lim', 1.35)} SELECT film_id, round_even(threshold, 6) AS threshold FROM lim")
def change_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.thresholds(changed(spark, sf_dir), O.visual_sensitivity).select("film_id", F.bround("threshold", 6).alias("threshold"))


_CUTS = f"""
WITH RECURSIVE {CHANGE}, {_limit('lim', 1.35)},
e AS (SELECT film_id, min(t) AS ea, max(t) AS eb FROM v_change GROUP BY film_id),
c AS (SELECT film_id, t, change, row_number() OVER (PARTITION BY film_id ORDER BY n) AS k FROM v_change JOIN lim USING (film_id) JOIN e USING (film_id)
      WHERE n > 1 AND change >= threshold AND t - ea >= 4 AND eb - t >= 4),
r(film_id, k, i, t, change) AS (SELECT DISTINCT film_id, 0::BIGINT, 0::BIGINT, -1e9::DOUBLE, -1e9::DOUBLE FROM c
    UNION ALL SELECT c.film_id, c.k, CASE WHEN c.t - r.t < 4 THEN r.i ELSE r.i + 1 END,
        CASE WHEN c.t - r.t < 4 AND c.change <= r.change THEN r.t ELSE c.t END, CASE WHEN c.t - r.t < 4 AND c.change <= r.change THEN r.change ELSE c.change END
    FROM r JOIN c ON c.film_id = r.film_id AND c.k = r.k + 1)
SELECT film_id, i AS cut, round_even(arg_max(t, k), 6) AS t, round_even(arg_max(change, k), 6) AS change FROM r WHERE i > 0 GROUP BY film_id, i
"""


@register("cut_points", _CUTS)
def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of every film: changes over the film's threshold, away from its ends, the stronger of close ones."""
    c = changed(spark, sf_dir)
    w = Window.partitionBy("film_id")
    c = c.withColumn("a", F.min("t").over(w)).withColumn("b", F.max("t").over(w)).join(S.thresholds(c, O.visual_sensitivity), "film_id")
    edge = (F.col("t") - F.col("a") >= O.min_segment) & (F.col("b") - F.col("t") >= O.min_segment)
    hits = c.filter((F.col("n") > 1) & (F.col("change") >= F.col("threshold")) & edge)
    kept = hits.groupBy("film_id").agg(folds.spaced(F.sort_array(F.collect_list(F.struct("n", "t", "change"))), max(2.0, O.min_segment), "change").alias("k"))
    return kept.select("film_id", F.posexplode("k").alias("p", "x")).select("film_id", (F.col("p") + 1).cast("long").alias("cut"), F.bround("x.t", 6).alias("t"), F.bround("x.change", 6).alias("change"))


_MICRO = f"""
WITH RECURSIVE {CHANGE}, {_limit('lim', 1.6)},
c AS (SELECT film_id, t, least(1.4::DOUBLE, change / greatest(1.0::DOUBLE, threshold)) AS score, row_number() OVER (PARTITION BY film_id ORDER BY n) AS k FROM v_change JOIN lim USING (film_id) WHERE n > 1 AND change >= threshold),
r(film_id, k, i, t, score) AS (SELECT DISTINCT film_id, 0::BIGINT, 0::BIGINT, -1e9::DOUBLE, -1e9::DOUBLE FROM c
    UNION ALL SELECT c.film_id, c.k, CASE WHEN c.t - r.t < 2 THEN r.i ELSE r.i + 1 END,
        CASE WHEN c.t - r.t < 2 AND c.score <= r.score THEN r.t ELSE c.t END, CASE WHEN c.t - r.t < 2 AND c.score <= r.score THEN r.score ELSE c.score END
    FROM r JOIN c ON c.film_id = r.film_id AND c.k = r.k + 1)
SELECT film_id, i AS event, round_even(arg_max(t, k), 6) AS t, round_even(arg_max(score, k), 6) AS score FROM r WHERE i > 0 GROUP BY film_id, i
"""


@register("micro_events", _MICRO)
def micro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short events of every film, scored against its threshold, the higher of close ones."""
    c = changed(spark, sf_dir).join(S.thresholds(changed(spark, sf_dir), O.micro_sensitivity), "film_id")
    score = S.clamp(F.col("change") / F.greatest(F.lit(1.0), F.col("threshold")), 0.0, 1.4)
    hits = c.filter((F.col("n") > 1) & (F.col("change") >= F.col("threshold"))).select("film_id", "n", "t", score.alias("score"))
    kept = hits.groupBy("film_id").agg(folds.spaced(F.sort_array(F.collect_list(F.struct("n", "t", "score"))), O.min_micro_gap, "score").alias("k"))
    return kept.select("film_id", F.posexplode("k").alias("p", "x")).select("film_id", (F.col("p") + 1).cast("long").alias("event"), F.bround("x.t", 6).alias("t"), F.bround("x.score", 6).alias("score"))


_NMS = f"""
WITH RECURSIVE {CHANGE},
c AS (SELECT film_id, t, change, row_number() OVER (PARTITION BY film_id ORDER BY change DESC, n) AS k FROM v_change),
r(film_id, k, kept) AS (SELECT DISTINCT film_id, 0::BIGINT, []::DOUBLE[] FROM c
    UNION ALL SELECT c.film_id, c.k, CASE WHEN len(kept) >= 16 OR len(list_filter(kept, lambda y: abs(y - c.t) < 2)) > 0 THEN kept ELSE list_append(kept, c.t) END FROM r JOIN c ON c.film_id = r.film_id AND c.k = r.k + 1)
SELECT film_id, round_even(unnest(arg_max(kept, k)), 6) AS t FROM r GROUP BY film_id
"""


@register("nms_dedupe", _NMS)
def nms_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest changes of every film, none within a gap of another."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("change")).alias("rank"), "n", "t")))
    kept = changed(spark, sf_dir).groupBy("film_id").agg(folds.suppressed(ranked, max(1.0, O.min_micro_gap), O.max_keyframes).alias("k"))
    return kept.select("film_id", F.explode("k").alias("x")).select("film_id", F.bround("x.t", 6).alias("t"))


def _clamp(x: str, hi: str = "1.0") -> str:
    return f"greatest(0.0::DOUBLE, least({hi}::DOUBLE, {x}))"


QUALITY_SQL = f"""
v_parts AS (SELECT *, {_clamp('contrast / 0.16::DOUBLE')} AS qc, {_clamp('edge / 0.12::DOUBLE')} AS qe, {_clamp('saturation / 0.35::DOUBLE')} AS qs,
    least({_clamp('(luma - 0.035::DOUBLE) / 0.18::DOUBLE')}, {_clamp('(0.97::DOUBLE - luma) / 0.18::DOUBLE')}) AS ql FROM v_samples),
v_quality AS (SELECT *, {_clamp("(CASE WHEN luma < 0.18::DOUBLE THEN greatest(ql, greatest(qc, qe) * 0.55::DOUBLE + qs * 0.2::DOUBLE) WHEN luma > 0.82::DOUBLE THEN greatest(ql, greatest(qc, qe) * 0.45::DOUBLE) ELSE ql END) * 0.4::DOUBLE + qc * 0.25::DOUBLE + qe * 0.25::DOUBLE + qs * 0.1::DOUBLE")} AS quality,
    contrast < 0.025::DOUBLE AND edge < 0.02::DOUBLE AND ((luma < 0.035::DOUBLE AND saturation < 0.08::DOUBLE) OR luma > 0.97::DOUBLE) AS low FROM v_parts)
"""


@register("frame_quality", f"WITH {V.SAMPLES_SQL}, {QUALITY_SQL} SELECT film_id, n, round_even(quality, 9) AS quality, low FROM v_quality")
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.samples(spark, sf_dir).select("film_id", "n", F.bround(S.quality(), 9).alias("quality"), S.low_information().alias("low"))


@register("useful_frames", f"WITH {V.SAMPLES_SQL}, {QUALITY_SQL} SELECT film_id, count(*) AS frames FROM (SELECT *, bool_and(low) OVER (PARTITION BY film_id) AS all_low FROM v_quality) WHERE NOT low OR all_low GROUP BY film_id")
def useful_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.samples(spark, sf_dir).withColumn("low", S.low_information())
    return S.useful_else_all(rows, "low", "film_id").groupBy("film_id").agg(F.count("*").alias("frames"))


_SIDE = "sqrt({})".format(" + ".join(f"pow({c} - round_even(avg({c}) OVER {{0}}, 0), 2)" for c in "rgb"))


@register(
    "color_island",
    f"""WITH {V.TILES_SQL}, x AS (SELECT *, count(*) OVER (PARTITION BY film_id) AS c, {_SIDE.format('p')} AS before, {_SIDE.format('q')} AS after FROM v_mean
    WINDOW p AS (PARTITION BY film_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY film_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
    SELECT film_id, n, CASE WHEN n > 2 AND n <= c - 2 THEN round_even(least(before, after), 6) ELSE 0.0::DOUBLE END AS island FROM x""",
)
def color_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.color_island(V.tiles(spark, sf_dir)).select("film_id", "n", F.bround("island", 6).alias("island"))


_PAIRS = f"""WITH {V.TILES_SQL}, x AS (SELECT a.film_id, a.n, a.i, sqrt(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) AS d, abs(a.luma - b.luma) AS l FROM v_tile a JOIN v_tile b ON a.film_id = b.film_id AND a.n = b.n + 1 AND a.i = b.i)"""


@register("regional_change", f"{_PAIRS} SELECT film_id, n, round_even(max(d) * 0.7::DOUBLE + sum(d) / 16 * 0.25::DOUBLE + max(l) * 120, 6) AS regional FROM x GROUP BY film_id, n")
def regional_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tiles(spark, sf_dir).withColumn("before", F.lag("tiles").over(Window.partitionBy("film_id").orderBy("n")))
    return t.filter("before is not null").select("film_id", "n", F.bround(S.regional_change(F.col("tiles"), F.col("before")), 6).alias("regional"))


_TILE_STEPS = [f"sqrt(pow({V._PREV[i][0]} - {V._WAS[i][0]}, 2) + pow(g - lag(g) OVER w, 2) + pow({V._PREV[i][1]} - {V._WAS[i][1]}, 2)) / 255" for i in range(4)]


@register(
    "visual_distance",
    f"""WITH {V.FRAMES_SQL}, x AS (SELECT film_id, n, 0.35::DOUBLE * sqrt(pow(r - lag(r) OVER w, 2) + pow(g - lag(g) OVER w, 2) + pow(b - lag(b) OVER w, 2)) / 255 + 0.42::DOUBLE * ({" + ".join(_TILE_STEPS)}) / 4 + 0.12::DOUBLE * greatest({", ".join(_TILE_STEPS)})
      + 0.06::DOUBLE * abs(luma - lag(luma) OVER w) + 0.03::DOUBLE * abs(contrast - lag(contrast) OVER w) + 0.02::DOUBLE * abs(edge - lag(edge) OVER w) AS d FROM v_frame WINDOW w AS (PARTITION BY film_id ORDER BY n))
    SELECT film_id, n, round_even(d, 6) AS distance FROM x WHERE n > 1""",
)
def visual_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = F.struct("r", "g", "b", "luma", "contrast", "edge", "tiles")
    t = V.frames(spark, sf_dir).withColumn("now", look).withColumn("was", F.lag("now").over(Window.partitionBy("film_id").orderBy("n")))
    return t.filter("was is not null").select("film_id", "n", F.bround(S.visual_distance(F.col("now"), F.col("was")), 6).alias("distance"))


@register(
    "post_event_pick",
    f"""{_MICRO.strip().rsplit('SELECT film_id, i AS event', 1)[0].replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}, {QUALITY_SQL},
    ev AS (SELECT film_id, i AS event, arg_max(t, k) AS t FROM r WHERE i > 0 GROUP BY film_id, i),
    c2 AS (SELECT ev.film_id, event, s.n, s.t, round_even(0.62::DOUBLE * quality - 0.12::DOUBLE * ((s.t - ev.t) / 2), 9) AS score FROM ev JOIN v_quality s ON s.film_id = ev.film_id AND s.t >= ev.t - 0.001::DOUBLE AND s.t <= ev.t + 2 + 0.001::DOUBLE)
    SELECT film_id, event, round_even(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY film_id, event ORDER BY score DESC, n) AS p FROM c2) WHERE p = 1""",
)
def post_event_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best frame within the lookahead of each event."""
    c = changed(spark, sf_dir).join(S.thresholds(changed(spark, sf_dir), O.micro_sensitivity), "film_id")
    score = S.clamp(F.col("change") / F.greatest(F.lit(1.0), F.col("threshold")), 0.0, 1.4)
    hits = c.filter((F.col("n") > 1) & (F.col("change") >= F.col("threshold"))).select("film_id", "n", "t", score.alias("score"))
    kept = hits.groupBy("film_id").agg(folds.spaced(F.sort_array(F.collect_list(F.struct("n", "t", "score"))), O.min_micro_gap, "score").alias("k"))
    events = kept.select("film_id", F.posexplode("k").alias("p", "x")).select("film_id", (F.col("p") + 1).cast("long").alias("event"), F.col("x.t").alias("et"), (F.col("x.t") - 0.001).alias("a"), (F.col("x.t") + O.micro_lookahead + 0.001).alias("z"))
    s = V.samples(spark, sf_dir).withColumn("quality", S.quality()).withColumn("t2", F.col("t"))
    met = I.overlap_join(s, events, ["film_id"], ("t", "t2"), ("a", "z"), 4.0)
    worth = F.bround(0.62 * F.col("quality") - 0.12 * ((F.col("t") - F.col("et")) / 2), 9)
    return met.groupBy("film_id", "event").agg(F.min_by("t", F.struct((-worth).alias("w"), "n")).alias("t")).select("film_id", "event", F.bround("t", 6).alias("t"))


_ENDS = f"v_ends AS (SELECT film_id, min(t) - 30 AS a, max(t) + 30 AS z FROM v_samples GROUP BY film_id)"


@register(
    "gap_anchors",
    f"""WITH {V.SAMPLES_SQL}, {_ENDS}, p AS (SELECT film_id, n, t FROM v_samples UNION ALL SELECT film_id, 0, a FROM v_ends UNION ALL SELECT s.film_id, max(n) + 1, any_value(z) FROM v_samples s JOIN v_ends USING (film_id) GROUP BY s.film_id),
    g AS (SELECT film_id, n, t, lead(t) OVER (PARTITION BY film_id ORDER BY n) AS u FROM p)
    SELECT film_id, n, round_even(u - t, 6) AS gap, greatest(1, CAST(ceil((u - t) / 20::DOUBLE) AS BIGINT) - 1) AS slots FROM g WHERE u - t > 20""",
)
def gap_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps over 20 between neighbours, the ends of the film (30 beyond its samples) among them."""
    s = V.samples(spark, sf_dir).select("film_id", "n", "t")
    return I.gaps(s, ends(s), 20.0).select("film_id", "n", F.bround("gap", 6).alias("gap"), "slots")


def ends(samples: DataFrame) -> DataFrame:
    """Films that begin 30 before their first sample and end 30 after their last."""
    return samples.groupBy("film_id").agg((F.min("t") - 30).alias("from"), (F.max("t") + 30).alias("to"))


@register(
    "boundary_gaps",
    f"WITH {V.SAMPLES_SQL}, {_ENDS} SELECT film_id, round_even(min(t) - any_value(a), 6) AS first_gap, round_even(any_value(z) - max(t), 6) AS last_gap, min(t) - any_value(a) > 24 OR any_value(z) - max(t) > 24 AS wide FROM v_samples JOIN v_ends USING (film_id) GROUP BY film_id",
)
def boundary_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.samples(spark, sf_dir)
    first, last = F.min("t") - F.first("from"), F.first("to") - F.max("t")
    return s.join(ends(s), "film_id").groupBy("film_id").agg(F.bround(first, 6).alias("first_gap"), F.bround(last, 6).alias("last_gap"), ((first > O.boundary_gap) | (last > O.boundary_gap)).alias("wide"))


CHUNKS_SQL = 'v_chunks AS (SELECT film_id, idx, idx * 10.0::DOUBLE AS "from", idx * 10.0::DOUBLE + 10 AS "to" FROM (SELECT film_id, unnest(range(0, CAST(floor(max("end") / 10) AS BIGINT) + 1)) AS idx FROM v_cues GROUP BY film_id))'


def chunks(cues: DataFrame) -> DataFrame:
    """Tumbling chunks of ten seconds over each film's cues."""
    c = cues.groupBy("film_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.max("end") / 10).cast("long"))).alias("idx"))
    return c.select("film_id", "idx", (F.col("idx") * F.lit(10.0)).alias("from"), (F.col("idx") * F.lit(10.0) + 10).alias("to"))


@register("cue_overlap_chunks", f'WITH {V.CUES_SQL}, {CHUNKS_SQL} SELECT c.film_id, idx, ord FROM v_chunks c JOIN v_cues q ON q.film_id = c.film_id AND q."end" >= "from" AND q.start <= "to"')
def cue_overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    return I.overlap_join(chunks(q), q, ["film_id"], ("from", "to"), ("start", "end"), 10.0).select("film_id", "idx", "ord")


@register("chunk_counts", f'WITH {V.CUES_SQL}, {CHUNKS_SQL} SELECT c.film_id, idx, count(ord) AS cues, count(*) FILTER (style = \'user\') AS user_cues FROM v_chunks c LEFT JOIN v_cues q ON q.film_id = c.film_id AND q."end" >= "from" AND q.start <= "to" GROUP BY c.film_id, idx')
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    c = chunks(q)
    met = I.overlap_join(c, q, ["film_id"], ("from", "to"), ("start", "end"), 10.0).groupBy("film_id", "idx").agg(F.count("*").alias("k"), F.count_if(F.col("style") == "user").alias("u"))
    return c.join(met, ["film_id", "idx"], "left").select("film_id", "idx", F.coalesce("k", F.lit(0)).alias("cues"), F.coalesce("u", F.lit(0)).alias("user_cues"))


TIMES_SQL = "v_times AS (SELECT film_id, probe, probe * 3.7::DOUBLE AS t FROM (SELECT film_id, unnest(range(0, 12)) AS probe FROM (SELECT DISTINCT film_id FROM v_cues)))"


def times(cues: DataFrame) -> DataFrame:
    """Twelve times a film, 3.7 seconds apart."""
    t = cues.select("film_id").distinct().withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return t.withColumn("t", F.col("at") * F.lit(3.7))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\{{[^}}]*\}}', '', 'g'), '\\[Nnh]', ' ', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
OPENING = "CASE WHEN {0} = '' THEN '' ELSE regexp_replace(CASE WHEN NOT regexp_matches({0}, '[㐀-鿿]') AND contains({0}, ' ') THEN array_to_string(string_split({0}, ' ')[1:6], ' ') ELSE substr({0}, 1, 24) END, '[,.!?;:，。！？；：]+$', '') || '...' END"
_FAR = 'CASE WHEN t >= start AND t <= "end" THEN 0.0::DOUBLE ELSE least(abs(t - start), abs(t - "end")) END'


@register(
    "cue_anchor",
    f"""WITH {V.CUES_SQL}, {TIMES_SQL}, x AS (SELECT v.film_id, probe, ord, {_FAR} AS d, text FROM v_times v JOIN v_cues q USING (film_id)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY film_id, probe ORDER BY d, ord) AS p FROM x WHERE d <= 6) WHERE p = 1)
    SELECT v.film_id, v.probe, b.ord, round_even(b.d, 6) AS distance, CASE WHEN b.ord IS NOT NULL THEN {OPENING.format(CLEAN.format("coalesce(b.text, '')"))} END AS opening
    FROM v_times v LEFT JOIN b USING (film_id, probe)""",
)
def cue_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    near = I.nearest_interval(times(q), q, ["film_id"], O.anchor_distance)
    return near.select("film_id", F.col("at").alias("probe"), "ord", F.bround("distance", 6).alias("distance"), F.when(F.col("ord").isNotNull(), X.opening(F.col("text"))).alias("opening"))


@register("subtitle_proximity", f"WITH {V.CUES_SQL}, {TIMES_SQL}, x AS (SELECT v.film_id, probe, min({_FAR}) AS d FROM v_times v JOIN v_cues q USING (film_id) GROUP BY v.film_id, probe) SELECT film_id, probe, round_even(CASE WHEN d <= 6 THEN 1 - d / 6 ELSE 0.0::DOUBLE END, 6) AS proximity FROM x")
def subtitle_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    near = I.nearest_interval(times(q), q, ["film_id"], O.anchor_distance)
    return near.select("film_id", F.col("at").alias("probe"), F.bround(F.coalesce(1 - F.col("distance") / O.anchor_distance, F.lit(0.0)), 6).alias("proximity"))


@register(
    "nearest_sample",
    f"""WITH {V.SAMPLES_SQL}, q AS (SELECT film_id, unnest(range(0, 20)) AS probe FROM (SELECT DISTINCT film_id FROM v_samples)), x AS (SELECT q.film_id, probe, s.n, abs(s.t - probe * 36.5::DOUBLE) AS d FROM q JOIN v_samples s USING (film_id))
    SELECT film_id, probe, n FROM (SELECT *, row_number() OVER (PARTITION BY film_id, probe ORDER BY d, n) AS p FROM x) WHERE p = 1""",
)
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.samples(spark, sf_dir)
    q = s.select("film_id").distinct().withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("t", F.col("at") * F.lit(36.5))
    return I.nearest_point(q, s.select("film_id", F.col("t").alias("s_t"), "n"), ["film_id"]).select("film_id", F.col("at").alias("probe"), "n")


@register("chunk_for_time", f'WITH {V.CUES_SQL}, {CHUNKS_SQL}, {TIMES_SQL} SELECT v.film_id, probe, min(idx) AS idx FROM v_times v LEFT JOIN v_chunks c ON c.film_id = v.film_id AND t >= "from" AND t <= "to" GROUP BY v.film_id, probe')
def chunk_for_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    return I.chunk_at(times(q), chunks(q), ["film_id"], 10.0).select("film_id", F.col("at").alias("probe"), "idx")


@register("chunk_recover", f'WITH {V.CUES_SQL}, {CHUNKS_SQL}, {TIMES_SQL} SELECT v.film_id, probe, coalesce(min(idx) FILTER ("to" > t), max(idx)) AS pos FROM v_times v JOIN v_chunks c USING (film_id) GROUP BY v.film_id, probe')
def chunk_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir)
    return I.recovered_chunk(times(q), chunks(q).withColumnRenamed("idx", "pos"), ["film_id"]).select("film_id", F.col("at").alias("probe"), "pos")


def _collapse(cues: str) -> str:
    """Tables of cues (film_id, start, end, x, k) of which growing texts are joined."""
    grows = "c.x = r.x OR starts_with(c.x, r.x || ' ')"
    return f"""r(film_id, k, i, s, e, x) AS (SELECT DISTINCT film_id, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, chr(1) FROM {cues}
      UNION ALL SELECT c.film_id, c.k, CASE WHEN {grows} THEN r.i ELSE r.i + 1 END, CASE WHEN {grows} THEN r.s ELSE c.start END, CASE WHEN {grows} THEN greatest(r.e, c."end") ELSE c."end" END, c.x FROM r JOIN {cues} c ON c.film_id = r.film_id AND c.k = r.k + 1)"""


#: cues whose texts grow word by word, as rolling captions do: each turn, and each turn with a word more
_ROLLING = f"v_rolling AS (SELECT film_id, start, \"end\", x, row_number() OVER (PARTITION BY film_id ORDER BY ord, part) AS k FROM (SELECT film_id, ord, start, \"end\", text AS x, 0 AS part FROM v_cues UNION ALL SELECT film_id, ord, start, \"end\" + 1, text || ' more', 1 FROM v_cues WHERE ord % 2 = 0))"


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.cues(spark, sf_dir).withColumn("part", F.lit(0))
    more = q.filter("ord % 2 = 0").withColumn("end", F.col("end") + 1).withColumn("text", F.concat("text", F.lit(" more"))).withColumn("part", F.lit(1))
    return q.unionByName(more)


@register("vtt_collapse", f"""WITH RECURSIVE {V.CUES_SQL}, {_ROLLING}, {_collapse('v_rolling')} SELECT film_id, i AS ord, arg_max(s, k) AS start, arg_max(e, k) AS "end", arg_max(x, k) AS text FROM r WHERE i > 0 GROUP BY film_id, i""")
def vtt_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", "part", "start", "end", "text"))), lambda x: F.struct(x["ord"].alias("ord"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    c = rolling(spark, sf_dir).groupBy("film_id").agg(folds.rolled_up(rows).alias("c"))
    return c.select("film_id", F.posexplode("c").alias("p", "c")).select("film_id", (F.col("p") + 1).cast("long").alias("ord"), "c.start", "c.end", "c.text")


@register(
    "ass_dedupe",
    f"""WITH {V.CUES_SQL}, d AS (SELECT film_id, start, "end", text FROM v_cues UNION ALL SELECT film_id, start + 0.01::DOUBLE, "end", text FROM v_cues),
    k AS (SELECT *, row_number() OVER (PARTITION BY film_id, round_even(start * 10, 0), round_even("end" * 10, 0), text ORDER BY start, "end", text) AS p FROM d)
    SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY start, "end", text) AS ord, round_even(start, 6) AS start, text FROM k WHERE p = 1""",
)
def ass_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.cues(spark, sf_dir).select("film_id", "start", "end", "text")
    both = c.unionByName(c.withColumn("start", F.col("start") + 0.01))
    return subtitles.distinct_cues(both, ["film_id"]).select("film_id", "ord", F.bround("start", 6).alias("start"), "text")


_SHOW = "CASE WHEN {0} >= 3600 THEN printf('%d:%02d:%02d', {0} // 3600, {0} // 60 % 60, {0} % 60) ELSE printf('%d:%02d', {0} // 60, {0} % 60) END"


@register("cue_ids", f"WITH {V.CUES_SQL} SELECT film_id, ord, printf('S%02d_%d', ord + 1, CAST(round_even(start * 10, 0) AS BIGINT)) AS id, {_SHOW.format('CAST(round_even(start, 0) AS BIGINT)')} AS clock FROM v_cues")
def cue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cues(spark, sf_dir).select("film_id", "ord", C.cue_id("S", F.col("ord") + 1, F.col("start")).alias("id"), C.show(F.col("start")).alias("clock"))


_LINE = "printf('{p}%02d_%d', {o}, CAST(round_even(start * 10, 0) AS BIGINT)) || ' ' || " + _SHOW.format("CAST(round_even(start, 0) AS BIGINT)") + " || '-' || " + _SHOW.format('CAST(round_even("end", 0) AS BIGINT)') + " || {m} || ': ' || text"
_AT = lambda x: _SHOW.format(f"CAST(round_even({x}, 0) AS BIGINT)")
_SPAN = f"{_AT('a')} || '-' || {_AT('z')}"


@register(
    "sidecar_lines",
    f"""WITH {V.CUES_SQL}, q AS (SELECT *, ord + 1 AS o, film_id % 3 = 1 AS burned, CASE WHEN ord % 2 = 0 THEN ord % 10 / 10::DOUBLE END AS sure FROM v_cues WHERE film_id % 3 <> 2),
    h AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY ord) AS o FROM v_cues WHERE style = 'assistant' AND film_id % 2 = 0),
    f AS (SELECT film_id, min(start) AS a, max("end") AS z FROM v_cues GROUP BY film_id),
    l AS (SELECT film_id, string_agg({_LINE.format(p='S', o='o', m="CASE WHEN NOT burned THEN '' WHEN sure IS NULL THEN ' [OCR]' ELSE printf(' [OCR %.2f]', sure) END")}, chr(10) ORDER BY ord) AS lines, CASE WHEN bool_and(burned) THEN 'burned-subtitle-ocr' ELSE 'source-subtitle' END AS label FROM q GROUP BY film_id),
    m AS (SELECT film_id, string_agg({_LINE.format(p='A', o='o', m="''")}, chr(10) ORDER BY ord) AS lines FROM h GROUP BY film_id)
    SELECT film_id, sha256('[subtitles ' || {_SPAN} || ' source=' || coalesce(l.label, 'none') || ']' || chr(10) || coalesce(l.lines || chr(10), '') || '[/subtitles]'
      || CASE WHEN m.lines IS NULL THEN '' ELSE chr(10) || chr(10) || '[audio-transcript ' || {_SPAN} || ' source=audio-asr backend=local model=unknown]' || chr(10) || m.lines || chr(10) || '[/audio-transcript]' END) AS digest
    FROM f LEFT JOIN l USING (film_id) LEFT JOIN m USING (film_id)""",
)
def sidecar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that goes with each film: its cues (of a third none, of a third recognised), and of every other film what the assistant says as a transcript."""
    q = V.cues(spark, sf_dir)
    burned = F.when(F.col("film_id") % 3 == 1, "burned-subtitle-ocr").otherwise("source-subtitle")
    shown = q.filter("film_id % 3 <> 2").withColumn("ord", F.col("ord") + 1).withColumn("source", burned).withColumn("confidence", F.when(F.col("ord") % 2 == 1, (F.col("ord") - 1) % 10 / 10))
    heard = q.filter("style = 'assistant' AND film_id % 2 = 0").withColumn("ord", F.row_number().over(Window.partitionBy("film_id").orderBy("ord")).cast("long"))
    pack = lambda d, name, *more: d.groupBy("film_id").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "text", *more))).alias(name))
    films = q.groupBy("film_id").agg(F.min("start").alias("from"), F.max("end").alias("to"))
    chunk = films.join(pack(shown, "cues", "source", "confidence"), "film_id", "left").join(pack(heard, "heard"), "film_id", "left")
    made = subtitles.sidecar(chunk.withColumn("backend", F.lit("local")).withColumn("model", F.lit(None).cast("string")), ["film_id"])
    return made.select("film_id", F.sha2("sidecar", 256).alias("digest"))


def film_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with all that picks are scored by: change, quality, colour islands, regional change, motion and sound."""
    s = S.color_island(changed(spark, sf_dir)).withColumn("quality", S.quality()).withColumn("low", S.low_information())
    loud = V.samples(spark, sf_dir).select("film_id", (F.col("n") - 1).alias("i"), F.bround((F.col("luma") - 0.5) * 20000, 0).alias("x"))
    heard = speech.heard_samples(s.withColumn("at", F.col("n")), speech.audio_bins(loud, 4, 0.25))
    return heard.select("film_id", "n", "t", "change", "r", "g", "b", "luma", "contrast", "edge", "quality", "low", "island", "regional", "motion", "tiles", F.col("audio_event").alias("audio"))


@register("timeline_chunks")
def timeline_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive chunks of every film with their keyframes."""
    return selection.adaptive_chunks(film_samples(spark, sf_dir), V.cues(spark, sf_dir))


_SPLIT = f"""
{_CUTS.strip().rsplit("SELECT film_id, i AS cut", 1)[0]},
v_cut AS (SELECT film_id, i, arg_max(t, k) AS t FROM r WHERE i > 0 GROUP BY film_id, i),
v_mark AS (SELECT film_id, i, t FROM v_cut UNION ALL SELECT film_id, 0, ea FROM e UNION ALL SELECT e.film_id, coalesce(max(i), 0) + 1, any_value(eb) FROM e LEFT JOIN v_cut USING (film_id) GROUP BY e.film_id),
v_first AS (SELECT film_id, i, t AS x, lead(t) OVER (PARTITION BY film_id ORDER BY i) AS y FROM v_mark),
halves(film_id, i, node, x, y, cut) AS (
    SELECT f.film_id, f.i, 1::BIGINT, x, y, coalesce((SELECT c.t FROM v_change c WHERE c.film_id = f.film_id AND c.t BETWEEN x + 4 - 0.001::DOUBLE AND y - 4 + 0.001::DOUBLE ORDER BY c.change DESC, c.n LIMIT 1), x + (y - x) / 2) FROM v_first f WHERE y IS NOT NULL
    UNION ALL
    SELECT h.film_id, h.i, 2 * node + side, CASE WHEN side = 0 THEN x ELSE cut END, CASE WHEN side = 0 THEN cut ELSE y END,
        coalesce((SELECT c.t FROM v_change c WHERE c.film_id = h.film_id AND c.t BETWEEN (CASE WHEN side = 0 THEN x ELSE cut END) + 4 - 0.001::DOUBLE AND (CASE WHEN side = 0 THEN cut ELSE y END) - 4 + 0.001::DOUBLE ORDER BY c.change DESC, c.n LIMIT 1),
                 (CASE WHEN side = 0 THEN x ELSE cut END) + ((CASE WHEN side = 0 THEN cut ELSE y END) - (CASE WHEN side = 0 THEN x ELSE cut END)) / 2)
    FROM halves h, (VALUES (0), (1)) s(side) WHERE y - x > 18)
SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY i, node) AS ord, round_even(x, 6) AS start, round_even(y, 6) AS "end" FROM halves WHERE y - x <= 18 AND y - x >= 1
"""


@register("segments_split", _SPLIT)
def segments_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every film, long ones halved."""
    bounds = selection.segment_bounds(changed(spark, sf_dir).select("film_id", "t", "change"))
    return bounds.select("film_id", "ord", F.bround("start", 6).alias("start"), F.bround("end", 6).alias("end"))
