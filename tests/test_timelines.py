"""Joins, folds, picks, sources and state against plain models."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import folds, frames, intervals as I, layout, retention, search, selection as S, speech
from strandline.options import Options
from strandline.plans import library
from strandline.sources import subtitles
from strandline.streaming import jobs, marks


def test_overlap_join_is_the_plain_join(spark):
    rng = random.Random(5)
    a = [(rng.randrange(3), i, x := rng.uniform(0, 90), x + rng.choice([0, 1, 30])) for i in range(120)]
    b = [(rng.randrange(3), i, x := rng.uniform(0, 90), x + rng.choice([0, 2, 50])) for i in range(120)]
    got = I.overlap_join(spark.createDataFrame(a, "k int, i int, s double, e double"), spark.createDataFrame(b, "k int, j int, u double, v double"), ["k"], ("s", "e"), ("u", "v"), 7.0)
    want = sorted((i, j) for k, i, s, e in a for m, j, u, v in b if k == m and e >= u and s <= v)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_touching_edges_meet(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0)], "k int, s double, e double")
    b = spark.createDataFrame([(1, 10.0, 20.0), (1, 20.0, 10.0)], "k int, u double, v double")
    assert I.overlap_join(a, b, ["k"], ("s", "e"), ("u", "v"), 3.0).count() == 1


def test_nearest_point_takes_the_earlier_of_two(spark):
    q = spark.createDataFrame([(1, 0, 5.0), (1, 1, -3.0), (1, 2, 99.0)], "k int, at long, t double")
    s = spark.createDataFrame([(1, 4.0, "a"), (1, 6.0, "b")], "k int, s_t double, x string")
    assert {r.at: r.x for r in I.nearest_point(q, s, ["k"]).collect()} == {0: "a", 1: "a", 2: "b"}


@pytest.mark.parametrize("seed", range(4))
def test_spaced(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.uniform(0, 60), rng.random()) for _ in range(40))
    kept = []
    for t, x in rows:
        if kept and t - kept[-1][0] < 4:
            if x > kept[-1][1]:
                kept[-1] = (t, x)
        else:
            kept.append((t, x))
    d = spark.createDataFrame(rows, "t double, x double").agg(folds.spaced(F.sort_array(F.collect_list(F.struct("t", "x"))), 4.0, "x").alias("k"))
    assert [tuple(r) for r in d.first().k] == kept


def films(seed, n=200):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"film_id": 1, "t": np.arange(n, dtype=float), "change": rng.gamma(2.0, 8.0, n), "quality": rng.random(n)})
    for c in "rgb":
        p[c] = rng.integers(0, 255, n).astype(float)
    for c in ("luma", "contrast", "edge"):
        p[c] = rng.random(n)
    return p


def test_nearest_point_reads_each_row_once(spark):
    times = spark.createDataFrame([(1, 0, 2.0), (1, 1, 5.2), (2, 0, 1.0)], "film_id long, at long, t double")
    samples = spark.createDataFrame([(1, 1.0, 7), (1, 1.0, 5), (1, 6.0, 4), (1, 6.0, 9), (2, 3.0, 2), (2, 3.0, 1)], "film_id long, s_t double, n long")
    found = I.nearest_point(times, samples, ["film_id"])
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert sorted((r.film_id, r.at, r.n) for r in found.collect()) == [(1, 0, 5), (1, 1, 4), (2, 0, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_segments_cover_the_film(seed):
    f = S.Film(films(seed), np.zeros((0, 2)), Options())
    bounds = sorted(f.segments(np.arange(200), 0.0, 199.0))
    assert bounds[0][0] == 0 and bounds[-1][1] == 199
    assert all(b == c for (_, b), (c, _) in zip(bounds, bounds[1:]))
    assert all(b - a <= 18 for a, b in bounds)


@pytest.mark.parametrize("seed", range(5))
def test_picks_keep_their_distance_and_pins_stay(seed):
    o = Options(pins=(50.5, 51.0))
    picks = S.Film(films(seed), np.array([[3.0, 9.0]]), o).picks(0.0, 199.0, 16)
    times = [p.time for p in picks]
    assert times == sorted(times) and {50.5, 51.0} <= set(times) and len(times) <= 16
    free = [p.time for p in picks if p.reason != "pinned"]
    assert all(b - a >= 2 for a, b in zip(free, free[1:]))


def test_chunks_follow_one_another():
    chunks = S.Film(films(3, 1500), np.zeros((0, 2)), Options()).chunks(0.0, 1499.0)
    assert chunks[0][0] == 0 and chunks[-1][1] == 1499
    assert all(a[1] == b[0] for a, b in zip(chunks, chunks[1:]))
    assert all(60 <= b - a <= 600 for a, b, _ in chunks[:-1])


def test_picks_are_compared_with_near_ones_only(monkeypatch):
    f, compared = S.Film(films(2, 400), np.zeros((0, 2)), Options()), []
    alike = S.Film.alike
    monkeypatch.setattr(S.Film, "alike", lambda self, p, q: compared.append(1) or alike(self, p, q))
    picks = [S.Pick(float(t), float(t * 7 % 13), "x", 0, 0) for t in range(0, 400, 4)]
    kept = f.distinct(picks, 400)
    assert [p.time for p in kept] == sorted(p.time for p in kept) and len(compared) <= 2 * len(picks)
    assert all(not alike(f, p, q) for p, q in zip(kept, kept[1:]))


def test_films_come_as_one_stream(spark):
    given = {k: films(k, 25 * k).assign(film_id=k, low=False) for k in (1, 2, 3, 4)}
    cues = np.array([[3.0, 9.0], [30.0, 31.0]])
    rows = [(None if k == 4 else k, *r) for k, p in given.items() for r in p.drop(columns="film_id").sample(frac=1, random_state=k).itertuples(index=False)]
    d = spark.createDataFrame(rows, "film_id long, " + ", ".join(f"{c} {'boolean' if c == 'low' else 'double'}" for c in given[1].columns[1:]))
    c = spark.createDataFrame([(k, a, b) for k in (2, None, 77) for a, b in cues.tolist()], "film_id long, start double, end double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # films go on from batch to batch
    try:
        made = S.adaptive_chunks(d, c)
        assert "CoGroup" not in made._jdf.queryExecution().toString()
        got = sorted(map(repr, map(tuple, made.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k, p in given.items():
        f = S.Film(p, cues if k in (2, 4) else np.zeros((0, 2)), Options())
        want += [(None if k == 4 else k, n, a, b, x.time, x.score, x.reason) for n, (a, b, picks) in enumerate(f.chunks(f.t[0], f.t[-1]), 1) for x in picks]
    assert got == sorted(map(repr, want))


def test_dark_frames_are_picked_only_alone():
    p = films(1, 40)
    p["low"] = True
    p.loc[7, "low"] = False
    f = S.Film(p, np.zeros((0, 2)), Options())
    assert list(f.useful(np.arange(40))) == [7] and len(f.useful(np.arange(3))) == 3


def test_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>One</i>\r\ntwo\r\n\r\n2\r\n00:00:00,5 --> 00:00:01,000\r\n{x}\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\nThree\r\n", newline="")
    got = [(r.ord, r.start, r.end, r.text) for r in subtitles.read(spark, str(tmp_path / "a.srt")).orderBy("ord").collect()]
    assert got == [(1, 1.0, 2.5, "One two"), (2, 3.0, 4.0, "Three")]


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nand so\n\n00:02.000 --> 00:03.000 align:start\nand so it\n\n00:04.000 --> 00:05.000\n<v Ann>Hi\n")
    got = [(r.ord, r.start, r.end, r.text) for r in subtitles.read(spark, str(tmp_path / "a.vtt")).orderBy("ord").collect()]
    assert got == [(1, 1.0, 3.0, "and so it"), (2, 4.0, 5.0, "[Ann] Hi")]


def test_ass(spark, tmp_path):
    line = "Dialogue: 0,0:00:0{},0:00:05.00,{},,0,0,0,,{}"
    (tmp_path / "a.ass").write_text("\n".join(["[Script Info]", line.format("1.00", "Main", "no"), "[Events]", line.format("2.00", "Main", "b, c"), line.format("1.00", "Main", "a\\Nb"), line.format("1.01", "Main", "a\\Nb"), line.format("1.00", "JP", "x")]))
    got = [(r.start, r.style, r.text) for r in subtitles.read(spark, str(tmp_path / "a.ass")).orderBy("ord").collect()]
    assert got == [(1.0, "Main", "a b"), (2.0, "Main", "b, c")]
    with pytest.raises(ValueError, match="format"):
        subtitles.read(spark, "x.txt")


def test_shift_keeps_sources(spark):
    c = spark.createDataFrame([("f", 1, 0.0, 1.0, "a", "s"), ("f", 2, 4.0, 9.0, "b", "asr")], "path string, ord long, start double, end double, text string, source string")
    got = [(r.ord, r.start, r.end, r.source) for r in subtitles.shifted(c, -5.0, ["path"]).collect()]
    assert got == [(1, 0.0, 4.0, "asr")]


def test_readings_merge(spark):
    r = spark.createDataFrame([(1, 0.0, "Hello world", 0.9), (1, 0.5, "Hello worl", 0.6), (1, 1.0, "Hello world", 0.7), (1, 9.0, "noise", 0.4), (1, 12.0, "Alone", 0.6)], "film_id long, time double, text string, confidence double")
    got = [(x.start, x.end, x.text, x.observations) for x in speech.merge_readings(r, 0.5).orderBy("start").collect()]
    assert got == [(0.0, 1.5, "Hello world", 3), (12.0, 12.5, "Alone", 1)]
    long = "Hello world and all of its many people"  # a little longer counts for a little: 0.65 + 32/800 over 0.66 + 10/800
    r = spark.createDataFrame([(1, 0.0, "Hello world", 0.66), (1, 0.5, long, 0.65), (1, 1.5, "its many people", 0.2)], "film_id long, time double, text string, confidence double")
    got = [(x.start, x.end, x.text, x.observations) for x in speech.merge_readings(r, 0.5).collect()]
    assert got == [(0.0, 2.0, long, 3)]


def test_whole_cues_are_compared_and_merged(spark, tmp_path):
    opening = "the same opening of every cue, far longer than sixty characters in all, "
    texts = [opening + "then rain", opening + "and " + "quite another ending " * 9, opening + "then rain", "Short / " + opening]
    rows = [(c, k, "user", t) for c in (1, 2) for k, t in enumerate(texts[c - 1 :])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.film_id, r.ord): (r.alike, r.plain) for r in library.text_similarity(spark, str(tmp_path)).collect()}
    want = {(c, k): (speech.similarity(t, texts[c + k - 2]), speech.plain(t)) for c, k, _, t in rows if k}
    assert set(got) == set(want) and min(a for a, _ in want.values()) < 0.7
    assert all(got[k] == (pytest.approx(a, abs=1e-6), p) for k, (a, p) in want.items())
    merged = [(r.film_id, r.start, r.end, r.text, r.observations) for r in library.ocr_merge(spark, str(tmp_path)).orderBy("film_id", "start").collect()]
    assert merged == [(c, 4.0 * k, 4.0 * k + 1.5, t + "?", 3) for c, k, _, t in rows]


def test_expiry_is_closed(spark):
    d = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-02 00:00:00' AS b")
    assert d.select(retention.expired(F.col("a"), F.col("b"), 86400.0), retention.expired(F.col("a"), F.col("b"), 86400.1)).first()[:] == (True, False)


def test_marks():
    assert marks.next_mark(None, 100.0) == (40.0, 100.0, 100.0)
    assert marks.next_mark(100.0, 110.0) == (100.0, 110.0, 110.0)
    assert marks.next_mark(110.0, 105.0) == (105.0, 105.0, 110.0)
    assert marks.next_mark(110.0, 20.0) == (0.0, 20.0, 20.0)


def test_high_water_stream(spark, tmp_path):
    spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "film_id long, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("film_id long, t double").parquet(str(tmp_path / "in"))
    q = marks.injected(stream).writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("marks").collect()) == [(1, 0.0, 10.0, 10.0), (1, 10.0, 20.0, 20.0), (2, 0.0, 5.0, 5.0)]


def test_cursor_stream(spark, tmp_path):
    rows = [(1, "g1", 0, 60.0), (1, "g1", 1, 120.0), (2, "g9", 0, 30.0)]
    spark.createDataFrame(rows, "film_id long, generation string, pos long, to double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("film_id long, generation string, pos long, to double").parquet(str(tmp_path / "in"))
    q = marks.handed_out(stream).writeStream.format("memory").queryName("cursor").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("cursor").collect()) == rows


def test_owned_leaves_out_what_is_there(spark):
    rows = [(1, 1.0, 2.0, "Hello!", 0.0, 5.0, True, False), (1, 1.04, 2.0, "hello", 0.0, 5.0, True, False), (1, 4.0, 7.0, "over", 0.0, 5.0, True, False), (1, 4.0, 7.0, "over", 5.0, 9.0, False, True)]
    d = spark.createDataFrame(rows, "film_id long, start double, end double, text string, from double, to double, first_window boolean, last_window boolean")
    assert [(r.text, r["from"]) for r in speech.owned(d, ["film_id"]).orderBy("start").collect()] == [("Hello!", 0.0), ("over", 5.0)]
    known = spark.createDataFrame([(1, 1.01, 2.01, "HELLO")], "film_id long, start double, end double, text string")
    assert [r.text for r in speech.owned(d, ["film_id"], known).collect()] == ["over"]


def test_boxes_of_one_frame(spark):
    box = "array<struct<text:string,confidence:double,x:double,y:double,width:double>>"
    rows = [([("Ｈｅｌｌｏ  there", 0.9, 0.4, 0.2, 0.3), ("first of two", 0.5, 0.4, 0.8, 0.3), ("second", 0.7, 0.4, 0.8, 0.3), ("hello THERE", 0.3, 0.4, 0.1, 0.3), ("edge", 0.9, 0.0, 0.5, 0.1), ("no", 0.9, 0.4, 0.5, 0.3)],), ([],), (None,)]
    got = [r.reading and (r.reading.text, round(r.reading.confidence, 6)) for r in speech.readings(spark.createDataFrame(rows, f"boxes {box}")).collect()]
    assert got == [("first of two / second / Hello there", 0.7), None, None]
    frames = spark.createDataFrame([("a",), ("b",)], "path string")
    images = spark.createDataFrame([("a", rows[0][0])], f"path string, boxes {box}")
    assert {r.path: len(r.boxes) for r in speech.with_readings(frames, images).collect()} == {"a": 6, "b": 0}


def test_frames_against_loops():
    rng = np.random.default_rng(9)
    w, h, grid = 7, 5, 3
    raw = rng.integers(0, 256, w * h * 3).astype(np.uint8).tobytes()
    s = frames.frame_stats(raw, w, h, grid)
    px = [[tuple(raw[3 * (y * w + x) + c] for c in range(3)) for x in range(w)] for y in range(h)]
    light = [[(0.2126 * r + 0.7152 * g + 0.0722 * b) / 255 for r, g, b in row] for row in px]
    steps = [abs(light[y][x] - light[y][x + 1]) for y in range(h) for x in range(w - 1)] + [abs(light[y][x] - light[y + 1][x]) for y in range(h - 1) for x in range(w)]
    tiles = {}
    for y in range(h):
        for x in range(w):
            tiles.setdefault(min(grid - 1, y * grid // h) * grid + min(grid - 1, x * grid // w), []).append((*px[y][x], light[y][x]))
    assert s["edge"] == pytest.approx(sum(steps) / len(steps)) and s["r"] == round(np.mean([p[0] for row in px for p in row]))
    assert s["saturation"] == pytest.approx(np.mean([(max(p) - min(p)) / max(p) if max(p) else 0 for row in px for p in row]))
    for k, t in enumerate(s["tiles"]):
        assert (t["r"], t["luma"]) == (round(np.mean([p[0] for p in tiles[k]])), pytest.approx(np.mean([p[3] for p in tiles[k]])))
    assert frames.frame_stats(b"", 0, 4)["tiles"] == [] and frames.frame_stats(None, 4, 4)["luma"] == 0
    assert frames.pixel_motion(b"\x00\xff", b"\xff\xff\x01") == 0.5 and frames.pixel_motion(b"a", None) == 0


def test_tiles_tell_alike_pictures_apart():
    p = films(2, 20)
    for c in ("r", "g", "b", "luma", "contrast", "edge"):
        p[c] = 0.5
    a, b = S.Pick(3.0, 1.0, "x", 0, 0), S.Pick(6.0, 1.0, "x", 0, 0)
    assert S.Film(p, np.zeros((0, 2)), Options()).alike(a, b)
    p["tiles"] = [[{"r": 255.0 * (i == 6), "g": 0.0, "b": 0.0, "luma": 0.0}] * 4 for i in range(20)]
    assert not S.Film(p, np.zeros((0, 2)), Options()).alike(a, b)


def test_rows_of_a_sheet(spark):
    f = spark.createDataFrame([(1, float(t)) for t in (10, 20, 40, 50, 90)], "film_id long, time double")
    b = spark.createDataFrame([(1, 0.0, 100.0), (2, 5.0, 9.0)], "film_id long, from double, to double")
    got = [tuple(r) for r in layout.rows_of_keyframes(f, b, layout.Sheet(per_row=2, pack=False)).orderBy("film_id", "row", "place").collect()]
    assert got == [(1, 0, 0, 10.0, 0.0, 30.0), (1, 0, 1, 20.0, 0.0, 30.0), (1, 1, 0, 40.0, 30.0, 70.0), (1, 1, 1, 50.0, 30.0, 70.0), (1, 2, 0, 90.0, 70.0, 100.0), (2, 0, 0, None, 5.0, 9.0)]
    none = spark.range(1).select(layout.display_rows(F.lit(5.0), F.lit(5.0)).alias("r"), layout.display_rows(F.lit(0.0), F.lit(61.0)).alias("s")).first()
    assert none.r == [] and [tuple(x) for x in none.s] == [(0.0, 30.0), (30.0, 60.0), (60.0, 61.0)]


def test_cursor_of_a_new_generation(spark, tmp_path):
    schema = "film_id long, generation string, pos long, to double"
    for k, rows in enumerate(([(1, "g1", 0, 60.0), (1, "g1", 1, 120.0)], [(1, "g2", 0, 50.0), (1, "g2", 1, 110.0), (1, "g2", 2, 170.0), (1, "g2", 3, 200.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = marks.handed_out(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "g1", 0, 60.0), (1, "g1", 1, 120.0), (1, "g2", 2, 170.0), (1, "g2", 3, 200.0)]


def test_tumbling_counts_and_jobs(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:05' AS ts, 1L AS film_id UNION ALL SELECT timestamp'2024-01-01 00:00:25', 1L UNION ALL SELECT timestamp'2024-01-01 00:00:35', 1L").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, film_id long").parquet(str(tmp_path / "in"))
    start = lambda: marks.tumbling(stream, "30 seconds", "1 minute").writeStream.format("memory").outputMode("complete").queryName("rows").option("checkpointLocation", str(tmp_path / "c")).start()
    q, fresh = jobs.started(spark, "rows", start)
    same, again = jobs.started(spark, "rows", start)
    assert fresh and not again and same.id == q.id
    q.processAllAvailable()
    assert jobs.state(spark, [q]).first().status == "running"
    assert sorted((r.window.start.second, r.n) for r in spark.table("rows").collect()) == [(0, 2), (30, 1)]
    q.stop()
    assert jobs.state(spark, [q]).first().status == "complete"


def test_no_path_has_no_cues(spark):
    assert subtitles.read(spark, None).collect() == []


def test_chunks_are_refined_and_ranges_focused(spark):
    d = spark.createDataFrame(films(4, 150))
    cues = spark.createDataFrame([(1, 1, "S01_20", 2.0, 4.0, "one two three four five six seven", "source-subtitle")], "film_id long, ord long, id string, start double, end double, text string, source string")
    whole = S.adaptive_chunks(d, cues).cache()
    ask = lambda rows: spark.createDataFrame(rows, "film_id long, chunk long, from double, to double, pins array<double>")
    first = whole.filter("chunk = 1").first()
    again = S.refined(whole, d, cues, ask([(1, 1, first["from"], first["to"], [7.25])])).collect()
    assert 7.25 in [r.time for r in again if r.chunk == 1] and any(r.reason == "pinned" for r in again)
    assert sorted(map(tuple, (r for r in again if r.chunk > 1))) == sorted(map(tuple, whole.filter("chunk > 1").collect()))
    close = S.focused(d, cues, ask([(1, 9, 20.0, 80.0, None)]), "dense").collect()
    assert {r.chunk for r in close} == {9} and all(20 <= r.time <= 80 for r in close)
    for bad, what in (([(1, 9, 20.0, 20.0, None)], "empty"), ([(1, 9, 20.0, 200.0, None)], "beyond"), ([(2, 9, 1.0, 2.0, None)], "no such film")):
        with pytest.raises(Exception, match=what):
            S.focused(d, cues, ask(bad)).collect()
    k = S.keyframes(whole, cues).orderBy("chunk", "time").collect()
    assert [r.id for r in k if r.chunk == 1] == [f"K{i}" for i in range(1, sum(r.chunk == 1 for r in k) + 1)]
    anchored = [r for r in k if r.subtitle_anchor]
    assert anchored and all(r.time <= 10 and r.subtitle_anchor.text == "one two three four five six..." for r in anchored)


def test_phrases_are_found_anywhere(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["ab", "abc", "b c", "cab", "x"]) for _ in range(rng.randrange(12)))) for i in range(80)] + [(80, None), (None, "abc x ab cab b")]
    phrases = [(0, "b"), (1, "c a"), (2, "abc"), (3, ""), (4, "  B  C "), (5, "x ab abc cab x"), (6, "b c ab x abc ab"), (7, None), (8, "abc"), (9, "c x ab cab")]
    d, w = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(phrases, "item_id long, phrase string")
    form = lambda x: " ".join((x or "").lower().split())
    want = {(i, j) for i, t in texts for j, p in phrases if form(p) and form(p) in form(t)}
    assert {tuple(r) for r in library.located(d, w).collect()} == want and len(want) > 100
    keyed = d.filter("text is not null").select(F.coalesce("doc_id", F.lit(-1)).alias("tk"), F.col("text").alias("t"))
    one = search.holding(keyed, w.filter("phrase <> ''").select(F.col("item_id").alias("pk"), F.col("phrase").alias("p")), block=2)
    assert {(r.tk, r.pk) for r in one.collect()} == {(-1 if i is None else i, j) for i, t in texts for j, p in phrases if p and t is not None and p in t}
    assert library.located(d, w.limit(0)).collect() == []
