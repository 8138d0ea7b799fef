"""Manifests, notes and the reader's tables."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import retention as R, selection as S
from strandline.sources import library as L, probes as P


@pytest.fixture
def shelf(tmp_path):
    key = {"id": "K1", "time": 3.0, "score": 1.0, "reason": "gap-coverage", "event_time": None}
    doc = {"title": "T", "generation_id": "g", "video": "v.mp4", "sheets": [{"index": 3, "time_range": [60.0, 90.0], "sidecar": "later", "keyframes": []}, {"index": 1, "time_range": [0.0, 60.0], "sidecar": "Hello There", "keyframes": [key], "subtitle_count": 4}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    note = lambda i, c, t, at: {"id": i, "chunk_index": c, "timecode": None, "time_seconds": t, "author": "a", "text": i, "created_at": at, "replies": []}
    (tmp_path / "n.json").write_text(json.dumps({"version": 1, "annotations": [note("N1", 1, None, "1"), note("N2", 1, 9.0, "2"), note("N3", None, 1.0, "3")]}))
    return tmp_path


def test_reading(spark, shelf):
    s = L.sheets(L.manifests(spark, str(shelf / "m.json")))
    assert [(r.pos, r["index"], r.starts, r.keyframes, r.subtitles) for r in L.overview(s).orderBy("pos").collect()] == [(0, 1, "0:00", 1, 4), (1, 3, "1:00", 0, 0)]
    n = L.notes(spark, str(shelf / "n.json")).withColumn("film_id", F.lit("f"))
    packets = [r.packet for r in L.read_chunk(s.withColumn("film_id", F.lit("f")), n).orderBy("pos").collect()]
    assert packets[0] == "[chunk]\ntitle: T\nchunk: 001/001\ntime: 0:00-1:00\nduration_seconds: None\nkeyframes: K1 0:03\nnext: chunk 003 1:00-1:30\n\n[notes]\nN1 note: N1\nN2 note: N2\n[/notes]\n\nHello There\n[/chunk]"
    assert "next: end of available generated sheets" in packets[1] and "[notes]\n[/notes]\n\nlater" in packets[1]
    assert L.sheet_at(s, 3).first().sidecar == "later"
    with pytest.raises(Exception, match="no sheet 7"):
        L.sheet_at(s, 7).collect()
    assert [(r["index"], r["rank"]) for r in L.locate(s, 60.0, "LATER").orderBy("pos").collect()] == [(1, 0), (3, 1)]
    assert [r["index"] for r in L.without(s, start=3).collect()] == [1]


def test_broken_documents(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{]")
    assert [(r.cursor, r.generation_id) for r in L.states(spark, str(tmp_path / "bad.json")).collect()] == [(0, None)]
    with pytest.raises(Exception):  # noqa: B017
        L.notes(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(Exception, match="annotations"):
        L.notes(spark, str(tmp_path / "none.json")).collect()


def test_shelf_of_films(spark):
    files = spark.createDataFrame([("a", "b.MP4", 5), ("a", "a.mkv", 7), ("a", "x.srt", 1), (".h", "a.mp4", 1), ("n", "x.srt", 1)], "film_id string, name string, bytes long")
    cues = spark.createDataFrame([("a", 0.0, 99.0), ("a", 5.0, 6.0)], "film_id string, start double, end double")
    assert [tuple(r) for r in L.films(files, cues).collect()] == [("a", "a.mkv", 7, "x.srt", 2, 6.0)]


def test_small_rules(spark):
    d = spark.createDataFrame([(0.0, 10.0, 100.0), (5.0, 5.0, 9.0), (0.0, 301.0, 999.0), (0.0, 10.0, 9.0)], "a double, b double, c double")
    got = [r[0] for r in d.select(S.range_problem(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [None, "the range is empty", "the range is too long", "the range lies beyond the film"]
    r = spark.createDataFrame([("p", "1", "old")], "path string, last_accessed_at string, kind string")
    assert [x.kind for x in L.upserted(r, spark.createDataFrame([("p", "2", "new")], r.schema)).collect()] == ["new"]
    t = spark.createDataFrame([("s", None), (None, None)], "s string, a string").select(L.track_list(F.col("s"), F.col("a")).alias("t")).collect()
    assert [[x.kind for x in r.t] for r in t] == [["subtitle"], []]


def test_notes_are_written_and_read_again(spark, shelf, tmp_path):
    s = L.sheets(L.manifests(spark, str(shelf / "m.json"))).withColumn("film_id", F.lit("f"))
    ask = lambda rows: spark.createDataFrame(rows, "film_id string, chunk_index long, text string, timecode string, author string, created_at string")
    made = L.new_notes(ask([("f", 1, " first ", "0:09", "a", "1"), ("f", 3, "second", "whenever", "b", "2")]), s).collect()
    assert [(r.chunk_index, r.text, r.time_seconds, list(r.chunk_time_range), r.kind, r.visibility, r.id[0]) for r in made] == [(1, "first", 9.0, [0.0, 60.0], "observation", "user", "N"), (3, "second", None, [60.0, 90.0], "observation", "user", "N")]
    for rows, what in (([("f", 2, "x", "", "a", "1")], "no sheet 2"), ([("f", 1, "  ", "", "a", "1")], "needs a text")):
        with pytest.raises(Exception, match=what):
            L.new_notes(ask(rows), s).collect()
    notes = spark.createDataFrame(made)
    answer = lambda rows: spark.createDataFrame(rows, "film_id string, note_id string, text string, author string, created_at string")
    replies = L.new_replies(answer([("f", made[0].id, "so?", "b", "3"), ("f", made[0].id, "yes", "a", "4")]), notes)
    with pytest.raises(Exception, match="no note N0"):
        L.new_replies(answer([("f", "N0", "x", "a", "1")]), notes).collect()
    (tmp_path / "out.json").write_text(L.document(notes, replies).first()["value"])
    again = L.notes(spark, str(tmp_path / "out.json")).orderBy("place").collect()
    assert [(r.place, r.id, r.text, [x.text for x in r.replies]) for r in again] == [(0, made[0].id, "first", ["so?", "yes"]), (1, made[1].id, "second", [])]


def test_job_reports(spark):
    jobs = spark.createDataFrame([("a", "running", "frames", 1, "x\ny\nz"), ("b", "Running", None, 2, None), ("c", "failed", None, None, ""), ("e", None, None, None, None)], "film_id string, status string, phase string, pid long, log string")
    made = spark.createDataFrame([("a", 0), ("a", 1), ("d", 0)], "film_id string, index long")
    got = {r.film_id: r for r in L.job_report(jobs, spark.createDataFrame([(1,)], "pid long"), made, tail=2).collect()}
    assert {k: (r.status, r.phase, r.available, r.kind) for k, r in got.items()} == {"a": ("running", "frames", 2, "waiting"), "b": ("stopped", "stopped", 0, "end"), "c": ("failed", "failed", 0, "end"), "d": ("manifest-available", "manifest-available", 1, "end"), "e": ("unknown", "unknown", 0, "end")}
    assert got["a"].log_tail == "y\nz" and "available_sheets: 2\nphase: frames" in got["a"].message and "generation_status: failed" in got["c"].message


def test_probes(spark):
    one = lambda column, text: spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("r")).first().r
    assert one(P.container, '{"format": {"duration": "n/a"}}').duration is None
    for column, text in ((P.container, "{"), (P.remote, "[]"), (P.remote, "oops")):
        with pytest.raises(Exception):  # noqa: B017
            one(column, text)
    assert one(P.subtitle_streams, "oops") == []
    d = spark.createDataFrame([(None, 1.0), (5, 1.0), (1 << 20, None), (1 << 20, 0.0), (1 << 20, 2.0)], "s long, d double")
    assert [r[0] for r in d.select(P.video_problem(F.col("s"), F.col("d"))).collect()] == ["there is no such video", "the video is small, as an incomplete download is", "the duration can't be read", "the duration isn't positive", None]
    assert d.select(P.video_problem(F.col("s"), F.col("d"), allow_small=True).alias("p")).collect()[1].p is None


def test_cleanup_rules(spark):
    rows = [("old", "url", False, "2024-01-01", None, 5), ("back", "url", False, "2024-01-01", "2024-01-03", 5), ("busy", "url", True, "2024-01-01", None, 5), ("new", "url", False, "2024-01-03", None, 5), ("mine", "local", False, "2024-01-01", None, 5), ("gone", "url", False, "2024-01-01", None, None)]
    e = spark.createDataFrame(rows, "path string, kind string, running boolean, a string, b string, bytes long").select("path", "kind", "running", "bytes", F.to_timestamp("a").alias("last_access"), F.to_timestamp("b").alias("last_access_now"), *(F.lit(None).cast("timestamp").alias(c) for c in ("prepared", "modified")))
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    for dry, word in ((True, "would-delete"), (False, "deleted")):
        got = {r.path: (r.action, r.reason, r.freed) for r in R.cleanup(e, now, 86400.0, dry).collect()}
        assert got == {"old": (word, None, 5), "back": ("skipped", "recently-reactivated", 0), "busy": ("skipped", "generation-running", 0)}
    with pytest.raises(ValueError, match="positive"):
        R.cleanup(e, now, 0, True)


def test_manifests_are_written_and_read_again(spark, shelf, tmp_path):
    m = L.manifests(spark, str(shelf / "m.json")).withColumn("film_id", F.lit("f"))
    s = L.sheets(m)
    (tmp_path / "out.json").write_text(L.manifest_document(m, s).first()["value"])
    again = L.sheets(L.manifests(spark, str(tmp_path / "out.json"))).withColumn("film_id", F.lit("f"))
    columns = ["index", "time_range", "sidecar", "keyframes", "subtitle_count"]
    assert [tuple(r) for r in again.select(*columns).orderBy("index").collect()] == [tuple(r) for r in s.select(*columns).orderBy("index").collect()]


def test_sources_are_opened(spark):
    w = spark.createDataFrame([("p1", "http://a/x", None), ("p2", "/films/b.mkv", None), ("p3", "/films/c.v2.mkv", "own.srt"), ("p4", "http://a/y", None)], "path string, source string, explicit string")
    known = P.records(spark.createDataFrame([("p1", '{"source": "http://a/x", "video_path": "/v/1.mkv", "title": "One"}'), ("p4", "{broken")], "path string, value string"))
    files = spark.createDataFrame([("/v/1.mkv",)], "path string")
    side = spark.createDataFrame([("p2", True, False, "en", ".srt", "b.en.srt"), ("p3", True, False, "en", ".srt", "c.srt")], "film string, stem_match boolean, only_one boolean, lang string, ext string, name string")
    none = spark.createDataFrame([], "film string, index int, codec string, lang string, commentary boolean, is_default boolean, forced boolean")
    got = {r.path: (r.video_path, r.subtitle_path, r.title, r.reused) for r in P.opened(w, known, files, side, none, ("en",)).collect()}
    assert got == {"p1": ("/v/1.mkv", None, "One", True), "p2": ("/films/b.mkv", "b.en.srt", "b", False), "p3": ("/films/c.v2.mkv", "own.srt", "c.v2", False), "p4": (None, None, "y", False)}
