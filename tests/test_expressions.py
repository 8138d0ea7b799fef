"""Expressions against values worked out by hand."""

import math
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X, timecode as C
from strandline.operators import ranking as R, scoring as S, speech
from strandline.options import Options, Recognition, arguments, decimal_rate, frame_rate, parsed, profile, usable_range


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_clock(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 59.5, 60.5, 3599.6, 3661.0, -3.0)], "x double")
    assert [r[0] for r in d.select(C.show(F.col("x"))).collect()] == ["0:00", "1:00", "1:00", "1:00:00", "1:01:01", "0:00"]


def test_time_codes(spark):
    codes = ["90", "1:30", "1:01:01.5", "1:30.5", "x", None, "1:2:3:4"]
    assert values(spark, codes, C.read) == [90.0, 90.0, 3661.5, 90.5, None, None, None]
    assert values(spark, codes, C.read_strict) == [90.0, 90.0, 3661.5, None, None, None, None]
    assert values(spark, ["00:00:01,5", "01:02.250", "1:00:00.1"], C.read_stamp) == [1.5, 62.25, 3600.1]
    assert values(spark, ["1:00, 30,,30", ""], C.pins) == [[30.0, 60.0], []]
    with pytest.raises(Exception, match="not a time"):
        values(spark, ["x"], C.read_or_fail)


def test_cue_text(spark):
    assert values(spark, ["{\\an8}<i>Hi</i>\\Nthere   you", " 　x "], X.clean_cue) == ["Hi there you", "x"]
    assert values(spark, ["a b c d e f, g", "a b", "一" * 30, "x" * 30, "<i>yes!</i>", "一 二 三", "", None, "{x}"], X.opening) == ["a b c d e f...", "a b...", "一" * 24 + "...", "x" * 24 + "...", "yes...", "一 二 三...", "", "", ""]
    assert values(spark, ["ab", "a1b", "一丁", "!!!"], X.meaningful) == [False, True, True, False]
    assert values(spark, ["S01_20", "A2", "", None, "_3"], X.short_label) == ["S01", "A2", "S", "S", "S"]
    assert values(spark, ["Straße, a_b!", " é "], X.asr_key) == ["strassea_b", "é"]
    assert values(spark, ["Straße 1"], X.folded) == ["strasse1"]


def test_an_opening_is_cleaned_once(spark):
    made = spark.range(1).select(X.opening(F.lit("<b>a  b</b>").substr(F.lit(1), F.length(F.lit("x")) + F.col("id") + 20)).alias("o"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("\\[Nnh]") == 1 and made.first().o == "a b..."


def test_text_with_open_brackets_only_is_read_once(spark):
    """Some seconds each where every bracket reads the rest of the text again."""
    given = ["{" * 60000, "<" * 60000, "a" + "." * 60000 + " b", "<>" * 3 + "<<i>" + "{}{<" + "<"]
    began = time.monotonic()
    assert values(spark, given[:2] + given[3:], X.clean_cue) == [given[0], given[1], "<><><>{<<"]
    assert values(spark, given, X.opening)[2] == given[2] + "..."
    assert time.monotonic() - began < 20


def test_addresses(spark):
    given = ["https://a.b/c?d#e", "http://a/b;p=1", "HTTP://A/x;y/z;p;q?r", "ftp://a/b;c?d", "/films/a;b.mkv", None, "http:///x?y", "https://h#f"]
    assert values(spark, given, X.public_url) == ["https://a.b/c", "http://a/b", "http://A/x;y/z", "ftp://a/b;c?d", "/films/a;b.mkv", "", "http:///x?y", "https://h"]
    assert values(spark, ["https://a", "-http://a", "ftp://a", "HTTP://A/b", None, "http:///x"], X.is_web) == [True, False, False, True, False, False]
    assert values(spark, ["Ein Film! (2020)", "/a/b/My.Film.v2.mkv", "x" * 80 + ".mp4", "", None, ".hidden", "...", "a/./"], X.slug) == ["ein-film-2020", "my.film.v2", "x" * 80, "film", "film", "hidden", "film", "a"]
    import hashlib

    tail = lambda u: hashlib.sha256(u.encode()).hexdigest()[:10]
    given = ["https://h.org/v/Clip One.mp4?x=1", "https://h.org/", "/films/A b.c.mkv"]
    assert values(spark, given, X.cache_folder) == [f"clip-one-{tail(given[0])}", f"h-{tail(given[1])}", "a-b"]
    assert values(spark, [" en, de ,,fr", "", None], X.preferences) == [["en", "de", "fr"], [], []]
    assert [r and tuple(r) for r in values(spark, ["4x3", " 5X4 ", "0x3", "4x", None], X.layout)] == [(4, 3), (5, 4), None, None, None]
    assert values(spark, ["a", "../a", ".a", "a/b", "", "a b", None], X.safe_id) == [True, False, False, False, False, True, False]
    assert values(spark, ["a/b.png", "/a", "a/../b", "..\\a", "", "a..b", None], X.safe_path) == [True, False, False, False, False, True, False]
    assert [str(t) for t in values(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02", "soon", None], X.iso_time)] == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00", "None", "None"]
    assert values(spark, ["0", "1023", "1024", "-5", "1099511627776"], lambda x: X.byte_size(x.cast("long"))) == ["0.0 B", "1023.0 B", "1.0 KiB", "0.0 B", "1.0 TiB"]
    assert values(spark, ["a.WEBM", "b", "c.mp4"], X.mime) == ["video/webm", "video/mp4", "video/mp4"]


def test_byte_ranges(spark):
    got = values(spark, [None, "bytes=0-", "bytes=10-19", "bytes=-5", "bytes=-0", "bytes=100-", "nonsense"], lambda x: X.byte_range(x, F.lit(100)))
    assert [tuple(r) for r in got] == [(0, 99, 200), (0, 99, 206), (10, 19, 206), (95, 99, 206), (None, None, 416), (None, None, 416), (None, None, 416)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 11])
@pytest.mark.parametrize("q", [0.5, 0.75, 0.9])
def test_floor_quantile(spark, n, q):
    x = [float((7 * i) % 11) for i in range(n)]
    got = spark.createDataFrame([(x,)], "x array<double>").select(S.floor_quantile(F.col("x"), q)).first()[0]
    assert got == (sorted(x)[math.floor((n - 1) * q)] if n else 0.0)


def test_threshold_of_nothing_is_infinite(spark):
    assert spark.createDataFrame([([],)], "x array<double>").select(S.change_threshold(F.col("x"), 1.35)).first()[0] == math.inf


def test_tracks(spark):
    t = spark.createDataFrame([("a", "en", True), ("a", "de-AT", False), ("a", "fr", False), ("b", "live_chat", False), ("b", "xx", True)], "f string, lang string, automatic boolean")
    got = {r.f: r.lang for r in R.remote_track(t, ["f"], ("en", "de.*")).collect()}
    assert got == {"a": "de-AT", "b": "xx"}


def test_row_pack(spark):
    d = spark.createDataFrame([(x,) for x in (1, 6, 7, 8)], "n long").select(R.row_pack(F.col("n"), 4, 6).alias("p")).select("p.*")
    assert [tuple(r) for r in d.collect()] == [(1, 3, 4), (1, 0, 6), (2, 1, 4), (2, 0, 4)]


def test_similarity():
    assert speech.similarity("Hello, World", "hello world") == 1.0
    assert speech.similarity("hello", "hello there") == pytest.approx(0.78 + 0.22 * 5 / 10)
    assert speech.similarity("abc", "xyz") == 0.0
    assert speech.similarity("x / hello", "hello") == 1.0
    assert speech.similarity("ab/cd", "abcd") == pytest.approx(2 * 2 / 6)  # parts are compared, not the whole
    assert speech.similarity("!!", "a") == speech.similarity("", "") == 0.0


def test_options():
    assert profile("reader").max_sheet == 420.0
    with pytest.raises(ValueError, match="positive"):
        Options(sample_step=0)
    for bad in ({"fps": 0}, {"crop": 0.1}, {"width": 100}):
        with pytest.raises(ValueError, match="must"):
            Recognition(**bad)
    assert usable_range(-3, None, 60.0) == (0.0, 60.0) and usable_range(5, 99, 60.0) == (5, 60.0)
    with pytest.raises(ValueError, match="empty"):
        usable_range(60, 70, 60.0)
    assert (frame_rate(0.5), frame_rate(3.0), frame_rate(1 / 30)) == ("2/1", "1/3", "30/1") and (decimal_rate(2.0), decimal_rate(0.3333333)) == ("2", "0.333333")
    o = Options(max_gap=20.5, pins=(1.0, 2.5), max_keyframes=9)
    assert parsed(arguments(o)) == o and arguments(Options()) == []
    with pytest.raises(ValueError, match="option"):
        parsed(["--nothing", "1"])
