"""Subtitle files (SRT, WebVTT, ASS) to cues, and cues to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandline.functions.text import clean_cue, strip
from strandline.functions.timecode import cue_id, read_stamp, show, subtitle_time
from strandline.operators.folds import rolled_up

FORMATS = ("srt", "vtt", "ass", "ssa")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of each file, with uniform line ends and without a byte-order mark."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return d.select("path", F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n").alias("value"))


def _blocks(d: DataFrame) -> DataFrame:
    """path, ord, and the lines of each block that has a line with an arrow, from that line on."""
    b = d.select("path", F.posexplode(F.split("value", r"\n[ \t]*(?:\n[ \t]*)+")).alias("ord", "block"))
    lines = b.select("path", F.col("ord").cast("long").alias("ord"), F.split("block", "\n").alias("lines"))
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), True).cast("int")
    return lines.withColumn("at", at).filter("at > 0").select("path", "ord", F.col("lines")[F.col("at") - 1].alias("timing"), F.slice("lines", F.col("at") + 1, F.size("lines")).alias("body"))


def _timed(b: DataFrame) -> DataFrame:
    stamps = F.regexp_extract_all("timing", F.lit(r"((?:\d+:)?\d{1,2}:\d{1,2}[,.]\d{1,3})"), F.lit(1))
    return b.withColumn("stamps", stamps).filter(F.size("stamps") >= 2).select("path", "ord", read_stamp(F.col("stamps")[0]).alias("start"), read_stamp(F.col("stamps")[1]).alias("end"), "body")


def srt(d: DataFrame, clean: bool = True) -> DataFrame:
    """Cues in the order of the file. clean=False keeps tags and line breaks and sorts by start."""
    rows = _timed(_blocks(d))
    body = F.array_join("body", "\n")
    text = clean_cue(body) if clean else strip(body)
    order = Window.partitionBy("path").orderBy(*(["ord"] if clean else ["start", "ord"]))
    return rows.select("path", "ord", "start", "end", text.alias("text")).filter("text <> ''").withColumn("ord", F.row_number().over(order).cast("long"))


def vtt(d: DataFrame) -> DataFrame:
    """Cues with speakers in brackets, rolling captions joined."""
    rows = _timed(_blocks(d))
    voiced = F.regexp_replace(F.array_join("body", "\n"), r"<v(?:\.[^\s>]*)?\s+([^>]+)>", "[$1] ")
    cues = rows.select("path", "ord", "start", "end", clean_cue(voiced).alias("text")).filter("text <> ''")
    rolled = cues.groupBy("path").agg(rolled_up(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "text")))).alias("c"))
    return rolled.select("path", F.posexplode("c").alias("pos", "c")).select("path", (F.col("pos") + 1).cast("long").alias("ord"), "c.start", "c.end", "c.text")


def ass(d: DataFrame, include: str | None = None, exclude: str | None = "JP|Ruby") -> DataFrame:
    """Dialogue of the Events section, by style, sorted, without repeats at a tenth of a second."""
    for pattern in (include, exclude):
        if pattern and len(pattern) > 200:
            raise ValueError("a style pattern has at most 200 characters")
    line = d.select("path", F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    head = F.when(F.col("line").rlike(r"^\s*\["), F.lower(F.trim("line")))
    line = line.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("path").orderBy("ord")))
    part = F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", 10)
    rows = line.filter((F.col("section") == "[events]") & F.col("line").startswith("Dialogue:")).select("path", "ord", part.alias("p")).filter(F.size("p") == 10)
    hundredths = lambda x: read_stamp(F.regexp_replace(F.trim(x), r"^(\d+:\d+:\d+)$", "$1.0"))
    rows = rows.select("path", "ord", hundredths(F.col("p")[1]).alias("start"), hundredths(F.col("p")[2]).alias("end"), F.trim(F.col("p")[3]).alias("style"), clean_cue(F.col("p")[9]).alias("text"))
    if include:
        rows = rows.filter(F.col("style").rlike(include))
    if exclude:
        rows = rows.filter(~F.col("style").rlike(exclude))
    return distinct_cues(rows.filter("text <> ''"), ["path"])


def distinct_cues(cues: DataFrame, keys: list[str]) -> DataFrame:
    """First of the cues with equal text and times to a tenth, in order of (start, end, text)."""
    tenth = lambda c: F.bround(F.col(c) * 10, 0)
    order = [F.col("start"), F.col("end"), F.col("text")]
    first = F.row_number().over(Window.partitionBy(*keys, tenth("start"), tenth("end"), "text").orderBy(*order))
    rows = cues.withColumn("__r", first).filter("__r = 1").drop("__r")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def read(spark: SparkSession, path: str | None, **options) -> DataFrame:
    """Cues of files, by the ending of path. None has no cues; another ending is an error."""
    if path is None:
        return spark.createDataFrame([], "path string, ord long, start double, end double, text string")
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"not a subtitle format: {kind}")
    d = texts(spark, path)
    return srt(d) if kind == "srt" else vtt(d) if kind == "vtt" else ass(d, **options)


def marked(cues: DataFrame, source: str = "source-subtitle") -> DataFrame:
    """Cues with the source they come from, where they don't name one."""
    named = F.coalesce("source", F.lit(source)) if "source" in cues.columns else F.lit(source)
    return cues.withColumn("source", named)


def together(*tracks: DataFrame) -> DataFrame:
    """All cues of several tracks, repeats included; columns that a track lacks are null."""
    out = tracks[0]
    for t in tracks[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def source_label(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, where its cues come from: burned-subtitle-ocr if all do, source-subtitle otherwise. Keys without cues have no row; their label is none."""
    ocr = F.bool_and(F.coalesce(F.col("source") == "burned-subtitle-ocr", F.lit(False)))
    return cues.groupBy(*keys).agg(F.when(ocr, "burned-subtitle-ocr").otherwise("source-subtitle").alias("label"))


def shifted(cues: DataFrame, offset: float, keys: list[str]) -> DataFrame:
    """Cues moved by offset: those that end before 0 go, starts stop at 0, numbered anew. Sources stay as they are."""
    if abs(offset) < 0.001:
        return cues
    moved = cues.withColumn("start", F.col("start") + offset).withColumn("end", F.col("end") + offset).filter(F.col("end") >= 0).withColumn("start", F.greatest("start", F.lit(0.0)))
    return moved.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "text")).cast("long"))


def srt_block(ord_: Column, start: Column, end: Column, text: Column, joined: bool = False) -> Column:
    """One block of an SRT file; joined texts get a line for each part."""
    body = F.replace(text, F.lit(" / "), F.lit("\n")) if joined else text
    return F.concat(ord_.cast("string"), F.lit("\n"), subtitle_time(start), F.lit(" --> "), subtitle_time(end), F.lit("\n"), body, F.lit("\n"))


def srt_text(cues: DataFrame, keys: list[str], joined: bool = False) -> DataFrame:
    """The SRT file of each key, as one value. joined: cues of several lines joined by slashes, as recognition gives them."""
    rows = cues.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "text"))).alias("c"))
    return rows.select(*keys, F.array_join(F.transform("c", lambda x: srt_block(x["ord"], x["start"], x["end"], x["text"], joined)), "\n").alias("srt"))


def sidecar_line(cue: Column, prefix: str = "S") -> Column:
    """id start-end: text, with the confidence of recognised cues where the struct has a source."""
    return _line(cue, prefix, F.lit(""))


def _line(cue: Column, prefix: str, mark: Column) -> Column:
    return F.concat(cue_id(prefix, cue["ord"], cue["start"]), F.lit(" "), show(cue["start"]), F.lit("-"), show(cue["end"]), mark, F.lit(": "), cue["text"])


def sidecar(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The text that goes with each chunk (keys, from, to, cues, heard, backend, model).

    cues: array of ord, start, end, text, source, confidence; heard: array of ord,
    start, end, text, null or empty without a transcript. ord counts from 1.
    """
    span = F.concat(show(F.col("from")), F.lit("-"), show(F.col("to")))
    burned = lambda c: F.coalesce(c["source"] == "burned-subtitle-ocr", F.lit(False))
    n = F.coalesce(F.size("cues"), F.lit(0))
    label = F.when(n <= 0, "none").when(F.forall("cues", burned), "burned-subtitle-ocr").otherwise("source-subtitle")
    mark = lambda c: F.when(burned(c), F.when(c["confidence"].isNull(), " [OCR]").otherwise(F.concat(F.lit(" [OCR "), F.format_string("%.2f", F.bround(c["confidence"], 2)), F.lit("]")))).otherwise("")
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("[subtitles "), span, F.lit(" source="), label, F.lit("]"))), F.coalesce(F.transform("cues", lambda c: _line(c, "S", mark(c))), none), F.array(F.lit("[/subtitles]")),
        F.when(
            F.size("heard") > 0,
            F.concat(F.array(F.lit(""), F.concat(F.lit("[audio-transcript "), span, F.lit(" source=audio-asr backend="), F.coalesce("backend", F.lit("unknown")), F.lit(" model="), F.coalesce("model", F.lit("unknown")), F.lit("]"))), F.transform("heard", lambda c: _line(c, "A", F.lit(""))), F.array(F.lit("[/audio-transcript]"))),
        ).otherwise(none),
    )
    return chunks.select(*keys, F.array_join(lines, "\n").alias("sidecar"))
