"""Manifests of chunks, their notes, and the tables a reader asks.

A manifest is a JSON document a film with its sheets (chunks); notes are a JSON
document with annotations and replies. Broken notes end a query, broken state
does not: it counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from strandline.functions import timecode as C
from strandline.operators.ranking import latest

KEYFRAME = "struct<id:string,time:double,score:double,reason:string,event_time:double,subtitle_anchor:struct<id:string,text:string,distance:double,source:string>>"
SHEET = f"struct<index:bigint,time_range:array<double>,duration:double,candidate_keyframes:bigint,sample_count:bigint,audio_sample_count:bigint,subtitle_count:bigint,audio_transcript_count:bigint,keyframes:array<{KEYFRAME}>,sheet:string,sidecar:string>"
MANIFEST = f"title string, generation_id string, video string, subtitle string, generated_at string, sheets array<{SHEET}>"
NOTE = "struct<id:string,chunk_index:bigint,timecode:string,time_seconds:double,kind:string,visibility:string,author:string,text:string,created_at:string,replies:array<struct<id:string,author:string,text:string,created_at:string>>>"
NOTES = f"version int, annotations array<{NOTE}>"
STATE = "cursor bigint, generation_id string, last_timecode double"
VIDEO = (".mp4", ".mkv", ".mov", ".webm", ".m4v")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """film_id (the path of the file), and the manifest's fields."""
    d = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return d.withColumn("film_id", F.input_file_name()).withColumn("sheets", F.coalesce("sheets", F.array().cast(f"array<{SHEET}>")))


def sheets(manifest: DataFrame) -> DataFrame:
    """One row a sheet, with pos, its place in order of index."""
    s = manifest.select("film_id", "title", "generation_id", F.explode("sheets").alias("s")).select("film_id", "title", "generation_id", "s.*")
    pos = F.row_number().over(Window.partitionBy("film_id").orderBy("index")) - 1
    return s.withColumn("from", F.col("time_range")[0]).withColumn("to", F.col("time_range")[1]).withColumn("pos", pos.cast("long"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """One row a note, with its place in the document; documents that don't hold annotations end the query."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("film_id"), F.from_json("value", NOTES, {"mode": "FAILFAST"}).alias("d"))
    checked = F.when(F.col("d.annotations").isNull(), F.raise_error(F.lit("no annotations")).cast(f"array<{NOTE}>")).otherwise(F.col("d.annotations"))
    return d.select("film_id", F.posexplode(checked).alias("place", "n")).select("film_id", F.col("place").cast("long").alias("place"), "n.*")


def states(spark: SparkSession, path: str) -> DataFrame:
    """Readers' cursors; what can't be read is at the start."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("film_id"), F.from_json("value", STATE).alias("s"))
    return d.select("film_id", F.coalesce("s.cursor", F.lit(0)).alias("cursor"), "s.generation_id", "s.last_timecode")


def films(files: DataFrame, cues: DataFrame) -> DataFrame:
    """The library: for files (film_id, name, bytes), the first video and first .srt by name, number of cues, and the end of the cue that starts last."""
    visible = files.filter(~F.col("film_id").startswith("."))
    first = lambda fits, what: F.min_by(F.when(fits, what), F.when(fits, F.col("name")))
    video = F.lit(False)
    for ending in VIDEO:
        video = video | F.lower("name").endswith(ending)
    f = visible.groupBy("film_id").agg(first(video, F.col("name")).alias("video"), first(video, F.col("bytes")).alias("bytes"), first(F.lower("name").endswith(".srt"), F.col("name")).alias("subtitle"))
    c = cues.groupBy("film_id").agg(F.count("*").alias("cues"), F.max_by("end", F.struct("start", "end")).alias("duration"))
    return f.filter("video is not null").join(c, "film_id", "left").withColumn("cues", F.coalesce("cues", F.lit(0)))


def overview(sheet: DataFrame) -> DataFrame:
    """A line a chunk: range, and counts of keyframes, cues and transcript cues."""
    return sheet.select("film_id", "pos", "index", C.show(F.col("from")).alias("starts"), C.show(F.col("to")).alias("ends"), F.size("keyframes").cast("long").alias("keyframes"), F.coalesce("subtitle_count", F.lit(0)).alias("subtitles"), F.coalesce("audio_transcript_count", F.lit(0)).alias("transcripts"))


def sheet_at(sheet: DataFrame, index: int) -> DataFrame:
    """The first sheet of that index of each film; a film without it ends the query."""
    found = sheet.filter(F.col("index") == index)
    films = sheet.select("film_id").distinct()
    first = found.groupBy("film_id").agg(F.min_by(F.struct(*sheet.columns), "pos").alias("s"))
    missing = F.raise_error(F.concat(F.lit(f"no sheet {index} in "), F.col("film_id").cast("string")))
    checked = films.join(first, "film_id", "left").withColumn("s", F.when(F.col("s").isNull(), missing.cast(first.schema["s"].dataType)).otherwise(F.col("s")))
    return checked.select("s.*")


def clock_range(start: Column, end: Column) -> Column:
    return F.concat(C.show(start), F.lit("-"), C.show(end))


def note_lines(note: DataFrame) -> DataFrame:
    """film_id, index and lines of the notes of each chunk, in the order of their document, replies after each; notes without a chunk have index -1."""
    head = F.trim(F.concat_ws(" ", F.coalesce("id", F.lit("")), F.coalesce("timecode", F.lit("")), F.concat(F.coalesce("kind", F.lit("note")), F.lit(": "), F.coalesce("text", F.lit("")))))
    head = F.regexp_replace(head, r"^(\S+)  ", "$1 ")
    reply = lambda r: F.concat(F.lit("\n  reply "), F.coalesce(r["id"], F.lit("")), F.lit(": "), F.coalesce(r["text"], F.lit("")))
    line = F.concat(head, F.coalesce(F.array_join(F.transform("replies", reply), ""), F.lit("")))
    rows = note.select("film_id", F.coalesce("chunk_index", F.lit(-1)).cast("long").alias("index"), "place", line.alias("line"))
    return rows.groupBy("film_id", "index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def packets(sheet: DataFrame, note: DataFrame) -> DataFrame:
    """What a reader gets of each chunk: its time and keyframes, where it goes on, its notes, and its text.

    sheet: sheets() with running (whether its film is still being generated).
    """
    opening = lambda k: F.coalesce(F.concat(F.lit(' "'), F.nullif(k["subtitle_anchor"]["text"], F.lit("")), F.lit('"')), F.lit(""))
    keys = F.array_join(F.transform("keyframes", lambda k: F.concat(F.coalesce(k["id"], F.lit("K")), F.lit(" "), C.show(F.coalesce(k["time"], F.lit(0.0))), opening(k))), " | ")
    w = Window.partitionBy("film_id")
    follows = F.lead(F.struct("index", "from", "to")).over(w.orderBy("pos"))
    s = sheet.withColumn("follows", follows).withColumn("last", F.greatest(F.count("*").over(w) - 1, F.lit(0))).join(note_lines(note), ["film_id", "index"], "left")
    number = lambda x: F.lpad(x.cast("string"), 3, "0")
    ahead = F.when(F.col("follows").isNotNull(), F.concat(F.lit("next: chunk "), number(F.col("follows.index")), F.lit(" "), clock_range(F.col("follows.from"), F.col("follows.to"))))
    ahead = ahead.when(F.col("running"), "next: waiting for the next generated sheet").otherwise("next: end of available generated sheets")
    text = F.concat_ws(
        "\n", F.lit("[chunk]"), F.concat(F.lit("title: "), F.coalesce("title", F.lit("Film"))), F.concat(F.lit("chunk: "), number(F.col("index")), F.lit("/"), number(F.col("last"))),
        F.concat(F.lit("time: "), clock_range(F.col("from"), F.col("to"))), F.concat(F.lit("duration_seconds: "), F.coalesce(F.col("duration").cast("string"), F.lit("None"))), F.concat(F.lit("keyframes: "), F.coalesce(keys, F.lit(""))), ahead,
        F.lit(""), F.lit("[notes]"), F.col("lines"), F.lit("[/notes]"), F.lit(""), F.coalesce("sidecar", F.lit("")), F.lit("[/chunk]"),
    )
    return s.select("film_id", "pos", "index", text.alias("packet"))


def read_chunk(sheet: DataFrame, note: DataFrame) -> DataFrame:
    """packets() of films whose generation has ended."""
    return packets(sheet.withColumn("running", F.lit(False)), note)


def new_notes(asked: DataFrame, sheet: DataFrame) -> DataFrame:
    """Notes to append, for requests (film_id, chunk_index, text, timecode, author, created_at, and kind and visibility if they differ from the usual).

    A request for a chunk that isn't there, or without text, ends the query.
    """
    have = {c: F.col(c) if c in asked.columns else F.lit(v) for c, v in (("kind", "observation"), ("visibility", "user"))}
    s = sheet.groupBy("film_id", F.col("index").alias("chunk_index")).agg(F.min_by(F.array("from", "to"), "pos").alias("chunk_time_range"))
    r = asked.withColumns(have).join(s, ["film_id", "chunk_index"], "left").withColumn("text", F.trim("text"))
    fault = F.when(F.col("chunk_time_range").isNull(), F.concat(F.lit("no sheet "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("null")))).when(F.coalesce("text", F.lit("")) == "", "a note needs a text")
    text = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("text"))
    name = F.concat(F.lit("N"), F.substring(F.sha2(F.concat_ws("\0", F.col("film_id").cast("string"), F.col("chunk_index").cast("string"), "author", "created_at", "timecode", "text"), 256), 1, 8))
    return r.select("film_id", name.alias("id"), "chunk_index", "chunk_time_range", F.coalesce("timecode", F.lit("")).alias("timecode"), C.read_strict(F.col("timecode")).alias("time_seconds"), "kind", "visibility", "author", text.alias("text"), "created_at")


def new_replies(asked: DataFrame, note: DataFrame) -> DataFrame:
    """Replies to append, for requests (film_id, note_id, text, author, created_at); one to a note that isn't there, or without text, ends the query."""
    known = note.select("film_id", F.col("id").alias("note_id")).distinct().withColumn("__known", F.lit(True))
    r = asked.join(known, ["film_id", "note_id"], "left").withColumn("text", F.trim("text"))
    fault = F.when(F.col("__known").isNull(), F.concat(F.lit("no note "), F.coalesce("note_id", F.lit("null")))).when(F.coalesce("text", F.lit("")) == "", "a reply needs a text")
    text = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("text"))
    name = F.concat(F.lit("R"), F.substring(F.sha2(F.concat_ws("\0", F.col("film_id").cast("string"), "note_id", "author", "created_at", "text"), 256), 1, 8))
    return r.select("film_id", "note_id", name.alias("id"), "author", text.alias("text"), "created_at")


def job_report(jobs: DataFrame, alive: DataFrame, sheet: DataFrame, tail: int = 20) -> DataFrame:
    """How far each film's generation is: status, available sheets, the end of its log, and what a reader past the last chunk is told.

    jobs: film_id, status, phase, pid, log; alive: pid of every process; sheet:
    film_id and index. A job that says it runs and whose process is gone has
    stopped; sheets without a job are a manifest that is available.
    """
    up = alive.select("pid").distinct().withColumn("__up", F.lit(True))
    r = jobs.join(up, "pid", "left").join(sheet.groupBy("film_id").agg(F.count("*").alias("available")), "film_id", "full").withColumn("available", F.coalesce("available", F.lit(0)))
    said = F.lower(F.coalesce("status", F.lit("")))
    status = F.when(F.col("status").isNull(), F.when(F.col("available") > 0, "manifest-available").otherwise("unknown")).when(said.isin("running", "running-untracked"), F.when(F.col("__up"), "running").otherwise("stopped")).otherwise(F.col("status"))
    r = r.withColumn("status", status).withColumn("phase", F.coalesce("phase", "status"))
    lines = F.split(F.coalesce("log", F.lit("")), "\n")
    rest = F.array_join(F.slice(lines, F.greatest(F.size(lines) - tail + 1, F.lit(1)), F.lit(max(tail, 0))), "\n")
    waiting = F.concat(F.lit("[waiting]\navailable_sheets: "), F.col("available").cast("string"), F.lit("\nphase: "), F.col("phase"), F.lit("\nThe next chunk isn't generated yet.\n[/waiting]"))
    over = F.concat(F.lit("[end]\navailable_sheets: "), F.col("available").cast("string"), F.lit("\ngeneration_status: "), F.col("status"), F.lit("\nNo later generated chunk is available.\n[/end]"))
    kind = F.when(F.col("status") == "running", "waiting").otherwise("end")
    return r.select("film_id", "status", "phase", "available", rest.alias("log_tail"), kind.alias("kind"), F.when(kind == "waiting", waiting).otherwise(over).alias("message"))


def document(note: DataFrame, reply: DataFrame) -> DataFrame:
    """The notes document of each film as JSON, from its tables of notes and replies; notes() reads it."""
    r = reply.groupBy("film_id", "note_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", "author", "text"))), lambda x: F.struct(x["id"].alias("id"), x["author"].alias("author"), x["text"].alias("text"), x["created_at"].alias("created_at"))).alias("replies"))
    n = note.drop("replies").join(r.withColumnRenamed("note_id", "id"), ["film_id", "id"], "left").withColumn("replies", F.coalesce("replies", F.array().cast(r.schema["replies"].dataType)))
    one = F.struct("created_at", "id", F.struct("id", "chunk_index", "timecode", "time_seconds", "kind", "visibility", "author", "text", "created_at", "replies").alias("n"))
    packed = n.groupBy("film_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["n"]).alias("annotations"))
    return packed.select("film_id", F.to_json(F.struct(F.lit(1).alias("version"), "annotations")).alias("value"))


def locate(sheet: DataFrame, time: float | None = None, words: str | None = None) -> DataFrame:
    """Chunks that hold a time (first), then those whose text holds the words; each once."""
    hit = F.lit(None).cast("int")
    if words is not None:
        hit = F.when(F.contains(F.lower(F.coalesce("sidecar", F.lit(""))), F.lower(F.lit(words))), 1).otherwise(hit)
    if time is not None:
        inside = (F.col("from") <= time) & (F.col("to") >= time)
        first = F.min(F.when(inside, F.col("pos"))).over(Window.partitionBy("film_id"))
        found = sheet.withColumn("__first", first)
        hit = F.when(F.col("pos") == F.col("__first"), 0).otherwise(hit)
        return found.withColumn("rank", hit).filter("rank is not null").drop("__first")
    return sheet.withColumn("rank", hit).filter("rank is not null")


def without(manifest_sheets: DataFrame, start: int | None = None, replaced: int | None = None) -> DataFrame:
    """Sheets before a resumed run: none from start on, and not the one that is replaced."""
    out = manifest_sheets
    if start is not None:
        out = out.filter(F.col("index") < start)
    if replaced is not None:
        out = out.filter(F.col("index") != replaced)
    return out


def manifest_document(film: DataFrame, sheet: DataFrame) -> DataFrame:
    """The manifest of each film (film_id, title, generation_id, video, subtitle, generated_at) as JSON, from the table of its sheets; manifests() reads it."""
    fields = [f.name for f in T.StructType.fromDDL(SHEET.removeprefix("struct<").removesuffix(">")).fields if f.name in sheet.columns]
    packed = sheet.groupBy("film_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sheets"))
    names = ["title", "generation_id", "video", "subtitle", "generated_at"]
    return film.select("film_id", *names).join(packed, "film_id", "left").select("film_id", F.to_json(F.struct(*names, F.coalesce("sheets", F.array().cast(packed.schema["sheets"].dataType)).alias("sheets"))).alias("value"))


def upserted(registry: DataFrame, fresh: DataFrame, by: str = "last_accessed_at") -> DataFrame:
    """Registry with fresh entries; of one path the later stays."""
    return latest(registry.unionByName(fresh), ["path"], [F.col(by)])


def with_source(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """Manifests with the source that was prepared for their video."""
    return manifest.join(sources.select(F.col("video_path").alias("video"), F.struct("source", "title", "metadata").alias("source")), "video", "left")


def track_list(subtitle: Column, transcript: Column) -> Column:
    """The text tracks a film has."""
    return F.filter(F.array(F.when(subtitle.isNotNull(), F.struct(F.lit("subtitle").alias("kind"), subtitle.alias("path"))), F.when(transcript.isNotNull(), F.struct(F.lit("transcript").alias("kind"), transcript.alias("path")))), lambda x: x.isNotNull())
