"""What probes and records say about sources, and which source and subtitle a film gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.text import is_web, stem
from strandline.operators import ranking

CONTAINER = "struct<format:struct<duration:string,size:string,format_name:string>,streams:array<struct<index:int,codec_type:string,codec_name:string,profile:string,width:int,height:int>>>"
SUBTITLES = "struct<streams:array<struct<index:int,codec_name:string,tags:struct<language:string,title:string>,disposition:struct<default:int,forced:int,hearing_impaired:int>>>>"
REMOTE = "struct<id:string,title:string,webpage_url:string,duration:double,extractor:string,subtitles:map<string,array<struct<ext:string>>>,automatic_captions:map<string,array<struct<ext:string>>>>"
RECORD = "struct<version:int,source:string,video_path:string,subtitle_path:string,title:string,metadata:map<string,string>,prepared_at:string,last_accessed_at:string,source_media_deleted_at:string>"
LEAST_BYTES = 1 << 20


def container(probe: Column) -> Column:
    """struct(duration, size, format_name, streams) of a container probe; a text that isn't JSON ends the query."""
    d = F.from_json(probe, CONTAINER, {"mode": "FAILFAST"})
    return F.struct(d["format"]["duration"].try_cast("double").alias("duration"), d["format"]["size"].try_cast("long").alias("size"), d["format"]["format_name"].alias("format_name"), d["streams"].alias("streams"))


def subtitle_streams(probe: Column) -> Column:
    """index, codec, lang, title, commentary, is_default and forced of each subtitle stream; none of a text that isn't JSON."""
    d = F.from_json(probe, SUBTITLES)
    none = F.array().cast("array<struct<index:int,codec:string,lang:string,title:string,commentary:boolean,is_default:boolean,forced:boolean>>")
    aside = lambda t: F.lower(F.coalesce(t, F.lit(""))).rlike("commentary|director|signs|songs|forced")
    on = lambda x: F.coalesce(x != 0, F.lit(False))
    one = lambda s: F.struct(s["index"].alias("index"), F.lower(F.coalesce(s["codec_name"], F.lit(""))).alias("codec"), F.coalesce(s["tags"]["language"], F.lit("und")).alias("lang"), s["tags"]["title"].alias("title"), aside(s["tags"]["title"]).alias("commentary"), on(s["disposition"]["default"]).alias("is_default"), on(s["disposition"]["forced"]).alias("forced"))
    return F.coalesce(F.transform(d["streams"], one), none)


def remote(metadata: Column) -> Column:
    """REMOTE of an address's metadata; a text that isn't a JSON object ends the query."""
    d = F.from_json(metadata, REMOTE, {"mode": "FAILFAST"})
    return F.when(d.isNull() | ~F.ltrim(metadata).startswith("{"), F.raise_error(F.lit("not a metadata object")).cast(REMOTE)).otherwise(d)


def remote_tracks(metadata: DataFrame) -> DataFrame:
    """Tracks (lang, automatic) of metadata (key, meta as remote() has it)."""
    named = lambda c, auto: metadata.select("key", F.explode(F.map_keys(F.coalesce(f"meta.{c}", F.create_map().cast("map<string,array<struct<ext:string>>>")))).alias("lang"), F.lit(auto).alias("automatic"))
    return named("subtitles", False).unionByName(named("automatic_captions", True))


def video_problem(size: Column, duration: Column, allow_small: bool = False) -> Column:
    """Why a video can't be read; null if it can."""
    small = F.lit(False) if allow_small else size < LEAST_BYTES
    return F.when(size.isNull(), "there is no such video").when(small, "the video is small, as an incomplete download is").when(duration.isNull(), "the duration can't be read").when(duration <= 0, "the duration isn't positive")


def records(d: DataFrame) -> DataFrame:
    """Source records of (path, value); what can't be read counts as none."""
    r = d.select("path", F.from_json("value", RECORD).alias("r")).select("path", "r.*")
    return r.filter(F.col("source").isNotNull() | F.col("video_path").isNotNull())


def record_line(source: Column, video: Column, subtitle: Column, title: Column, metadata: Column, now: Column) -> Column:
    """A source record as JSON, as records() reads it."""
    return F.to_json(F.struct(F.lit(1).alias("version"), source.alias("source"), video.alias("video_path"), subtitle.alias("subtitle_path"), title.alias("title"), metadata.alias("metadata"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("prepared_at")))


def cached(wanted: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted sources (path, source) that a record in their folder serves: same source, its video there, and its subtitle if it names one.

    known: records(); files: path of every file that exists.
    """
    have = files.select(F.col("path").alias("__file")).distinct()
    r = wanted.join(known, ["path", "source"]).filter("video_path is not null and video_path <> ''")
    r = r.join(have, F.col("video_path") == F.col("__file"), "left_semi")
    there = r.filter("subtitle_path is null or subtitle_path = ''").unionByName(r.filter("subtitle_path <> ''").join(have, F.col("subtitle_path") == F.col("__file"), "left_semi"))
    return there.select("path", "source", "video_path", F.when(F.col("subtitle_path") != "", F.col("subtitle_path")).alias("subtitle_path"), F.coalesce(F.when(F.col("title") != "", F.col("title")), stem(F.col("video_path"))).alias("title"), "metadata", F.lit(True).alias("reused"))


def prepared(videos: DataFrame, sidecars: DataFrame, streams: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """The subtitle of each local video (film, video, explicit): the one that was named, else the best file beside it, else the best stream in it.

    sidecars and streams: as ranking takes them, by film. Returns film, kind
    (explicit, sidecar, embedded or null), subtitle, stream and title.
    """
    side = ranking.sidecar_file(sidecars, ["film"], preferred).select("film", F.col("name").alias("__side"))
    inner = ranking.embedded_track(streams, ["film"], preferred).select("film", F.col("index").alias("__index"))
    r = videos.join(side, "film", "left").join(inner, "film", "left")
    named = F.col("explicit") != ""
    kind = F.when(named, "explicit").when(F.col("__side").isNotNull(), "sidecar").when(F.col("__index").isNotNull(), "embedded")
    return r.select("film", kind.alias("kind"), F.when(named, F.col("explicit")).otherwise(F.col("__side")).alias("subtitle"), F.when(kind == "embedded", F.col("__index")).alias("stream"), stem(F.col("video")).alias("title"))


def source_kind(source: Column) -> Column:
    return F.when(is_web(source), "url").otherwise("local")


def opened(wanted: DataFrame, known: DataFrame, files: DataFrame, sidecars: DataFrame, streams: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """Sources to open (path, source, explicit): those a record serves, and local ones prepared from what lies beside and in them.

    Returns path, source, video_path, subtitle_path, title and reused; addresses
    without a record have no video yet.
    """
    have = cached(wanted.select("path", "source"), known, files).select("path", "source", "video_path", "subtitle_path", "title", "reused")
    rest = wanted.join(have.select("path", "source"), ["path", "source"], "left_anti")
    local = prepared(rest.select(F.col("path").alias("film"), F.col("source").alias("video"), "explicit"), sidecars, streams, preferred)
    video = F.when(source_kind(F.col("source")) == "local", F.col("source"))
    fresh = rest.join(local.withColumnRenamed("film", "path"), "path", "left").select("path", "source", video.alias("video_path"), F.when(video.isNotNull(), F.col("subtitle")).alias("subtitle_path"), stem(F.col("source")).alias("title"), F.lit(False).alias("reused"))
    return have.unionByName(fresh)
