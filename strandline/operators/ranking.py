"""Choices of one track, file or version among many, and orders of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LANGUAGES = ("zh-hans", "zh-cn", "zh", "en", "ja")


def language_rank(lang: Column, preferred: tuple[str, ...]) -> Column:
    """Position of the first preference a language equals or extends (xx-*), else beyond all."""
    norm = F.lower(F.replace(lang, F.lit("_"), F.lit("-")))
    out = F.lit(len(preferred) + 100)
    for i, p in reversed(list(enumerate(preferred))):
        p = p.lower().replace("_", "-")
        fits = norm.startswith(p[:-2]) & ((F.length(norm) == len(p) - 2) | norm.startswith(p[:-2] + "-")) if p.endswith(".*") else (norm == p)
        out = F.when(fits, i).otherwise(out)
    return out


def best(df: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """The row of each key that comes first in an order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*carry), F.struct(*order)).alias("__best")).select(*keys, "__best.*")


def remote_track(tracks: DataFrame, keys: list[str], preferred: tuple[str, ...]) -> DataFrame:
    """Of tracks (lang, automatic): manual before automatic, then preference, then the shortest and first name; chat tracks don't count."""
    real = tracks.filter((F.col("lang") != "live_chat") & (F.col("lang") != ""))
    return best(real, keys, [F.col("automatic").cast("int"), language_rank(F.col("lang"), preferred), F.length("lang"), F.col("lang")], ["lang", "automatic"])


def embedded_track(streams: DataFrame, keys: list[str], preferred: tuple[str, ...]) -> DataFrame:
    """Of streams (index, codec, lang, commentary, is_default, forced): text codecs by language, no commentary, default, not forced, index."""
    text = streams.filter(F.col("codec").isin("subrip", "srt", "ass", "ssa", "webvtt", "mov_text", "text"))
    flags = [F.col("commentary").cast("int"), (~F.col("is_default")).cast("int"), F.col("forced").cast("int"), F.col("index")]
    return best(text, keys, [language_rank(F.col("lang"), preferred), *flags], ["index", "codec", "lang"])


def sidecar_file(files: DataFrame, keys: list[str], preferred: tuple[str, ...]) -> DataFrame:
    """Of files (stem_match, only_one, lang, ext, name): those of the same stem by language, ending and name; else the only one."""
    usable = files.filter(F.col("stem_match") | F.col("only_one"))
    return best(usable, keys, [(~F.col("stem_match")).cast("int"), language_rank(F.col("lang"), preferred), F.col("ext"), F.col("name")], ["name"])


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in by))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def notes_in_order(notes: DataFrame) -> DataFrame:
    """Notes (film_id, chunk, time, created_at) numbered by chunk, time (missing last) and creation."""
    w = Window.partitionBy("film_id").orderBy("chunk", F.col("time").asc_nulls_last(), "created_at")
    return notes.withColumn("place", F.row_number().over(w).cast("long"))


def row_pack(count: Column, base: int, most: int) -> Column:
    """struct(rows, empty, per_row): fewest rows, then fewest empty places, then fewest a row, of base to most a row."""
    options = F.transform(F.sequence(F.lit(base), F.lit(most)), lambda k: F.struct(F.ceil(count / k).cast("long").alias("rows"), (F.ceil(count / k) * k - count).cast("long").alias("empty"), k.cast("long").alias("per_row")))
    return F.array_min(options)
