"""Times of day and of media, as Column expressions over seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def show(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; halves round to even, nothing is below 0."""
    s = F.bround(F.greatest(seconds, F.lit(0.0)), 0).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def subtitle_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000, 0).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def read(code: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS, whose parts may have fractions; null if it is none of them."""
    fine = code.rlike(r"^\s*\d+(\.\d+)?(:\d+(\.\d+)?){0,2}\s*$")
    return F.when(fine, F.aggregate(F.split(F.trim(code), ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double")))


def read_or_fail(code: Column) -> Column:
    """As read(), but what can't be read ends the query."""
    value = read(code)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(code, F.lit("null")))).cast("double")).otherwise(value)


def read_strict(code: Column) -> Column:
    """As read(), but only H:MM:SS may have a fraction among codes with colons."""
    return F.when(code.rlike(r"^\s*(\d+(\.\d+)?|\d+:\d{1,2}|\d+:\d{1,2}:\d{1,2}(\.\d+)?)\s*$"), read(code))


def read_stamp(stamp: Column) -> Column:
    """Seconds of a subtitle stamp: hours optional, fraction after a comma or point, padded on the right."""
    part = lambda i: F.regexp_extract(stamp, r"(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?", i)
    number = lambda x: F.when(x == "", 0).otherwise(F.when(x != "", x.cast("int")))
    fine = stamp.rlike(r"(?:(\d+):)?\d{1,2}:\d{1,2}")
    ms = F.rpad(part(4), 3, "0")
    return F.when(fine, number(part(1)) * 3600 + number(part(2)) * 60 + number(part(3)) + number(ms) / 1000.0)


def pins(codes: Column) -> Column:
    """Distinct times of a comma-separated list, ascending, to 3 decimals."""
    parts = F.filter(F.transform(F.split(codes, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.bround(read(x), 3))))


def cue_id(prefix: str, ordinal: Column, start: Column) -> Column:
    """Prefix, ordinal (from 1) of two digits or more, and the start in tenths, 0 at least."""
    return F.format_string(f"{prefix}%02d_%d", ordinal.cast("int"), F.greatest(F.lit(0), F.bround(start * 10, 0).cast("long")))
