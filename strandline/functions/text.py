"""Text of cues, addresses and names, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def named(x: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of x, with x worked out once however often it stands there; a CASE works it out anew in each part."""
    return F.transform(F.array(x), made)[0]


def strip(x: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends. A single space is left as it stands."""
    return F.trim(F.regexp_replace(x, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def clean_cue(x: Column) -> Column:
    """A cue's text without override blocks, tags, and line-break escapes.

    An open bracket that isn't closed takes the rest of the text with it, as it is: else
    the rest would be read again from each of them.
    """

    def marked(x: Column) -> Column:
        plain = F.regexp_replace(x, r"\{[^}]*+\}|(\{[^}]*+)", "$1")
        plain = F.regexp_replace(plain, r"\\[Nnh]", " ")
        plain = F.regexp_replace(plain, r"<[^>]++>|(<[^>]*+)", "$1")
        return F.when(x.contains("{") | x.contains("<") | x.contains("\\"), plain).otherwise(x)

    return squeeze(named(x, marked))


def opening(x: Column, chars: int = 24, words: int = 6) -> Column:
    """The first words of a cue's text (characters, where it has CJK or no space), with dots after them; nothing of an empty or null one."""

    def cut(text: Column) -> Column:
        by_word = ~text.rlike(r"[㐀-鿿]") & text.contains(" ")
        head = F.when(by_word, F.substring_index(text, " ", words)).otherwise(F.substring(text, 1, chars))
        return F.when(text == "", "").otherwise(F.concat(F.regexp_replace(head, r"(?<![,.!?;:，。！？；：])[,.!?;:，。！？；：]+$", ""), F.lit("...")))

    return named(clean_cue(F.coalesce(x, F.lit(""))), cut)


def folded(x: Column) -> Column:
    """Letters and digits only, case folded."""
    return F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def meaningful(x: Column) -> Column:
    """Two CJK characters, or three characters with a letter or digit among them."""
    key = folded(x)
    return F.when(x.rlike(r"[㐀-鿿]"), F.length(key) >= 2).otherwise((F.length(key) >= 3) & key.rlike("[a-z0-9]"))


def asr_key(x: Column) -> Column:
    """Letters, digits and underscores only, case folded: by which recognised segments are told apart."""
    return F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"(?U)\W+", "")


_WEB = r"^[\x00-\x20]*((?i)https?)://([^/?#]+)([^?#]*)"


def public_url(x: Column) -> Column:
    """A web address without query, fragment, and parameters of its last part; anything else as it is, null as empty."""
    part = lambda i: F.regexp_extract(x, _WEB, i)
    return F.when(x.rlike(_WEB), F.concat(F.lower(part(1)), F.lit("://"), part(2), F.regexp_replace(part(3), ";[^/]*$", ""))).otherwise(F.coalesce(x, F.lit("")))


def is_web(x: Column) -> Column:
    """Whether x is an http or https address with a host; null isn't."""
    return F.coalesce(x.rlike(_WEB) & ~x.startswith("-"), F.lit(False))


def base_name(path: Column) -> Column:
    """The last part of a path, as a file has it."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(path, r"^\.$", ""), r"(?:/+\.)*/*$", ""), r"[^/]*$", 0)


def stem(path: Column) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_replace(base_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def slug(x: Column) -> Column:
    """A file name's worth of the stem of a path; film of nothing."""
    s = F.lower(F.regexp_replace(F.regexp_replace(stem(F.coalesce(x, F.lit(""))), r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", ""))
    return F.when(s == "", "film").otherwise(s)


def cache_folder(source: Column) -> Column:
    """The name of a source's folder: of an address, its last part or host and a hash; of a file, its name."""
    path = F.regexp_replace(F.regexp_extract(source, _WEB, 3), ";[^/]*$", "")
    name = base_name(F.regexp_replace(path, "/+$", ""))
    hint = F.when(name == "", F.regexp_extract(source, _WEB, 2)).otherwise(name)
    return F.when(is_web(source), F.concat(slug(hint), F.lit("-"), short_hash(source))).otherwise(slug(stem(source)))


def preferences(x: Column) -> Column:
    """The parts of a comma-separated list that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), strip), lambda p: p != "")


def layout(x: Column) -> Column:
    """struct(columns, rows) of a layout like 4x3; null where it is none."""
    form = r"^\s*(\d+)[xX](\d+)\s*$"
    part = lambda i: F.try_to_number(F.regexp_extract(x, form, i), F.lit("999999999")).cast("int")
    return F.when(x.rlike(form) & (part(1) > 0) & (part(2) > 0), F.struct(part(1).alias("columns"), part(2).alias("rows")))


def iso_time(x: Column) -> Column:
    """A time in ISO form, in UTC where it names no zone; null where it can't be read."""
    return F.try_to_timestamp(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), x))


def safe_id(x: Column) -> Column:
    """Whether an id names a folder of its own: no separators, no dots that lead elsewhere, not hidden."""
    return F.coalesce((x != "") & ~x.rlike(r"[/\\]") & ~x.contains("..") & ~x.startswith("."), F.lit(False))


def safe_path(x: Column) -> Column:
    """Whether a relative path stays within its root."""
    y = F.replace(x, F.lit("\\"), F.lit("/"))
    return F.coalesce((x != "") & ~y.startswith("/") & ~y.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def short_label(cue: Column) -> Column:
    """A cue's id without its time."""
    head = F.substring_index(F.coalesce(cue, F.lit("")), "_", 1)
    return F.when(head == "", "S").otherwise(head)


def text_colour(r: Column, g: Column, b: Column) -> Column:
    """dark on a light ground, else light."""
    return F.when((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255 > 0.55, "dark").otherwise("light")


def short_hash(x: Column, n: int = 10) -> Column:
    return F.substring(F.sha2(x, 256), 1, n)


def byte_size(x: Column) -> Column:
    """Bytes for people: B, KiB, MiB, GiB, TiB with one decimal."""
    x = F.greatest(x.cast("double"), F.lit(0.0))
    out = F.format_string("%.1f TiB", F.bround(x / float(1 << 40), 1))
    for unit, power in (("GiB", 30), ("MiB", 20), ("KiB", 10), ("B", 0)):
        out = F.when(x < float(1 << (power + 10)), F.format_string(f"%.1f {unit}", F.bround(x / float(1 << power), 1))).otherwise(out)
    return out


def mime(name: Column) -> Column:
    known = {"mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm", "mkv": "video/x-matroska", "mov": "video/quicktime"}
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in known.items() for v in kv)), ext), F.lit("video/mp4"))


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end, status) of a range header: 206, 200 without one, 416 where it can't be met."""
    first, last = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2))
    valid = header.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    start = F.when(first == "", F.greatest(F.lit(0), size - F.when(last != "", last.cast("long")))).otherwise(F.when(first != "", first.cast("long")))
    end = F.when((first == "") | (last == ""), size - 1).otherwise(F.least(size - 1, F.when(last != "", last.cast("long"))))
    status = F.when(header.isNull(), 200).when(~valid | (start >= size) | (start > end), 416).otherwise(206)
    return F.struct(F.when(status == 206, start).when(status == 200, 0).cast("long").alias("start"), F.when(status == 206, end).when(status == 200, size - 1).cast("long").alias("end"), status.alias("status"))
