"""WARC records and a Merkle fixity audit of replicas.

Records are WARC/1.0 responses, filed by the number of their page: FILE pages to
a file, RANGE pages to a range. Within a file records lie in order of page and
digest, each at its offset, so a range of pages is a range of offsets. A tree's
leaves are the records' digests; a node of level 0 covers one range, a node of a
higher level FANOUT nodes below it. Ranges are cut by page and not by offset, so
a lost or longer record changes its own range and not those after it. Roots are
compared first, and only nodes that differ are descended, level by level, down to
the records of the ranges that differ; those are matched as multisets.

A node's hash covers its number of children and the sums of their digests, taken
in words of SLICE hex digits. Every child's digest covers its own place, so order
counts, and sums are pre-aggregated before each shuffle: a range that holds a
third of all records, as under one page id, is never gathered. All of it is
DataFrame expressions; each level of a tree is written once.

Defined results: a null url or body is empty. A row with a null id is numbered by
its url's hash, below 0. Rows that share an id are records of their own; of these,
as many as differ between the replicas are reported, first altered ones (paired in
order of digest), then missing or extra ones. An empty table gives an empty audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared

FILE, RANGE, FANOUT, LEVELS, SLICE = 1024, 64, 16, 4, 8
_WORDS = range(0, 64, SLICE)


def record(url: Column, body: Column) -> Column:
    """The bytes of a response record."""
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce(body, F.lit(""))).cast("string"), F.lit("\r\n\r\n"))
    return F.encode(F.concat(head, F.coalesce(body, F.lit("")), F.lit("\r\n\r\n")), "UTF-8")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", size: int = FILE) -> DataFrame:
    """Records of pages: file, number, page_id, offset, length and digest.

    Offsets are sums over the pages of a file and the first SLICE / 2 digits of
    their digests, then within these, so records of one page id share no task.
    """
    page = F.col(id_col).cast("long")
    number = F.coalesce(page, -1 - F.pmod(F.xxhash64(F.coalesce(F.col(url_col), F.lit(""))), F.lit(1 << 40)))
    rows = pages.select(number.alias("number"), page.alias("page_id"), record(F.col(url_col), F.col(body_col)).alias("bytes"))
    rows = rows.select(F.floor(F.col("number") / size).cast("long").alias("file"), "number", "page_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    rows = _shared.written(rows.withColumn("part", F.substring("digest", 1, SLICE // 2)), "records")
    keys = ["file", "number", "part"]
    ahead = Window.partitionBy("file").orderBy("number", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum("length").alias("held")).select(*keys, F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*keys).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(sums, keys)
    return placed.select("file", "number", "page_id", (F.col("offset") + F.col("ahead")).alias("offset"), "length", "digest")


def _hashed(rows: DataFrame, keys: list[str], child: Column) -> DataFrame:
    """keys and hash: the number of children and the sums of their hashes' words."""
    rows = rows.select(*keys, F.sha2(child, 256).alias("__child"))
    word = lambda k: F.conv(F.substring("__child", k + 1, SLICE), 16, 10).cast("long")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.sum(word(k)).alias(f"__{k}") for k in _WORDS))
    return sums.select(*keys, F.sha2(F.concat_ws(":", "__n", *(f"__{k}" for k in _WORDS)), 256).alias("hash"))


def nodes(index: DataFrame, size: int = RANGE) -> DataFrame:
    """Nodes of level 0: file, node, hash."""
    ranged = index.withColumn("node", F.floor(F.col("number") / size).cast("long"))
    return _hashed(ranged, ["file", "node"], F.concat_ws(":", "number", "length", "digest"))


def above(below: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes one level up."""
    up = below.select("file", F.floor(F.col("node") / fanout).cast("long").alias("node"), F.concat_ws(":", "node", "hash").alias("child"))
    return _hashed(up, ["file", "node"], F.col("child"))


def tree(index: DataFrame, size: int = RANGE, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The levels of an index's trees from the ranges up, each written and computed from the one below."""
    found = [_shared.written(nodes(index, size), "level0")]
    for k in range(1, levels):
        found.append(_shared.written(above(found[-1], fanout), f"level{k}"))
    return found


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """file and node of the nodes that differ or that one side lacks."""
    both = a.withColumnRenamed("hash", "__a").join(b.withColumnRenamed("hash", "__b"), ["file", "node"], "full")
    return both.filter(~F.col("__a").eqNullSafe(F.col("__b"))).select("file", "node")


def audit(left: DataFrame, right: DataFrame, size: int = RANGE, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Records that differ between two replicas' indexes (file, number, page_id, offset, length, digest).

    file, offset, page_id, expected and found (digests, null where a side lacks the
    record), kind: altered, missing or extra. offset is that in the left index, of
    extra records that in the right one; of equal records under one id, the first's.
    """
    trees = [tree(index, size, fanout, levels) for index in (left, right)]
    differing = _differing(trees[0][-1], trees[1][-1])
    for level in range(levels - 2, -1, -1):
        parents = differing.withColumnRenamed("node", "__up")
        below = [t[level].withColumn("__up", F.floor(F.col("node") / fanout).cast("long")).join(parents, ["file", "__up"], "left_semi").drop("__up") for t in trees]
        differing = _differing(*below)
    ranges = differing.withColumnRenamed("node", "__range")
    found = [index.withColumn("__range", F.floor(F.col("number") / size).cast("long")).join(ranges, ["file", "__range"], "left_semi").withColumn("__side", F.lit(side)) for side, index in enumerate((left, right))]
    on = lambda side, x: F.when(F.col("__side") == side, x)
    keys = ["file", "number", "page_id"]
    counted = found[0].unionByName(found[1]).groupBy(*keys, "digest").agg(*(F.count(on(s, F.lit(1))).alias(f"__n{s}") for s in (0, 1)), *(F.min(on(s, F.col("offset"))).alias(f"__at{s}") for s in (0, 1)))
    alone = _shared.written(counted.filter("__n0 <> __n1"), "differing")
    sides = []
    for s in (0, 1):
        rows = alone.filter(F.col(f"__n{s}") > F.col(f"__n{1 - s}")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"__n{s}") - F.col(f"__n{1 - s}"))))
        place = F.row_number().over(Window.partitionBy("file", "number").orderBy("digest", "__copy"))
        sides.append(rows.select("file", "number", place.alias("__place"), F.col("page_id").alias(f"__page{s}"), F.col(f"__at{s}").alias(f"__offset{s}"), F.col("digest").alias(("expected", "found")[s])))
    both = sides[0].join(sides[1], ["file", "number", "__place"], "full")
    kind = F.when(F.col("expected").isNull(), "extra").when(F.col("found").isNull(), "missing").otherwise("altered")
    return both.select("file", F.coalesce("__offset0", "__offset1").alias("offset"), F.coalesce("__page0", "__page1").alias("page_id"), "expected", "found", kind.alias("kind"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with planted faults: every 97th body from 13 has its first character replaced, every 211th record from 5 is lost."""
    body = F.when(F.col("page_id") % 97 == 13, F.overlay(F.coalesce("html", F.lit("")), F.lit("~"), F.lit(1))).otherwise(F.col("html"))
    return pages.filter(~(F.col("page_id") % 211).eqNullSafe(F.lit(5))).select("page_id", "url", body.alias("html"))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Archive pages, archive a damaged replica anew, and audit it."""
    return audit(_shared.written(archive(pages), "index"), _shared.written(archive(damaged(pages)), "replica"))
