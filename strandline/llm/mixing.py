"""Mixing sources to target weights, by packed blocks and index permutations.

The words of each source are packed into blocks of one length, BLOCK words at most
and shorter in a source of few words, in an order of the documents that a two-level
prefix sum gives (sums of hash buckets first, then within a bucket), so that no task
sees a whole source. The mix is a row of slots, SHARD to an output shard. Each
source has as many slots as its target asks for, and a pseudorandom permutation of
all slots says which are whose: so the counts of sources in a shard are a multinomial
draw given the totals of the whole mix. (Free draws would miss the targets by one
over the root of the number of slots.) The j-th slot of a source is its block
p(j mod n), for a pseudorandom permutation p of its n blocks, so blocks repeat
evenly. Permutations are swap-or-not rounds on indices. Slots and blocks meet in a
join by source and index.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share all
words; a source stops at MOST times its words and the excess is reshared.

All of it is DataFrame expressions. What is windowed as a whole is one row a source
and one row a source and bucket. Random numbers are integer hashes of indices:
reruns agree.

Defined results: a null or empty text has no words, takes part with size 0, and
0 words are taken; a null source is a source of its own, the last; rows with a
null id are packed as any other; repeated rows are packed one after another. An
empty table gives an empty result. A text of any length is cut into as many pieces
as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared

WEIGHTS, MOST = (1, 2, 3), 3
BLOCK, LEAST_BLOCKS, SHARD, ROUNDS = 64, 512, 1024, 12
BUCKET_ROWS, MOST_BUCKETS, STRETCH = 1 << 12, 1 << 16, 1 << 14
PRIME = 2147483647
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _hashed(x: Column) -> Column:
    """A hash below 2**32 of an integer from 0 below 2**62, by shifts, sums and multiplications that fit a long."""
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    step = lambda h, k: low(h.bitwiseXOR(F.shiftright(h, 16)) * k)
    first = low(x) + F.shiftright(x, 32) * 73244475
    return F.aggregate(F.array(*(F.lit(k) for k in (73244475, 0x2C1B3C6D, 73244475))), low(first), step, lambda h: h.bitwiseXOR(F.shiftright(h, 16)))


def _shifts(n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The rounds of a permutation of n indices: what each reflects them about. key: which permutation, below 2**20."""
    about = lambda r: (_hashed(key * 4096 + r * 2) * (1 << 30) + _hashed(key * 4096 + r * 2 + 1)) % n
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")), lambda r: F.struct(about(r).alias("about"), (key * 64 + r).alias("code")))


def _permuted(x: Column, n: Column, shifts: Column) -> Column:
    """Index x below n to another, one to one, by swap-or-not rounds.

    One higher-order function: as columns of their own, rounds make the optimizer's constraints grow without end.
    """

    def step(acc: Column, r: Column) -> Column:
        other = (r["about"] + n - acc) % n
        return F.transform(F.array(other), lambda y: F.when(_hashed(F.greatest(acc, y) * 4096 + r["code"]) % 2 == 1, y).otherwise(acc))[0]

    return F.aggregate(shifts, x.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Each source with number, source_size, target, words to a block, n blocks, and slots. One row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("number", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("most", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything))
    order = everything.orderBy(F.col("most").cast("double") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("place", F.row_number().over(order))
    free = F.col("most") >= F.col("level") * F.col("weight")
    s = s.withColumn("level", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("place"))).over(everything))
    s = s.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    s = s.withColumn("n", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n") / F.col("source_size"))).otherwise(0).cast("long"))
    return s.select("source", "number", "source_size", "target", "block", "n", "slots")


def slots(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """All slots of the mix: number of the source, shard, slot, and block.

    Sources' slots are numbered one after another; the permutation of all numbers gives each its slot.
    """
    everything = Window.partitionBy(F.lit(0))
    ahead = everything.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    s = sources.filter("slots > 0").withColumn("ahead", F.coalesce(F.sum("slots").over(ahead), F.lit(0))).withColumn("all", F.sum("slots").over(everything))
    s = s.withColumn("whose", _shifts(F.col("all"), F.lit(0).cast("long"))).withColumn("which", _shifts(F.col("n"), F.col("number")))
    # slots of a source are made in stretches, dealt to tasks in turn
    total = sources.agg(F.sum("slots")).first()[0] or 0
    tasks = max(1, min(1 << 20, total // STRETCH))
    s = s.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(STRETCH).cast("long"))))
    s = s.withColumn("task", (F.floor((F.col("ahead") + F.col("from")) / STRETCH) % tasks).cast("int")).repartitionById(tasks, "task")
    s = s.withColumn("j", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + STRETCH, F.col("slots")) - 1)))
    s = s.withColumn("place", _permuted(F.col("ahead") + F.col("j"), F.col("all"), F.col("whose")))
    s = s.withColumn("drawn", _permuted(F.col("j") % F.col("n"), F.col("n"), F.col("which")))
    return s.select("number", F.floor(F.col("place") / shard).cast("long").alias("shard"), (F.col("place") % shard).cast("int").alias("slot"), F.col("drawn").alias("block"))


def sized(documents: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc_id, source, size, and text_key, by which rows without an id are spread."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("text_key"))


def packed(sizes: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Each row of sizes with its source's columns and start, the offset of its first word among its source's. rows: about how many."""
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    spread = F.pmod(F.coalesce("doc_id", "text_key"), F.lit(PRIME))
    at = sizes.withColumn("bucket", (spread * 48271 % PRIME % buckets).cast("int"))
    at = at.join(sources.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    sums = at.groupBy("number", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return at.join(sums.hint("merge"), ["number", "bucket"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("ahead", "inside", "bucket", "text_key")


def pieces(rows: DataFrame) -> DataFrame:
    """Each row of packed, once for each block it has words in: at (the block), from and to, in words of the document."""
    end = F.col("start") + F.col("size")
    cut = rows.filter("size > 0").withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block")))))
    return cut.withColumn("from", F.greatest(F.col("start"), F.col("at") * F.col("block")) - F.col("start")).withColumn("to", F.least(end, (F.col("at") + 1) * F.col("block")) - F.col("start"))


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken (its words in all slots) of every document."""
    sizes = _shared.written(sized(documents, id_col, source_col, text_col), "sizes")
    sources = _shared.written(targets(sizes, weights, most, block), "sources")
    rows = _shared.written(packed(sizes, sources, sizes.count()), "packed")
    times = slots(sources).groupBy("number", F.col("block").alias("at")).agg(F.count("*").alias("times"))
    held = pieces(rows).select("number", "at", "start", (F.col("to") - F.col("from")).alias("words"))
    taken = held.join(times.hint("merge"), ["number", "at"]).groupBy("number", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    some, none = rows.filter("size > 0").join(taken.hint("merge"), ["number", "start"], "left"), rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none, allowMissingColumns=True).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def emit(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: shard, slot, source, block, and the piece of a document that lies in the block (doc_id, from, to in words).

    A block over several documents gives several rows a slot.
    """
    sizes = _shared.written(sized(documents, id_col, source_col, text_col), "sizes")
    sources = _shared.written(targets(sizes, weights, most, block), "sources")
    held = pieces(packed(sizes, sources, sizes.count())).select("number", "source", F.col("at").alias("block"), "doc_id", "from", "to")
    return slots(sources).join(held.hint("merge"), ["number", "block"]).select("shard", "slot", "source", "block", "doc_id", "from", "to")


def remix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", count_col: str | None = "n_chars", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = 512) -> DataFrame:
    """The texts of the mix: for every slot, each piece of a document in its block, as a row of documents.

    The text is the piece's words and what stands between them; count_col, if there
    is such a column, is its number of characters; other columns are the document's.
    Documents of which no words are taken, and those without words, go.
    """
    row = F.struct(*documents.columns)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("text_key"), row.alias("row"))
    bare = rows.drop("row")
    sizes = _shared.written(bare.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "sizes")
    sources = _shared.written(targets(sizes, weights, most, block), "sources")
    held = packed(rows, sources, sizes.agg(F.sum("rows")).first()[0] or 0).filter("size > 0")
    # a word with the white space after it; what stands before the first word goes with that
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(r"(?:^[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit(0))
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    low = lambda b: F.greatest(F.col("start"), b * F.col("block")) - F.col("start")
    high = lambda b: F.least(F.col("start") + F.col("size"), (b + 1) * F.col("block")) - F.col("start")
    whole = F.array(F.struct(first.alias("at"), F.col("row")[text_col].alias("text")))
    cut = F.transform(F.array(words), lambda w: F.transform(F.sequence(first, last), lambda b: F.struct(b.alias("at"), F.array_join(F.slice(w, (low(b) + 1).cast("int"), (high(b) - low(b)).cast("int")), "").alias("text"))))[0]
    held = held.withColumn("piece", F.explode(F.when(first == last, whole).otherwise(cut)))
    plain = [c for c in documents.columns if c not in (text_col, count_col)]
    text = F.col("piece")["text"]
    held = held.select("number", F.col("piece")["at"].alias("block"), F.struct(*(F.col("row")[c].alias(c) for c in plain)).alias("row"), text.alias("text"))
    taken = slots(sources).join(held.hint("merge"), ["number", "block"])
    of = {text_col: F.col("text"), count_col: F.length("text").cast(dict(documents.dtypes).get(count_col, "long"))}
    return taken.select(*(of[c].alias(c) if c in of else F.col("row")[c].alias(c) for c in documents.columns))
