"""Near-duplicates by SuperMinHash, banding, verification and components.

1. Every text becomes its set of word shingles, a key of the whole set, and a
   SuperMinHash signature cut into bands. Texts with equal sets are one node from
   here on (the least id stands for them), so exact copies cost one row each.
2. Nodes that share a band meet: each band links its nodes to its least node, and
   components of these links are the clusters within which links can lie.
3. The sets of clustered nodes, and only those, are read again. A cluster over
   block_bytes is clustered anew by the rare items of its sets: with items in one
   order, rare ones first, two sets can only be alike enough if the first few items
   of each have one in common (prefix filter; exact in any order). Texts that share
   boilerplate and nothing else fall apart here. The order comes from counts of
   items in COUNTERS hash buckets, whatever the size of the input.
4. Sets are sent to their cluster, cut into blocks of bounded bytes. Within a block,
   the prefix filter by the block's own counts, sizes and positions leave candidates,
   which are verified on full sets, one node against many at once; what can't join
   two components isn't compared. The cluster's least node is compared with every block.
5. In clusters of several blocks, nodes that are not yet with the least node are
   compared with the other blocks too, so no link between different blocks is lost.
6. Components of the confirmed links are the result.

With 25 bands of 5 values a pair at similarity 0.85 shares no band with
probability 4e-7; pairs above, less. There is no cap on a band's nodes. With exact
set, clusters come from rare items alone, over all sets, and no pair is missed.

Defined results: null and empty texts, and texts without words, have an empty set
and are linked with nothing; texts of fewer words than a shingle have their whole
sequence as one. Rows without an id are left out of links, have no component and
are kept. Rows that share an id count as one document with several sets. An empty
table gives an empty result; a text of any length is one set, held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared, _text as T
from .graph import components
from .shingles import shingle_sets, super_minhash

U = np.uint64
BANDS, ROWS = 25, 5
SIGNED = "doc_id long, n_shingles long, code binary, bands array<long>"
SETS = "node long, cluster long, items binary"
_SETS = pa.schema([("node", pa.int64()), ("cluster", pa.int64()), ("items", pa.binary())])
COUNTERS = 1 << 18


def _bands(items: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = super_minhash(items, offsets, bands * rows).reshape(-1, bands, rows)
    h = np.zeros(s.shape[:2], U)
    for k in range(rows):
        h = T.mix(h + s[:, :, k] * U(2 * k + 3) + U(k + 1))
    return T.mix(h + np.arange(bands, dtype=U))


def sign_batches(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.flat(batch.column("text"))
        for i, j, items, o in shingle_sets(data, offsets, width):
            n = np.diff(o)
            h = _bands(items, o, bands, rows)
            one = np.concatenate([np.zeros(1, U), np.cumsum(T.mix(items), dtype=U)])
            two = np.concatenate([np.zeros(1, U), np.cumsum(T.mix(items ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U)])
            code = np.stack([one[o[1:]] - one[o[:-1]], two[o[1:]] - two[o[:-1]], n.astype(U)], 1)
            some = n > 0
            at = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(h[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array([r.tobytes() for r in code], pa.binary()), lists], names=["doc_id", "n_shingles", "code", "bands"])


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.flat(batch.column("text"))
        for i, j, items, o in shingle_sets(data, offsets, width):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), batch.column("cluster").slice(i, j - i), pa.array([items[o[k] : o[k + 1]].tobytes() for k in range(j - i)], pa.binary())], schema=_SETS)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many items of a task's sets fall into each hash bucket."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        items, _ = T.flat(batch.column("items"))
        total += np.bincount((items.view(U) & U(COUNTERS - 1)).view(np.int64), minlength=COUNTERS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["counter", "n"])


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least number of common items with which a set of n can be linked."""
    return -(-percent * n // 100)


def prefix_batches(batches: Iterator[pa.RecordBatch], counts: bytes, percent: int) -> Iterator[pa.RecordBatch]:
    """The first items of each set, rare ones first, of which a linked set must share one."""
    known = np.frombuffer(counts, np.int64)
    for batch in batches:
        data, offsets = T.flat(batch.column("items"))
        for i, j in T.chunks(offsets, 1 << 22):
            items = data[offsets[i] : offsets[j]].view(U)
            o = (offsets[i : j + 1] - offsets[i]) // 8
            n = np.diff(o)
            row = np.repeat(np.arange(j - i), n)
            order = np.lexsort((items, known[(items & U(COUNTERS - 1)).view(np.int64)], row))
            first = order[np.arange(len(items)) - o[:-1][row] <= (n - _need(n, percent))[row]]
            at = pa.array(row[first] + i)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("cluster").take(at), pa.array(items[first].view(np.int64))], names=["node", "cluster", "item"])


class _Block:
    """Nodes with their sets, items numbered by the block's own counts, rare ones first, and the components found so far."""

    def __init__(self, node: np.ndarray, items: list[bytes], percent: int) -> None:
        self.node, self.percent = node, percent
        self.size = np.array([len(x) // 8 for x in items], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        _, inverse, count = np.unique(np.frombuffer(b"".join(items), U), return_inverse=True, return_counts=True)
        del items
        rank = np.empty(len(count), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
        self.count = np.sort(count)
        item = rank[inverse]
        del inverse, rank
        self.item = item[np.lexsort((item, np.repeat(np.arange(len(node), dtype=np.int32), self.size)))]
        self.need = _need(self.size, percent)
        self.label = np.arange(len(node))
        seen: dict[int, int] = {}
        for i, x in enumerate(node.tolist()):  # rows that share an id
            self.label[i] = seen.setdefault(x, i)
        self.tested: dict[int, np.ndarray] = {}
        self.mark = np.zeros(len(count), bool)

    def join(self, i: int, j: int) -> None:
        x, y = sorted((self.label[i], self.label[j]), key=lambda r: self.node[r])
        self.label[self.label == y] = x

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes that share an item of their prefixes, and the item's place in each; of items with the same nodes, the first."""
        n = np.minimum(self.size, self.size - self.need + 1)  # of each set, its prefix
        keep = np.repeat(self.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.repeat(np.arange(len(self.node)), n)
        some = self.count[self.item[keep]] > 1
        keep, row = keep[some], row[some]
        o = np.argsort(self.item[keep], kind="stable")
        if not len(o):
            return
        row, keep = row[o], keep[o]
        x, place = self.item[keep], keep - self.first[row]
        k = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        end = np.append(k[1:], len(o))
        k, end, code = k[end - k > 1], end[end - k > 1], np.add.reduceat(T.mix(row.astype(U) + U(0x9E3779B97F4A7C15)), k)[end - k > 1]
        for g in np.sort(np.unique(code, return_index=True)[1]):
            yield row[k[g] : end[g]], place[k[g] : end[g]]

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are linked with node i, on full sets."""
        mine = self.item[self.first[i] : self.first[i + 1]]
        self.mark[mine] = True
        out = np.zeros(len(others), bool)
        step = max(1, (1 << 20) // max(1, int(self.size[others].max(initial=1))))
        for a in range(0, len(others), step):
            j = others[a : a + step]
            n = self.size[j]
            start = np.cumsum(n) - n
            hit = self.mark[self.item[np.repeat(self.first[j] - start, n) + np.arange(int(n.sum()))]]
            both = np.add.reduceat(hit, start, dtype=np.int64)
            out[a : a + step] = 100 * both >= self.percent * (n + len(mine) - both)
        self.mark[mine] = False
        return out

    def compare(self, i: int, at: int, others: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The nodes among others, of other components, that are linked with i; at and places: where the item they share stands."""
        go = self.label[others] != self.label[i]
        others, places = others[go], places[go]
        n, m = self.size[i], self.size[others]
        most = np.minimum(n - at, m - places)  # items in common, if none stands before this one
        go = (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (100 * most >= self.percent * (n + m - most))
        others = others[go]
        if i in self.tested:
            others = others[~np.isin(others, self.tested[i])]
        if not len(others):
            return others
        yes = self.alike(i, others)
        if not yes.all():
            self.tested[i] = np.union1d(self.tested.get(i, np.zeros(0, np.int64)), others[~yes])
        return others[yes]


def settle_block(key, table: pa.Table, percent: int) -> pa.Table:
    """Confirmed links of one block, as each node with the least of its component."""
    node = table.column("node").to_numpy()
    o = np.argsort(node, kind="stable")
    table = table.take(pa.array(o))
    block = _Block(node[o], table.column("items").to_pylist(), percent)
    for members, places in block.groups():
        for k in range(len(members) - 1):
            label = block.label[members[k:]]
            if (label == label[0]).all():
                break
            for j in block.compare(members[k], places[k], members[k + 1 :], places[k + 1 :]).tolist():
                block.join(members[k], j)
    return pa.table({"a": pa.array(block.node), "b": pa.array(block.node[block.label])})


def cross_blocks(key, left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links between some nodes of a cluster (left) and a block (right), where they share a prefix item and not yet a component."""
    links = []
    if left.num_rows and right.num_rows:
        n = left.num_rows
        both = pa.concat_tables([left.select(right.column_names), right])
        label = both.column("label").to_numpy()
        block = _Block(both.column("node").to_numpy(), both.column("items").to_pylist(), percent)
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            if block.label[i] != block.label[first.setdefault(x, i)]:
                block.join(i, first[x])
        for members, places in block.groups():
            for k in np.flatnonzero(members < n).tolist():
                for j in block.compare(members[k], places[k], members, places).tolist():
                    if block.label[j] != block.label[members[k]]:
                        block.join(members[k], j)
                        links.append((int(block.node[members[k]]), int(block.node[j])))
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each node linked with the least node that has the same keys."""
    least = rows.groupBy(*keys).agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(least, keys).filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def finer_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """node and label: the clusters of sets by the rare items they share. Nodes without such an item are linked with none and go."""
    counted = sets.mapInArrow(T.shipped(__name__, "count_batches"), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    first = _shared.written(sets.mapInArrow(T.shipped(__name__, "prefix_batches", counts.tobytes(), percent), "node long, cluster long, item long"), "prefixes")
    return components(_met(first, ["cluster", "item"]))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block_bytes: int = 16 << 20, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the least document of each component) for every document.

    Documents are linked where percent of their sets' union is shared.
    exact: find clusters without bands, at the cost of the sets of all documents.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = _shared.written(docs.mapInArrow(T.shipped(__name__, "sign_batches", width, bands, rows), SIGNED), "signed")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    nodes = known.groupBy("code").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    nodes = _shared.written(nodes, "nodes")
    if exact:
        every = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("cluster"), "text")
        cluster = finer_clusters(_shared.written(every.mapInArrow(T.shipped(__name__, "set_batches", width), SETS), "all_sets"), percent)
    else:
        cluster = components(_met(nodes.select("node", F.explode("bands").alias("band")), ["band"]))
    sizes = nodes.groupBy("node").agg(F.sum("n").alias("n"))
    cluster = _shared.written(cluster.join(sizes, "node").select("node", F.col("label").alias("cluster"), "n"), "clusters")
    blocks = lambda size: F.ceil(F.sum(size) / block_bytes).cast("int").alias("blocks")
    several = cluster.groupBy("cluster").agg(blocks(F.col("n") * 8)).filter("blocks > 1").select("cluster", F.lit(True).alias("large"))
    cut = not several.isEmpty()
    texts = docs.join(cluster.select(F.col("node").alias("doc_id"), "cluster").hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("node"), "cluster", "text")
    sets = texts.mapInArrow(T.shipped(__name__, "set_batches", width), SETS)
    if cut:
        sets = _shared.written(sets.join(several, "cluster", "left").select("node", "cluster", "items", "large"), "sets")
        finer = finer_clusters(sets.filter("large"), percent)
        sets = sets.join(finer, "node", "left").withColumn("cluster", F.when(F.col("large"), F.col("label")).otherwise(F.col("cluster"))).filter("cluster is not null").select("node", "cluster", "items")
        sets = _shared.written(sets, "finer")
        total = _shared.written(sets.groupBy("cluster").agg(blocks(F.length("items"))), "blocks")
        several = total.filter("blocks > 1")
        sets = sets.join(total, "cluster")
        own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        sets = sets.withColumn("block", F.explode(F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
        cut = not several.isEmpty()
    else:
        sets = sets.withColumn("block", F.lit(0))
    ship = lambda f: T.shipped(__name__, f, percent)
    links = sets.groupBy("cluster", "block").applyInArrow(_keyed(ship("settle_block")), "a long, b long")
    if cut:
        links = _shared.written(links, "confirmed")
        so_far = components(links)
        at = sets.join(several.select("cluster"), "cluster").filter("node <> cluster").join(so_far, "node", "left").withColumn("label", F.coalesce("label", "node"))
        at = _shared.written(at, "open")
        home = so_far.select(F.col("node").alias("cluster"), F.col("label").alias("home"))
        rest = at.join(home, "cluster", "left").filter(F.col("label") != F.coalesce("home", "cluster")).drop("home")
        own_block = F.col("block")
        rest = rest.select("node", "cluster", "items", "label", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != own_block)).alias("block"))
        left_bytes = rest.groupBy("cluster", "block").agg(F.ceil(F.sum(F.length("items")) / block_bytes).cast("int").alias("pieces"))
        rest = rest.join(left_bytes, ["cluster", "block"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
        against = at.select("node", "cluster", "items", "label", "block").join(left_bytes, ["cluster", "block"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        keys = ["cluster", "block", "piece"]
        columns = [*keys, "node", "label", "items"]
        rest = _shared.written(rest.select(columns), "rest")
        crossed = rest.groupBy(*keys).cogroup(against.select(columns).groupBy(*keys)).applyInArrow(_keyed2(ship("cross_blocks")), "a long, b long")
        label = components(links.unionByName(_shared.written(crossed, "crossed")))
    else:
        label = links.select(F.col("a").alias("node"), F.col("b").alias("label")).distinct()
    label = _shared.written(label, "components")
    home = nodes.select("code", "node").join(label, "node", "left").select("code", F.coalesce("label", "node").alias("home"))
    out = signed.join(home, "code", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("home", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _keyed(f):
    def run(key, table):
        return f(key, table)

    return run


def _keyed2(f):
    def run(key, left, right):
        return f(key, left, right)

    return run
