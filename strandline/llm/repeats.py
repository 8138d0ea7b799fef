"""Exact removal of repeated byte passages (suffix-array dedup).

Method: depth-limited radix sort. Suffixes are ordered only through their first
WINDOW bytes, most significant digit first; the equal groups that remain are
exactly the repeated windows. The first digit is content-defined: every window
is filed under the 24-byte gram with the smallest hash in it (its anchor), so
that equal windows meet in one group whatever document they stand in, and only
about one gram in fourteen is ever shuffled. Further passes take eight bytes at
a time within groups.

Passes, by exchange:

1. anchors: per document, runs of windows with one anchor, as two keys (anchor: its
   bucket and 40 bits more, whole run: 64 bits). Runs equal within a task are settled
   there, so a passage in a third of all rows sends one row a task.
2. groups: a run that stands in a smaller document is covered; where one anchor
   has different runs, the smallest document of each run is asked for its bytes.
3. windows: those bytes are radix-sorted, window by window.
4. cover: spans return to their documents.

Anchors with many different runs take the next digit, that of whole windows: each
window is filed under 128 bits of its own 50 bytes, so that it spreads over all
buckets, and equal ones within a task send one row. That is done in pass 1 for
anchors that a sample of documents (one in RATE) shows in more than HOT of them and
with over LEAST_HOT runs, and in pass 3 for those with over SPLIT different runs; either way results are the
same. So no task holds more than a share of one anchor.

Texts are shuffled once, by id; both passes that need them read that exchange.

Defined results: a null or empty text has 0 bytes, nothing is removed; a text
below WINDOW bytes keeps all. Rows with a null id take no part and keep all.
Rows that share an id count as one document: they never remove one another,
and each loses the union of the spans found under that id (they meet in one
task). An empty table gives an empty result; a text of any length is read in
pieces of PIECE bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T

U = np.uint64
GRAM = 24
PIECE = 1 << 18
LOW40 = U((1 << 40) - 1)
WIRE = "bucket int, kind int, p binary, q binary, r binary, s binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "pqrs")])
#: kinds: records of anchors, covered spans, covered runs by key, runs whose bytes are asked for, bytes of runs, runs whose windows are asked for, windows by key
RECORDS, SPANS, COVERED, ASKED, RUNS, WIDE, WINDOWS = range(7)
RATE, HOT, LEAST_HOT, MOST_HOT, SPLIT = 64, 1e-4, 1 << 14, 1 << 17, 20_000
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FULL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    m = len(data) - GRAM + 1
    h = np.zeros(m, U)
    for j in range(0, GRAM, 8):
        x = np.ndarray((m,), np.dtype("<u8"), buffer=data, offset=j, strides=(1,)).copy()
        x *= U(0x9E3779B97F4A7C15 + 2 * j)
        h ^= x
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def _pieces(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges with their rows; a long row is cut at fixed places of its own."""
    for i, j in T.chunks(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PIECE:
            yield a, b, i, j
        else:
            for s in range(a, b, PIECE):
                if s == a or b - s >= window:
                    yield s, min(s + PIECE + window - 1, b), i, j


def runs(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first and last window, gram hash, hash of the run's bytes."""
    found = []
    width = window - GRAM + 1
    for a, b, i, j in _pieces(offsets, window):
        if b - a < window:
            continue
        part = np.ascontiguousarray(data[a:b])
        h = _gram_hashes(part)
        low = U((1 << 20) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=U)
        s = 1
        while 2 * s <= width:
            least = np.minimum(least[:-s], least[s:])
            s *= 2
        if s < width:
            least = np.minimum(least[: -(width - s)], least[width - s :])
        at = np.arange(len(least))
        if j - i > 1:
            row = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))[: len(least)]
            fits = at + (a + window) <= offsets[row + 1]
            at, row, least = at[fits], row[fits], least[fits]
        else:
            row = np.full(len(at), i)
        if not len(at):
            continue
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        k = np.flatnonzero(new)
        lo, hi = at[k], at[np.append(k[1:], len(at)) - 1]
        anchor = (least[k] & low).astype(np.int64)
        found.append((row[k], lo + a, hi + a, h[anchor], T.span_hashes(part, lo, hi + window)))
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(U), e.astype(U)
    return tuple(np.concatenate(x) for x in zip(*found))


def window_keys(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of the windows at these places; both cover every byte."""
    words = np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))
    one, two = np.zeros(len(at), U), np.zeros(len(at), U)
    for k in [*range(0, window - 7, 8), window - 8]:
        x = words[at + k]
        one = T.mix(one ^ (x * U(0x9E3779B97F4A7C15) + U(k)))
        two = T.mix(two * U(0xD6E8FEB86659FD93) + (x ^ U(0xA5A5A5A5A5A5A5A5)))
    return one, two


def _windows_of(data: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """All windows of these runs: row, place and keys."""
    n = hi - lo + 1
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(row, n), at, *window_keys(data, at, window)


def _settle_windows(doc: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows by key: those that stand in a smaller document too, and one of the smallest document each."""
    o = np.lexsort((at, doc, two, one))
    new = np.append(True, (one[o][1:] != one[o][:-1]) | (two[o][1:] != two[o][:-1])) if len(o) else np.zeros(0, bool)
    least = doc[o][new][np.cumsum(new) - 1]
    return o[doc[o] > least], o[new]


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of overlapping or touching spans, by document."""
    if not len(doc):
        return doc, lo, hi
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    new = np.empty(len(doc), bool)
    new[0] = True
    new[1:] = doc[1:] != doc[:-1]
    first = np.cumsum(new) - 1
    base = first * (int(hi.max()) + 1)  # ends grow from document to document, so one running maximum serves all
    top = np.maximum.accumulate(hi + base)
    new[1:] |= lo[1:] + base[1:] > top[:-1]
    k = np.flatnonzero(new)
    return doc[k], lo[k], (top - base)[np.append(k[1:], len(doc)) - 1]


def _five(x: np.ndarray) -> bytes:
    return (x & U(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> U(32)).astype(np.uint8).tobytes()


def _five_back(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, "<u4", n).astype(U) | (np.frombuffer(x, np.uint8, n, 4 * n).astype(U) << U(32))


def _rle(doc: np.ndarray) -> tuple[bytes, bytes]:
    k = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    return doc[k].tobytes(), np.diff(np.append(k, len(doc))).astype(np.uint32).tobytes()


def _rle_back(p: bytes, q: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(p, np.int64), np.frombuffer(q, np.uint32))


class _Out:
    """Rows of the wire format, one for each bucket that gets something."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def split(self, bucket: np.ndarray, *then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        o = np.lexsort((*then, bucket))
        b = bucket[o]
        k = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        for s, e in zip(k, np.append(k[1:], len(b))):
            yield int(b[s]), o[s:e]

    def spans(self, n: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        doc, lo, hi = _merged(doc, lo, hi)
        for b, i in self.split(np.mod(doc, n), doc):
            self.rows.append((b, SPANS, doc[i].tobytes(), lo[i].tobytes(), hi[i].tobytes(), b""))

    def keys(self, kind: int, bucket: np.ndarray, doc: np.ndarray, r: np.ndarray | None, s: np.ndarray) -> None:
        for b, i in self.split(bucket, doc):
            p, q = _rle(doc[i])
            self.rows.append((b, kind, p, q, b"" if r is None else _five(r[i]), s[i].tobytes()))

    def windows(self, n: int, doc: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray, window: int) -> None:
        """Spans of those that stand in a smaller document of the same task; the others go on by key."""
        covered, first = _settle_windows(doc, at, one, two)
        self.spans(n, doc[covered], at[covered], at[covered] + window)
        doc, at, one, two = doc[first], at[first], one[first], two[first]
        for b, i in self.split((one % U(n)).astype(np.int64), two):
            self.rows.append((b, WINDOWS, doc[i].tobytes(), at[i].tobytes(), one[i].tobytes(), two[i].tobytes()))

    def take(self) -> pa.Table:
        columns = list(zip(*self.rows)) or [()] * 6
        self.rows = []
        return pa.table([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def count_anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Bytes of all texts (key 0), number of sampled ones (key 1), and different runs of each anchor in the sample (keys from 2, with n > 1)."""
    for batch in batches:
        data, offsets = T.flat(batch.column("sampled"))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 0]), pa.array([int(np.asarray(batch.column("n")).sum()), batch.num_rows - batch.column("sampled").null_count])], names=["key", "gram", "n"])
        for i, j in T.chunks(offsets, 1 << 23):
            o = offsets[i : j + 1]
            _, _, _, gram, run = runs(data[o[0] : o[-1]], o - o[0], window)
            gram = gram[np.unique(T.mix(gram ^ T.mix(run)), return_index=True)[1]]
            gram, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), 2)), pa.array(gram.view(np.int64)), pa.array(n)], names=["key", "gram", "n"])


def find_anchors(batches: Iterator[pa.RecordBatch], n: int, window: int, flush: int, hot: bytes) -> Iterator[pa.RecordBatch]:
    """Pass 1. flush: bytes of text after which what has been gathered is sent. hot: anchors whose windows are filed one by one, ascending."""
    held, wide, size, out, hot = [], [], 0, _Out(), np.frombuffer(hot, U)

    def send() -> Iterator[pa.RecordBatch]:
        if wide:
            out.windows(n, *(np.concatenate(x) for x in zip(*wide)), window)
            wide.clear()
        if not held:
            yield from out.take().to_batches()
            return
        doc, lo, hi, gram, run = (np.concatenate(x) for x in zip(*held))
        held.clear()
        both = T.mix(gram ^ T.mix(run))
        o = np.lexsort((doc, both))
        doc, lo, hi, gram, run, both = doc[o], lo[o], hi[o], gram[o], run[o], both[o]
        new = np.append(True, both[1:] != both[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        more = doc > least
        out.spans(n, doc[more], lo[more], hi[more] + window)
        gram, run, doc = gram[new], run[new], doc[new]
        out.keys(RECORDS, ((gram >> U(40)) % U(n)).astype(np.int64), doc, gram & LOW40, run)
        yield from out.take().to_batches()

    for batch in batches:
        data, offsets = T.flat(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in T.chunks(offsets, flush):
            o = offsets[i : j + 1]
            part = np.ascontiguousarray(data[o[0] : o[-1]])
            row, lo, hi, gram, run = runs(part, o - o[0], window)
            if len(row) and len(hot):
                m = _inside(gram, hot)
                if m.any():
                    of, at, one, two = _windows_of(part, row[m], lo[m], hi[m], window)
                    wide.append((ids[i:j][of], at - (o - o[0])[of], one, two))
                    row, lo, hi, gram, run = (x[~m] for x in (row, lo, hi, gram, run))
            if len(row):
                at = (o - o[0])[row]
                held.append((ids[i:j][row], lo - at, hi - at, gram, run))
            size += int(o[-1] - o[0])
            if size >= flush and (held or wide):
                yield from send()
                size = 0
    if held or wide:
        yield from send()


def _keyed_windows(out: _Out, table: pa.Table, n: int, window: int) -> None:
    """Spans of the windows of one bucket that stand in a smaller document."""
    table = table.filter(pa.array(np.asarray(table.column("kind")) == WINDOWS))
    if table.num_rows:
        got = [np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in zip("pqrs", (np.int64, np.int64, U, U))]
        covered, _ = _settle_windows(*got)
        doc, at = got[0][covered], got[1][covered]
        out.spans(n, doc, at, at + window)


def settle_groups(key, table: pa.Table, n: int, window: int, most: int) -> pa.Table:
    """Pass 2, for the anchors of one bucket, and windows that were filed one by one."""
    out = _Out()
    _keyed_windows(out, table, n, window)
    table = table.filter(pa.array(np.asarray(table.column("kind")) != WINDOWS))
    kinds = np.asarray(table.column("kind"))
    rows = {c: table.column(c).to_pylist() for c in "pqrs"}
    docs, ones, twos = [], [], []
    for i, kind in enumerate(kinds):
        if kind == SPANS:
            out.rows.append((key[0].as_py(), SPANS, *(rows[c][i] for c in "pqrs")))
            continue
        d = _rle_back(rows["p"][i], rows["q"][i])
        docs.append(d)
        ones.append(_five_back(rows["r"][i], len(d)))
        twos.append(np.frombuffer(rows["s"][i], U))
    if docs:
        doc, one, two = np.concatenate(docs), np.concatenate(ones), np.concatenate(twos)
        del docs, ones, twos, rows
        o = np.argsort(one)
        s = one[o]
        same = s[1:] == s[:-1]
        keep = o[np.append(same, False) | np.append(False, same)] if len(s) else o
        doc, one, two = doc[keep], one[keep], two[keep]
        if len(doc):
            o = np.lexsort((doc, two, one))
            doc, one, two = doc[o], one[o], two[o]
            group = np.append(True, one[1:] != one[:-1])
            run = group | np.append(True, two[1:] != two[:-1])
            first = doc[run][np.cumsum(run) - 1]
            starts = np.flatnonzero(group)
            g = np.cumsum(group) - 1
            least, top = np.minimum.reduceat(first, starts)[g], np.maximum.reduceat(first, starts)[g]
            asked = run & (least < top)
            large = np.add.reduceat(run, starts, dtype=np.int64)[g] > most
            for kind, take in ((COVERED, doc > first), (ASKED, asked & ~large), (WIDE, asked & large)):
                out.keys(kind, np.mod(doc[take], n), doc[take], None, two[take])
    return out.take()


def _by_doc(table: pa.Table, kinds: tuple[int, ...], ids: np.ndarray) -> dict[int, tuple]:
    """Keys or spans of a bucket, with the index of each document in ids."""
    got: dict[int, list] = {k: [] for k in kinds}
    kind = np.asarray(table.column("kind"))
    p, q, r, s = (table.column(c) for c in "pqrs")
    for i, k in enumerate(kind):
        if k == SPANS:
            got[SPANS].append((np.frombuffer(p[i].as_py(), np.int64), np.frombuffer(q[i].as_py(), np.int64), np.frombuffer(r[i].as_py(), np.int64)))
        else:
            d = _rle_back(p[i].as_py(), q[i].as_py())
            at = np.searchsorted(ids, d)
            got[k].append((at, _run_code(at, np.frombuffer(s[i].as_py(), U))))
    return {k: tuple(np.concatenate(x) for x in zip(*v)) if v else () for k, v in got.items()}


def _run_code(doc: np.ndarray, run: np.ndarray) -> np.ndarray:
    """A key of a run within a document, for documents of one bucket by number."""
    return T.mix(run ^ T.mix(doc.astype(U) + U(0x9E3779B97F4A7C15)))


def _texts(left: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = T.flat(left.column("text"))
    return left.column("doc_id").to_numpy().astype(np.int64), data, offsets


def _inside(x: np.ndarray, these: np.ndarray) -> np.ndarray:
    k = np.searchsorted(these, x)
    k[k == len(these)] = 0
    return these[k] == x


def read_runs(key, left: pa.Table, right: pa.Table, n: int, window: int) -> pa.Table:
    """Pass 3, for the documents of one bucket: covered runs as spans, asked runs as bytes."""
    out = _Out()
    left = left.filter(left.column("doc_id").is_valid())
    if not left.num_rows or not right.num_rows:
        return out.take()
    names = np.unique(left.column("doc_id").to_numpy())
    got = _by_doc(right, (SPANS, COVERED, ASKED, WIDE), names)
    covered, asked, wide = (np.sort(got[k][1]) if got[k] else np.zeros(0, U) for k in (COVERED, ASKED, WIDE))
    wanted = np.unique(np.concatenate([got[k][0] for k in (COVERED, ASKED, WIDE) if got[k]] or [np.zeros(0, np.int64)]))
    left = left.filter(pa.array(np.isin(left.column("doc_id").to_numpy(), names[wanted])))
    ids, data, offsets = _texts(left)
    spans = [got[SPANS]] if got[SPANS] else []
    width = window + window - GRAM
    for i, j in T.chunks(offsets, 1 << 23):
        o = offsets[i : j + 1]
        part = np.ascontiguousarray(data[o[0] : o[-1]])
        row, lo, hi, gram, run = runs(part, o - o[0], window)
        if not len(row):
            continue
        doc = ids[i:j][row]
        code = _run_code(np.searchsorted(names, doc), run)
        at = (o - o[0])[row]
        if len(covered):
            m = _inside(code, covered)
            spans.append((doc[m], lo[m] - at[m], hi[m] + window - at[m]))
        if len(asked):
            m = np.flatnonzero(_inside(code, asked))
            if len(m):
                size = hi[m] - lo[m] + window
                where = lo[m][:, None] + np.arange(width)
                text = part[np.minimum(where, len(part) - 1)]
                text[np.arange(width) >= size[:, None]] = 0
                bucket = ((gram[m] >> U(40)) % U(n)).astype(np.int64)
                for b, k in out.split(bucket):
                    g = gram[m][k] & LOW40
                    out.rows.append((b, RUNS, doc[m][k].tobytes(), (lo[m] - at[m])[k].tobytes(), _five(g) + size[k].astype(np.uint8).tobytes(), text[k].tobytes()))
        if len(wide):
            m = _inside(code, wide)
            if m.any():
                of, place, one, two = _windows_of(part, np.flatnonzero(m), lo[m], hi[m], window)
                out.windows(n, doc[of], place - at[of], one, two, window)
    if spans:
        out.spans(n, *(np.concatenate(x) for x in zip(*spans)))
    return out.take()


def radix_groups(digits: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Most-significant-digit passes over rows of digits: the group of equal rows each row ends in, -1 if it is alone."""
    n, depth = digits.shape
    final = np.full(n, -1, np.int64)
    alive = np.arange(n)
    for k in range(depth):
        d = digits[alive, k]
        o = np.lexsort((d, group))
        g, d, alive = group[o], d[o], alive[o]
        new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        alive, group = alive[many], number[many]
        if not len(alive):
            return final
    final[alive] = group
    return final


def sort_windows(key, table: pa.Table, n: int, window: int) -> pa.Table:
    """Pass 4, for the runs and windows of one bucket: windows that stand in a smaller document."""
    out = _Out()
    _keyed_windows(out, table, n, window)
    table = table.filter(pa.array(np.asarray(table.column("kind")) != WINDOWS))
    docs, at, grams, sizes, texts = [], [], [], [], []
    width = window + window - GRAM
    for kind, p, q, r, s in zip(*(table.column(c).to_pylist() for c in ("kind", *"pqrs"))):
        if kind == SPANS:
            out.rows.append((key[0].as_py(), SPANS, p, q, r, s))
            continue
        d = np.frombuffer(p, np.int64)
        docs.append(d)
        at.append(np.frombuffer(q, np.int64))
        grams.append(_five_back(r, len(d)))
        sizes.append(np.frombuffer(r, np.uint8, len(d), 5 * len(d)))
        texts.append(np.frombuffer(s, np.uint8).reshape(-1, width))
    if not docs:
        return out.take()
    doc, lo, gram, size, text = (np.concatenate(x) for x in (docs, at, grams, sizes, texts))
    del docs, at, grams, sizes, texts
    o = np.argsort(gram, kind="stable")
    starts = np.flatnonzero(np.append(True, gram[o][1:] != gram[o][:-1]))
    words = -(-window // 8)
    cover = []
    step = 2 * SPLIT  # runs that are expanded at once, of whole groups
    edges = np.append(starts, len(o))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + step, side="right")) - 1)
        i = o[edges[a] : edges[b]]
        a = b
        count = size[i].astype(np.int64) - window + 1
        of = np.repeat(i, count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        order = np.unique(gram[of], return_inverse=True)[1]
        buffer = np.zeros((len(of), words * 8), np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(text, window, axis=1)
        buffer[:, :window] = view[of, k]
        group = radix_groups(buffer.view(">u8").astype(U), order)
        m = np.flatnonzero(group >= 0)
        if not len(m):
            continue
        g, d = group[m], doc[of[m]]
        least = np.full(int(g.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, g, d)
        m = m[d > least[g]]
        cover.append((doc[of[m]], lo[of[m]] + k[m], lo[of[m]] + k[m] + window))
    if cover:
        out.spans(n, *(np.concatenate(x) for x in zip(*cover)))
    return out.take()


def cut_spans(key, left: pa.Table, right: pa.Table, full: bool) -> pa.Table:
    """Last pass, for the documents of one bucket."""
    spans = {}
    if right.num_rows:
        doc, lo, hi = _merged(*_by_doc(right, (SPANS,), np.zeros(0, np.int64))[SPANS])
        k = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        spans = {int(doc[s]): (lo[s:e], hi[s:e]) for s, e in zip(k, np.append(k[1:], len(doc)))}
    data, offsets = T.flat(left.column("text"))
    rows = []
    for i, d in enumerate(left.column("doc_id").to_pylist()):
        a, b = int(offsets[i]), int(offsets[i + 1])
        cuts = []
        if d in spans:
            cuts = [(int(x), min(int(y), b - a)) for x, y in zip(*spans[d]) if x < b - a]
        at, digest, parts = a, hashlib.sha256(), []
        for x, y in [*cuts, (b - a, b - a)]:
            piece = data[at : a + x].tobytes()
            digest.update(piece)
            if full:
                parts.append(piece)
            at = a + y
        row = (d, b - a, sum(y - x for x, y in cuts), len(cuts), digest.hexdigest())
        rows.append((*row, b"".join(parts), [{"start": x, "end": y} for x, y in cuts]) if full else row)
    types = [pa.int64()] * 4 + [pa.string()] + ([pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] if full else [])
    names = [x.strip().split(" ")[0] for x in (KEPT + ", kept, spans" if full else KEPT).split(",")]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)


def hot_anchors(docs: DataFrame, window: int, rate: int = RATE) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the anchors with different runs in many of the sampled documents, at most MOST_HOT.

    A guide for how windows are filed and nothing else; it reads one document in rate, by hash of its id.
    """
    some = docs.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"), F.when(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0, F.col("text")).alias("sampled"))
    counts = some.mapInArrow(T.shipped(__name__, "count_anchors", window), "key long, gram long, n long").groupBy("key", "gram").agg(F.sum("n").alias("n"))
    got = counts.filter((F.col("key") < 2) | (F.col("n") >= LEAST_HOT)).orderBy("key", F.desc("n"), "gram").limit(MOST_HOT).toArrow()
    key, gram, n = (np.asarray(got.column(c)) for c in ("key", "gram", "n"))
    total = {int(k): int(x) for k, x in zip(key[key < 2], n[key < 2])}
    return total.get(0, 0), np.sort(gram[(key == 2) & (n >= HOT * total.get(1, 0))].view(U))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, bucket_mb: int = 16, flush_mb: int = 12, full: bool = False, split: int = SPLIT, rate: int = RATE) -> DataFrame:
    """Remove every byte covered by a window that also starts in a document with a smaller id.

    documents: one row a document; other columns are not read.
    bucket_mb: MB of text to a bucket, which one Python task holds.
    full: also return the remaining bytes and the removed spans.
    split, rate: how many runs of an anchor are sorted together, and one in how many documents is sampled for hot anchors.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, spans).
    """
    if window < GRAM or window + window - GRAM > 255:
        raise ValueError("window must lie between 24 and 139 bytes")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size, hot = hot_anchors(docs.filter("doc_id is not null"), window, rate)
    n = max(12, -(-size // (bucket_mb << 20)))
    spread = lambda x: x.repartitionById(n, "bucket")
    ship = lambda f, *a: T.shipped(__name__, f, *a)
    anchors = docs.filter("doc_id is not null").mapInArrow(ship("find_anchors", n, window, flush_mb << 20, hot.tobytes()), WIRE)
    told = spread(anchors).groupBy("bucket").applyInArrow(_keyed(ship("settle_groups", n, window, split)), WIRE)
    placed = spread(docs.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(n)).cast("int")))
    left = lambda: placed.groupBy("bucket")
    read = left().cogroup(spread(told).groupBy("bucket")).applyInArrow(_keyed2(ship("read_runs", n, window)), WIRE)
    cover = spread(read).groupBy("bucket").applyInArrow(_keyed(ship("sort_windows", n, window)), WIRE)
    return left().cogroup(spread(cover).groupBy("bucket")).applyInArrow(_keyed2(ship("cut_spans", full)), FULL if full else KEPT)


def _keyed(f):
    def run(key, table):
        return f(key, table)

    return run


def _keyed2(f):
    def run(key, left, right):
        return f(key, left, right)

    return run
