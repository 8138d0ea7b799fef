"""Distinct sampled segmentations of texts: Gumbel top-k by perturbed A* search.

The vocabulary is that of a SentencePiece model file (path is a parameter; the
file is never changed or copied). A text is a lattice: nodes are byte offsets,
edges are pieces; characters without a piece go by byte pieces. The lattice falls
into units at places that no piece spans: between two bytes that no piece of the
vocabulary has next to each other, and in units over LONG bytes also wherever no
edge of the text crosses. So units are only a matter of speed, and a text without
such places is one unit, however long. A piece of merge rank r weighs
1 / (r + RANK_SHIFT), as merge models carry ranks and not probabilities.

Exact backward masses make every prefix a set of segmentations of known
probability. The search keeps open sets ("as this path up to a step, then another
piece") with the perturbed value of their best member, a Gumbel variable
truncated at that of the set they were cut from. The set with the highest value
is opened: its next piece and all later ones are drawn by their conditional
probability, which yields its best member, and the new path's own sets are
opened. So k rounds give the top k of Gumbel-perturbed segmentations, which is k
draws without replacement. The value of the best set left is the threshold for
inclusion scores, 1 - exp(-exp(log_prob - threshold)), which are given as
logarithms.

Every random number is a hash of row key, round, unit and step, so results don't
depend on partitions or batches. All texts of a chunk are searched together;
lattices are built once for each distinct unit of it.

Defined results: a null or empty text has one segmentation without pieces, and
any text at most as many samples as it has segmentations (fewer than k rows). A
null key counts as 0. Repeated rows give equal rows. An empty table gives an empty
result. Masses of long units are kept with exponents of their own, so that they
don't vanish; a unit's lattice is held whole, some 300 bytes of memory a byte. Decoding is exact for every
text, including literal U+2581.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T

U = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG, RANK_SHIFT = 56, 10.0  # masses of units up to LONG bytes can't vanish
CHUNK, SEARCH = 1 << 20, 1 << 17  # bytes of text whose units share a lattice, and that are searched together
DEEP, FLOOR, SLOTS = 60.0, 38.0, 1 << 20
SCHEMA = "doc_id long, sample int, ids array<int>, n_pieces long, n_bytes long, log_prob double, perturbed double, log_inclusion double"
_loaded: dict = {}


class Vocabulary:
    """Pieces by the hash of their bytes, with weights."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = []
        codes, ids, sizes = [], [], []
        self.byte_id = np.full(256, model.unk_id())
        weight = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                raw = bytes([int(piece[3:5], 16)])
                self.byte_id[raw[0]] = i
                weight[i] = 1.0 / (n + RANK_SHIFT)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw = b""
            else:
                raw = piece.replace("▁", " ").encode()
                weight[i] = 1.0 / (max(0.0, -model.get_score(i)) + RANK_SHIFT)
                codes.append(raw)
                ids.append(i)
            self.bytes.append(raw)
        self.weight = weight / weight.sum()
        data = np.frombuffer(b"".join(codes), np.uint8)
        ends = np.cumsum([len(c) for c in codes])
        self.beside = np.zeros(1 << 16, bool)  # pairs of bytes that stand next to each other in a piece
        pair = data[:-1].astype(np.int64) << 8 | data[1:]
        self.beside[np.delete(pair, ends[:-1] - 1)] = True
        h = T.span_hashes(data, ends - [len(c) for c in codes], ends)
        o = np.argsort(h)
        self.hash, self.id = h[o], np.array(ids)[o]
        self.longest = max(map(len, codes))
        # pieces by the low bits of their hashes: the first of a slot in the first table, and so on
        slot = (self.hash & U(SLOTS - 1)).astype(np.int64)
        o = np.argsort(slot, kind="stable")
        first = np.flatnonzero(np.append(True, slot[o][1:] != slot[o][:-1]))
        depth = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
        self.tables = [np.full(SLOTS, -1, np.int32) for _ in range(int(depth.max()) + 1)]
        for d, table in enumerate(self.tables):
            table[slot[o][depth == d]] = o[depth == d]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are pieces, and their ids."""
        slot = (h & U(SLOTS - 1)).view(np.int64)
        at = self.tables[0][slot]
        k = np.flatnonzero(at >= 0)
        at, want = at[k], h[k]
        good = self.hash[at] == want
        for table in self.tables[1:]:  # few slots have a second piece
            bad = np.flatnonzero(~good)
            other = table[slot[k[bad]]]
            hit = (other >= 0) & (self.hash[other] == want[bad])
            at[bad[hit]], good[bad[hit]] = other[hit], True
        return k[good], self.id[at[good]]


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _matches(raw: np.ndarray, stop: np.ndarray, vocab: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces in a flat buffer by length: where they start, and their ids. stop: where each byte's unit ends."""
    n = len(raw)
    p, q = T._pow(n + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(T.TABLE[raw] * p[:n], dtype=U)])
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    for k in range(1, vocab.longest + 1):
        at = at[at + k <= stop[at]]
        if not len(at):
            break
        found, ids = vocab.find(T.mix((total[at + k] - total[at]) * q[at] + U(k * 0x9E3779B97F4A7C15 & (2**64 - 1))))
        yield k, at[found], ids


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of spans one after another, where each span begins (and the last ends), and where each byte's span ends."""
    size = ends - starts
    base = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts - base[:-1], size) + np.arange(int(base[-1]))], base, np.repeat(base[1:], size)


def units(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of a flat buffer."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n:
        cut[1:n] |= ~vocab.beside[data[:-1].astype(np.int64) << 8 | data[1:]] & ((data[1:] & 0xC0) != 0x80)
    edge = np.flatnonzero(cut)
    long = np.flatnonzero(np.diff(edge) > LONG)
    if len(long):
        raw, base, stop = _gathered(data, edge[long], edge[long + 1])
        spanned = np.zeros(len(raw) + 1, np.int64)
        for k, at, _ in _matches(raw, stop, vocab):
            if k > 1:
                np.add.at(spanned, at + 1, 1)
                np.add.at(spanned, at + k, -1)
        free = np.flatnonzero((np.cumsum(spanned)[:-1] == 0) & ((raw & 0xC0) != 0x80))
        cut[free + np.repeat(edge[long] - base[:-1], np.diff(base))[free]] = True
        edge = np.flatnonzero(cut)
    return edge[:-1], edge[1:]


class Lattice:
    """Edges of distinct units: by node, with the probability of each given its node."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> None:
        raw, base, stop = _gathered(data, starts, ends)
        n = len(raw)
        node, target, piece = [], [], []
        alone = np.zeros(n, bool)  # characters that have a piece of their own
        lead = (raw & 0xC0) != 0x80
        follow = np.append(np.flatnonzero(lead), n)
        width = np.zeros(n, np.int64)
        width[follow[:-1]] = np.diff(follow)
        for k, i, ids in _matches(raw, stop, vocab):
            node.append(i)
            target.append(i + k)
            piece.append(ids)
            alone[i[width[i] == k]] = True
        own = np.maximum.accumulate(np.where(lead, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        i = np.flatnonzero(~alone[own])
        node.append(i)
        target.append(i + 1)
        piece.append(vocab.byte_id[raw[i]])
        count = np.bincount(np.concatenate(node), minlength=n)
        self.first = np.concatenate([[0], np.cumsum(count)])
        size = int(self.first[-1])
        self.node, self.target, self.piece = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, np.int32)
        filled = self.first[:-1].copy()
        for i, j, ids in zip(node, target, piece):  # a node has one edge of each length
            at = filled[i]
            self.node[at], self.target[at], self.piece[at] = i, j, ids
            filled[i] += 1
        del node, target, piece, filled
        final = self.target == stop[self.node]
        # masses from the end of each unit backwards
        far = stop[self.node] - self.node
        most = int(far.max(initial=0))
        far = far.astype(np.uint8 if most < 256 else np.uint16 if most < 1 << 16 else np.int64)
        o = np.argsort(far, kind="stable")
        cuts = np.searchsorted(far[o], np.arange(1, most + 2))
        mass, power = np.zeros(n + 1), np.zeros(n + 1 if most > LONG else 0, np.int64)  # a node's mass is mass * 2**power
        self.prob = vocab.weight[self.piece]
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = o[a:b]
            at = self.node[e]
            self.prob[e] *= np.where(final[e], 1.0, mass[self.target[e]])
            if len(power):
                up = np.where(final[e], 0, power[self.target[e]])
                power[at] = -(1 << 60)
                np.maximum.at(power, at, up)
                self.prob[e] = np.ldexp(self.prob[e], np.maximum(up - power[at], -2000))
            np.add.at(mass, at, self.prob[e])
            if len(power):
                one = np.unique(at)
                mass[one], shift = np.frexp(mass[one])
                power[one] += shift
                self.prob[e] = np.ldexp(self.prob[e], -shift[np.searchsorted(one, at)])
        self.target[final] = -1
        self.prob /= mass[self.node]
        with np.errstate(divide="ignore"):
            self.log = np.log(self.prob)
        # sums over a chunk in integers, so that none depends on what stands before it in the chunk
        self.fixed = np.rint(np.where(self.prob > 0, self.log, 0.0) * 2.0**36).astype(np.int64)
        share = (self.prob * 2.0**40).astype(np.int64)
        run = np.cumsum(share)
        self.cdf = (run - (run - share)[self.first[self.node]]) * 2.0**-40
        self.cdf[self.first[1:][np.diff(self.first) > 0] - 1] = 2.0
        self.start = base[:-1]

    def draw(self, node: np.ndarray, seed: np.ndarray, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to its unit's end, one path after another, and their number for each."""
        who, taken = np.arange(len(node)), []
        count = np.zeros(len(node), np.int64)
        at = node
        while len(who):
            x = T.uniform(T.mix(seed[who] + U((step + len(taken) + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))))
            edge = self.first[at]
            todo = np.flatnonzero(x >= self.cdf[edge])
            while len(todo):
                edge[todo] += 1
                todo = todo[x[todo] >= self.cdf[edge[todo]]]
            taken.append((who, edge))
            count[who] += 1
            at = self.target[edge]
            more = at >= 0
            who, at = who[more], at[more]
        out = np.empty(int(count.sum()), np.int64)
        first = np.cumsum(count) - count
        for k, (w, e) in enumerate(taken):
            out[first[w] + k] = e
        return out, count


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _pick(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each stretch (n + 1 offsets) and where it is; -inf and -1 of an empty one."""
    n = len(first) - 1
    best, where = np.full(n, -np.inf), np.full(n, -1)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        best[some] = np.maximum.reduceat(value, first[some])
        hit = np.flatnonzero(value == np.repeat(best, np.diff(first)))
        row = np.searchsorted(first, hit, side="right") - 1
        k = np.append(True, row[1:] != row[:-1])
        where[row[k]] = hit[k]
    return best, where


class _Path:
    """One sample of every document: edges in order, open sets' values, and where documents start."""

    def __init__(self, edge: np.ndarray, unit: np.ndarray, first: np.ndarray, opened: np.ndarray, value: np.ndarray, lattice: Lattice, seed: np.ndarray) -> None:
        self.edge, self.unit, self.first, self.value = edge, unit, first, value
        size = np.diff(first)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        log = lattice.fixed[edge]
        run = np.cumsum(log)
        head = np.zeros(len(size), np.int64)
        some = size > 0
        head[some] = (run - log)[first[:-1][some]]
        self.total = np.zeros(len(size))
        self.total[some] = (run[first[1:][some] - 1] - head[some]) * 2.0**-36
        self.before = (run - log - np.repeat(head, size)) * 2.0**-36
        self.left, self.open = np.zeros(len(edge)), np.full(len(edge), -np.inf)
        self._values(np.flatnonzero(self.before > -DEEP), opened, value, lattice, seed)
        # uniform() resolves 53 bits, so no set below -DEEP can reach the best ones, unless there is none above
        best = _pick(self.open, first)[0]
        if (best[some & (self.total < -DEEP)] < FLOOR - DEEP).any():
            self._values(np.flatnonzero(self.before <= -DEEP), opened, value, lattice, seed)

    def _values(self, i: np.ndarray, opened: np.ndarray, value: np.ndarray, lattice: Lattice, seed: np.ndarray) -> None:
        row = self.row[i]
        at = i - self.first[row]
        keep = at >= opened[row]
        i, row, at = i[keep], row[keep], at[keep]
        node = lattice.node[self.edge[i]]
        left = np.maximum(1.0 - lattice.prob[self.edge[i]], 0.0)
        left[lattice.first[node + 1] - lattice.first[node] == 1] = 0.0
        u = T.uniform(T.mix(seed[row] + at.astype(U) * U(0xC2B2AE3D27D4EB4F)))
        with np.errstate(divide="ignore"):
            self.open[i] = -np.logaddexp(-value[row], np.log(-np.log(u)) - self.before[i] - np.log(left))
        self.left[i] = left


def sample_chunk(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int, vocab: Vocabulary) -> Iterator[tuple[int, list[tuple[np.ndarray, ...]]]]:
    """Up to k samples of each text, for stretches of texts from a row on: arrays of (rows, edge pieces, n + 1 offsets, log_prob, perturbed, log_inclusion)."""
    starts, ends = units(data, offsets, vocab)
    row = T.rows_of(starts, offsets)
    h = T.span_hashes(data, starts, ends)
    _, one, kind = np.unique(h, return_index=True, return_inverse=True)
    lattice = Lattice(data, starts[one], ends[one], vocab)
    first = np.searchsorted(row, np.arange(len(offsets)))
    node = lattice.start[kind]
    del starts, ends, h, one, kind
    for i, j in T.chunks(offsets, SEARCH):
        yield i, search(lattice, node[first[i] : first[j]], first[i : j + 1] - first[i], keys[i:j], k)


def search(lattice: Lattice, node: np.ndarray, first_unit: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Perturbed A* over the texts whose units start at these nodes; first_unit: n + 1 offsets of the texts' units."""
    rows = len(first_unit) - 1
    row = np.repeat(np.arange(rows), np.diff(first_unit))
    index = np.arange(len(row)) - first_unit[row]
    seeds = [T.mix(keys.astype(np.int64).view(U) + U((s + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) for s in range(k)]
    unit_seed = lambda s: T.mix(seeds[s][row] + index.astype(U) * U(0xA0761D6478BD642F))
    with np.errstate(divide="ignore"):
        value = -np.log(-np.log(T.uniform(T.mix(seeds[0] + U(0x1234567)))))
    edge, steps = lattice.draw(node, unit_seed(0))
    stop = np.concatenate([[0], np.cumsum(steps)])
    paths = [_Path(edge, np.repeat(np.arange(len(row)), steps), stop[first_unit], np.zeros(rows, np.int64), value, lattice, T.mix(seeds[0] + U(99)))]
    alive = [np.ones(rows, bool)]
    used: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # path, position and edge of each document's opened sets
    for s in range(1, k + 1):
        tops = [_pick(p.open, p.first) for p in paths]
        values = np.stack([t[0] for t in tops])
        parent = values.argmax(0)
        value = values.max(0)
        if s == k:
            break
        go = np.flatnonzero(value > -np.inf)
        at = np.stack([t[1] for t in tops])[parent[go], go]
        old = np.empty(len(go), np.int64)
        unit = np.empty(len(go), np.int64)
        left, before = np.empty(len(go)), np.empty(len(go))
        for r, p in enumerate(paths):
            m = parent[go] == r
            old[m], unit[m], left[m], before[m] = p.edge[at[m]], p.unit[at[m]], p.left[at[m]], p.before[at[m]]
        where = lattice.node[old]
        x = T.uniform(T.mix(seeds[s][go] + U(0x77777))) * left
        new, chosen = np.full(len(go), -1), np.zeros(len(go), bool)
        e = lattice.first[where].copy()
        end = lattice.first[where + 1]
        last = np.full(len(go), -1)
        while True:  # over the few edges of a node
            live = np.flatnonzero((e < end) & ~chosen)
            if not len(live):
                break
            out = e[live] == old[live]
            for past_r, past_at, past_e in used:
                out |= (past_r[go[live]] == parent[go[live]]) & (past_at[go[live]] == at[live]) & (past_e[go[live]] == e[live])
            w = np.where(out, 0.0, lattice.prob[e[live]])
            last[live[~out]] = e[live[~out]]
            hit = ~out & (x[live] < w)
            new[live[hit]] = e[live[hit]]
            chosen[live[hit]] = True
            x[live] -= w
            e[live] += 1
        new = np.where(new < 0, last, new)
        fine = new >= 0
        for r, p in enumerate(paths):  # what remains of the opened sets
            m = (parent[go] == r) & fine
            i = at[m]
            p.left[i] = np.maximum(p.left[i] - lattice.prob[new[m]], 0.0)
            spare = lattice.first[where[m] + 1] - lattice.first[where[m]] > 2 + sum((pr[go[m]] == r) & (pa_[go[m]] == i) for pr, pa_, _ in used)
            u = T.uniform(T.mix(seeds[s][go[m]] + U(0x88888)))
            with np.errstate(divide="ignore"):
                v = -np.logaddexp(-value[go[m]], np.log(-np.log(u)) - before[m] - np.log(p.left[i]))
            p.open[i] = np.where(spare, v, -np.inf)
            m = (parent[go] == r) & ~fine
            p.open[at[m]] = -np.inf
        go, at, unit, new = go[fine], at[fine], unit[fine], new[fine]
        mark = [np.full(rows, -1) for _ in range(3)]
        mark[0][go], mark[1][go], mark[2][go] = parent[go], at, new
        used.append(tuple(mark))
        # the new paths: the parent's start, the new edge, the rest of its unit, all later units drawn anew
        target = lattice.target[new]
        inner = np.flatnonzero(target >= 0)
        rest, n_rest = lattice.draw(target[inner], unit_seed(s)[unit[inner]], 1 << 20)
        own = np.zeros(len(go), np.int64)
        own[inner] = n_rest
        later = np.zeros(len(row), bool)
        later_from = unit + 1
        size = first_unit[go + 1] - later_from
        u_index = _ranges(later_from, size)
        later[u_index] = True
        fresh, f_steps = lattice.draw(node[u_index], unit_seed(s)[u_index])
        f_unit = np.repeat(u_index, f_steps)
        f_stop = np.concatenate([[0], np.cumsum(f_steps)])
        u_stop = np.concatenate([[0], np.cumsum(size)])
        tail = f_stop[u_stop[1:]] - f_stop[u_stop[:-1]]
        pool_e = np.concatenate([*(p.edge for p in paths), new, rest, fresh])
        rest_unit = np.repeat(unit[inner], n_rest)
        pool_u = np.concatenate([*(p.unit for p in paths), unit, rest_unit, f_unit])
        shift = np.cumsum([0, *(len(p.edge) for p in paths)])
        head = np.empty(len(go), np.int64)
        for r, p in enumerate(paths):
            m = parent[go] == r
            head[m] = p.first[go[m]] + shift[r]
            at[m] += shift[r]
        rest_first = np.zeros(len(go), np.int64)
        rest_first[inner] = np.cumsum(n_rest) - n_rest
        begin = np.stack([head, shift[-1] + np.arange(len(go)), shift[-1] + len(go) + rest_first, shift[-1] + len(go) + len(rest) + f_stop[u_stop[:-1]]], 1)
        length = np.stack([at - head, np.ones(len(go), np.int64), own, tail], 1)
        take = _ranges(begin.ravel(), length.ravel())
        total = np.zeros(rows, np.int64)
        total[go] = length.sum(1)
        opened = np.zeros(rows, np.int64)
        opened[go] = length[:, 0] + 1
        paths.append(_Path(pool_e[take], pool_u[take], np.concatenate([[0], np.cumsum(total)]), opened, value, lattice, T.mix(seeds[s] + U(99))))
        live = np.zeros(rows, bool)
        live[go] = True
        alive.append(live)
    return [(np.flatnonzero(a), lattice.piece[p.edge], p.first, p.total, p.value, _log_inclusion(p.total - value)) for p, a in zip(paths, alive)]


def _log_inclusion(y: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(y))), also where that is far below what a double holds."""
    return np.where(y < -30, y, np.log(-np.expm1(-np.exp(np.clip(y, -30, 30)))))


def sample_batches(batches: Iterator[pa.RecordBatch], k: int, path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    sizes = np.array([len(b) for b in vocab.bytes])
    for batch in batches:
        data, offsets = T.flat(batch.column("text"))
        names = batch.column("doc_id")
        keys = names.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in T.chunks(offsets, CHUNK):
            o = offsets[i : j + 1]
            found = ((i + at, s, x) for at, parts in sample_chunk(data[o[0] : o[-1]], o - o[0], keys[i:j], k, vocab) for s, x in enumerate(parts))
            for at, s, (rows, piece, first, total, value, inclusion) in found:
                n = np.diff(first)[rows]
                held = np.concatenate([[0], np.cumsum(sizes[piece])])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(piece.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows + at)), pa.array(np.full(len(rows), s + 1, np.int32)), lists, pa.array(n), pa.array(held[first[rows + 1]] - held[first[rows]]), *(pa.array(x[rows]) for x in (total, value, inclusion))],
                    names=["doc_id", "sample", "ids", "n_pieces", "n_bytes", "log_prob", "perturbed", "log_inclusion"],
                )
        T.trim()


def decode(ids: list[int] | np.ndarray, path: str = MODEL) -> str:
    """The text of a segmentation."""
    vocab = vocabulary(path)
    return b"".join(vocab.bytes[i] for i in ids).decode("utf-8", "replace")


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else decode(x, path) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])


def sample_segmentations(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, path: str = MODEL) -> DataFrame:
    """Up to k distinct segmentations of every text, best perturbed value first: piece ids, their number, and the bytes they spell."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(T.shipped(__name__, "sample_batches", k, path), SCHEMA)


def decode_segmentations(samples: DataFrame, path: str = MODEL) -> DataFrame:
    """Texts of samples with doc_id, sample and ids."""
    return samples.select("doc_id", "sample", "ids").mapInArrow(T.shipped(__name__, "decode_batches", path), "doc_id long, sample int, text string")
