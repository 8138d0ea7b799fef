"""Word shingles of texts as sorted sets of 52-bit hashes, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import _text as T

U = np.uint64
CHUNK = 1 << 20
ROWS = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows i to j: the distinct shingles of all of them, ascending within a row, and their j - i + 1 offsets.

    A-Z are lower-cased, words are runs of bytes other than space and \\x09 to
    \\x0D. A text of fewer words than width has its whole sequence as one
    shingle, one without words has none.
    """
    for a, b in T.chunks(offsets, CHUNK):
        for i in range(a, b, ROWS):
            j = min(i + ROWS, b)
            o = offsets[i : j + 1] - offsets[i]
            part = T.LOWER[data[offsets[i] : offsets[j]]]
            starts, ends = T.words(part, o)
            row = T.rows_of(starts, o)
            n = np.bincount(row, minlength=j - i)
            if not len(starts):
                yield i, j, np.zeros(0, U), np.zeros(j - i + 1, np.int64)
                continue
            h = T.span_hashes(part, starts, ends)
            whole = np.zeros(len(h), U)
            first = np.cumsum(n) - n
            for k in range(width):
                if len(h) > k:
                    m = len(h) - k
                    short = row[k:] == row[:m]
                    whole[:m] += np.where(short, T.mix(h[k:] + U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))), U(0))
            at = np.arange(len(h)) - first[row]
            use = (at + width <= n[row]) | ((n[row] < width) & (at == 0))
            code = T.mix(whole[use] + np.minimum(n[row[use]], width).astype(U)) >> U(12)
            key = np.unique(row[use].astype(U) << U(52) | code)
            where = np.append(np.searchsorted(key, np.arange(j - i, dtype=U) << U(52)), len(key))  # ROWS << 52 would be past 64 bits
            yield i, j, key & U((1 << 52) - 1), where


def super_minhash(items: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures of sets: one row of m values for each, all ones where the set is empty.

    Each element walks a random permutation of the m slots and leaves (step,
    random) in the slot it reaches; the least value of a slot counts. Values of
    a later step are always larger, so a set stops at the step after which all
    its slots are filled, which for large sets is the first or second.
    """
    rows = len(offsets) - 1
    top = U(2**64 - 1)
    signature = np.full(rows * m, top, U)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    step = lambda e, j: T.mix(e + U(0xD1B54A32D192ED03 * (j + 1) & (2**64 - 1)))

    def draw(e: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = step(e, j)
        return ((x >> U(40)) * U(m - j) >> U(24)).astype(np.int64) + j, U(j << 32) | (x & U(0xFFFFFFFF))

    k0, value = draw(items, 0)
    np.minimum.at(signature, row * m + k0, value)
    table = None
    for j in range(1, m):
        open_rows = (signature.reshape(rows, m) == top).any(axis=1) & (np.diff(offsets) > 0)
        keep = open_rows[row]
        if not keep.any():
            break
        items, row = items[keep], row[keep]
        if j == 1:
            k0 = k0[keep]
            k, value = draw(items, 1)
            slot = np.where(k == k0, 0, k)
        else:
            if table is None:
                k0 = k0[keep]
                table = np.tile(np.arange(m, dtype=np.uint16), (len(items), 1))
                at = np.arange(len(items))
                for i, past in ((0, k0), (1, draw(items, 1)[0])):
                    table[at, past], table[:, i] = table[:, i].copy(), table[at, past]
            else:
                table = table[keep]
            k, value = draw(items, j)
            at = np.arange(len(items))
            slot = table[at, k].astype(np.int64)
            table[at, k] = table[:, j]
        np.minimum.at(signature, row * m + slot, value)
    return signature.reshape(rows, m)
