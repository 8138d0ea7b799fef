"""Quality rules: counts of a text, and a suffix array's repeated substrings.

A suffix array over the words of each text (prefix doubling; only groups that
are still equal are sorted again) and its longest-common-prefix intervals give,
for each word position, the longest substring from there that stands in the
text a second time. Substrings of MIN_WORDS or more are maximal repeats; the
union of their spans is held against MAX_COVERED of the words, and the longest
against MAX_LONGEST of them. Many texts are sorted at once, under their row.

All work is per row: no shuffle, memory bounded by one chunk of texts or by one
text that is longer than a chunk.

Defined results: null and empty texts, and texts of spaces alone, have no words
and fail the base rules; null ids are kept as they are; repeated rows give
repeated rows. Lines and words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T

U = np.uint64
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 5, 0.4, 0.25
CHUNK = 1 << 19
FIELDS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64()),
]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
BLANK = T.SPACE
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def suffix_array(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in suffix order within their rows, and a mark on each that shares 4 words or more with the one before it.

    word: a hash for each word; row: the row of each word, ascending.
    """
    n = len(word)
    key = row.astype(U) << U(44) | word >> U(20)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head + 1
    last = np.concatenate([np.flatnonzero(row[1:] != row[:-1]) + 1, [n]])
    end = np.repeat(last, np.diff(np.concatenate([[0], last])))
    deep = np.zeros(n, bool)
    k = 1
    while True:
        many = ~new | np.append(~new[1:], False)
        at = np.flatnonzero(many)
        if k == 4:
            deep = ~new
        if not len(at):
            break
        i = order[at]
        j = i + k
        inside = j < end[i]
        second = np.where(inside, rank[np.minimum(j, n - 1)], 0)
        pair = rank[i].astype(U) << U(32) | second.astype(U)
        o = np.argsort(pair)
        pair = pair[o]
        order[at] = i = i[o]
        fresh = np.append(True, pair[1:] != pair[:-1])
        new[at] |= fresh
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[i] = head + 1
        k *= 2
    return order, deep


def common_prefixes(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word position, the length of the longest substring from there that recurs in its row; 0 where that is below 4 words."""
    n = len(word)
    best = np.zeros(n, np.int64)
    if n < 8:
        return best
    order, deep = suffix_array(word, row)
    at = np.flatnonzero(deep)
    at = at[at > 0]
    if not len(at):
        return best
    p, q = T._pow(n + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(word * p[:n], dtype=U)])
    i, j = order[at - 1], order[at]
    last = np.concatenate([np.flatnonzero(row[1:] != row[:-1]) + 1, [n]])
    end = np.repeat(last, np.diff(np.concatenate([[0], last])))
    low = np.zeros(len(at), np.int64)
    high = np.minimum(end[i] - i, end[j] - j)
    while True:
        mid = (low + high + 1) // 2
        if (low == high).all():
            break
        same = (total[i + mid] - total[i]) * q[i] == (total[j + mid] - total[j]) * q[j]
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    np.maximum.at(best, i, low)
    np.maximum.at(best, j, low)
    return best


def _covered(best: np.ndarray, least: int, first: np.ndarray) -> np.ndarray:
    """Words covered by repeats of at least so many words, per row. first: n + 1 word offsets of the rows."""
    n = len(best)
    reach = np.where(best >= least, np.arange(n) + best, 0)
    return _per_row(np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool), first)


def measure(data: np.ndarray, offsets: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """All counts of the rows of one chunk."""
    rows = len(offsets) - 1
    starts, ends = T.words(data, offsets)
    row = T.rows_of(starts, offsets)
    n_words = np.bincount(row, minlength=rows).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])
    out = {"n_words": n_words, "word_chars": _per_row(LEAD[data] & ~BLANK[data], offsets), "n_symbols": _per_row(SYMBOL[data], offsets)}
    # lines: cut after each \n and at each row's start and end
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1], offsets[1:]]))
    a, b = cut[:-1], cut[1:]
    b = b - (data[b - 1] == 10) if len(b) else b
    line_row = np.searchsorted(offsets, a, side="right") - 1
    held = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, line_row = a[held], b[held], line_row[held]
    code = T.span_hashes(data, a, b) if len(a) else np.zeros(0, U)
    o = np.lexsort((code, line_row))
    c, r = code[o], line_row[o]
    again = np.append(False, (c[1:] == c[:-1]) & (r[1:] == r[:-1])) if len(o) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(r[again], minlength=rows).astype(np.int64)
    word = T.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, U)
    best = common_prefixes(word, row)
    out["n_repeat_words"] = _covered(best, 8, first)
    out["n_covered_words"] = _covered(best, min_words, first)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, np.where(best >= min_words, best, 0))
    out["longest_repeat"] = longest
    return out


def _judged(column: pa.Array, min_words: int, max_covered: float, max_longest: float) -> dict[str, np.ndarray]:
    """All counts and the verdict of the texts of one batch."""
    data, offsets = T.flat(column)
    parts = []
    for i, j in T.chunks(offsets, CHUNK):
        o = offsets[i : j + 1]
        parts.append(measure(data[o[0] : o[-1]], o - o[0], min_words))
    if not parts:
        return {}
    x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = x["n_words"]
    x["base_failed"] = (n < 20) | (100 * x["n_repeat_words"] > 30 * n)
    x["kept"] = ~x["base_failed"] & (x["n_covered_words"] <= max_covered * n) & (x["longest_repeat"] <= max_longest * n)
    return x


def judge_batches(batches: Iterator[pa.RecordBatch], min_words: int, max_covered: float, max_longest: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _judged(batch.column("text"), min_words, max_covered, max_longest)
        if x:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id") if k == "doc_id" else pa.array(x[k], t) for k, t in FIELDS], names=[k for k, _ in FIELDS])


def kept_batches(batches: Iterator[pa.RecordBatch], text_col: str, min_words: int, max_covered: float, max_longest: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _judged(batch.column(text_col), min_words, max_covered, max_longest)
        if x:
            yield batch.filter(pa.array(x["kept"]))


def judge_quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """Counts and verdict of every text; only the id and text columns are read.

    kept is false where the base rules fail, else where repeats of min_words or
    more cover over max_covered of the words, or the longest has over
    max_longest of them.
    """
    if min_words < 4:
        raise ValueError("repeats of fewer than 4 words are not kept")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(T.shipped(__name__, "judge_batches", min_words, max_covered, max_longest), SCHEMA)


def keep_quality(documents: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """The rows that judge_quality keeps, each by its own text, whatever its id."""
    if min_words < 4:
        raise ValueError("repeats of fewer than 4 words are not kept")
    return documents.mapInArrow(T.shipped(__name__, "kept_batches", text_col, min_words, max_covered, max_longest), documents.schema)
