"""Vectorised byte work on Arrow string columns, shared by the operators.

Texts are handled as one flat UTF-8 buffer with document offsets, a few
hundred kilobytes at a time, so that memory stays bounded whatever the length
of a text and no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import importlib
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

ROOT = str(Path(__file__).resolve().parents[2])

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

#: Bytes that separate words: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte; the seed is part of the format of hashes.
TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def shipped(module: str, name: str, *args) -> Callable:
    """A function for mapInArrow that imports its code on the executor.

    Nothing of the package is pickled, so state that a module keeps (tables,
    vocabularies) lives as long as the Python worker does.
    """
    root = ROOT

    def run(*batches):
        if root not in sys.path:
            sys.path.append(root)
        found = getattr(importlib.import_module(module), name)(*batches, *args)
        large = any(isinstance(b, pa.Table) and b.nbytes > 4 << 20 for b in batches)
        return importlib.import_module(f"{module.rpartition('.')[0]}._text").trimmed(found, large)

    return run


def trimmed(found, large: bool):
    """What a function for mapInArrow or applyInArrow gives; memory that it let go of returns to the system, as workers live on."""
    if isinstance(found, pa.Table):
        if large:
            trim()
        return found
    return _then_trimmed(found)


def _then_trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= _B
    x ^= x >> U(27)
    x *= _C
    x ^= x >> U(31)
    return x


def mix_int(x: int) -> int:
    """mix() of one Python integer."""
    m = (1 << 64) - 1
    x &= m
    x = (x ^ (x >> 30)) * int(_B) & m
    x = (x ^ (x >> 27)) * int(_C) & m
    return x ^ (x >> 31)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a flat buffer; no word crosses a row's end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = ~SPACE[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    last = on.copy()
    last[:-1] &= ~on[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = on[cut]
    last[cut - 1] = on[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_R = 0xD6E8FEB86659FD93
_RI = pow(_R, -1, 1 << 64)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for r in (_R, _RI):
            p = np.empty(size, np.uint64)
            p[0], have, step = 1, 1, r
            while have < size:
                p[have : 2 * have] = p[:have] * U(step)
                step = step * step & ((1 << 64) - 1)
                have *= 2
            out.append(p)
        if size <= 1 << 21:
            _powers[size] = tuple(out)
        return tuple(out)
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal contents have equal hashes wherever they stand."""
    n = len(data)
    p, q = _pow(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(TABLE[data] * p[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _A)


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row each start lies in, for starts in order."""
    n = np.searchsorted(starts, offsets[1:], side="left")
    return np.repeat(np.arange(len(offsets) - 1), np.diff(n, prepend=0))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles above 0 and below 1."""
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def pack(arrays: list[np.ndarray]) -> pa.Array:
    """Each array's bytes as one binary value."""
    return pa.array([a.tobytes() for a in arrays], pa.binary())
