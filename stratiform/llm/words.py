"""Words and small text rules shared by the operators: column forms, and numpy forms for Arrow batches.

A word is a run of characters other than space and U+0009 to U+000D. Word and n-gram keys are 64-bit hashes; two
different words share one with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; only the first and the last piece of the split can be empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), GAP)
    edge = lambda at: F.when(F.element_at(pieces, at) == "", 1).otherwise(0)
    return F.greatest(F.size(pieces) - edge(1) - F.when(F.size(pieces) > 1, edge(-1)).otherwise(0), F.lit(0)).cast("long")


# -- numpy ------------------------------------------------------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit keys over all others."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.full(size, _BASE, dtype=np.uint64)
        _inverses = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        for held in (_powers, _inverses):
            held[0] = 1
            np.cumprod(held, out=held)
    return _powers[:n], _inverses[:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of which two give the hash of any stretch of bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def stretch(running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start up to each stop; equal bytes have equal hashes wherever they stand."""
    return mixed((running[stop] - running[start]) * powers(len(running))[1][start] + (stop - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after it; a word ends with its row."""
    inside = ~_IS_GAP[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def blocks(start: np.ndarray, stop: np.ndarray, size: int = 1 << 20):
    """Groups of words, and the stretch of bytes that each covers: about ``size`` bytes, or one longer word."""
    cuts = np.flatnonzero(np.diff(start // size)) + 1
    for i, j in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(start)]])):
        if j > i:
            yield slice(i, j), start[i], stop[j - 1]


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a text column in order, and the index of each row's first word (rows + 1 entries)."""
    data, offsets = bytes_of(column)
    start, stop = word_bounds(data, offsets)
    out = np.empty(len(start), dtype=np.uint64)
    for words_, a, b in blocks(start, stop):
        running = sums(FOLD[data[a:b]] if fold else data[a:b])
        out[words_] = stretch(running, start[words_] - a, stop[words_] - a)
    return out, np.searchsorted(start, offsets)


_STEP = mixed(np.arange(101, 117, dtype=np.uint64)) | _U(1)


def grams(keys: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n keys; the caller leaves out runs that cross rows."""
    if len(keys) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(keys) - n + 1, dtype=np.uint64)
    for i in range(n):
        total += keys[i : i + len(total)] * _STEP[i]
    return mixed(total)


def sequence_hash(keys: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence of keys."""
    total = np.full(1, len(keys), dtype=np.uint64)
    for i in range(len(keys)):
        total = total * _U(_BASE) + keys[i : i + 1] * _STEP[i % len(_STEP)]
    return mixed(total)[0]


def batches_of(reader, rows: int = 1 << 30, size: int = 4 << 20):
    """Cuts Arrow batches so that none holds much more text than ``size``, though a single long row stays whole."""
    for batch in reader:
        held = batch.nbytes
        step = len(batch) if held <= size else max(1, int(len(batch) * size / held))
        for at in range(0, len(batch), min(step, rows) or 1):
            yield batch.slice(at, min(step, rows))
