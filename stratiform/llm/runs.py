"""Periodic runs of words: candidates on harmonic grids, extended exactly by queries on a run-length grammar.

A stretch of period q that is at least 4q long holds four neighbouring points of the grid 0, q, 2q, ..., all with the same
word; such points are the candidates. How far a candidate reaches is a longest common extension of two places, which a
grammar answers that recompression makes: rounds of block compression (a stretch of one symbol becomes a symbol) and pair
compression (a symbol of the left half of the alphabet and a following one of the right half become a symbol). Equal
stretches get equal symbols but for their edges, so a query climbs while the places stand at the edges of symbols, steps
over one symbol or block a level, and descends the same way. Queries of many candidates go through the levels together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratiform.llm.stored import prepare
from stratiform.llm.words import batches_of, mixed

#: A run is at least so many words long, and so many periods.
LEAST, TIMES = 6, 4
#: Bytes of text whose words make one grammar (a longer text makes its own), and candidates extended together.
TEXT, TOGETHER = 2 << 20, 1 << 18


class Level:
    """Symbols, the place of each one's parent in the next level, and of each parent's first child (with an end)."""

    def __init__(self, symbols, parent, first, blocks):
        self.symbols, self.parent, self.first, self.blocks = symbols, parent, first, blocks

    def mirrored(self) -> Level:
        size, above = len(self.symbols), len(self.first) - 1
        return Level(self.symbols[::-1], above - 1 - self.parent[::-1], size - self.first[::-1], self.blocks)


def _joined(symbols: np.ndarray, heads: np.ndarray, blocks: bool, fresh: int) -> tuple[Level, np.ndarray, int]:
    """A level whose children from one head to the next become one symbol; single children keep theirs."""
    first = np.append(np.flatnonzero(heads), len(symbols))
    count = np.diff(first)
    above = symbols[first[:-1]].copy()
    several = np.flatnonzero(count > 1)
    mate = count[several] if blocks else symbols[first[several] + 1]
    names, which = np.unique(above[several] * (int(mate.max(initial=0)) + 1) + mate, return_inverse=True)
    above[several] = fresh + which
    return Level(symbols, np.cumsum(heads) - 1, first, blocks), above, fresh + len(names)


def recompress(symbols: np.ndarray) -> list[Level]:
    """Levels of the grammar of a sequence, up to one where all symbols differ."""
    levels: list[Level] = []
    fresh = int(symbols.max(initial=-1)) + 1
    number = 0
    while True:
        heads = np.append(True, symbols[1:] != symbols[:-1])
        if not heads.all():
            level, symbols, fresh = _joined(symbols, heads, True, fresh)
            levels.append(level)
        if len(np.unique(symbols)) == len(symbols):
            levels.append(Level(symbols, None, None, False))
            return levels
        right = (mixed(symbols.astype(np.uint64) * np.uint64(2654435761) + np.uint64(number + 1)) >> np.uint64(7)) & np.uint64(1) == 1
        heads = np.append(True, ~(right[1:] & ~right[:-1]))
        number += 1
        if not heads.all():
            level, symbols, fresh = _joined(symbols, heads, False, fresh)
            levels.append(level)


class Grammar:
    """Longest common extensions in a sequence that starts and ends with symbols found nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.levels = recompress(symbols)
        self.back = [x.mirrored() for x in self.levels[:-1]]
        self.back.append(Level(self.levels[-1].symbols[::-1], None, None, False))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are equal; a and b differ."""
        return self._extend(self.levels, a, b)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols at and before a and b are equal."""
        return self._extend(self.back, self.size - 1 - a, self.size - 1 - b)

    @staticmethod
    def _extend(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        begun, a, b = a, a.copy(), b.copy()
        top = np.full(len(a), len(levels) - 1)
        rising = np.arange(len(a))
        for k, level in enumerate(levels[:-1]):
            x, y = a[rising], b[rising]
            inside = (level.first[level.parent[x]] != x) | (level.first[level.parent[y]] != y)
            equal = inside & (level.symbols[x] == level.symbols[y])
            step = Grammar._step(level, x, y) * equal
            x, y = x + step, y + step
            up, vp = level.parent[x], level.parent[y]
            edge = (level.first[up] == x) & (level.first[vp] == y) & ~(inside & ~equal)
            a[rising], b[rising] = np.where(edge, up, x), np.where(edge, vp, y)
            top[rising[~edge]] = k
            rising = rising[edge]
        # From here on the symbols at a and b differ, on each query's own level.
        for k in range(len(levels) - 2, -1, -1):
            level = levels[k]
            falling = np.flatnonzero(top > k)
            x, y = level.first[a[falling]], level.first[b[falling]]
            step = Grammar._step(level, x, y) * (level.symbols[x] == level.symbols[y])
            a[falling], b[falling] = x + step, y + step
        return a - begun

    @staticmethod
    def _step(level: Level, x: np.ndarray, y: np.ndarray) -> np.ndarray | int:
        """How far equal symbols reach: one symbol, or the shorter rest of two blocks."""
        if not level.blocks:
            return 1
        return np.minimum(level.first[level.parent[x] + 1] - x, level.first[level.parent[y] + 1] - y)


def candidates(symbols: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Points of the grids at which four neighbours are equal, with their period, in groups of bounded size.

    ``first`` and ``size`` are the place and the number of words of each document.
    """
    held, seen = [], 0
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    for q in range(1, longest // TIMES + 1):
        use = int(np.searchsorted(-size, -max(LEAST, TIMES * q), side="right"))
        count = (size[:use] - 1 - (TIMES - 1) * q) // q + 1
        before = np.cumsum(count) - count
        x = np.repeat(first[:use] - before * q, count) + np.arange(int(count.sum())) * q
        for step in range(1, TIMES):
            x = x[symbols[x] == symbols[x + step * q]]
        if len(x):
            held.append((x, np.full(len(x), q)))
            seen += len(x)
        if seen >= TOGETHER:
            yield tuple(np.concatenate(v) for v in zip(*held))
            held, seen = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held))


def _shortest(start, length, period):
    """Of stretches found with several periods, the shortest one, by start and then period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (place in the whole sequence), length and smallest period of every run of documents of such sizes, laid end to end."""
    first = np.cumsum(size) - size
    found = [(np.zeros(0, np.int64),) * 3]
    parts = []
    for x, q in candidates(symbols, first, size):
        parts.append((x, q))
        if sum(len(p[0]) for p in parts) >= TOGETHER:
            found.append(_extended(symbols, first, size, parts))
            parts = []
    if parts:
        found.append(_extended(symbols, first, size, parts))
    return _shortest(*(np.concatenate(v) for v in zip(*found)))


def _extended(symbols, first, size, parts):
    """Runs of the candidates. Only documents that hold one enter the grammar, each with a symbol of its own before it."""
    x, q = (np.concatenate(v) for v in zip(*parts))
    doc = np.searchsorted(first, x, side="right") - 1
    # Empty documents share their place with the next one, which the search gives.
    used, which = np.unique(doc, return_inverse=True)
    total = int(size[used].sum()) + len(used) + 1
    at = np.cumsum(size[used] + 1) - size[used]
    own = np.ones(total, dtype=bool)
    own[at - 1] = False
    own[-1] = False
    text = np.empty(total, dtype=np.int64)
    inside = np.repeat(first[used], size[used]) + np.arange(int(size[used].sum())) - np.repeat(np.cumsum(size[used]) - size[used], size[used])
    text[own] = symbols[inside]
    text[~own] = int(symbols.max(initial=0)) + 1 + np.arange(len(used) + 1)
    grammar = Grammar(text)
    place = x - first[doc] + at[which]
    ahead, behind = grammar.ahead(place, place + q), grammar.behind(place - 1, place + q - 1)
    length = ahead + behind + q
    keep = length >= np.maximum(LEAST, TIMES * q)
    return _shortest((x - behind)[keep], length[keep], q[keep])


RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _find(batches):
    for batch in batches_of(batches, size=TEXT):
        texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        names: dict[bytes, int] = {}
        size = np.array([len(t) for t in texts], dtype=np.int64)
        symbols = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), dtype=np.int64, count=int(size.sum()))
        start, length, period = runs_of(symbols, size)
        first = np.append(np.cumsum(size) - size, size.sum())
        doc = np.searchsorted(first[:-1] + size, start, side="right")
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        collapsed = []
        for i, held in enumerate(texts):
            for s, n, q in zip(*(v[cuts[i] : cuts[i + 1]].tolist() for v in (start - first[doc], length, period))):
                held[s + q : s + n] = [None] * (n - q)
            kept = [w for w in held if w is not None] if cuts[i + 1] > cuts[i] else held
            collapsed.append(b" ".join(kept).decode())
        runs = pa.StructArray.from_arrays([pa.array(v) for v in (start - first[doc], length, period)], names=["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), pa.array(collapsed, pa.string())],
            names=["doc_id", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row of ``docs`` (``doc_id``, ``text``).

    Words are stretches of characters other than space and U+0009 to U+000D. ``runs`` are the maximal stretches of words
    that repeat with a smallest period q, at least six words and four periods long, by start and then period; starts count
    words from 0. ``collapsed`` are the words but those that a run holds after its first period, joined by one space. Null,
    empty and blank texts have no runs and collapse to an empty text; every row is answered by itself, also when ids are
    null or repeat; other columns are not read. A text is held whole by its task.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_find, RUNS)
