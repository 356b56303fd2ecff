"""Periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least ``LEAST`` words and ``TIMES`` periods, that no neighbouring word
extends. Words are what stands between ASCII blanks, case kept.

Candidates lie on the harmonic grid: for each period q the positions 0, q, 2q, ... A stretch
of four periods holds four grid positions in a row with identical words, so only such a place
can lie in a run. The texts that have such places are turned into a run-length grammar by
recompression: in turn, blocks of equal symbols become one symbol each, then pairs of
neighbours from two halves of the alphabet do. Equal stretches are cut alike but for their
ends, so the longest common extension of two positions climbs the levels of the grammar and
comes down again in a logarithmic number of steps, whole blocks at a time. Extensions of a
candidate and of the position a period later, in both directions, give the maximal run;
of the periods found for one stretch the least is its smallest.

No shuffle: each text is one row's own work. Defined results: null texts, and texts without
words, have no words and no runs; repeated rows and null ids are rows of their own; an empty
table gives an empty result; a text of any length is read whole (its words are held in its
task); columns are selected by name, others may have any name.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tripwire.llm.common import arrow_map, slices, text_bytes

LEAST, TIMES = 6, 4
#: Texts of fewer words look their grid up in one table; others go through it period by period.
_TABLE = 1 << 13
_SLICE = 2 << 20


class Grammar:
    """Levels of a sequence under recompression: for each the texts' offsets at which its symbols start, the
    symbols (equal ones have equal expansions), and how many equal ones stand from each one on and up to it.
    ``fixed`` marks symbols that stand alone in the sequence; they are in no block and no pair."""

    def __init__(self, symbols: np.ndarray, fixed: np.ndarray):
        self.levels = []
        starts, new = np.arange(len(symbols) + 1), int(symbols.max(initial=0)) + 1
        for turn in range(1, 1 << 16):
            m = len(symbols)
            first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]) if m else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[first, m])
            at, begin, size = np.arange(m), np.repeat(first, sizes), np.repeat(sizes, sizes)
            self.levels.append((starts, symbols, begin + size - at, at - begin + 1))
            symbols, starts, fixed = symbols[first], starts[np.r_[first, m]], fixed[first]
            block = sizes > 1
            symbols[block], new = self._named(symbols[block], sizes[block], new)
            free = ~fixed[:-1] & ~fixed[1:]
            if not free.any():
                break
            # Halves of the alphabet by a hash of the symbol and the turn; the order with more pairs is taken.
            half = (symbols.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            half = ((half ^ (half >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 1
            pairs = max((np.flatnonzero(free & (half[:-1] == side) & (half[1:] != side)) for side in (True, False)), key=len)
            symbols[pairs], new = self._named(symbols[pairs], symbols[pairs + 1], new)
            keep = np.ones(len(symbols), bool)
            keep[pairs + 1] = False
            symbols, starts, fixed = symbols[keep], starts[np.r_[keep, True]], fixed[keep]

    @staticmethod
    def _named(a: np.ndarray, b: np.ndarray, new: int) -> tuple[np.ndarray, int]:
        """One new symbol for each distinct (a, b)."""
        if not len(a):
            return a, new
        kinds, which = np.unique(a * np.int64(1 << 31) + b, return_inverse=True)
        return new + which, new + len(kinds)

    def _step(self, level: tuple, x: np.ndarray, y: np.ndarray, which: np.ndarray, back: bool) -> np.ndarray:
        """Move the positions of ``which`` past equal symbols of a level, whole blocks at a time; whether they moved."""
        starts, symbols, ahead, behind = level
        a, b = np.searchsorted(starts, x[which]), np.searchsorted(starts, y[which])
        on = (starts[a] == x[which]) & (starts[b] == y[which])
        p, q = (a - 1, b - 1) if back else (a, b)
        on &= symbols[p] == symbols[q]
        runs = behind if back else ahead
        count = np.minimum(runs[p], runs[q])[on]
        to = a[on] - count if back else a[on] + count
        by = starts[to] - starts[a[on]]
        moved = which[on]
        x[moved] += by
        y[moved] += by
        return on

    def extension(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """Lengths of the longest common stretches from (or, ``back``, up to) each pair of offsets. Each pair must
        meet a fixed symbol on its way."""
        x, y, begin = x.copy(), y.copy(), x
        alive, peak = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, level in enumerate(self.levels[:-1]):
            above = self.levels[k + 1][0]
            for _ in range(4):
                up = (above[np.searchsorted(above, x[alive])] == x[alive]) & (above[np.searchsorted(above, y[alive])] == y[alive])
                todo = alive[~up]
                if not len(todo):
                    break
                moved = self._step(level, x, y, todo, back)
                alive = np.setdiff1d(alive, todo[~moved], assume_unique=True)
            alive = alive[(above[np.searchsorted(above, x[alive])] == x[alive]) & (above[np.searchsorted(above, y[alive])] == y[alive])]
            peak[alive] = k + 1
            if not len(alive):
                break
        for k in range(int(peak.max(initial=0)), -1, -1):
            todo = np.flatnonzero(peak >= k)
            while len(todo):
                todo = todo[self._step(self.levels[k], x, y, todo, back)]
        return np.abs(x - begin)


@functools.cache
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid positions and periods of texts below ``_TABLE`` words, by the last word that the test reads, and
    how many of them a text of so many words has."""
    periods = np.arange(1, _TABLE // (TIMES - 1) + 1)
    counts = np.maximum((_TABLE - 1) // periods - (TIMES - 2), 0)
    q = np.repeat(periods, counts)
    k = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = (k + TIMES - 1) * q
    order = np.argsort(last, kind="stable")
    return (k * q)[order].astype(np.int32), q[order].astype(np.int32), np.searchsorted(last[order], np.arange(_TABLE + 1))


def candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid positions and periods with identical words there and on the next grid positions."""
    n = len(words)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= _TABLE:
        at, q, count = _grid()
        at, q = at[: count[n]], q[: count[n]]
        for k in range(1, TIMES):
            hit = words[at + (k - 1) * q] == words[at + k * q]
            at, q = at[hit], q[hit]
        return at.astype(np.int64), q.astype(np.int64)
    places, periods = [], []
    for q in range(1, n // TIMES + 1):
        grid = words[::q]
        same = grid[1:] == grid[:-1]
        hit = same[: len(same) - TIMES + 2]
        for k in range(1, TIMES - 1):
            hit = hit & same[k : len(same) - TIMES + 2 + k]
        k = np.flatnonzero(hit)
        places.append(k * q)
        periods.append(np.full(len(k), q))
    return np.concatenate(places), np.concatenate(periods)


def _maximal(grammar: Grammar, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the maximal stretches around offsets ``at``. Neighbouring grid positions of one
    period mostly lie in one stretch: only the first is extended, then those that it does not hold."""
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    out = []
    while len(at):
        head = np.r_[True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + q[1:])]
        chain = np.cumsum(head) - 1
        x, p = at[head], q[head]
        start = x - grammar.extension(x, x + p, back=True)
        end = x + p + grammar.extension(x, x + p)
        out.append((start, end, p))
        rest = (at < start[chain]) | (at >= (end - p)[chain])
        at, q = at[rest], q[rest]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, as numbers of its words, its runs (start, length, period) by start, then period."""
    found = [candidates(t) for t in texts]
    chosen = [k for k, (at, _) in enumerate(found) if len(at)]
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not chosen:
        return out
    top = max(int(texts[k].max()) for k in chosen) + 1
    parts, bases, at, q = [np.array([top])], [], [], []
    size = 1
    for number, k in enumerate(chosen, 1):
        bases.append(size)
        parts += [texts[k], np.array([top + number])]
        at.append(found[k][0] + size)
        q.append(found[k][1])
        size += len(texts[k]) + 1
    symbols = np.concatenate(parts).astype(np.int64)
    start, end, p = _maximal(Grammar(symbols, symbols >= top), np.concatenate(at), np.concatenate(q))
    long = end - start >= np.maximum(LEAST, TIMES * p)
    start, length, p = start[long], (end - start)[long], p[long]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, p = start[least], length[least], p[least]
    order = np.lexsort((p, start))
    rows = np.stack([start, length, p], axis=1)[order]
    of = np.searchsorted(np.array(bases), rows[:, 0], "right") - 1
    cuts = np.searchsorted(of, np.arange(len(chosen) + 1))
    for number, k in enumerate(chosen):
        out[k] = rows[cuts[number] : cuts[number + 1]] - np.array([bases[number], 0, 0])
    return out


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None) -> DataFrame:
    """Per row: id, ``runs`` (start, length, period; in words), and ``collapsed``, the words that are in no run
    after its first period, joined by one space. ``change(id, words)`` may replace a text's words first."""
    run_type = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
    schema = docs.select(id_col).schema.add("runs", run_type).add("collapsed", "string")
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, _SLICE):
            texts = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split()  # of bytes: ASCII blanks only
                texts.append(words if change is None else change(i, words))
            numbers = []
            for words in texts:
                known: dict[bytes, int] = {}
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            found = runs(numbers)
            collapsed = []
            for words, r in zip(texts, found, strict=True):
                left = words if not len(r) else [words[k] for k in np.flatnonzero(kept(len(words), r))]
                collapsed.append(b" ".join(left).decode())
            offsets = np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.string())], schema.names)

    return arrow_map(docs.select(F.col(id_col), text_bytes(F.col(text_col)).alias("raw_text")), run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the registered query searches: in a tenth of the texts, by crc32 of the id, the words from one
    place on are replaced by a repetition of the first few of them. A null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
