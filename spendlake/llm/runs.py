"""Periodic runs of words (operator 13): online dyadic square catching.

Words are appended; level k watches periods ``2^k <= q < 2^(k+1)`` with one catcher at a time.
Whenever a block of ``m = 2^k`` words is completed (blocks start at multiples of m) it becomes the
catcher's pattern, and every word appended from ``m`` to ``2m`` places later ends a window that is
compared with it, so the distance between window and block is the period.  Windows are
compared by prefix fingerprints, the words appended together at once, and a match is confirmed word by
word.  A confirmed match is extended to the left over the words already there and to the right by
each later append, for as long as words q apart are equal; a stretch of two periods is a square, and
stretches that cover the same words are one run with the smallest of their periods.

Any stretch of three periods holds a completed block and its copy one period later, so all runs
of ``min_periods >= 3`` periods are found.  Work is ``O(n log n)`` for n words: a level does a constant number of
comparisons per word, and windows inside a run already known for a divisor of their period are
dropped together.  State is two numbers per word and the stretches.

The words of a document stay in one task; documents are spread over tasks as they are read, and nothing is
shuffled.

Defined cases: null or empty texts have no words, no runs and an empty collapsed text; repeated
rows and null ids are each treated alone; an empty table gives an empty result; only ``doc_id`` and
``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scramble

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers never vanish


@dataclass(frozen=True)
class RunSettings:
    min_words: int = 6
    min_periods: int = 4
    words_at_once: int = 1 << 17


class _Powers:
    """Powers of BASE modulo 2^64."""

    def __init__(self):
        self.values = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) <= n:
            steps = np.full(max(n + 1, 2 * len(self.values)), BASE)
            steps[0] = 1
            self.values = np.multiply.accumulate(steps)
        return self.values


POWERS = _Powers()


class SquareCatcher:
    """Words of one document, appended in any portions."""

    def __init__(self, settings: RunSettings = RunSettings()):
        if settings.min_periods < 3:
            raise ValueError("runs of fewer than three periods can escape the catchers")
        self.settings = settings
        self.n = 0
        self._word = np.empty(64, np.int64)
        self._sum = np.zeros(65, np.uint64)  # fingerprint of the first i words
        self._next: list[int] = []  # per level: first window not yet compared
        self._open: dict[int, int] = {}  # period -> start of the stretch that reaches the last word
        self._last: dict[int, tuple[int, int]] = {}  # period -> the latest closed stretch
        self._runs: dict[int, tuple[list, list]] = {}  # period -> starts, ends of closed stretches of run length
        self._squares: list[tuple[int, int]] = []
        self._told: set[tuple[int, int]] = set()

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Append word numbers; returns the new squares as (start of the stretch, period)."""
        self._squares = []
        old = self._grow(np.asarray(words, np.int64))
        for q, start in list(self._open.items()):
            end = self._forward(old, q)
            if end < self.n:
                del self._open[q]
                self._close(q, start, end)
            self._tell(q, start, end)
        level = 0
        while 3 << level <= self.n:
            if level == len(self._next):
                self._next.append(1 << level)
            self._catch(level)
            level += 1
        return self._squares

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run so far, by start, then period."""
        best: dict[tuple[int, int], int] = {}
        for q, (starts, ends) in self._runs.items():
            for place in zip(starts, ends):
                best[place] = min(q, best.get(place, q))
        for q, start in self._open.items():
            if self._long(q, start, self.n):
                best[start, self.n] = min(q, best.get((start, self.n), q))
        return sorted((s, e - s, q) for (s, e), q in best.items())

    def _long(self, q: int, start: int, end: int) -> bool:
        return end - start >= max(self.settings.min_words, self.settings.min_periods * q)

    def _grow(self, words: np.ndarray) -> int:
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self._word):
            size = max(self.n, 2 * len(self._word))
            self._word = np.concatenate([self._word[:old], np.empty(size - old, np.int64)])
            self._sum = np.concatenate([self._sum[: old + 1], np.zeros(size - old, np.uint64)])
        self._word[old : self.n] = words
        marks = scramble(words.astype(np.uint64) + np.uint64(1)) * POWERS.upto(self.n)[old : self.n]
        self._sum[old + 1 : self.n + 1] = self._sum[old] + np.cumsum(marks, dtype=np.uint64)
        return old

    def _forward(self, x: int, q: int) -> int:
        """First place from x on whose word differs from that q before it."""
        size = 64
        while x < self.n:
            stop = min(self.n, x + size)
            differ = np.flatnonzero(self._word[x:stop] != self._word[x - q : stop - q])
            if len(differ):
                return x + int(differ[0])
            x, size = stop, 4 * size
        return self.n

    def _backward(self, x: int, q: int) -> int:
        """First place such that all words from it up to x equal those q after them."""
        size = 64
        while x > 0:
            stop = max(0, x - size)
            differ = np.flatnonzero(self._word[stop:x] != self._word[stop + q : x + q])
            if len(differ):
                return stop + int(differ[-1]) + 1
            x, size = stop, 4 * size
        return 0

    def _catch(self, level: int) -> None:
        m = 1 << level
        at = np.arange(self._next[level], self.n - m + 1)
        self._next[level] = max(self._next[level], self.n - m + 1)
        if not len(at):
            return
        block = ((at >> level) - 1) << level
        sums, power = self._sum, POWERS.upto(2 * m)
        hit = np.flatnonzero((sums[block + m] - sums[block]) * power[at - block] == sums[at + m] - sums[at])
        if not len(hit):
            return
        block, q = block[hit], at[hit] - block[hit]
        new = ~self._inside_known(block, block + q + m, q)
        for b, p in zip(block[new].tolist(), q[new].tolist()):
            self._pursue(b, p, m)

    def _inside_known(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether a known run, whose period divides q, holds all words from start to end."""
        known = np.zeros(len(q), bool)
        for p, (starts, ends) in self._runs.items():
            i = np.searchsorted(starts, start, "right") - 1
            known |= (i >= 0) & (np.asarray(ends)[i] >= end) & (q % p == 0)
        for p, s in self._open.items():
            if self._long(p, s, self.n):
                known |= (start >= s) & (q % p == 0)
        return known

    def _pursue(self, b: int, q: int, m: int) -> None:
        if self._open.get(q, self.n) <= b:
            return
        start, end = self._last.get(q, (0, 0))
        if start <= b and b + q + m <= end:
            return
        if not np.array_equal(self._word[b : b + m], self._word[b + q : b + q + m]):
            return  # only the fingerprints agree
        start, end = self._backward(b, q), self._forward(b + q + m, q)
        if end == self.n:
            self._open[q] = start
        else:
            self._close(q, start, end)
        self._tell(q, start, end)

    def _close(self, q: int, start: int, end: int) -> None:
        self._last[q] = (start, end)
        if self._long(q, start, end):
            starts, ends = self._runs.setdefault(q, ([], []))
            starts.append(start)
            ends.append(end)

    def _tell(self, q: int, start: int, end: int) -> None:
        if end - start >= 2 * q and (start, q) not in self._told:
            self._told.add((start, q))
            self._squares.append((start, q))


def runs_of(words: list, settings: RunSettings = RunSettings()) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words."""
    catcher, numbers = SquareCatcher(settings), {}
    for i in range(0, len(words), settings.words_at_once):
        part = words[i : i + settings.words_at_once]
        catcher.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in part), np.int64, len(part)))
    return catcher.runs()


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those of a run after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g] if runs else words


def echo_words(doc_id: int | None, words: list) -> list:
    """The words with a repeating tail in a tenth of the documents, chosen by the id's CRC-32: from word
    a on, word i becomes original word a + (i - a) % p.  Without an id nothing is repeated."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = ("doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
          "collapsed string")


def periodic_runs(docs: DataFrame, settings: RunSettings = RunSettings(),
                  prepare: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """Per document doc_id, n_words, runs (by start, then period) and collapsed (the words outside
    repetitions, joined by one space).  ``prepare`` may change the words of a document first."""

    def find(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1)):
                words = (text.as_py() or "").encode().split()  # bytes.split knows ASCII white space only
                if prepare:
                    words = prepare(doc_id, words)
                runs = runs_of(words, settings)
                rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs],
                             b" ".join(collapse(words, runs)).decode()))
            n, runs, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(find, SCHEMA)


def run_digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest run (ties: smallest start, then period) and digests
    of all runs and of the collapsed text."""
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(1))
    line: Callable[[Column], Column] = lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select("doc_id", "runs", "collapsed", longest.alias("top")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
