"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 3).

Patterns are all runs of ``window`` consecutive words of the benchmark items (a shorter item is
one pattern).  Patterns of one length m share the tables of the method, with blocks of two words:
the shift table says for a block's hash how far the search may jump (m - 1 for a block in no pattern),
blocks that end a pattern have shift 0 and lead to a bucket of patterns keyed by the hash of that suffix and
ordered by the hash of the pattern, and the words themselves are compared to confirm an occurrence.

The patterns are a stated query set: they are read in blocks of at most ``block_words`` words and
the tables of each block are built once, as arrays of some 70 bytes a word and a dictionary of its distinct
words, broadcast and searched in all documents, with one pass over the documents per
block, which adds the block's hits to each row.  Nothing is shuffled.

Defined cases: null and empty texts have no words; items without words have no pattern; items
with a null id count for hits but cannot be named, so they are left out of n_items and the list;
rows of items that share an id are one item; repeated documents are reported once per row;
empty tables give an empty result (no documents) or clean documents (no items); other columns
are not read (or, in the filter, returned unchanged).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scramble

SPANS = "array<struct<a:int,b:int>>"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class DecontamSettings:
    window: int = 10
    block_words: int = 1_000_000


def item_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters; A-Z lower-cased (bytes.lower touches no others)."""
    return WORD.findall(text.encode().lower()) if text else []


def _rolled(ids: np.ndarray, m: int) -> np.ndarray:
    """64-bit hash of each run of m ids."""
    ids = ids.astype(np.uint64)
    n = len(ids) - m + 1
    out = ids[:n]
    for k in range(1, m):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    return scramble(out)


class LengthTable:
    """Wu-Manber tables of the patterns of one length ``m``, as arrays.

    ``pool`` holds the word ids of the items, ``starts`` where a pattern stands in it and ``owners`` whose it is.
    ``shift[h]``: how far the search may jump on a block (its last two words) of hash h; blocks that share a
    hash share the smaller jump.  ``slots[h]`` to ``slots[h + 1]`` is the bucket of the patterns that end
    in a block of hash h, ordered by the hash of the whole pattern; ``hashes`` are those of all patterns."""

    def __init__(self, m: int, pool: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.m, self.size = m, min(2, m)
        self.bits = np.uint64(64 - max(10, int(4 * len(starts)).bit_length()))
        self.pool = pool.tobytes()
        whole = _rolled(pool, m)[starts]
        blocks = self.blocks(pool)
        self.shift = np.full(1 << (64 - int(self.bits)), m - self.size + 1, np.uint8 if m < 256 else np.int32)
        for end in range(self.size, m + 1):
            np.minimum.at(self.shift, blocks[starts + end - self.size], m - end)
        last = blocks[starts + m - self.size]
        order = np.lexsort((owners, whole, last))
        self.whole, self.starts, self.owners = whole[order], starts[order].astype(np.int32), owners[order].astype(np.int32)
        self.hashes = np.unique(whole)
        self.slots = np.searchsorted(last[order], np.arange(len(self.shift) + 1)).astype(np.int32)

    def blocks(self, ids: np.ndarray) -> np.ndarray:
        """Hash of each block of the method in a sequence of word ids."""
        return (_rolled(ids, self.size) >> self.bits).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of all occurrences in a text, and the numbers of the items they belong to."""
        spans, owners = [], set()
        n, m = len(ids), self.m
        if n < m:
            return spans, owners
        hashes = self.blocks(ids)
        jumps = self.shift[hashes].tolist()
        ends = []  # blocks that end a pattern
        at, last = m - self.size, n - self.size
        while at <= last:
            jump = jumps[at]
            if jump:
                at += jump
            else:
                ends.append(at)
                at += 1
        if not ends:
            return spans, owners
        at = np.array(ends)
        starts = at + self.size - m
        whole = _rolled(ids, m)[starts]
        known = np.searchsorted(self.hashes, whole)
        hit = self.hashes[np.minimum(known, len(self.hashes) - 1)] == whole
        text = ids.tobytes() if hit.any() else b""
        for slot, start, key in zip(hashes[at[hit]].tolist(), starts[hit].tolist(), whole[hit]):
            lo, hi = self.slots[slot], self.slots[slot + 1]
            bucket = self.whole[lo:hi]
            lo, hi = lo + np.searchsorted(bucket, key), lo + np.searchsorted(bucket, key, "right")
            width, window = 4 * m, text[4 * start : 4 * (start + m)]
            found = [i for i in range(lo, hi) if self.pool[4 * self.starts[i] : 4 * self.starts[i] + width] == window]
            if found:
                spans.append((start, start + m))
                owners.update(self.owners[found].tolist())
        return spans, owners


class PatternTables:
    """The tables of one block of items, one per pattern length, over numbered words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.names = [item_id for item_id, _ in items]
        self.numbers: dict[bytes, int] = {}
        number = self.numbers.setdefault
        sizes = np.array([len(words) for _, words in items], np.int64)
        pool = np.array([number(w, len(self.numbers) + 1) for _, words in items for w in words], np.int32)
        first = np.cumsum(sizes) - sizes
        lengths = np.minimum(sizes, window)
        self.tables = []
        for m in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == m)
            n = sizes[own] - m + 1
            owners = np.repeat(own, n)
            starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owners]
            self.tables.append(LengthTable(m, pool, *self._distinct(m, pool, starts, owners)))

    @staticmethod
    def _distinct(m: int, pool: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the repetitions of a pattern in one item."""
        whole = _rolled(pool, m)[starts]
        order = np.lexsort((starts, owners, whole))
        starts, owners, whole = starts[order], owners[order], whole[order]
        again = np.zeros(len(starts), bool)
        again[1:] = (whole[1:] == whole[:-1]) & (owners[1:] == owners[:-1])
        for k in range(m):  # by the words, not the hash alone
            again[1:] &= pool[starts[1:] + k] == pool[starts[:-1] + k]
        return starts[~again], owners[~again]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of all occurrences, and the ids of the items they belong to."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))  # 0: in no item
        spans, owners = [], set()
        for table in self.tables:
            found, whose = table.search(ids)
            spans += found
            owners |= whose
        return spans, {self.names[i] for i in owners}


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, settings: DecontamSettings) -> Iterator[list]:
    """The items, a bounded block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for r in rows.toLocalIterator():
        words = item_words(r.t)
        if block and size + len(words) > settings.block_words:
            yield block
            block, size = [], 0
        block.append((r.i, words))
        size += len(words)
    if block:
        yield block


def _search_block(docs: DataFrame, keep: list[str], block: list, settings: DecontamSettings) -> DataFrame:
    """docs (keep, __text and the hits so far) with the block's hits merged in."""
    shared = docs.sparkSession.sparkContext.broadcast(PatternTables(block, settings.window))

    def make():
        tables = shared.value

        def search(texts, spans, items):
            n_words, all_spans, all_items = [], [], []
            for text, s, i in zip(texts.to_pylist(), spans.to_pylist(), items.to_pylist()):
                words = item_words(text)
                found, ids = tables.search(words)
                n_words.append(len(words))
                all_spans.append([{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in s] + found)])
                all_items.append(sorted({*i, *ids} - {None}))
            return n_words, all_spans, all_items

        return search

    fields = [("__n", "bigint"), ("__spans", SPANS), ("__items", "array<string>")]
    return map_arrow(docs, [*keep, "__text"], ["__text", "__spans", "__items"], fields, make)


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str],
                       settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """The ``keep`` columns of docs plus __text, __n (words), __spans (hit word spans) and __items (ids)."""
    found = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"),
        F.array().cast(SPANS).alias("__spans"), F.array().cast("array<string>").alias("__items"))
    blocks = item_blocks(benchmark, settings)
    block = next(blocks, [])
    while block is not None:
        found = _search_block(found, keep, block, settings)
        block = next(blocks, None)
        if block is not None:  # one block's tables in a worker at a time
            found = materialise(found, "hits")
    return found


def contamination_report(docs: DataFrame, benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = find_contamination(docs, benchmark, ["doc_id"], settings)
    n_hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["b"] - x["a"]))
    return found.select(
        "doc_id", F.col("__n").alias("n_words"), n_hit.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """The documents in which no pattern occurs, with their columns."""
    others = [c for c in docs.columns if c != "text"]  # the text travels once, beside them
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"), "text")
    found = find_contamination(packed, benchmark, ["__row"], settings)
    return found.where(F.size("__spans") == 0).select(
        *[F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])
