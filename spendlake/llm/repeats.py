"""Repeated word windows over a corpus: the part that operators 1 and 7 share.

A window is ``size`` consecutive words of a document.  Each window belongs to the k-word run with
the smallest hash in it (its minimiser), so equal windows belong to equal runs wherever they
stand, and a minimiser owns a range of consecutive windows: an *occurrence*.  The words that an
occurrence's windows cover are its *context*.

1. Occurrences are counted by (minimiser, context), summed per task first, so a text with a
   million copies is one row per task.  A minimiser that occurs once cannot repeat and is dropped.
2. Contexts that repeat as a whole settle all their windows (the inside of long repeats).
3. Where a minimiser has several contexts (the edges of repeats), one occurrence of each context
   compares window by window.
4. Repeated windows are gathered per document and meet the text again.

The text is shuffled once (by row key) and both reads of it share that shuffle.  Joins on hot
minimisers are inner joins that Spark splits.  Nothing is collected to the driver.

Row keys are hashes of (doc_id, text): repeated rows have one key and are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (all_window_hashes, map_arrow, materialise, odd_multipliers, scramble, text_chunks, window_hashes,
                     word_hashes)

CHUNK_BYTES = 2_000_000
# Lower bits of an order value hold the position; longer arrays are cut into overlapping parts.
POSITION_BITS = 20


@dataclass(frozen=True)
class WindowSettings:
    """``size``: words in a window; ``run``: words in a minimiser run; ``across``: a window repeats only
    if it stands in another document too (else anywhere else)."""

    size: int
    run: int = 8
    across: bool = False


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, v
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def occurrences(h: np.ndarray, counts: np.ndarray, s: WindowSettings) -> dict[str, np.ndarray]:
    """Occurrences in an array of word hashes of several documents (``counts`` words each): doc (index),
    lo (first window, in the document), n (windows), at (minimiser's place from lo), a (minimiser)
    and c (context)."""
    limit = 1 << POSITION_BITS
    if len(h) > limit:
        parts, step = [], limit - s.size
        doc_of = np.repeat(np.arange(len(counts)), counts)
        start_of = np.cumsum(counts) - counts
        for at in range(0, len(h) - s.size + 1, step):
            part = slice(at, min(len(h), at + step + s.size - 1))
            docs, inner = np.unique(doc_of[part], return_counts=True)
            found = occurrences(h[part], inner, s)
            skipped = np.maximum(at - start_of[docs], 0)
            found["lo"] = found["lo"] + skipped[found["doc"]]
            found["doc"] = docs[found["doc"]]
            parts.append(found)
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    empty = {"doc": np.empty(0, np.int64), "lo": np.empty(0, np.int64), "n": np.empty(0, np.int64),
             "at": np.empty(0, np.int64), "a": np.empty(0, np.uint64), "c": np.empty(0, np.uint64)}
    if len(h) < s.size:
        return empty
    runs = all_window_hashes(h, s.run, 1)
    mask = np.uint64(limit - 1)
    order = (runs & ~mask) | np.arange(len(runs), dtype=np.uint64)
    place = (_sliding_min(order, s.size - s.run + 1) & mask).astype(np.int64)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(doc_of[: len(place)] == doc_of[s.size - 1 :])
    if not len(starts):
        return empty
    place = place[starts]
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate([[0], new])
    n = np.diff(np.concatenate([first, [len(starts)]]))
    lo, at = starts[first], place[first]
    doc = doc_of[lo]
    # n < size, so the first and the last window cover the whole context
    ends = np.stack([window_hashes(h, lo, s.size, 2), window_hashes(h, lo + n - 1, s.size, 2)])
    m = odd_multipliers(4, 3)
    with np.errstate(over="ignore"):
        c = scramble(ends[0] * m[0] + ends[1] * m[1] + n.astype(np.uint64) * m[2] + (at - lo).astype(np.uint64) * m[3])
    return {"doc": doc, "lo": lo - (np.cumsum(counts) - counts)[doc], "n": n, "at": at - lo, "a": runs[at], "c": c}


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, k1, k2 (row key)."""
    return docs.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))


def dealt(docs: DataFrame) -> DataFrame:
    """The keyed documents by row key, with ``z`` (the text, compressed for the shuffle)."""

    def make():
        compress = zstandard.ZstdCompressor(level=1).compress

        def squeeze(texts):
            return ([None if t is None else compress(t.encode()) for t in texts.to_pylist()],)

        return squeeze

    small = map_arrow(keyed(docs), ["doc_id", "k1", "k2"], ["text"], [("z", "binary")], make)
    return small.repartition("k1", "k2")


def split_words(column: pa.Array):
    """The words of each compressed text."""
    expand = zstandard.ZstdDecompressor().decompress
    for z in column:
        yield expand(z.as_py()).split() if z.is_valid else []


def _occurrence_rows(rows: DataFrame, s: WindowSettings) -> DataFrame:
    """a, c, k1, k2, lo, n, at of every occurrence."""

    def run(batches):
        for b in batches:
            k1, k2 = b.column(1), b.column(2)
            for first, sizes, data in text_chunks((t.as_py() for t in b.column(0)), CHUNK_BYTES):
                o = occurrences(*reversed(word_hashes(data, sizes)), s)
                rows_of = pa.array(first + o["doc"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(o["a"].view(np.int64)), pa.array(o["c"].view(np.int64)), k1.take(rows_of), k2.take(rows_of),
                    pa.array(o["lo"].astype(np.int32)), pa.array(o["n"].astype(np.int32)), pa.array(o["at"].astype(np.int32)),
                ], names=["a", "c", "k1", "k2", "lo", "n", "at"])

    texts = rows.select(F.col("text").cast("binary"), "k1", "k2")
    return texts.mapInArrow(run, "a bigint, c bigint, k1 bigint, k2 int, lo int, n int, at int")


def _settled(s: WindowSettings):
    return (F.col("k_low") != F.col("k_high")) if s.across else (F.col("times") > 1)


def repeated_windows(docs: DataFrame, rows: DataFrame, s: WindowSettings, prune=None) -> DataFrame:
    """k1, k2, __found: array of struct(lo, n), ranges of repeated windows, per row key.

    ``rows``: the dealt documents.  All their uses are in one plan and read the same columns, so
    that they share one shuffle.  ``prune``: another way from edge occurrences to the windows to
    be compared."""
    every = _occurrence_rows(keyed(docs), s)
    # Tables are written before a join on a frequent minimiser: Spark splits such a join only if it
    # reads both sides straight from a shuffle.
    frequent = every.groupBy("a").agg(F.count(F.lit(1)).alias("n_a")).where("n_a > 1").select("a")
    frequent = materialise(frequent, "frequent")
    occ = materialise(every.join(frequent, "a"), "occurrences")
    contexts = occ.groupBy("a", "c").agg(
        F.count(F.lit(1)).alias("times"), F.min("k1").alias("k_low"), F.max("k1").alias("k_high"))
    variants = materialise(occ.groupBy("a").agg((F.min("c") != F.max("c")).alias("edge")), "variants")
    alive = contexts.join(variants, "a").select("a", "c", "k_low", _settled(s).alias("settled"), "edge")
    # written here, so that the next join deals occurrences by (a, c) and not by a frequent minimiser alone
    alive = materialise(alive.where("settled or edge"), "contexts")
    met = materialise(occ.join(alive, ["a", "c"]), "met")
    inside = met.where("settled").select("k1", "k2", F.struct("lo", "n").alias("range"))
    edges = met.where("edge and k1 = k_low").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("a", "lo", "n", "at", "settled")).alias("edges"))
    windows = _edge_windows(rows.join(edges, ["k1", "k2"]), s, prune)
    checked = windows.groupBy("w", "a").agg(
        F.max("settled").alias("any"), F.count(F.lit(1)).alias("times"),
        F.min("k1").alias("k_low"), F.max("k1").alias("k_high"))
    checked = checked.where(F.col("any") | _settled(s)).select("w", "a")
    outside = windows.where("not settled").join(checked, ["w", "a"]).select(
        "k1", "k2", F.struct("lo", F.lit(1).alias("n")).alias("range"))
    # equal rows report the same ranges: each is kept once
    return inside.unionByName(outside).groupBy("k1", "k2").agg(F.collect_set("range").alias("__found"))


def edge_chunks(batches):
    """Chunks of dealt documents with their ``edges``: yields the word hashes ``h`` of the chunk and, per edge,
    a, lo, n, at, settled, k1, k2 and ``base`` and ``end`` (its document's words in ``h``), all as arrays."""
    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        col = {f.name: b.column(i) for i, f in enumerate(b.schema)}
        texts = (expand(z.as_py()) if z.is_valid else None for z in col["z"])
        for first, sizes, data in text_chunks(texts, CHUNK_BYTES):
            counts, h = word_hashes(data, sizes)
            lists = col["edges"].slice(first, len(sizes))
            flat = lists.flatten()
            e = {f.name: v.to_numpy(zero_copy_only=False) for f, v in zip(flat.type, flat.flatten())}
            doc = np.repeat(np.arange(len(sizes)), lists.value_lengths().to_numpy())
            for k in ("k1", "k2"):
                e[k] = col[k].to_numpy()[first + doc]
            end = np.cumsum(counts)
            yield h, {**e, "base": (end - counts)[doc], "end": end[doc]}


def stretches(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 .. start + n - 1 of each start, one after the other."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _edge_windows(joined: DataFrame, s: WindowSettings, prune) -> DataFrame:
    """w (hash of the window), a, settled, k1, k2, lo for the windows of edge occurrences."""
    if prune is not None:
        return prune(joined, s)

    def run(batches):
        for h, e in edge_chunks(batches):
            lo = stretches(e["lo"].astype(np.int64), e["n"])
            w = window_hashes(h, lo + np.repeat(e["base"], e["n"]), s.size, 4)
            yield pa.RecordBatch.from_arrays([
                pa.array(w.view(np.int64)), *[pa.array(np.repeat(e[k], e["n"])) for k in ("a", "settled", "k1", "k2")],
                pa.array(lo.astype(np.int32)),
            ], names=["w", "a", "settled", "k1", "k2", "lo"])

    picked = joined.select("doc_id", "k1", "k2", "z", "edges")
    return picked.mapInArrow(run, "w bigint, a bigint, settled boolean, k1 bigint, k2 int, lo int")


def covered_words(n_words: int, ranges: list, size: int) -> np.ndarray:
    """Mask of the words inside a repeated window; ranges: (first window, windows)."""
    steps = np.zeros(n_words + 1, np.int64)
    if ranges:
        lo = np.array([r["lo"] for r in ranges])
        end = lo + np.array([r["n"] for r in ranges]) - 1 + size
        np.add.at(steps, lo, 1)
        np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))
