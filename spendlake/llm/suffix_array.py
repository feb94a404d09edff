"""Substring deduplication with sparse suffix arrays (operator 1).

Suffixes are kept only at minimiser positions: every passage of ``size`` words has one whose run of
``run`` words lies inside it, and equal passages have it at the same place.  Suffixes whose first
words occur once in the corpus are dropped by a count, suffixes that stand in equal surroundings
settle each other; the others are sorted (range-partitioned by first run and following words, so a
frequent run is split by what follows).  Neighbours in that order share the longest common prefix
that a suffix has with any other; it bounds how far a match reaches to the right, and only
matches that can still reach ``size`` words are extended to the left, window by window, which
also confirms them.

The result has one row per repeated passage and document: passages of at least ``size`` words, of
which every window of ``size`` words also stands in another document.

Defined cases: null, empty and shorter texts have no passages; rows with equal id and text are one
document; null ids are ids; equal passages are reported in each document; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, window_hashes
from .repeats import (WindowSettings, covered_words, dealt, edge_chunks, repeated_windows, spans_of, split_words,
                      stretches)

SETTINGS = WindowSettings(size=50, run=10, across=True)


def _suffix_rows(joined: DataFrame, s: WindowSettings) -> DataFrame:
    """a, suffix (4 bytes per word from the minimiser on, at most size words), k1, k2, lo, at, settled and
    the hashes of the occurrence's windows."""

    def run(batches):
        for h, e in edge_chunks(batches):
            short = (h >> np.uint64(32)).astype(">u4")
            from_word = e["base"] + e["lo"] + e["at"]
            to_word = np.minimum(from_word + s.size, e["end"])
            suffix = [short[i:j].tobytes() for i, j in zip(from_word.tolist(), to_word.tolist())]
            starts = stretches(e["base"] + e["lo"], e["n"])
            found = window_hashes(h, starts, s.size, 4).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(e["n"])])
            hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([
                pa.array(e["a"]), pa.array(suffix, pa.binary()), *[pa.array(e[k]) for k in ("k1", "k2", "lo", "at", "settled")], hashes,
            ], names=["a", "suffix", "k1", "k2", "lo", "at", "settled", "hashes"])

    picked = joined.select("doc_id", "k1", "k2", "z", "edges")
    return picked.mapInArrow(
        run, "a bigint, suffix binary, k1 bigint, k2 int, lo int, at int, settled boolean, hashes array<bigint>")


def common_words(x: bytes, y: bytes) -> int:
    """Words that two suffixes share from the start."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // 4
    a, b = np.frombuffer(x[:n], ">u4"), np.frombuffer(y[:n], ">u4")
    return int(np.argmax(a != b))


def _compare_neighbours(joined: DataFrame, s: WindowSettings) -> DataFrame:
    """The windows of sorted suffixes that can be part of a match (columns of the shared window check).

    A window that starts o words before the minimiser needs size - o equal words from it on.  At the
    edges of a sorted partition the neighbour is unknown and counts as equal."""
    # written, since the range partitioning reads its rows twice (once to sample them)
    rows = materialise(_suffix_rows(joined, s), "suffixes").repartitionByRange("a", "suffix").sortWithinPartitions("a", "suffix")

    def run(batches):
        held = None  # (row, longest prefix shared with the row before)
        names = ["w", "a", "settled", "k1", "k2", "lo"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
        out: list[list] = [[] for _ in names]

        def finish(row, reach):
            for i, w in enumerate(row["hashes"]):
                if s.size - (row["at"] - i) <= reach:
                    for column, value in zip(out, (w, row["a"], row["settled"], row["k1"], row["k2"], row["lo"] + i)):
                        column.append(value)

        for b in batches:
            for row in b.to_pylist():
                shared = s.size
                if held is not None:
                    before, reach = held
                    shared = common_words(before["suffix"], row["suffix"]) if before["a"] == row["a"] else 0
                    finish(before, max(reach, shared))
                held = (row, shared)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)
            out = [[] for _ in names]
        if held is not None:
            finish(held[0], s.size)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    return rows.mapInArrow(run, "w bigint, a bigint, settled boolean, k1 bigint, k2 int, lo int")


def repeated_passages(docs: DataFrame, settings: WindowSettings = SETTINGS) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words and sha256 of each repeated passage."""
    rows = dealt(docs)
    found = repeated_windows(docs, rows, settings, prune=_compare_neighbours)
    joined = rows.join(found, ["k1", "k2"]).select("doc_id", "k1", "k2", "z", "__found")

    def make():
        import hashlib

        def spans(texts, found):
            out = []
            for words, ranges in zip(split_words(texts), found.to_pylist()):
                out.append([
                    {"a": a, "b": b, "s": hashlib.sha256(b" ".join(words[a:b])).hexdigest()}
                    for a, b in spans_of(covered_words(len(words), ranges, settings.size))])
            return (out,)

        return spans

    passages = map_arrow(joined, ["doc_id"], ["z", "__found"], [("__p", "array<struct<a:int,b:int,s:string>>")], make)
    each = passages.select("doc_id", F.explode("__p").alias("__p"))
    return each.select(
        "doc_id", F.col("__p.a").cast("bigint").alias("start_word"), F.col("__p.b").cast("bigint").alias("end_word"),
        (F.col("__p.b") - F.col("__p.a")).cast("bigint").alias("n_words"), F.col("__p.s").alias("sha256"))
