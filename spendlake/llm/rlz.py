"""Substring deduplication by repeated windows, in place of relative Lempel-Ziv parsing (operator 7).

The corpus itself is the reference.  Its blocks are the partitions of an index from minimisers to
the contexts in which they stand (see ``repeats.py``); every document's occurrences meet every
block that can hold a match, by key, instead of scanning block after block.  No factors (reference
position, length) are made: the windows that stand elsewhere too are united, and each stretch of
words that they cover is a duplicate span, whatever references its parts have.  The union is what a
greedy parse with a check of each window at factor boundaries removes, without keeping references.

Every occurrence of a repeated passage is a span, the first included.  Windows are judged on the
input, not on what is left.

Defined cases: null or empty texts have no words and keep nothing; texts shorter than a window
keep all words; rows with equal id and text repeat each other (their windows start elsewhere
too); null ids are ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .repeats import WindowSettings, covered_words, dealt, repeated_windows, spans_of, split_words

SETTINGS = WindowSettings(size=35)
SPANS = "array<struct<a:int,b:int>>"


def parsed_documents(docs: DataFrame, settings: WindowSettings = SETTINGS, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and spans (word ranges covered by
    repeated windows); with_text: also kept_text (kept words joined by one space)."""
    rows = dealt(docs)
    found = repeated_windows(docs, rows, settings)
    joined = rows.join(found, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "z", "__found")

    def make():
        def parse(texts, found):
            out = [[], [], [], []]
            kept_texts = []
            for words, ranges in zip(split_words(texts), found.to_pylist()):
                mask = covered_words(len(words), ranges or [], settings.size)
                if ranges:
                    kept = b" ".join([w for w, gone in zip(words, mask.tolist()) if not gone])
                else:
                    kept = b" ".join(words)
                spans = spans_of(mask) if ranges else []
                for column, value in zip(out, (len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(),
                                               [{"a": a, "b": b} for a, b in spans])):
                    column.append(value)
                if with_text:
                    kept_texts.append(kept.decode())
            return (*out, kept_texts) if with_text else out

        return parse

    fields = [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string"), ("spans", SPANS)]
    if with_text:
        fields.append(("kept_text", "string"))
    return map_arrow(joined, ["doc_id"], ["z", "__found"], fields, make)


def remove_repeats(docs: DataFrame, settings: WindowSettings = SETTINGS) -> DataFrame:
    """doc_id and text without the words in duplicate spans."""
    parsed = parsed_documents(docs, settings, with_text=True)
    return parsed.select("doc_id", F.col("kept_text").alias("text"))
