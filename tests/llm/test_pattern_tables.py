"""Operator 3: the pattern tables against a search for every pattern, also of many repetitions and lengths."""

import random

import numpy as np
import pytest

from spendlake.llm.decontam import PatternTables


def plain_search(items, window, words):
    patterns = {}
    for item_id, own in items:
        m = min(window, len(own))
        for a in range(len(own) - m + 1 if m else 0):
            patterns.setdefault(tuple(own[a : a + m]), set()).add(item_id)
    spans, ids = set(), set()
    for m in {len(p) for p in patterns}:
        for a in range(len(words) - m + 1):
            found = patterns.get(tuple(words[a : a + m]))
            if found:
                spans.add((a, a + m))
                ids |= found
    return sorted(spans), ids


@pytest.mark.parametrize("seed", range(4))
def test_tables_equal_a_search_for_every_pattern(seed):
    rng = random.Random(seed)
    for _ in range(100):
        vocabulary = [b"%d" % i for i in range(rng.choice([2, 4, 12]))]
        items = [(rng.choice([None, "a", "b", str(k)]), rng.choices(vocabulary, k=rng.randrange(9)))
                 for k in range(rng.randrange(7))]
        window = rng.randrange(1, 6)
        tables = PatternTables(items, window)
        for _ in range(4):
            words = rng.choices([*vocabulary, b"zz"], k=rng.randrange(25))
            spans, ids = tables.search(words)
            assert (sorted(spans), ids) == plain_search(items, window, words)


def test_tables_are_small_arrays():
    words = [b"w%d" % x for x in np.random.default_rng(1).zipf(1.3, 100_000) % 30_000]
    items = [(str(i), words[i : i + 100]) for i in range(0, len(words), 100)] + [("again", words[:500])]
    tables = PatternTables(items, 10)
    held = sum(a.nbytes for t in tables.tables for a in (t.shift, t.whole, t.starts, t.owners, t.slots)) + len(tables.tables[0].pool)
    assert held < 80 * len(words)
    spans, ids = tables.search([b"other", *words[85:125]])
    assert {"0", "100", "again"} <= ids and (1, 11) in spans and "300" not in ids
