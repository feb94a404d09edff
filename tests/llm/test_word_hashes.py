"""The words of a chunk of texts are hashed together: no Python step per word."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from spendlake.llm.common import LONG_WORD, text_chunks, word_hashes
from spendlake.llm.repeats import WindowSettings, _edge_windows, _occurrence_rows
from spendlake.llm.suffix_array import _suffix_rows


class Taken:
    """In place of a DataFrame: hands out the function given to mapInArrow."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


@pytest.fixture
def calls(monkeypatch):
    seen, plain = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x, *a: seen.append(1) or plain(x, *a))
    return seen


def texts(seed=1, n=300):
    rng = random.Random(seed)
    chars = ["a", "b", "Z", "é", "漢", "\x00", "\x85", " ", "\x1c", "\x08", "\x0e", "\xa0"]
    word = lambda: "".join(rng.choice(chars) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 33])))
    gap = lambda: "".join(rng.choice(" \t\n\x0b\x0c\r") for _ in range(rng.choice([1, 1, 3])))
    out = [gap() * rng.randrange(2) + "".join(word() + gap() for _ in range(rng.randrange(9))) + word() * rng.randrange(2)
           for _ in range(n)]
    out += ["a" * k for k in range(1, 3 * LONG_WORD)] + ["a" * 40 + "b" + "a" * 80, "", " ", "x", "x", "\x00", "\x00\x00"]
    rng.shuffle(out)
    return [None, "", *out, None, " "]


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_equal_words_and_only_they_have_equal_hashes(limit):
    raw = [None if t is None else t.encode() for t in texts()]
    want = [(t or b"").split() for t in raw]
    found, upto = {}, 0
    for first, sizes, data in text_chunks(iter(raw), limit):
        assert first == upto and len(data) == sizes.sum()
        counts, h = word_hashes(data, sizes)
        upto += len(sizes)
        assert counts.tolist() == [len(w) for w in want[first:upto]]
        for word, value in zip((w for ws in want[first:upto] for w in ws), h.tolist(), strict=True):
            assert found.setdefault(word, value) == value
    assert upto == len(raw) and len(set(found.values())) == len(found)


def test_texts_without_words():
    assert list(text_chunks([], 10)) == []
    for raw in ([None], [b"", b""], [b" \n", b"", b"\t"]):
        (_, sizes, data), = text_chunks(raw, 10)
        counts, h = word_hashes(data, sizes)
        assert counts.tolist() == [0] * len(raw) and len(h) == 0


def test_scans_hash_only_long_words_one_by_one(spark, calls):
    s = WindowSettings(size=4, run=2)
    text = " ".join(f"word{i}" for i in range(500)) + " " + "y" * (LONG_WORD + 1)
    k1, k2 = pa.array([7, 8], pa.int64()), pa.array([1, 2], pa.int32())
    raw = pa.RecordBatch.from_arrays([pa.array([text.encode(), None]), k1, k2], names=["text", "k1", "k2"])
    (rows,) = _occurrence_rows(Taken(), s)([raw])
    assert sum(rows.column(5).to_pylist()) == 501 - s.size + 1 and set(rows.column(2).to_pylist()) == {7}
    assert len(calls) == 1

    edge = {"a": 5, "lo": 3, "n": 2, "at": 1, "settled": True}
    last = {"a": 6, "lo": 497, "n": 1, "at": 2, "settled": False}
    kind = pa.list_(pa.struct([("a", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("settled", pa.bool_())]))
    z = pa.array([zstandard.ZstdCompressor().compress(t.encode()) for t in ("a b c d e f", text)])
    dealt = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), k1, k2, z, pa.array([[{**edge, "lo": 0}], [edge, last]], kind)], names=["doc_id", "k1", "k2", "z", "edges"])
    (out,) = _edge_windows(Taken(), s, None)([dealt])
    assert [out.column(i).to_pylist() for i in range(1, 6)] == [
        [5, 5, 5, 5, 6], [True] * 4 + [False], [7, 7, 8, 8, 8], [1, 1, 2, 2, 2], [0, 1, 3, 4, 497]]
    assert len(set(out.column(0).to_pylist())) == 5
    (suffixes,) = _suffix_rows(Taken(), s)([dealt])
    assert [len(x) for x in suffixes.column(1).to_pylist()] == [16, 16, 8]  # two words are left after the last minimiser
    assert np.concatenate(suffixes.column(7).to_pylist()).tolist() == out.column(0).to_pylist()
    assert len(calls) == 3
