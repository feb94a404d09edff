"""Operators 11, 12 and 13 against brute force on small tables."""

import collections
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import audit, runs, warc

DOCS = "doc_id long, text string, lang string, hash string, salt int, row string, part string"


def audit_rows():
    rng = random.Random(3)
    say = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    texts = [say(rng.choice([0, 3, 99, 100, 130]), rng.choice([20, 90, 9000])) for _ in range(60)]
    texts += [t.upper() for t in texts[:12]] + [t + " #" for t in texts[5:15]] + ["", "x | y", "É" * 30, "AB" + "é" * 18]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), "en") for i in range(50)]
    rows += [(None, texts[3], "en"), (None, texts[3], "en"), (None, None, None), (7, texts[7], "en"), (7, texts[7], "fr"),
             (300, None, "en"), (301, None, None), (7, texts[9], "en")]
    rows += [(1000 + i, "copied over and over", "en") for i in range(2600)] + [(999, "copied over and over", "de")] * 1300
    return rows


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marked = []
    for i, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and first[t] < i}
        marked.append((lang or "", "".join(k for k, v in fails.items() if v), i in good, i in toxic))
    counts = collections.Counter(marked)
    out = {}
    for part in {m[0] for m in marked}:
        mine = [(m, n) for m, n in counts.items() if m[0] == part]
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for s, letter in enumerate(order):
                before = set(order[:s])
                row = collections.Counter()
                for (_, fails, g, x), n in mine:
                    gone, own = bool(before & set(fails)), letter in fails
                    row["kept"] += n * (not gone and not own)
                    row["removed"] += n * (own and not gone)
                    row["redundant"] += n * (own and gone)
                    row["unique_fails"] += n * (fails == letter)
                    row["good_lost"] += n * (own and not gone and g)
                    row["toxic_lost"] += n * (own and not gone and x)
                removed_by[letter] += row["removed"]
                out[part, "".join(order), s + 1] = (letter, row)
        for (p, o, s), (letter, row) in out.items():
            if p == part:
                row["shapley"] = removed_by[letter]
    return {k: tuple(r[c] for c in COUNTS) for k, (_, r) in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (None, 1, 1), (1500, 1, None), (999, None, 1), (5000, 1, 1)]
    docs = spark.createDataFrame([(*r, "h", 1, "r", "p") for r in rows], DOCS).repartition(5)
    got = audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_marks_copies_by_salted_join(spark):
    docs = spark.createDataFrame([(*r, "h", 1, "r", "p") for r in audit_rows()], DOCS).select("doc_id", "text")
    found = audit.later_copies(docs.withColumns({"text": F.coalesce("text", F.lit(""))}), hot_parts=1)
    assert found.where("text = 'copied over and over'").count() == 2600
    assert found.where("doc_id = 999").count() == 0
    assert found.where("doc_id is null").count() == 0


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit_filters(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


PAGES = "page_id long, url string, html string, key string, member int, row int"


def page_rows():
    rng = random.Random(4)
    long = ["<p>" + "".join(rng.choice("abc é\r\n") for _ in range(n)) for n in (998, 1000, 5000, 40000)]
    rows = [(i, f"http://h{i % 5}.example/{i % 3}?q=ü x\r\nX: y", rng.choice([*long, "short", "", None])) for i in range(120)]
    rows += [(None, None, long[2]), (None, "", long[3]), (119, "http://z/", long[2]), (500, "http://a/", long[2]),
             (500, "http://b/", long[2]), (500, "http://b/", long[2]), (501, "u", "WARC/1.1\r\n\r\n" * 200), (3, "s", "tiny"), (3, "s", "tiny")]
    return rows + [(1000 + i, f"http://hot/{i}", long[1]) for i in range(2100)]


def brute_records(rows, least=1000):
    best = {}
    for i, (page_id, url, html) in enumerate(rows):
        data = (html or "").encode()
        rank = (page_id is not None, page_id or 0, url is not None, url or "", i)
        if len(data) >= least and rank > best.get(data, ()):
            best[data] = rank
    out = collections.Counter()
    for i, (page_id, url, html) in enumerate(rows):
        data = (html or "").encode()
        win = best.get(data)
        response = win is None or win[4] == i
        out[page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit",
            None if response else (win[1] if win[0] else None)] += 1
    return out


def files_in(path):
    folder = path.removeprefix("file:")
    return {n: hashlib.sha1(open(f"{folder}/{n}", "rb").read()).hexdigest() for n in os.listdir(folder) if n.endswith(".gz")}


SMALL = warc.WarcSettings(file_bytes=30_000, split_bytes=7_000, hot_parts=1)


def test_archives_equal_brute_force_and_are_deterministic(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], PAGES)
    one = warc.write_archives(pages.repartition(3), settings=SMALL)
    other = warc.write_archives(pages.orderBy(F.rand(1)).repartition(7), settings=SMALL)
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    read = warc.read_archives(spark, one, with_payload=True).collect()
    assert collections.Counter(tuple(r[c] for c in fields) for r in read) == brute_records(rows)
    texts = collections.Counter((h or "").encode() for _, _, h in rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest and bytes(r.payload) in texts
               for r in read if r.record_type == "response")
    files = files_in(one)
    assert len(files) > 5 and files == files_in(other)
    manifest = spark.read.parquet(f"{one}/manifest").collect()
    assert {m.file for m in manifest} == set(files) and sum(m.records for m in manifest) == len(rows)
    assert max(len(m.splits) for m in manifest) > 2
    assert os.listdir(one.removeprefix("file:") + "/_temporary") == []


def test_archives_are_plain_warc_files(spark):
    pages = spark.createDataFrame([(1, "http://a/b c", "x" * 2000), (2, "http://a/d", "x" * 2000)], "page_id long, url string, html string")
    path = warc.write_archives(pages).removeprefix("file:")
    import gzip

    text = gzip.decompress(open(f"{path}/pages-00000000.warc.gz", "rb").read()).decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert "WARC-Target-URI: http://a/b%20c\r\n" in text and text.count("x" * 2000) == 1
    response = warc.record_id("response", 2, "http://a/d", hashlib.sha1(b"x" * 2000).digest())
    assert f"WARC-Record-ID: {response}\r\n" in text and f"WARC-Refers-To: {response}\r\n" in text


def test_reader_trusts_the_manifest_only_and_checks_digests(spark):
    pages = spark.createDataFrame([(1, "http://a/", "y" * 3000)], "page_id long, url string, html string")
    path = warc.write_archives(pages)
    folder = path.removeprefix("file:")
    open(f"{folder}/pages-00000009.warc.gz", "wb").write(b"left by a lost task")
    assert warc.read_archives(spark, path).count() == 1
    name = f"{folder}/pages-00000000.warc.gz"
    data = open(name, "rb").read()
    info = len(warc.info_record("pages-00000000.warc.gz", warc.WarcSettings.date))
    record = zlib.decompress(data[info:], 31).replace(b"yyyy", b"zyyy", 1)
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    bad = gz.compress(record) + gz.flush()
    open(name, "wb").write(data[:info] + bad)
    spark.createDataFrame([("pages-00000000.warc.gz", info + len(bad), 1, [0])],
                          "file string, bytes bigint, records bigint, splits array<bigint>").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archives(spark, path).collect()


def test_commit_may_run_again(spark):
    pages = spark.createDataFrame([(1, "http://a/", "y")], "page_id long, url string, html string")
    path = warc.write_archives(pages)
    entries = spark.read.parquet(f"{path}/manifest").withColumn("temporary", F.lit("_temporary/gone"))
    assert warc._committed(entries, path).count() == 1
    with pytest.raises(Exception, match="missing or incomplete"):
        warc._committed(entries.withColumn("bytes", F.col("bytes") + 1), path).count()


def test_archives_of_nothing(spark):
    path = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(spark, path).collect() == []


def brute_runs(w, min_words=6, min_periods=4):
    out = {}
    for q in range(1, len(w) // min_periods + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s >= max(min_words, min_periods * q):
                out.setdefault((s, i), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def random_words(rng):
    w = []
    for _ in range(rng.randrange(1, 6)):
        a = rng.choice([1, 2, 3, 20])
        if rng.random() < 0.6:
            u = [rng.randrange(a) for _ in range(rng.randrange(1, 30))]
            w += (u * rng.randrange(1, 9))[: rng.randrange(1, 150)]
        else:
            w += [rng.randrange(a) for _ in range(rng.randrange(30))]
    return w


def test_runs_equal_brute_force_in_any_portions():
    rng = random.Random(5)
    for _ in range(3000):
        w = random_words(rng)
        expected = brute_runs(w)
        assert runs.runs_of(w) == expected
        catcher, i = runs.SquareCatcher(), 0
        while i < len(w):
            j = i + rng.choice([1, 1, 2, 5, 40])
            catcher.append(np.array(w[i:j]))
            i = j
        assert catcher.runs() == expected
    three = runs.RunSettings(min_words=3, min_periods=3)
    for _ in range(500):
        w = random_words(rng)
        assert runs.runs_of(w, three) == brute_runs(w, 3, 3)


def test_squares_are_told_as_words_arrive():
    catcher = runs.SquareCatcher()
    told = [catcher.append(np.array([x])) for x in [9, 1, 2, 3, 1, 2, 3, 1, 2, 3, 8]]
    assert told[6] == [(1, 3)] and sum(map(len, told)) == 1


def test_long_repetitive_texts_take_near_linear_work():
    fibonacci, b = [0], [0, 1]
    while len(b) < 30_000:
        fibonacci, b = b, b + fibonacci
    for w in (["a"] * 200_000, list(range(1, 90)) * 2000, ([1] * 7 + [2]) * 20_000, b):
        found = runs.runs_of(w)
        assert all(length >= max(6, 4 * q) for _, length, q in found)
    assert runs.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]


def test_run_query_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " \n".join(f"Ä{x}" for x in random_words(rng) + [rng.randrange(9) for _ in range(40)])) for i in range(150)]
    rows += [(None, "a a a a a a a"), (None, None), (200, None), (201, ""), (202, " \t"), (203, "b" * 9), rows[0], rows[0],
             (204, " ".join(["x y"] * 3000)), (205, " ".join("one two three".split() * 4))]
    docs = spark.createDataFrame([(*r, "z", "c") for r in rows], "doc_id long, text string, runs string, collapsed string").repartition(3)
    got = collections.Counter(map(tuple, runs.run_digest(runs.periodic_runs(docs, prepare=runs.echo_words)).collect()))
    expected = collections.Counter()
    planted = 0
    for i, text in rows:
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w)
        gone = {j for s, length, q in found for j in range(s + q, s + length)}
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        four = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        expected[i, len(found), *four, sha("".join("%d,%d,%d\n" % r for r in found).encode()),
                 sha(b" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert got == expected and planted > 5
