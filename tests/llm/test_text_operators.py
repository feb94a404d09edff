"""Operators 3, 4, 5, 6 against brute force, round trips and hand-written cases."""

import hashlib
import os
import random
import re

import numpy as np
import pytest

from spendlake.llm import decontam, licences, packing, site_tree

VOCABULARY = packing.PackSettings().vocabulary
SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- operator 3

def brute_contamination(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    pats = []
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        pats += [(i, w[k : k + m]) for k in range(len(w) - m + 1)] if m else []
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    if i is not None:
                        ids.add(str(i))
        text = ",".join(sorted(ids))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 30])
def test_contamination_equals_brute_force(spark, block_words):
    rng = random.Random(3)
    vocab = ["a", "B", "cc", "Été", "x9", "zz"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 12, 15]))) for i in range(8)] + [(3, say(11)), (None, say(12)), (20, None), (21, "..")]
    docs = [(i, say(rng.choice([0, 1, 5, 40, 200]))) for i in range(30)] + [(7, None), (None, items[5][1]), (31, ""), (31, "")]
    docs += [(40 + i, f"{say(5)} {items[i][1]} {say(5)}") for i in range(8)]
    settings = decontam.DecontamSettings(block_words=block_words)
    got = decontam.contamination_report(
        frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), settings
    ).drop("spans", "items").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_contamination(docs, items)


def test_decontaminate_keeps_clean_rows_and_clashing_columns(spark):
    docs = frame(spark, [(1, "one two three", 5), (2, "quite other words", 6), (3, None, 7)], "doc_id long, text string, __spans int")
    items = frame(spark, [(1, "two THREE")], "item_id long, text string")
    got = decontam.decontaminate(docs, items)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(2, "quite other words", 6), (3, None, 7)]
    empty = frame(spark, [], "item_id long, text string")
    assert decontam.decontaminate(docs, empty).count() == 3
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


# ---------------------------------------------------------------- operator 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site-header">Site</header><nav><ul><li><a href="/x">X</a></li></ul></nav><div class="notice">Cookies</div>
<!-- ad --><div class="ad">Buy {0}</div><form><label>Mail</label><input></form>
<article><h1>Title {0}</h1><p><b>First &amp; second.<br><p>Next&nbsp;line  with
 breaks {0}</p><div class="share">Share</div><ul><li>one<li>two</ul></article>
<div id="comments"><p>Comment {0}</p></div><aside>Side</aside><footer>&copy; {0}</footer>{1}"""


def test_main_text_of_articles(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(i, "</body></html>" if i % 2 else "")) for i in range(6)]
    pages += [(10, None, None), (11, "http://h.example/e", ""), (12, "x", "plain &lt;text"), (3, "http://h.example/3", PAGE.format(3, ""))]
    df = frame(spark, pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in site_tree.extract_pages(df.withColumn("__low", df.url)).collect()}
    assert got[0].text == "Title 0\nFirst & second.\nNext line with breaks 0\none\ntwo"
    assert got[1].n_chars == len(got[1].text) and got[1].text.startswith("Title 1")
    assert (got[10].text, got[10].n_chars, got[10].url) == ("", 0, None)
    assert got[11].text == "" and got[12].text == "plain <text"
    assert site_tree.extract_pages(df).count() == len(pages)
    assert site_tree.extract_pages(df.limit(0)).count() == 0


STORY = "<h1>Head line</h1><p>First part of the story, quite long.</p><p>Second part of the story, as long.</p>"
TEXT = "Head line\nFirst part of the story, quite long.\nSecond part of the story, as long."


@pytest.mark.parametrize("name", ["class='content-sidebar-wrap'", "class=has-sidebar", "class=no-sidebar", "id='page-header-wrap'",
                                  "class='ad-free'", "class='side menu-page'"])
def test_layout_wrappers_hide_nothing(name):
    box = "<nav>Go</nav><div class=comments><article>A comment</article></div><div class=ad>Buy this</div><footer>End</footer>"
    for story in (f"<article>{STORY}</article>", f"<main>{STORY}</main>"):
        for page in (f"<body><div {name}>{story}{box}</div>", f"<body><div {name}><div {name}>{story}</div>{box}</div>"):
            assert site_tree.main_text(page) == TEXT, page
    if "ad-" not in name:
        assert site_tree.main_text(f"<body><div {name}><div>{STORY}</div>{box}</div>") == TEXT
        assert site_tree.main_text(f"<body><form {name}><div>{STORY}</div></form><footer>End</footer></body>") == TEXT


def test_open_heads_and_stories_outside_articles():
    for head in ("<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title>", "<head><title>T</title><style>p{}</style><body class=x>"):
        assert site_tree.main_text(f"{head}<article>{STORY}</article>") == TEXT
        assert site_tree.main_text(f"{head}{STORY}") == TEXT
    assert site_tree.main_text("<head><title>T</title>Plain words") == "Plain words"
    for other in ("<article>A teaser</article>", "<section><article><p>A comment</p></article></section>"):
        got = site_tree.main_text(f"<body><div id=content>{STORY}</div>{other}")
        assert got.startswith(TEXT), got
    side = "<div class=sidebar><article>A teaser</article></div><div class=comments><article>A comment</article></div>"
    assert site_tree.main_text(f"<body><div id=content>{STORY}</div>{side}") == TEXT
    few = "<article><p>Short story.</p></article>"
    assert site_tree.main_text(f"<body>{few}<div class=ad>{'Buy this now. ' * 30}</div><div class=sidebar>{STORY}</div>") == "Short story."


def test_quotes_open_values_only_after_an_equals_sign():
    from spendlake.llm.site_tree import blocks_of

    texts = lambda html: [b.text() for b in blocks_of(html)]
    assert texts("<article><p>First</p><p title=it's>Second part...</p><p>Third part, isn't it.</p></article>") == [
        "First", "Second part...", "Third part, isn't it."]
    assert texts("<p title='a>b' data=\"x>y\">one</p><p \"stray>two</p><a href=x title=\"it's\">three</a>") == ["one", "two", "three"]
    assert texts("<div class=\"a\"id='b'>four</div><p title=\"never closed>five") == ["four"]


def test_style_tree_removes_repeated_branches(spark):
    page = '<body><div class="top">Welcome to the site</div><div class="text"><p>Story {0} of its own</p></div><div class="end">All the same</div></body>'
    df = frame(spark, [(i, f"http://s.example/{i}", page.format(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.text for r in site_tree.extract_pages(df).collect()} == {f"Story {i} of its own" for i in range(8)}
    alone = frame(spark, [(1, "http://one.example/", page.format(1))], "page_id long, url string, html string")
    assert site_tree.extract_pages(alone).first().text == "Welcome to the site\nStory 1 of its own\nAll the same"


# ---------------------------------------------------------------- operator 5

def test_licence_scan(spark):
    mit = dict(licences.TEMPLATES)["MIT"]
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose."),
        (2, "Copyright (c) 2020 Somebody\n\n" + licences._MIT_GRANT + "\n" + licences._MIT_KEEP + "\n\n" + licences._MIT_WARRANTY),
        (3, licences._APACHE_NOTICE.replace(". ", ".\n")),
        (4, "This text is about a licence and permission, no more."),
        (5, None), (6, ""), (7, "word " * 20_000), (7, "word " * 20_000),
        (8, "This work is licensed under the GNU General Public License, version 3."), (9, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in licences.licence_report(frame(spark, rows, "doc_id long, text string")).collect()}
    found = {k: v.license for k, v in got.items()}
    assert found == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: None, 5: None, 6: None, 7: None, 8: "GPL-3.0", 9: "CC-BY-NC-4.0"}
    assert mit and got[1].score == 1.0 and got[4].score == 0.0


def test_licence_pruning_equals_full_comparison():
    t = licences.Templates(licences.LicenceSettings())
    rng = random.Random(5)
    texts = [x for _, x in licences.all_templates()]
    for _ in range(300):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "other"
        grams = licences.bigrams(" ".join(words))
        best = max(((2 * len(grams & licences.bigrams(x)) / (len(grams) + len(licences.bigrams(x)))) for x in texts), default=0)
        hit = t.best(grams)
        assert (hit is not None) == (best >= t.t) and (hit is None or abs(hit[0] - best) < 1e-12)


def test_licences_inside_longer_texts():
    t = licences.Templates(licences.LicenceSettings())
    prose = " ".join(f"word{i} about{i % 7} things" for i in range(900))
    for key, text in licences.TEMPLATES:
        parts = text.replace(". ", ".\n\n").replace(": ", ":\n\n")  # blank lines, as the wordings are usually set
        found = t.scan(f"{prose}\n\nCopyright (c) 2020 Somebody\n\n{parts}\n\n{prose}")
        assert [(x[0], x[1]) for x in found] == [(1.0, key)], key
        assert [(x[0], x[1]) for x in t.scan(f"{prose} {text} {prose}")] == [(1.0, key)], key
        wrapped = "\n".join(" * " + " ".join(text.split()[i : i + 3]) for i in range(0, len(text.split()), 3))
        assert [(x[0], x[1]) for x in t.scan(f"{prose}\n{wrapped}\n{prose}")] == [(1.0, key)], key
    assert t.scan("Copyright 2020 A. Person. Licensed under the MIT License. All rights reserved.") == [(1.0, "MIT", 0)]
    assert t.scan("(c) University of the Arts, released under\nthe ISC License") == [(1.0, "ISC", 0)]
    gap = " " * 5000
    assert t.scan(f"one{gap}two\nLicensed{gap}under CC BY 4.0; see there") == [(1.0, "CC-BY-4.0", 1)]
    both = t.scan(f"Released under the MIT License.\n{prose}\nReleased under the MIT License. {prose} SPDX-License-Identifier: GPL-3.0")
    assert [(x[1], x[2]) for x in both] == [("MIT", 0), ("MIT", 2), ("GPL-3.0", 2)]


def test_licence_runs_equal_all_windows():
    t = licences.Templates(licences.LicenceSettings())
    rng = random.Random(8)
    sets = [(key, licences.bigrams(x)) for key, x in licences.all_templates()]
    notices = [x for _, x in licences.all_templates() if len(x) < 120]
    for _ in range(40):
        words = []
        for _ in range(3):
            words += rng.choices(["the", "license", "under", "licensed", "mit"], k=rng.randrange(6)) + rng.choice(notices).split()
            if rng.random() < 0.5:
                words.insert(rng.randrange(len(words)), rng.choice(words))
        words = licences.TOKEN.findall(" ".join(words).lower())
        best = 0.0
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                grams = set(zip(words[a:b], words[a + 1 : b]))
                best = max(best, max(2 * len(grams & x) / (len(grams) + len(x)) for _, x in sets))
        found = t.scan(" ".join(words))
        assert max((x[0] for x in found), default=0.0) == (best if best >= t.t else 0.0)


# ---------------------------------------------------------------- operator 6

def test_best_fit_decreasing_takes_the_tightest_row():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 100):
        lengths = rng.integers(1, capacity + 1, 200)
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(k for r in rows for k in r) == list(range(200))
        free: list[int] = []  # plain best fit
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(capacity - n)
        assert sorted(capacity - int(lengths[r].sum()) for r in rows) == sorted(free)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_packing_round_trip(spark, tmp_path):
    import tiktoken

    texts = {1: "Hello world, " * 40, 2: "", 4: "Ünïcode  double   spaces\n\nand lines \n x", 5: "a " * 3000, 6: " lead and trail ", 7: "\t\n", 8: "'s it's <|endoftext|> 123 1,000.5"}
    rows = [(k, v) for k, v in texts.items()] + [(3, None)]
    settings = packing.PackSettings(row_tokens=64, group_tokens=500)
    packed = packing.pack_documents(frame(spark, rows, "doc_id long, text string").coalesce(1), settings)
    parts: dict[int, list] = {}
    for r in packed.collect():
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for d, at, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((at, ids[a:b].tolist()))
    encoder = packing.Tokenizer(settings)
    plain = tiktoken.Encoding("x", pat_str=packing.PRE_TOKENS, special_tokens={}, mergeable_ranks=_ranks())
    for d, t in texts.items():
        ids = [x for _, p in sorted(parts.pop(d)) for x in p]
        assert ids[-1] == settings.end_id and ids[:-1] == plain.encode_ordinary(t) == encoder.ids(t).tolist()
        assert plain.decode(ids[:-1]) == t
    assert not parts
    packing.write_binary(packed, str(tmp_path / "out"), 64)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r.n_rows for r in out) == packed.count()
    assert all(len(r.input_ids) == r.n_rows * 64 * 2 for r in out)
    assert packing.pack_documents(frame(spark, [], "doc_id long, text string"), settings).count() == 0


def _ranks():
    import base64

    with open(VOCABULARY, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_cached_parts_equal_plain_encoding():
    import tiktoken

    plain = tiktoken.Encoding("x", pat_str=packing.PRE_TOKENS, special_tokens={}, mergeable_ranks=_ranks())
    t = packing.Tokenizer(packing.PackSettings(cached_words=50))
    rng = random.Random(2)
    bits = ["a", "Bé", " ", "  ", "\n", "\t", " ", "1", "'s", ".", "%%", " x", "　", "漢字", "\u0085"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert t.ids(text).tolist() == plain.encode_ordinary(text), repr(text)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_a_text_is_encoded_by_one_call():
    t = packing.Tokenizer(packing.PackSettings())
    calls, encode = [], t.encode
    t.encode = lambda text: calls.append(text) or encode(text)
    text = "one two  three\n four 'll five" * 50
    assert t.ids(text).tolist() == encode(text) and calls == [text]
    assert t.ids("").tolist() == []
