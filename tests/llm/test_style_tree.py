"""Operator 4: importance of contents and branches against a plain computation, and what it removes."""

import math
import random
from collections import Counter, defaultdict

import pytest

from spendlake.llm import site_tree

SCHEMA = "page_id long, url string, html string"
BOX = "<div class=box><p>Join our readers today.</p><p>All the same.</p></div>"


def texts(spark, pages):
    return {r.page_id: r.text for r in site_tree.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}


def story(i):
    return f"<p>Story {i} begins like no other of them.</p><p>It ends after {i * i} words or so.</p>"


def told(i):
    return f"Story {i} begins like no other of them.\nIt ends after {i * i} words or so."


@pytest.mark.parametrize("tag", ["main", "article", "div"])
@pytest.mark.parametrize("host", ["www.site.example", "h{}.site.example", "one{}.test"])
def test_repeated_boxes_go_wherever_they_stand(spark, tag, host):
    pages = [(i, f"http://{host.format(i)}/{i}", f"<body><{tag}>{story(i)}{BOX if i % 5 < 2 else ''}</{tag}></body>") for i in range(30)]
    assert texts(spark, pages) == {i: told(i) for i in range(30)}


def test_a_box_of_few_pages_stays(spark):
    pages = [(i, f"http://a.example/{i}", f"<body><article>{story(i)}{BOX if i < 4 else ''}</article></body>") for i in range(9)]
    got = texts(spark, pages)
    assert all(got[i] == told(i) + ("\nJoin our readers today.\nAll the same." if i < 4 else "") for i in range(9))


def test_copies_of_an_article_and_its_bare_headings_stay(spark):
    page = "<body><div class=ad>Buy {1}</div><div class=top>Welcome</div><article><h2>Summary</h2><div class=entry>{0}</div></article></body>"
    pages = [(i, f"http://a.example/{i}", page.format(story(7), i)) for i in range(20)]
    pages += [(100 + i, f"http://a.example/{i}", page.format(story(i), i)) for i in range(20, 30)]
    got = texts(spark, pages)
    assert all(got[i] == "Summary\n" + told(7) for i in range(20))
    assert all(got[100 + i] == "Summary\n" + told(i) for i in range(20, 30))


def test_rare_contents_of_a_low_branch_go_with_it(spark):
    badge = "<span class=new><b>New</b></span><div class=hint>Since {}</div>"
    page = "<body><div class=text>{0}</div><div class=side-by><p>Always here</p><p>and here</p>{1}</div></body>"
    pages = [(i, f"http://a.example/{i}", page.format(story(i), badge.format(i) if i == 3 else "")) for i in range(40)]
    pages = [(i, u, h.replace("side-by", "box-of")) for i, u, h in pages]
    assert texts(spark, pages) == {i: told(i) for i in range(40)}


def test_class_words_hide_no_paragraph():
    for page in ("<article><p class=print-lead>Lead paragraph of the story</p><p>More.</p></article>",
                 "<body><div><p class=print-lead>Lead paragraph of the story</p><p>More.</p></div>",
                 "<article><h2 class='side-title'>Lead paragraph of the story</h2><p class=form-intro>More.</p></article>"):
        assert site_tree.main_text(page) == "Lead paragraph of the story\nMore."
    assert site_tree.main_text("<article><p>Text</p><p class=ad>Buy</p><p class='notice'>Cookies</p><div class=share-bar>Share</div></article>") == "Text"
    assert site_tree.main_text("<body><p>Some text</p><p class=copyright-line>All rights</p>") == "Some text"


def test_deeply_nested_pages(spark):
    deep = "".join(f"<div class=c><font>Part {i} " for i in range(3000))
    pages = [(i, f"http://a.example/{i}", f"<body><article>{story(i)}</article>{deep}") for i in range(3)]
    pages.append((9, "http://b.example/", f"<body>{deep}"))
    got = texts(spark, pages)
    assert got[9] == "\n".join(f"Part {i}" for i in range(3000))
    assert all(got[i].endswith("Part 2999") for i in range(3))


def entropy(values: Counter) -> float:
    n = sum(values.values())
    return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in values.values()) / math.log(n)


def plain_low(pages, settings=site_tree.TreeSettings()):
    """host -> low paths, from the blocks alone."""
    contents, shown = defaultdict(set), defaultdict(set)  # (tree, path) -> {(value, story)}
    of_host = defaultdict(set)
    for _, url, html in pages:
        host = url.split("//")[1].split("/")[0]
        blocks = [b for b in site_tree.blocks_of(html) if not b.furniture]
        longest = sorted([b.text() for b in blocks if b.article] or [b.text() for b in blocks], key=lambda t: (-len(t), t))
        same = tuple(longest[:2])
        by_path, children = defaultdict(list), defaultdict(list)
        for b in blocks:
            by_path[b.path].append(b.text())
            parts = b.path.split("/")
            for k in range(2, len(parts) + 1):
                children["/".join(parts[:k])].append(parts[k] if k < len(parts) else None)
        for tree in {host, ".".join(host.split(".")[-2:]), ""}:
            for path, found in by_path.items():
                contents[tree, path].add((tuple(found), same))
            for path, found in children.items():
                shown[tree, path].add((tuple(found), same))
        of_host[host] |= set(children)
    scored = {k: (len(v), entropy(Counter(x for x, _ in v))) for k, v in contents.items()}
    verdict = {}
    for (tree, path), rows in shown.items():
        if len(rows) < settings.min_pages:
            continue
        below = [x for (t, p), x in scored.items() if t == tree and (p == path or p.startswith(path + "/"))]
        mean = sum(n * imp for n, imp in below) / sum(n for n, _ in below)
        values = Counter(x for x, _ in rows)
        g = settings.decay ** len(values)
        low = (1 - g) * entropy(values) + g * mean < settings.min_importance
        verdict[tree, path] = low and all(imp < settings.min_importance for n, imp in below if n >= settings.min_pages)
    out = {}
    for host, paths in of_host.items():
        trees = [host, ".".join(host.split(".")[-2:]), ""]
        low = {p for p in paths if next((verdict[t, p] for t in trees if (t, p) in verdict), False)}
        if low:
            out[host] = low
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_low_branches_equal_a_plain_computation(spark, seed):
    rng = random.Random(seed)
    pages = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            tag = rng.choice(["div class=a", "div class=b", "div class=e", "section", "h2"])
            inner = rng.choice(["same words", "other words", f"words {rng.randint(0, 4)}", f"own words {i}"])
            if "=b" in tag or "=e" in tag:
                inner = "fixed words" if rng.random() < 0.97 else inner
            if rng.random() < (0.2 if "=b" in tag else 0.5 if "=e" not in tag else 0):
                inner = f"<p>{inner}</p><div class=c/d>{rng.choice(['fixed', f'text {i}'])}</div>"
            parts.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        body = "".join(dict.fromkeys(parts)) + f"<p>The story numbered {i} of this test</p>"
        host = rng.choice(["x.site.example", "x.site.example", f"h{i % 9}.site.example", f"own{i % 40}.test"])
        pages.append((i, f"http://{host}/{i}", f"<article>{body}</article>" if rng.random() < 0.3 else body))
    pages += [(1000 + i, *pages[5][1:]) for i in range(30)]
    nodes = site_tree.style_nodes(spark.createDataFrame(pages, SCHEMA).repartition(4))
    got = {r.host: set(r["__low"]) for r in site_tree.low_branches(nodes).collect()}
    want = {host: {site_tree.branches(p)[-1][0] for p in paths} for host, paths in plain_low(pages).items()}
    assert want and got == want
