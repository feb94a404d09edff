"""Main text of web pages by site style trees (operator 4).

Pages are merged into style trees: a node is a path of styles (tag with class, id and role) from the
root down, with the contents and the presentations (sequence of the styles of the texts below it) seen
there.  The importance of a content node is the entropy of its contents over the pages that show it,
0 when all show the same and 1 when all differ.  The importance of a branch is
``(1 - g^l) * P + g^l * A``: P is the entropy of its l presentations, A the mean importance of the
contents below it, weighted by pages.  A branch goes from every page when its importance is low and no
content below it that enough pages show is important; so do rare contents in it.

Pages count by their story: pages whose two longest texts (of the article, if there is one) agree
count once, so copies of an article do not make it look like furniture.  A node that fewer than
``min_pages`` stories of a host show is judged by the tree of the host's domain (its last two
labels), then by the tree of all pages.  Inside <article> and <main> a branch can go only if it has
a class, id or role, or is a div or section: a bare heading or paragraph is the article's own.

Furniture that differs from page to page (adverts, comments) is told by tags and class words.
Names are evidence only: a named element (or form) that a <main> lies in, that holds the page's
articles, or that holds most of its text is a layout wrapper and hides nothing (``lifted``); the
class of a paragraph or heading hides it only if the whole class name says furniture (``_named``).

Scale: each page is parsed once for the tree and once for its text.  The tree's rows are hashes; they
are made distinct and counted with map-side sums, keyed by (tree, node, value, story), so a hot host
or the tree of all pages is no hot key.  The nodes of a host meet the judgements on (tree, node),
and each host gets the list of its low nodes, as long as the host has low styles, by a join that
splits a hot host.

Defined cases: elements nested deeper than ``DEPTH`` levels have the node of that level (their texts are
blocks like all others), so unclosed tags do not make paths long; null or empty html gives an empty
text; a null URL belongs to the empty host; repeated rows are pages of their own; truncated and badly
nested markup is closed by the rules below; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .urls import url_host


@dataclass(frozen=True)
class TreeSettings:
    """``min_pages``: stories that must show a node before a tree judges it; ``min_importance``: nodes
    below are removed; ``decay``: g of the branch importance."""

    min_pages: int = 5
    min_importance: float = 0.3
    decay: float = 0.9


# Comments, declarations, and tags with their attributes.  A quote opens a value only directly after an equals sign.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math canvas object".split())
RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
HIDDEN = RAW | frozenset("head button select option datalist dialog audio video map label legend".split())
# Any other tag, and text, ends an open head.
HEAD_TAGS = frozenset("html head base link meta".split()) | RAW
FURNITURE_TAGS = frozenset("nav footer aside menu header".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split())
# An open element of the value's kind ends when the key's tag starts.
CLOSES_P = BLOCKS - frozenset("body html br td th tr tbody thead tfoot caption li dt dd option optgroup legend".split())
# tag: (open elements that it ends, elements that bound the search)
CLOSES_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
}
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation navi menu submenu breadcrumb breadcrumbs crumbs pager pagination paginator "
    "header masthead topbar footer foot bottombar copyright legal colophon "
    "sidebar side aside rail widget widgets related recommended recommendations trending popular "
    "notice notices cookie cookies consent gdpr disclaimer alert popup modal overlay newsletter subscribe signup "
    "login signin register search searchbox share sharing social follow "
    "comment comments commentlist discussion disqus replies reply respond "
    "toolbar skip toc tags tagcloud form print".split())
# Of these, words for what a page's own text is never in, unless its articles are.
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted "
    "related recommended recommendations trending popular cookie cookies consent gdpr newsletter subscribe signup "
    "comment comments commentlist discussion disqus replies reply respond".split())
# Of these, words that also name a paragraph's look or place.
WEAK_WORDS = frozenset(
    "print share follow form notice tags side legal search register reply respond popular discussion".split())
# Elements that hold text of their own, not layout.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt".split())
MODIFIER = re.compile(r"(?:has|no|with|without|hide|show)[-_]")
HEADING_WORDS = frozenset("header masthead banner".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CONTENT_TAGS = frozenset("article main".split())


# Elements below this level belong to the node of the element at this level.
DEPTH = 64

TELLING = re.compile(r"class|id\s*=|role|hidden|style", re.IGNORECASE)


def _style(tag: str, attrs: str, inside: bool) -> tuple[str, bool, str, bool]:
    return _full_style(tag, attrs if attrs and TELLING.search(attrs) else "", inside)


def _named(tag: str, names: str, inside: bool) -> set[str]:
    """Furniture words among the class and id names.  A text element needs a name made of them alone; outside
    of articles a word that is not weak will do."""
    out: set[str] = set()
    for name in names.split():
        words = set() if MODIFIER.match(name) else set(re.findall(r"[a-z]+", name))
        found = words & FURNITURE_WORDS
        if tag not in TEXT_TAGS or found == words or not inside and found - WEAK_WORDS:
            out |= found
    return out


@functools.lru_cache(maxsize=20_000)
def _full_style(tag: str, attrs: str, inside: bool) -> tuple[str, bool, str, bool]:
    """(style, is furniture by tag or role, kind of name, is hidden) of an element; ``inside`` an article,
    headers are its own.  Kinds: "" none, "layout" a furniture name that wrappers have too, "foreign"."""
    found = {}
    for m in ATTRIBUTE.finditer(attrs) if attrs.strip(" /\n\t") else ():
        found.setdefault(m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or ""))
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    furniture = tag in FURNITURE_TAGS or role in FURNITURE_ROLES
    named = _named(tag, names, inside)
    if inside and (tag == "header" or "header" in named) and not role:
        furniture, named = False, named - HEADING_WORDS
    if tag in ("html", "body") or tag in CONTENT_TAGS:
        furniture, named = role in FURNITURE_ROLES, set()
    kind = "foreign" if named & FOREIGN_WORDS else "layout" if named or tag in ("form", "fieldset") else ""
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(
        re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()))
    style = tag + "".join("." + x for x in sorted(set(names.replace("/", "|").split())) if not re.search(r"\d{2}", x))
    return style + (f"[{role}]" if role else ""), furniture, kind, hidden


class Block:
    """Text of one block: its style path, whether it is furniture, whether it lies in an article, the
    named elements around it ((number, is foreign), outermost first), and its pieces."""

    __slots__ = ("path", "furniture", "article", "named", "pieces", "_text")

    def __init__(self, path: str, furniture: bool, article: bool, named: tuple):
        self.path, self.furniture, self.article, self.named, self.pieces = path, furniture, article, named, []
        self._text: str | None = None

    def text(self) -> str:
        """With references decoded and each run of white space as one space (once complete)."""
        if self._text is None:
            text = "".join(self.pieces)
            self._text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
        return self._text


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    out: list[Block] = []
    # (tag, style path, furniture, article, named elements)
    stack: list[tuple[str, str, bool, bool, tuple]] = [("", "", False, False, ())]
    n_named = 0
    current: Block | None = None
    at = 0

    def say(text: str) -> None:
        nonlocal current
        if not text:
            return
        if stack[-1][0] == "head" and not text.isspace():
            close(len(stack) - 1)
        if current is None:
            block_path = next(x[1] for x in reversed(stack) if x[0] in BLOCKS or not x[0])
            current = Block(block_path, *stack[-1][2:])
            out.append(current)
        current.pieces.append(text)

    def close(index: int) -> None:
        nonlocal current
        if any(x[0] in BLOCKS or x[2] or x[4] for x in stack[index:]):
            current = None
        del stack[index:]

    seen = 0  # text up to here is said
    while True:
        at = html.find("<", at)
        if at < 0:
            say(html[seen:])
            break
        m = MARKUP.match(html, at)
        if m is None:  # a bare "<" is text
            at += 1
            continue
        say(html[seen:at])
        seen = at = m.end()
        if m["cdata"] is not None:
            say(html_lib.escape(m["cdata"]))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end tag does not close blocks
            continue
        if tag in RAW:  # skipped up to its end tag
            if not m["attrs"].endswith("/") or tag not in ("svg", "math"):
                end = RAW_END[tag].search(html, at)
                seen = at = end.start() if end else len(html)
            continue
        if tag not in HEAD_TAGS and stack[-1][0] == "head":
            close(len(stack) - 1)
        if tag in CLOSES_P and any(x[0] == "p" for x in stack):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in CLOSES_LIKE:
            kinds, stop = CLOSES_LIKE[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in kinds:
                    close(i)
                    break
                if stack[i][0] in stop:
                    break
        if tag in VOID:
            if tag in BLOCKS:
                current = None
            continue
        _, path, bad, inside, named = stack[-1]
        style, furniture, kind, hidden = _style(tag, m["attrs"], inside)
        if tag in BLOCKS or furniture != bad or kind:
            current = None
        if kind:
            n_named += 1
            named = (*named, (n_named, kind == "foreign"))
        elif tag == "main":
            named = ()
        path = f"{path}/{style}" if len(stack) <= DEPTH else path
        stack.append((tag, path, bad or furniture or hidden or tag in HIDDEN, inside or tag in CONTENT_TAGS, named))
    return lifted([b for b in out if b.text()])


def lifted(blocks: list[Block]) -> list[Block]:
    """Names judged by the page: sets ``furniture`` of blocks in named elements that are no wrappers.

    Its text (without foreign elements inside) is compared with the text outside of named elements.  An element
    hides nothing when it has an article, the text outside has none and is shorter, or when its text is most of
    the page's and over four times the text outside (which must have no article that it lacks).  A foreign
    element needs both: the articles and four times the text."""
    open_ = [b for b in blocks if b.named and not b.furniture]
    if open_:
        free = [b for b in blocks if not b.named and not b.furniture]
        total = sum(len(b.text()) for b in blocks)
        size = sum(len(b.text()) for b in free)
        article = any(b.article for b in free)
        while open_:
            around: dict[tuple, list[Block]] = {}
            for b in open_:
                around.setdefault(b.named[0], []).append(b)
            found = None
            for element, held in around.items():
                own = [b for b in held if not any(foreign for _, foreign in b.named[1:])] or held
                length = sum(len(b.text()) for b in own)
                has = any(b.article for b in own)
                if element[1]:
                    wrapper = has and not article and length > 4 * size
                else:
                    wrapper = has and not article and length > size or (
                        2 * length > total and length > 4 * size and (has or not article))
                if wrapper and (found is None or (has, length) > found[:2]):
                    found = (has, length, element)
            if found is None:
                break
            for b in around[found[2]]:
                b.named = b.named[1:]
                if not b.named:
                    size += len(b.text())
                    article = article or b.article
            open_ = [b for b in open_ if b.named]
        for b in open_:
            b.furniture = True
    return blocks


# Rows of a style tree: kind 0 is a content (``above``: the branches it lies in), kind 1 a presentation.
NODES = "host string, node bigint, kind int, value bigint, story bigint, above array<bigint>"


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - 2**63


@functools.lru_cache(maxsize=50_000)
def branches(path: str) -> tuple[tuple[int, bool], ...]:
    """(node, whether it may go inside an article) of the path and the paths above it, outermost first."""
    out, inside, prefix = [], False, ""
    for style in path.split("/")[1:] or [""]:
        prefix += "/" + style
        tag = re.split(r"[.\[]", style)[0]
        out.append((_hash(prefix), inside and tag not in CONTENT_TAGS and (style != tag or tag in ("div", "section"))))
        inside = inside or tag in CONTENT_TAGS
    return tuple(out)


def page_nodes(html: str) -> list[tuple[int, int, int, int, list | None]]:
    """(node, kind, value, story, above) of a page's style tree, outside of furniture told by names."""
    blocks = [b for b in blocks_of(html) if not b.furniture]
    longest = sorted([b.text() for b in blocks if b.article] or [b.text() for b in blocks], key=lambda t: (-len(t), t))
    story = _hash("\n".join(longest[:2]))
    contents: dict[str, list[str]] = {}
    shown: dict[int, int] = {}
    for b in blocks:
        contents.setdefault(b.path, []).append(b.text())
        nodes = [node for node, _ in branches(b.path)]
        for node, child in zip(nodes, [*nodes[1:], 0]):
            shown[node] = (shown.get(node, 0) * 1_000_003 + child + 1) % 2**64
    rows = []
    for path, texts in contents.items():
        above = [node for node, _ in branches(path)]
        rows.append((above[-1], 0, _hash("\n".join(texts)), story, above))
    return rows + [(node, 1, value - 2**63, story, None) for node, value in shown.items()]


def style_nodes(pages: DataFrame) -> DataFrame:
    """The rows of the pages' style trees (``NODES``), distinct within a batch."""
    def run(batches):
        for b in batches:
            rows: dict[tuple, list | None] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                for *key, above in page_nodes(html.as_py()) if html.is_valid else ():
                    rows[(host, *key)] = above
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(columns, types)], pa.array(list(rows.values()), pa.list_(pa.int64()))],
                names=["host", "node", "kind", "value", "story", "above"])

    return pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(run, NODES)


def _trees(nodes: DataFrame, *columns: str) -> DataFrame:
    """Each row once per tree that it belongs to, narrowest (lowest level) first: its host's, its domain's, that of all pages."""
    trees = F.array_distinct(F.array("host", F.substring_index("host", ".", -2), F.lit("")))
    return nodes.select(F.posexplode(trees).alias("level", "tree"), *columns)


def node_importance(nodes: DataFrame) -> DataFrame:
    """tree, node, kind, n (stories), n_values, importance in [0, 1], above: entropy of the node's values."""
    stories = _trees(nodes, "node", "kind", "value", "story", "above").groupBy("tree", "node", "kind", "value", "story").agg(
        F.first("above").alias("above"))
    values = stories.groupBy("tree", "node", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.first("above").alias("above"))
    per = values.groupBy("tree", "node", "kind").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"),
        F.sum(F.col("n") * F.log("n")).alias("__nlogn"), F.first("above").alias("above"))
    entropy = F.log("n") - F.col("__nlogn") / F.col("n")
    return per.select(
        "tree", "node", "kind", "n", "n_values",
        F.when(F.col("n_values") == F.col("n"), 1.0)
        .when(F.col("n_values") == 1, 0.0).otherwise(entropy / F.log("n")).alias("importance"), "above")


def judged_branches(importance: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """tree, node, low: the branches that enough stories of a tree show, and whether they are to go."""
    enough = F.col("n") >= settings.min_pages
    below = importance.where("kind = 0").select(
        "tree", F.explode("above").alias("node"), "n", (F.col("n") * F.col("importance")).alias("weighed"),
        F.when(enough, F.col("importance")).alias("known"))
    contents = below.groupBy("tree", "node").agg(
        (F.sum("weighed") / F.sum("n")).alias("mean"), F.max("known").alias("most"))
    own = importance.where((F.col("kind") == 1) & enough).select(
        "tree", "node", F.pow(F.lit(settings.decay), F.col("n_values")).alias("g"), "importance")
    composite = (1 - F.col("g")) * F.col("importance") + F.col("g") * F.col("mean")
    low = (composite < settings.min_importance) & (F.coalesce("most", F.lit(0.0)) < settings.min_importance)
    return own.join(contents, ["tree", "node"]).select("tree", "node", low.alias("low"))


def low_branches(nodes: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """host, __low: the nodes to remove on a host, each by the narrowest tree that judges it."""
    judged = judged_branches(node_importance(nodes), settings)
    shown = _trees(nodes.where("kind = 1").select("host", "node").distinct(), "host", "node")
    verdicts = shown.join(judged, ["tree", "node"]).groupBy("host", "node").agg(F.min_by("low", "level").alias("low"))
    return verdicts.where("low").groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("__low"))


def main_text(html: str | None, low: frozenset = frozenset()) -> str:
    """The page's main text: blocks outside furniture and low branches, one per line.

    When articles hold most of the text, text outside of them is left out."""
    kept = [b for b in (blocks_of(html) if html else []) if not b.furniture and not _removed(b, low)]
    if 2 * sum(len(b.text()) for b in kept if b.article) > sum(len(b.text()) for b in kept):
        kept = [b for b in kept if b.article]
    return "\n".join(b.text() for b in kept)


def _removed(block: Block, low: frozenset) -> bool:
    return bool(low) and any(node in low and (apart or not block.article) for node, apart in branches(block.path))


def extract_pages(pages: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """page_id, url, text, n_chars (code points) per page."""
    pages = pages.select("page_id", "url", "html")
    nodes = materialise(style_nodes(pages), "nodes")
    low = materialise(low_branches(nodes, settings), "branches")
    joined = pages.withColumn("__host", url_host(F.col("url"))).join(
        low.withColumnRenamed("host", "__host"), "__host", "left")

    def make():
        known: dict[tuple, frozenset] = {}

        def texts(html, low):
            out = []
            for h, paths in zip(html, low.to_pylist()):
                key = tuple(paths or ())
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = frozenset(key)
                out.append(main_text(h.as_py(), known[key]))
            return (out,)

        return texts

    out = map_arrow(joined, ["page_id", "url"], ["html", "__low"], [("text", "string")], make)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
