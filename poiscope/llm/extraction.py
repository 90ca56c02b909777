"""Main text of HTML pages by wrapper induction.

Pages of one host are aligned by simple tree matching into a wrapper: a tree of slots that knows for
each slot whether its text differs between pages. Neighbouring elements with one label (the
paragraphs of an article, the links of a menu) are one repeated slot, so wrappers stay small. All pages
of a host take part: each task folds its pages into one wrapper per host, and these are merged in
two steps. The content is the article or main element on the way to the deepest slot that holds nearly all varying
text outside menus, headers, footers, sidebars, notices, adverts, forms and comments; where there is none, the
deepest slot beside which no further headings, paragraphs, lists or tables stand. Of it go, unless nothing varies
there, the constant blocks: those whose text stands on nine tenths of the host's different pages, five at least. (As
neighbours of one label share a slot, a template paragraph among them is known by its text; copies of a page count once.)

A name marks what is not the article by one of its words, but not if it names content too, nor if it only says what
the element has or how it is set (has-sidebar, header-fixed). A form, or an element so named, that holds the page's
first heading, article or main element with over half of the text is the page and not outside of it.

Blocks are the texts between borders of block elements. Character references are decoded once, white
space (space, tab to carriage return) inside a block becomes one space, empty blocks vanish.

Defined results: a null or empty page gives an empty text; a page whose host has no other page, or that
lacks the host's content slot, is judged by its own tree. Pages without a host form one group.
Only the id, url and html columns are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from poiscope.llm.boosting import written
from poiscope.llm.dom import BLOCKS, RAW, Node, Slot, merged, parse
from poiscope.llm.url_filter import host_of

SPACES = re.compile("[ \t-\r]+")
# Elements and words in names that mark what is not the article.
OUTSIDE = frozenset(
    """
    nav header footer aside form script style noscript template iframe button select option textarea svg math canvas
    menu dialog head title object audio video input
    """.split()
)
OUTSIDE_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies notice
    notices consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus
    reply replies respond share sharing social related newsletter subscribe subscription popup modal widget toolbar pagination pager
    contentinfo complementary search alert login signup skip
    """.split()
)
CONTENT_WORDS = frozenset("content article post entry main page story".split())
STATE_WORDS = frozenset("has with without no is show hide fixed sticky open closed enabled".split())
KEPT_TAGS = frozenset("html body main article #root".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
HEADS = frozenset("h1 article main".split())
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.9
NEARLY_ALL = 0.9
HOSTS_AT_ONCE = 2000
BROADCAST_BYTES = 32 << 20
MERGE_SALTS = 16


@lru_cache(maxsize=1 << 16)
def outside(label: str) -> bool:
    tag, _, names = label.partition(" ")
    if tag in KEPT_TAGS:
        return False
    if tag in OUTSIDE:
        return True
    tokens = names.split()
    if CONTENT_WORDS.intersection(tokens):
        return False
    # A word in the name of a text block may be its subject (related-work), unless the name has no other word.
    test = all if tag in TEXT_TAGS else any
    for token in tokens:
        words = [w for w in re.split("[^a-z]+", token) if w]
        if words and not STATE_WORDS.intersection(words) and test(w in OUTSIDE_WORDS for w in words):
            return True
    return False


def _holds(node: Node, test: set[str] | frozenset[str]) -> bool:
    return any(c.label.split(" ")[0] in test or _holds(c, test) for c in node.children)


def _size(node: Node) -> int:
    """Letters of text that could be shown."""
    return sum(len(p.strip()) if isinstance(p, str) else 0 if p.tag in RAW else _size(p) for p in node.parts)


def pages_in_disguise(root: Node) -> frozenset[str]:
    """Labels of forms and of elements named as outside that hold the page itself."""
    found, whole = set(), 0

    def walk(node: Node) -> None:
        nonlocal whole
        for c in node.children:
            if outside(c.label):
                if (c.tag not in OUTSIDE or c.tag == "form") and _holds(c, HEADS):
                    whole = whole or _size(root)
                    if 2 * _size(c) > whole:
                        found.add(c.label)
                        walk(c)
            else:
                walk(c)

    walk(root)
    return frozenset(found)


def slots_of(node: Node) -> Slot:
    """The tree of a page with repeated neighbours as one slot."""
    own = SPACES.sub(" ", " ".join(p for p in node.parts if isinstance(p, str))).strip()
    children: list[Slot] = []
    for child in node.children:
        slot = slots_of(child)
        if children and children[-1].label == slot.label:
            children[-1] = merged(children[-1], slot)
        else:
            children.append(slot)
    text = xxhash.xxh64_intdigest(own) >> 1
    return Slot(node.label, text, len(own), 1, children)


def _mark_pages(slot: Slot) -> None:
    slot.pages = 1
    for c in slot.children:
        _mark_pages(c)


def content_path(wrapper: Slot, kept: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """Labels from the root to the slot of the content."""

    def weight(s: Slot) -> int:
        return 0 if outside(s.label) and s.label not in kept else s.chars * (1 + (s.text is None)) + sum(map(weight, s.children))

    path, levels, at = [], [wrapper], wrapper
    total = weight(wrapper)
    while total:
        best = max(at.children, key=weight, default=None)
        # A paragraph is never the container: the walk stops above text that is spread over siblings.
        if best is None or weight(best) < NEARLY_ALL * total or best.label.split(" ")[0] in ("p", "h1", "li", "b", "a", "span"):
            break
        path.append(best.label)
        levels.append(best)
        at = best
    tags = [label.split(" ")[0] for label in path]
    for tag in ("article", "main"):
        if tag in tags:
            return tuple(path[: len(tags) - tags[::-1].index(tag)])
    # Headings, paragraphs and the like beside the way belong to the text.
    for depth in range(len(path)):
        beside = [c for c in levels[depth].children if c is not levels[depth + 1]]
        if any(c.label.split(" ")[0] in TEXT_TAGS and weight(c) for c in beside):
            return tuple(path[:depth])
    return tuple(path)


@lru_cache(maxsize=4096)
def _wrapper(text: str) -> tuple[str, ...]:
    """The way to the content of a wrapper."""
    return content_path(Slot.load(json.loads(text)))


def _find(root: Node, path: tuple[str, ...]) -> list[Node]:
    level = [root]
    for label in path:
        level = [c for n in level for c in n.children if c.label == label]
    return level


def blocks_of(node: Node, pages: frozenset[str] = frozenset()) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", "".join(held)).strip(" ")
        held.clear()
        if text:
            out.append(text)

    def walk(n: Node) -> None:
        for part in n.parts:
            if isinstance(part, str):
                held.append(part)
                continue
            block = part.tag in BLOCKS
            if block:
                flush()
            if part.tag == "br":
                held.append(" ")
            elif not outside(part.label) or part.label in pages:
                walk(part)
            if block:
                flush()

    walk(node)
    flush()
    return out


def block_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def main_text(page: str | None, wrapper: str | None, template: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    pages = pages_in_disguise(root)
    found = []
    if wrapper and not pages:
        path = _wrapper(wrapper)
        found = _find(root, path) if path else []
    if not found:
        found = _find(root, content_path(slots_of(root), pages))
    blocks = [b for node in found for b in blocks_of(node, pages)]
    left = [b for b in blocks if block_key(b) not in template] if template else blocks
    return "\n".join(left or blocks)


def induce_wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper) and (host, template) of all pages (host, html): the wrapper as JSON, the keys of template blocks."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Slot] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"host": list(held), "wrapper": [json.dumps(s.dump()) for s in held.values()], "page": 0, "block": 0})

        for f in frames:
            blocks = []
            for host, page in zip(f["host"], f["html"]):
                root = parse(page or "")
                slot = slots_of(root)
                _mark_pages(slot)
                held[host] = merged(held[host], slot) if host in held else slot
                keys = list(map(block_key, blocks_of(root)))
                whole = block_key(str(keys))  # copies of a page count once
                blocks += [(host, None, whole, k) for k in {*keys, 0}]
                if len(held) > HOSTS_AT_ONCE:
                    yield rows()
                    held.clear()
            yield pd.DataFrame(blocks, columns=["host", "wrapper", "page", "block"])
        if held:
            yield rows()

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        slot = None
        for text in sorted(frame["wrapper"]):
            other = Slot.load(json.loads(text))
            slot = other if slot is None else merged(slot, other)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(slot.dump())]})

    kind = "host string, wrapper string"
    parts = written(pages.select("host", "html").mapInPandas(fold, f"{kind}, page long, block long"), "parts")
    salted = parts.filter("wrapper IS NOT NULL").groupBy("host", (F.crc32("wrapper") % MERGE_SALTS).alias("salt"))
    wrappers = salted.applyInPandas(join, kind).groupBy("host").applyInPandas(join, kind)
    # Different pages that hold each block; block 0 stands for all pages of the host.
    held = parts.filter("wrapper IS NULL").select("host", "page", "block").distinct().groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    whole = held.filter("block = 0").select("host", F.col("n").alias("pages"))
    often = held.filter(f"block <> 0 AND n >= {TEMPLATE_PAGES}").join(whole, "host").filter(F.col("n") >= F.col("pages") * TEMPLATE_SHARE)
    # On nine tenths of the pages: fewer than a page's blocks and a ninth.
    return wrappers, often.groupBy("host").agg(F.collect_list("block").alias("template"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row."""
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    induced, templates = induce_wrappers(base)
    wrappers = written(induced.join(templates, "host", "left"), "wrappers")
    bytes_of = F.length("host") + F.length("wrapper") + 8 * F.coalesce(F.size("template"), F.lit(0))
    size = wrappers.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0]
    joined = base.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")

    @F.pandas_udf("string")
    def text(html: pd.Series, wrapper: pd.Series, template: pd.Series) -> pd.Series:
        sets: dict[bytes, frozenset[int]] = {}

        def set_of(keys) -> frozenset[int]:
            if keys is None or not len(keys):
                return frozenset()
            said = keys.tobytes()
            if said not in sets:
                sets[said] = frozenset(keys.tolist())
            return sets[said]

        return pd.Series([main_text(h, w, set_of(t)) for h, w, t in zip(html, wrapper, template)], dtype=object)

    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text("html", "wrapper", "template").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
