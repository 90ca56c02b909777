"""A forgiving HTML parser and simple tree matching over labelled trees."""

from __future__ import annotations

import html as entities
import re

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Elements of HTML by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
DEPTH = 200


class Node:
    """An element: tag, names (class, id and role), and text and elements in page order."""

    __slots__ = ("tag", "names", "parts")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.parts = tag, names, []

    @property
    def label(self) -> str:
        return f"{self.tag} {re.sub('[0-9]+', '#', self.names)}".rstrip()

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str) -> Node:
    """The tree of a page; character references in texts are decoded. Any text gives some tree.

    Elements nested more than 200 deep are added to the last one at that depth; their end tags close nothing else.
    """
    root = Node("#root")
    open_: list[Node] = [root]
    deep: list[str] = []  # elements beyond that depth
    at, low = 0, None

    def pop_to(tags: set[str], stop: set[str] = frozenset()) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in tags:
                del open_[i:]
                return
            if open_[i].tag in stop:
                return

    while True:
        found = TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            open_[-1].parts.append(entities.unescape(text))
        if not found:
            return root
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["close"] or found["close2"]:
            if name in deep:
                del deep[len(deep) - 1 - deep[::-1].index(name) :]
            else:
                deep.clear()
                pop_to({name})
            continue
        if name in BLOCKS:
            pop_to({"p"}, {"article", "body", "div", "section", "td", "li", "table", "button", "blockquote"})
        if name in CLOSES:
            pop_to(*CLOSES[name])
        attrs = found["attrs"] or ""
        names = " ".join((a or b or c).lower() for _, a, b, c in NAMES.findall(attrs)) if "=" in attrs else ""
        node = Node(name, " ".join(names.split()))
        open_[-1].parts.append(node)
        if name in RAW:
            low = low if low is not None else page.lower() if len(page.lower()) == len(page) else page
            end = low.find(f"</{name}", at)
            if end < 0:
                return root
            at = end
            open_.append(node)
        elif name not in VOID and not attrs.endswith("/"):
            if len(open_) < DEPTH:
                open_.append(node)
            else:
                deep.append(name)


class Slot:
    """A node of a wrapper: what the aligned nodes of many pages have in common.

    text: hash of the text all of them had, None once they differed. chars: characters of own text over
    all pages; pages: pages with this node.
    """

    __slots__ = ("label", "text", "chars", "pages", "children")

    def __init__(self, label: str, text: int | None, chars: int, pages: int, children: list[Slot]):
        self.label, self.text, self.chars, self.pages, self.children = label, text, chars, pages, children

    def dump(self) -> list:
        return [self.label, self.text, self.chars, self.pages, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, data: list) -> Slot:
        return cls(*data[:4], [cls.load(c) for c in data[4]])


def match(a: Slot, b: Slot, memo: dict | None = None) -> int:
    """Simple tree matching: the largest number of node pairs that keep label, order and ancestry."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    memo = {} if memo is None else memo
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + _table(a.children, b.children, memo)[-1][-1]
    return memo[key]


def _table(xs: list[Slot], ys: list[Slot], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = rows[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(last[j + 1], row[j], last[j] + match(x, y, memo)))
        rows.append(row)
    return rows


def pairs(xs: list[Slot], ys: list[Slot], memo: dict) -> list[tuple[int | None, int | None]]:
    """Aligned positions in order; None where one side has no partner."""
    if len(xs) == len(ys) and all(x.label == y.label for x, y in zip(xs, ys)):
        return [(i, i) for i in range(len(xs))]  # every node has its partner already
    table, i, j, out = _table(xs, ys, memo), len(xs), len(ys), []
    while i or j:
        if i and j and xs[i - 1].label == ys[j - 1].label and table[i][j] == table[i - 1][j - 1] + match(xs[i - 1], ys[j - 1], memo):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def merged(a: Slot, b: Slot, memo: dict | None = None) -> Slot:
    """The wrapper of both; their labels are equal."""
    memo = {} if memo is None else memo
    children = []
    for i, j in pairs(a.children, b.children, memo):
        if j is None:
            children.append(a.children[i])
        elif i is None:
            children.append(b.children[j])
        else:
            children.append(merged(a.children[i], b.children[j], memo))
    return Slot(a.label, a.text if a.text == b.text else None, a.chars + b.chars, a.pages + b.pages, children)
