"""A forgiving markup tree with implied end tags and visibility, and its rendering.

The tree keeps, for each run of text, the source line (split at line feed) it
starts on, so that rendered blocks can be traced back to lines of the page.
Nothing here touches Spark; :mod:`actloom.llm.main_text` runs it in Arrow batches.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

# Element classes of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template iframe svg noscript object math canvas video audio select textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"button", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "body", "head", "html"}
# What a start tag closes, and the elements beyond which it closes nothing.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
FENCE = frozenset({"table", "td", "th", "caption"})
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "hidden", "line")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None", line: int):
        self.tag, self.attrs, self.parent, self.children, self.line = tag, attrs, parent, [], line
        self.hidden = (
            "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or (tag == "input" and attrs.get("type", "").lower() == "hidden")
            or bool(HIDING_STYLE.search(attrs.get("style", "")))
        )


class Text:
    """A run of text: what is written, and the line it starts on."""

    __slots__ = ("value", "line", "parent")

    def __init__(self, value: str, line: int, parent: Node):
        self.value, self.line, self.parent = value, line, parent


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def build(page: str) -> Node:
    """Tree of a page. Any text gives a tree: unknown, stray or missing tags are repaired."""
    starts = [0]
    starts.extend(m.end() for m in re.finditer("\n", page))
    line_of = lambda at: bisect_right(starts, at) - 1
    root = top = Node("#root", {}, None, 0)
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        upto = m.start() if m else size
        if upto > at:
            value = page[at:upto]
            if not value.isspace():
                top.children.append(Text(value, line_of(at), top))
            elif top.children:
                top.children.append(Text(" ", line_of(at), top))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                top.children.append(Text(m[0][9:-3], line_of(m.start()), top))
            continue
        tag = m[2].lower()
        if m[1]:
            top = close(top, tag)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else (size if tag in ("script", "style") else at)
            continue
        top = implied(top, tag)
        node = Node(tag, attributes(m[3]), top, line_of(m.start()))
        top.children.append(node)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            top = node
    return root


def implied(top: Node, tag: str) -> Node:
    """The node under which an element of this tag opens, after the end tags it implies."""
    if tag in CLOSES_P:
        node = top
        while node.parent is not None and node.tag not in BLOCK:
            node = node.parent
        if node.tag == "p" or (tag in HEADINGS and node.tag in HEADINGS):
            top = node.parent
    if tag in IMPLIED:
        ends, stops = IMPLIED[tag]
        node, last = top, None
        while node.parent is not None and node.tag not in stops:
            if node.tag in ends:
                last = node
            node = node.parent
        if last is not None:
            top = last.parent
    return top


def close(top: Node, tag: str) -> Node:
    """Where writing goes on after an end tag; one without a start is passed over."""
    node = top
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if node.tag in FENCE and tag not in TABLE_PARTS or tag not in BLOCK and node.tag in BLOCK:
            return top
        node = node.parent
    return top


class Block:
    """A rendered block: its pieces as (line, text, inside a link), its element and its kind."""

    __slots__ = ("node", "pieces", "kind", "depth", "_text", "_linked")

    def __init__(self, node: Node, kind: str, depth: int):
        self.node, self.kind, self.depth, self.pieces = node, kind, depth, []
        self._text = self._linked = None

    def changed(self) -> None:
        """To be called after pieces were taken out of a block that was read."""
        self._text = self._linked = None

    @property
    def text(self) -> str:
        if self._text is None:
            whole = "".join(x for _, x, _ in self.pieces)
            self._text = whole.strip("\n") if self.kind == "pre" else SPACE.sub(" ", whole).strip()
        return self._text

    @property
    def linked(self) -> float:
        """Share of the text that stands in links."""
        if self._linked is None:
            inside = sum(len(x.strip()) for _, x, link in self.pieces if link)
            self._linked = inside / max(1, sum(len(x.strip()) for _, x, _ in self.pieces)) if inside else 0.0
        return self._linked

    @property
    def lines(self) -> set[int]:
        """Source lines that hold some of the text."""
        out = set()
        for start, value, _ in self.pieces:
            out.update(start + k for k, part in enumerate(value.split("\n")) if part.strip())
        return out


def render(root: Node) -> list[Block]:
    """All visible text of the tree as blocks, in order of the page.

    An element of block kind starts a block, as does a line break; a table row
    is one block whose cells are parted by a tab; a list item is one block
    for each run between its own nested blocks.
    """
    blocks: list[Block] = []
    current: Block | None = None
    # (node or text, entering, block-level element, kind, link, list depth)
    stack: list[tuple] = [(root, root, "text", False, 0)]
    while stack:
        item, owner, kind, link, depth = stack.pop()
        if item is None:  # the end of a block
            current = None
            continue
        if isinstance(item, Text):
            value = html.unescape(item.value) if "&" in item.value else item.value
            if current is None:
                if not value.strip():
                    continue
                current = Block(owner, kind, depth)
                blocks.append(current)
            current.pieces.append((item.line, value, link))
            continue
        if isinstance(item, str):  # between the cells of a row
            if current is not None:
                current.pieces.append((-1, item, False))
            continue
        if item.hidden or item.tag == "head":
            continue
        tag = item.tag
        if tag == "br":
            if kind != "row":
                current = None
            elif current is not None:
                current.pieces.append((item.line, " ", False))
            continue
        link = link or (tag == "a" and "href" in item.attrs)
        is_block = tag in BLOCK or (tag == "span" and stands_alone(item))
        if tag in ("td", "th") and is_row(item.parent):
            stack.append(("\t", owner, kind, link, depth))
            for child in reversed(item.children):
                stack.append((child, owner, "row", link, depth))
            continue
        if is_block:
            current = None
            owner = item
            kind = "row" if tag == "tr" and is_row(item) else "item" if tag == "li" else "heading" if tag in HEADINGS else "pre" if tag == "pre" else "quote" if tag == "blockquote" else "text"
            depth += tag in ("ul", "ol", "menu", "dl")
            stack.append((None, None, None, False, 0))
        for child in reversed(item.children):
            stack.append((child, owner, kind, link, depth))
    return [b for b in blocks if b.text]


def stands_alone(node: Node) -> bool:
    """Whether an inline element has no inline text beside it on its level."""
    if node.parent is None or node.parent.tag not in BLOCK:
        return False
    around = node.parent.children
    k = around.index(node)
    for side in (range(k - 1, -1, -1), range(k + 1, len(around))):
        for j in side:
            x = around[j]
            if isinstance(x, Text):
                if x.value.strip():
                    return False
            else:
                if x.tag not in BLOCK and x.tag != "br":
                    return False
                break
    return True


def is_row(node: Node) -> bool:
    """Whether a table row is one of data: each cell has only inline content."""
    if node.tag != "tr":
        return False
    for cell in node.children:
        if isinstance(cell, Node):
            if cell.tag not in ("td", "th"):
                return False
            if any(isinstance(x, Node) and x.tag in BLOCK for x in cell.children):
                return False
    return sum(isinstance(c, Node) for c in node.children) > 1


def layout(blocks: list[Block]) -> str:
    """Blocks as text: a blank line between blocks, list marks, and cells of a table padded to columns."""
    out: list[str] = []
    k = 0
    while k < len(blocks):
        b = blocks[k]
        if b.kind == "row":
            rows = []
            while k < len(blocks) and blocks[k].kind == "row" and table_of(blocks[k].node) is table_of(b.node):
                raw = "".join(x for _, x, _ in blocks[k].pieces)
                rows.append([SPACE.sub(" ", c).strip() for c in raw.rstrip("\t").split("\t")])
                k += 1
            width = [max((len(r[j]) for r in rows if j < len(r)), default=0) for j in range(max(map(len, rows)))]
            out.append("\n".join("  ".join(c.ljust(width[j]) for j, c in enumerate(r)).rstrip() for r in rows))
            continue
        if b.kind == "item":
            items = []
            while k < len(blocks) and blocks[k].kind == "item":
                items.append("  " * max(0, blocks[k].depth - 1) + "- " + blocks[k].text)
                k += 1
            out.append("\n".join(items))
            continue
        out.append(("> " + b.text) if b.kind == "quote" else b.text)
        k += 1
    return "\n\n".join(out)


def table_of(node: Node) -> Node | None:
    while node is not None and node.tag != "table":
        node = node.parent
    return node
