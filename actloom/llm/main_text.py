"""Main body of stored web pages, by layout-aware rendering.

A page is built into a tree with implied tags, its visible text is rendered
block by block (lists, aligned table cells, block spacing), and the blocks of
the main body are told from page furniture by where they stand in the layout:
the container of the page's title heading, less navigation, notices, teasers,
comments, bylines and prompts inside it. Text already taken from a page has
no tree; its lines are read in order with the same notions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.llm.page_tree import HEADINGS, Block, Node, build, layout, render

FURNITURE_TAGS = frozenset("nav aside footer form button dialog menu".split())
FURNITURE_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navbar|menu|sidebar|footer|cookies?|breadcrumbs?|comments?|share|related|teasers?|ads?|advert|banner|promo|newsletter)(?:$|[\s_-])", re.I)
MARKUP = re.compile(r"<(?:!doctype|html|head|body|div|p|table|tr|td|main|article|section|h[1-6]|ul|ol|span|nav)\b[^>]*>", re.I)

# Wording of page furniture in the languages of the pages.
TEASER_HEADS = frozenset("related|most read|latest rulings|loe ka|read also|see also|recommended|more news|more on this|mehr zum thema|meistgelesen|lesen sie auch|enim loetud|seotud".split("|"))
LABELS = frozenset(
    "home|deutsch|eesti|english|forms|acts in force|register|court calendar|log in|open data|news|jobs|tenders|about|faq|fees|drafts|archive|search|contact us|contact|sitemap|"
    "accessibility statement|privacy notice|follow us on the public channels|nõustun|loe lähemalt|einverstanden|i agree|refuse|accept all|only necessary|cookie settings|advertisement|reklaam|anzeige|"
    "print|share|subscribe|menu|sign in|sign up|log out|next|previous|back|impressum|datenschutz".split("|")
)
PROMPT = re.compile(
    r"^(?:advertisement|reklaam|anzeige)\b.{0,20}$"
    r"|^share(?: this)?\s*:|^(?:read also|see also|loe ka|lesen sie auch)\s*:"
    r"|^get the .{1,60} letter\b.*|^subscribe to\b.*|.*\benter your (?:e-?mail )?address and press\b.*"
    r"|^your .{1,60} in one (?:day|hour|week)!.*|.*\bcompare offers from\b.*"
    r"|^sign in to (?:read|see|view)\b.*|^log in to (?:read|see|view)\b.*|^click here to\b.*",
    re.I,
)
COOKIES = re.compile(r"\bcookies?\b|küpsiseid|small files on your device", re.I)
FOOT = re.compile(r"^©|^\(c\) \d{4}|information desk, open on|is not liable for damage caused by the use of|^all rights reserved", re.I)
BYLINE = re.compile(r"^(?:\d{1,2}[./]\s?\d{1,2}[./]\s?\d{2,4}|\d{4}-\d\d-\d\d)\s*(?:[,|·–-]\s*[^.!?]{0,60})?$|^by [^.!?]{3,50}, \d{1,2}[./]", re.I)
TRAIL = re.compile(r"^[^.!?;:]{1,40}(?:\s[›»>→/]\s[^.!?;]{1,60}){1,6}$")
COMMENT = re.compile(r"^[a-zõäöü]+_?[a-zõäöü]*\d+\s*:\s", re.I)
COMMENT_COUNT = re.compile(r"^\d+ (?:comments?|kommentaari?|kommentare?)$", re.I)
INNER_STOP = re.compile(r"[.,;?!]\s")
ENDED = re.compile(r"[.!?:;…”\"»)]\s*$")


LEAD = re.compile(r"^[^.!?]{2,40}[:：]\s*$")


def is_prompt(text: str) -> bool:
    return bool(PROMPT.match(text)) or text.lower() in LABELS or bool(BYLINE.match(text)) or bool(COMMENT_COUNT.match(text))


def is_sentence(block: Block) -> bool:
    """Whether a block is running text: long enough, hardly linked, and ended."""
    return block.linked < 0.3 and len(block.text) > 60 and bool(ENDED.search(block.text))


def is_link(block: Block) -> bool:
    """Whether a block only leads elsewhere, whatever its words: it is one link, or a short lead with a colon and a link."""
    if block.kind not in ("text", "heading") or not any(link for _, _, link in block.pieces) or ENDED.search(block.text):
        return False
    lead = "".join(x for _, x, link in block.pieces if not link).strip()
    return not lead or bool(LEAD.match(lead)) and bool(block.pieces[-1][2] or not block.pieces[-1][1].strip())


def foot_from(blocks: list[Block]) -> int:
    """Where the end of a container begins, in which footers stand: after its last running text but one."""
    running = [k for k, b in enumerate(blocks) if is_sentence(b) and not FOOT.search(b.text)]
    return running[-1] + 1 if running else 0


def inside(node: Node | None, top: Node) -> list[Node] | None:
    """The elements from node up to, without, top; None if top is not above."""
    chain = []
    while node is not None and node is not top:
        chain.append(node)
        node = node.parent
    return chain if node is top else None


def named_furniture(node: Node) -> bool:
    if node.tag in FURNITURE_TAGS:
        return True
    name = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')} {node.attrs.get('role', '')}".strip()
    return bool(name) and node.tag not in ("body", "html") and bool(FURNITURE_NAME.search(name))


def above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def containers(blocks: list[Block]) -> list[Node]:
    """The elements that hold the main body.

    With titles (h1), the parent of that with the most unlinked text, and the
    others beside it that are of its kind and hold running text, as a page may
    hold several articles. Without, the element with the most running text
    under one parent: of three paragraphs, or of fewer under a heading of its own.
    """
    weight: dict[int, tuple[Node, int, int]] = {}
    for b in blocks:
        if b.node.tag != "h1" or any(named_furniture(n) for n in above(b.node)):
            continue
        top = b.node.parent
        while top.tag in ("header", "hgroup", "a", "strong", "span") and top.parent is not None:
            top = top.parent
        weight[id(top)] = (top, 0, 0)
    if not weight:
        runs: dict[int, list] = {}
        for b in blocks:
            if b.node.tag == "p" and b.node.parent is not None and is_sentence(b) and not is_prompt(b.text) and not COMMENT.match(b.text) and not COOKIES.search(b.text) and not any(named_furniture(n) or n.tag == "article" and "h4" in {c.tag for c in n.children if isinstance(c, Node)} for n in above(b.node)):
                runs.setdefault(id(b.node.parent), [b.node.parent, 0])[1] += 1
        headed = lambda top: top.tag in ("article", "main") or any(isinstance(c, Node) and c.tag == "h2" for c in top.children)
        fit = [x for x in runs.values() if x[1] >= 3 or x[1] >= 2 and headed(x[0])]
        best = max(fit, key=lambda x: x[1], default=None)
        return [best[0]] if best else []
    for b in blocks:
        for n in above(b.node):
            if id(n) in weight:
                top, size, running = weight[id(n)]
                weight[id(n)] = (top, size + int(len(b.text) * (1 - b.linked)), running + is_sentence(b))
    first = max(weight.values(), key=lambda x: x[1])[0]
    alike = [top for top, _, running in weight.values() if top is not first and top.parent is first.parent and top.tag == first.tag and running]
    return [first, *alike]


def furniture_under(top: Node, blocks: list[Block]) -> set[int]:
    """Elements inside the container that are teasers, comments or a footer by what they hold."""
    held: dict[int, list[Block]] = {}
    node_of: dict[int, Node] = {}
    ends = {id(b) for b in blocks[foot_from(blocks) :]}
    before = {id(b): a.node.tag for a, b in zip(blocks, blocks[1:])} | {id(b): "" for b in blocks[:1]}
    for b in blocks:
        for n in inside(b.node, top) or ():
            if n.tag in ("div", "section", "td", "article", "ul", "ol", "table", "tr"):
                held.setdefault(id(n), []).append(b)
                node_of[id(n)] = n
    out = set()
    for key, own in held.items():
        if any(b.node.tag == "h1" for b in own):
            continue
        texts = [b.text for b in own]
        if texts[0].lower().rstrip(":") in TEASER_HEADS or sum(bool(COMMENT.match(t)) for t in texts) * 2 > len(texts) or any(FOOT.search(b.text) and id(b) in ends for b in own) or any(COOKIES.search(t) for t in texts) and any(t.lower() in LABELS for t in texts) or COMMENT_COUNT.match(texts[0]):
            out.add(key)
        elif node_of[key].tag in ("ul", "ol") and all(b.linked > 0.8 for b in own) and ends and id(own[0]) in ends and len(ends) < len(blocks) and before[id(own[0])] in HEADINGS - {"h1", "h2"}:
            out.add(key)  # a list of links under a heading of its own, after the last running text
        elif node_of[key].tag == "article" and own[0].node.tag in HEADINGS and own[0].linked > 0.8:
            out.add(key)
    return out


def prune(block: Block) -> None:
    """Take bylines and prompts that stand on a source line of their own out of a block of bare text."""
    by_line: dict[int, list[str]] = {}
    for line, value, _ in block.pieces:
        for k, part in enumerate(value.split("\n")):
            if part.strip():
                by_line.setdefault(line + k, []).append(part)
    if len(by_line) < 2:
        return
    bad = {k for k, parts in by_line.items() if (t := " ".join("".join(parts).split())) and (BYLINE.match(t) or len(t) < 120 and PROMPT.match(t))}
    if bad:
        block.pieces = [x for x in block.pieces if x[0] not in bad]
        block.changed()


def html_body(page: str) -> tuple[list[Block], set[int]]:
    """Blocks of the main body and the source lines they stand on."""
    blocks = render(build(page))
    found: list[Block] = []
    for top in containers(blocks):
        found += body_of(top, blocks)
    place = {id(b): k for k, b in enumerate(blocks)}
    kept = sorted({id(b): b for b in found}.values(), key=lambda b: place[id(b)])
    lines: set[int] = set()
    for b in kept:
        lines |= b.lines
    return kept, lines


def body_of(top: Node, blocks: list[Block]) -> list[Block]:
    """The blocks of a container less the furniture in it."""
    own = [b for b in blocks if inside(b.node, top) is not None]
    cut = furniture_under(top, own)
    ends = {id(b) for b in own[foot_from(own) :]}
    kept: list[Block] = []
    dropped: dict[str, int] = {}
    sizes: dict[str, int] = {}
    for b in own:
        chain = inside(b.node, top)
        name = b.node.attrs.get("class", "") if b.node is not top and b.node.tag in ("div", "span", "section") else ""
        prune(b)
        text = b.text
        if not text:
            continue
        if name:
            sizes[name] = sizes.get(name, 0) + 1
        if any(named_furniture(n) or id(n) in cut for n in chain):
            continue
        linked_trail = b.linked > 0.4 and bool(TRAIL.match(text)) and b.kind == "text"
        furniture = is_prompt(text) or bool(COMMENT.match(text)) or id(b) in ends and bool(FOOT.search(text))
        if b.kind in ("text", "quote") and furniture or linked_trail or is_link(b):
            if name:
                dropped[name] = dropped.get(name, 0) + 1
            continue
        kept.append(b)
    # Blocks share a class with prompts only where the class is one of prompts: where most of its blocks are.
    bad = {n for n in dropped if 2 * dropped[n] >= sizes[n]}
    kept = [b for b in kept if not (b.node is not top and b.node.attrs.get("class", "") in bad)]
    # A heading under which nothing was kept, only links, was one of teasers.
    held = {id(b) for b in kept}
    bare = {id(b) for b, after in zip(own, own[1:]) if b.node.tag in HEADINGS - {"h1"} and after.linked > 0.8 and id(after) not in held}
    kept = [b for b in kept if id(b) not in bare]
    return kept if any(b.node.tag == "h1" or is_sentence(b) or b.kind != "heading" for b in kept) else []


def is_title(line: str) -> bool:
    return 2 < len(line) <= 140 and not ENDED.search(line) and not line.startswith(("- ", "* ", "“", '"', "> ")) and "\t" not in line


def text_body(page: str) -> set[int]:
    """Lines of the main body of text that was taken from a page."""
    lines = [x.strip() for x in page.split("\n")]
    n = len(lines)
    running = [k for k, x in enumerate(lines) if len(x) > 60 and ENDED.search(x) and not FOOT.search(x) and not COOKIES.search(x)]
    foot = running[-1] + 1 if running else 0  # where the end of the page begins, in which footers stand
    kind = [""] * n  # "", furniture: x, prompt inside the body: p, byline: b, trail: t, teaser head: h, comment: c
    for k, x in enumerate(lines):
        low = x.lower()
        if not x:
            kind[k] = " "
        elif low.rstrip(":") in TEASER_HEADS:
            kind[k] = "h"
        elif BYLINE.match(x):
            kind[k] = "b"
        elif COMMENT_COUNT.match(x) or COMMENT.match(x):
            kind[k] = "c"
        elif low in ("advertisement", "reklaam", "anzeige") or PROMPT.match(x):
            kind[k] = "s" if re.match(r"(?:sign|log) in to", low) else "p"
        elif low in LABELS or FOOT.search(x) and (x[0] == "©" or k >= foot):
            kind[k] = "x"
        elif " | " in x and sum(part.strip().lower() in LABELS for part in x.split("|")) * 2 > x.count("|") + 1:
            kind[k] = "x"
        elif TRAIL.match(x) and re.search(r" [›»>→] ", x):
            kind[k] = "t"
        elif COOKIES.search(x):
            kind[k] = "x"
    # A run of short labels is navigation even where their words are not known.
    k = 0
    while k < n:
        j = k
        while j < n and (kind[j] == "x" or kind[j] == "" and len(lines[j].split()) <= 3 and len(lines[j]) <= 24 and is_title(lines[j])):
            j += 1
        if j - k >= 5:
            kind[k:j] = ["x"] * (j - k)
        k = max(j, k + 1)
    out: set[int] = set()
    k, teaser = 0, False
    while k < n:
        if kind[k] == "h":
            k = after_teasers(lines, kind, k + 1)
            continue
        if kind[k] == "":
            out.add(k)
        k += 1
    if not any(ENDED.search(lines[k]) or "\t" in lines[k] or lines[k].startswith("- ") for k in out) and len(out) < 2:
        # A lone title is a body only under a trail or over a byline.
        out = {k for k in out if any(kind[j] in "bt" for j in range(max(0, k - 2), min(n, k + 3)))}
    return out


def after_teasers(lines: list[str], kind: list[str], start: int) -> int:
    """First line after a list of teasers: where furniture of another kind, or the title of the body, begins.

    Teasers are titles, and texts that end in an ellipsis. The body begins
    with the last title before a line that can be neither: a whole sentence, a
    wrapped one (it has an inner stop or comma, or goes on in small letters), a
    list item, a table row, or a prompt, which only a body has.
    """
    title = -1
    k = start
    while k < len(lines):
        x = lines[k]
        if kind[k] in ("x", "t", "h", "c", "s"):
            return k
        if kind[k] in ("b", "p") and title >= 0:
            return title
        if kind[k] == "b":
            return k
        if kind[k] in (" ", "p"):
            k += 1
            continue
        goes_on = k + 1 < len(lines) and lines[k + 1][:1].islower()
        if x.endswith("…"):
            title = -1
        elif is_title(x) and not goes_on and not INNER_STOP.search(x):
            title = k
        else:
            return title if title >= 0 else k
        k += 1
    return k


def main_body(content: str | None) -> tuple[str, list[int]]:
    """Text of the main body and its lines in the page; nothing for NULL, an empty page or one without a body."""
    if not content or content.isspace():
        return "", []
    if MARKUP.search(content):
        kept, lines = html_body(content)
        return layout(kept), sorted(lines)
    lines = sorted(text_body(content))
    parts = content.split("\n")
    return "\n".join(parts[k].rstrip("\r") for k in lines), lines


def extract_main_text(pages: DataFrame, key: str = "target_id", content: str = "content") -> DataFrame:
    """(key, main_text, main_lines) of each page that has content.

    Rows with NULL content give no row; a page without a main body gives an
    empty text and no lines; repeated rows give repeated results (their
    reduction is left to the caller, which knows the key). One narrow pass over
    the pages: nothing is shuffled, and a page is held one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [main_body(x) for x in pdf["content"]]
            yield pd.DataFrame({"key": pdf["key"], "main_text": [x for x, _ in found], "main_lines": [y for _, y in found]})

    source = pages.select(F.col(key).cast("string").alias("key"), F.col(content).cast("string").alias("content")).where(F.col("content").isNotNull())
    return source.mapInPandas(run, "key string, main_text string, main_lines array<int>").withColumnRenamed("key", key)
