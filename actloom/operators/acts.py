"""Acts in XML: a typed reading, and chunks that keep to its structure.

An act is read in one walk that carries the heading levels passed; a level that
opens forgets the ones below it. Amendment marks leave the text and are listed.
Chunks are one section each; long ones are cut by subsections and then clauses,
and short neighbours under one heading are joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

# Element names of the act schema.
LEVELS = {"osa": "part", "peatykk": "chapter", "jagu": "division", "jaotis": "subdivision"}
METADATA = {
    "valjaandja": "publisher", "dokumentLiik": "documentKind", "globaalID": "globalId", "skeemiNimi": "schemaName", "tekstiliik": "textKind",
    "dokumentStaatus": "documentStatus", "kehtivuseAlgus": "validFrom", "kehtivuseLopp": "validUntil", "metaandmedVersioonKuupaev": "metadataVersionDate",
}
SUPERSCRIPTS = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
SCHEMA_LOCATION = "{http://www.w3.org/2001/XMLSchema-instance}schemaLocation"
RAISED = re.compile(r"<sup>(.*?)</sup>", re.I | re.S)
UNREAD = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", re.S)
SECTION_NUMBER = re.compile(r"§\s*([0-9⁰¹²³⁴⁵⁶⁷⁸⁹]+)")


def local(element) -> str:
    """Name without namespace; comments and instructions have none."""
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def parsed(content: str | None):
    """The root element, or None for no or malformed XML. Texts that declare entities, wherever, are refused (entity expansion)."""
    if not content or "<!ENTITY" in content.upper() and "<!ENTITY" in UNREAD.sub("", content).upper():
        return None
    try:
        return ElementTree.fromstring(content)
    except (ElementTree.ParseError, ValueError):
        return None


def flat(text: str) -> str:
    return RAISED.sub(lambda m: m[1].translate(SUPERSCRIPTS), " ".join(text.split()))


def spoken(element) -> str:
    """Text of an element without amendment marks, raised digits as superscripts, white space collapsed."""
    def pieces(x, top: bool) -> Iterator[str]:
        name = local(x)
        if name == "sup":
            yield "".join(x.itertext()).translate(SUPERSCRIPTS)
        elif name != "muutmismarge" or top:
            if name != "muutmismarge":
                yield x.text or ""
                for child in x:
                    yield from pieces(child, False)
        if not top:
            yield x.tail or ""

    return flat("".join(pieces(element, True)))


def child(element, name: str) -> str:
    return next((spoken(x) for x in element if local(x) == name), "")


def own_text(element) -> str:
    return flat(" ".join(t for x in element if local(x) == "sisuTekst" and (t := spoken(x))))


@dataclass
class Item:
    """A subsection or a clause: its number, shown number, text and clauses."""

    number: str
    shown: str
    text: str
    clauses: list["Item"] = field(default_factory=list)
    index: int = 0

    @property
    def label(self) -> str:
        return self.shown.strip() or (f"({self.number})" if self.number else f"({self.index})")

    def render(self) -> str:
        lines = [" ".join(x for x in (self.shown.strip(), self.text) if x), *(c.render() for c in self.clauses)]
        return "\n".join(x for x in lines if x)


@dataclass
class Section:
    levels: dict[str, tuple[str, str]]
    number_text: str
    shown: str
    title: str
    intro: str
    items: list[Item]

    @property
    def number(self) -> str:
        m = SECTION_NUMBER.search(self.shown)
        return m[1] if m else self.number_text

    @property
    def heading(self) -> str:
        return f"{self.shown.strip() or f'§ {self.number}.'} {self.title}".strip()

    @property
    def parent(self) -> tuple:
        return tuple(self.levels.get(x, ("", ""))[0] for x in LEVELS.values())

    def body(self, items: list[Item] | None = None) -> str:
        parts = ([self.intro] if items is None else []) + [x.render() for x in (self.items if items is None else items)]
        return "\n".join(x for x in parts if x) or self.intro


@dataclass
class Act:
    title: str
    metadata: dict[str, str]
    sections: list[Section]
    amendments: list[str]


def title_of(content: str | None) -> str:
    """The plain text of the first title element; empty for none or malformed XML."""
    root = parsed(content)
    if root is None:
        return ""
    return next(("".join(x.itertext()).strip() for x in root.iter() if local(x) == "pealkiri"), "")


def read(content: str | None) -> Act | None:
    """The act in an XML text; None where it is malformed or no act."""
    root = parsed(content)
    if root is None or local(root) != "oigusakt":
        return None
    title = next((spoken(x) for x in root.iter() if local(x) == "pealkiri"), "")
    metadata: dict[str, str] = {}
    for x in root.iter():
        name = METADATA.get(local(x))
        if name and name not in metadata and (value := spoken(x)):
            metadata[name] = value
    if root.get(SCHEMA_LOCATION):
        metadata["schemaLocation"] = root.get(SCHEMA_LOCATION)
    if root.get("id"):
        metadata["xmlId"] = root.get("id")
    act = Act(title, metadata, [], [])
    stack: list[tuple] = [(root, {}, False)]
    while stack:
        x, levels, body = stack.pop()
        name = local(x)
        if name == "muutmismarge":
            where = ""
            if body:
                named = [f"{level.capitalize()} {levels[level][0]}".strip() for level in ("part", "chapter", "division") if any(levels.get(level, ()))]
                where = " > ".join(([title] if title else []) + named)
            act.amendments += [mark for p in x if local(p) == "avaldamismarge" and (mark := amendment(p, child(x, "joustumine"), where))]
            continue
        if name == "paragrahv":
            act.sections.append(section(x, levels))
            body = True
        elif name in LEVELS:
            order = list(LEVELS.values())
            level = LEVELS[name]
            levels = {k: v for k, v in levels.items() if order.index(k) < order.index(level)}
            levels[level] = (child(x, f"{name}Nr"), child(x, f"{name}Pealkiri"))
            body = body or level in ("part", "chapter")
        stack.extend((c, levels, body) for c in reversed(list(x)))
    return act


def amendment(publication, in_force: str, where: str) -> str:
    reference = ", ".join(t for name in ("RTosa", "avaldamineKuupaev", "RTartikkel") if (t := child(publication, name)))
    if reference and not reference.startswith("RT"):
        reference = f"RT {reference}"
    return " - ".join(x for x in (reference, in_force and f"in force {in_force}", where and f"[{where}]") if x)


def section(x, levels: dict) -> Section:
    items = [
        Item(child(y, "loigeNr"), child(y, "kuvatavNr"), own_text(y), [Item(child(z, "alampunktNr"), child(z, "kuvatavNr"), own_text(z)) for z in y if local(z) == "alampunkt"])
        for y in x
        if local(y) == "loige"
    ]
    for k, item in enumerate(items, 1):
        item.index = k
    return Section(levels, child(x, "paragrahvNr"), child(x, "kuvatavNr"), child(x, "paragrahvPealkiri"), own_text(x), items)


# --- chunks ------------------------------------------------------------------
def estimate(text: str) -> int:
    return max(1, round(len(text) / 4)) if text else 0


@dataclass
class Config:
    target: int = 600
    most: int = 1100
    least: int = 100
    merge_short: bool = True
    headings: bool = True
    title: bool = True
    metadata: bool = True
    amendments: bool = True
    count: Callable[[str], int] = estimate


@dataclass
class Chunk:
    text: str
    kind: str
    metadata: dict

    def json(self) -> str:
        return json.dumps(self.metadata, ensure_ascii=False, separators=(",", ":"))


def headings(act: Act, levels: dict) -> list[str]:
    """The lines over a section: the act and each level with a number or a title."""
    out = [f"Act: {act.title}"] if act.title else []
    for level in LEVELS.values():
        number, name = (x.strip() for x in levels.get(level, ("", "")))
        if number or name:
            head = f"{level.capitalize()} {number}".strip()
            out.append(f"{head}: {name}" if name else head)
    return out


def grouped(items: Iterable, weight: Callable, room: int) -> Iterator[list]:
    """Runs of items whose weights fit the room; an item over it is a run of its own."""
    held: list = []
    total = 0
    for item in items:
        w = weight(item)
        if held and total + w > room:
            yield held
            held, total = [], 0
        held.append(item)
        total += w
    if held:
        yield held


def span(labels: list[str]) -> str:
    return labels[0] if len(labels) == 1 else f"{labels[0]}-{labels[-1]}"


def describe(act: Act, sections: list[Section], items: str = "") -> dict:
    first = sections[0]
    level = lambda name, k: first.levels.get(name, ("", ""))[k]
    where = [act.title] + [f"{name.capitalize()} {level(name, 0)}".strip() for name in ("chapter", "division") if any(first.levels.get(name, ()))]
    numbers = ", ".join(s.number for s in sections)
    where.append(f"§§ {numbers}" if len(sections) > 1 else (first.shown.strip() or f"§ {first.number}").rstrip("."))
    out = {
        "actTitle": act.title, "chunkType": "legal_body", "partNumber": level("part", 0), "partTitle": level("part", 1), "chapterNumber": level("chapter", 0),
        "chapterTitle": level("chapter", 1), "divisionTitle": level("division", 1), "subdivisionTitle": level("subdivision", 1), "sectionNumber": numbers,
        "sectionTitle": "; ".join(s.title for s in sections if s.title), "subsectionRange": items, "legalPath": " > ".join(x for x in where if x),
        "documentId": act.metadata.get("globalId", ""), **({"merged": True} if len(sections) > 1 else {}),
    }
    return {k: v for k, v in out.items() if v != ""}


def body_chunks(act: Act, config: Config) -> Iterator[Chunk]:
    def whole(s: Section) -> str:
        if not config.headings:
            return s.body()
        return "\n\n".join(x for x in ("\n".join([*headings(act, s.levels), s.heading]), s.body()) if x)

    def together(run: list[Section]) -> str:
        over = ["\n".join(headings(act, run[0].levels))] if config.headings and headings(act, run[0].levels) else []
        return "\n\n".join(over + ["\n".join(x for x in (s.heading, s.body()) if x) for s in run])

    def closed(run: list[Section]) -> Iterator[Chunk]:
        if run:
            yield Chunk(whole(run[0]) if len(run) == 1 else together(run), "legal_body", describe(act, run))

    run: list[Section] = []
    for s in act.sections:
        size = config.count(whole(s))
        short = config.merge_short and size < config.least and size <= config.most
        if run and (not short or run[-1].parent != s.parent):
            yield from closed(run)
            run = []
        if short:
            run.append(s)
            if config.count(together(run)) >= config.target:
                yield from closed(run)
                run = []
        elif size > config.most and s.items:
            yield from parts(act, s, config)
        else:
            yield from closed([s])
    yield from closed(run)


def parts(act: Act, s: Section, config: Config) -> Iterator[Chunk]:
    """A long section by runs of subsections; a subsection too long by itself by runs of its clauses under its lead-in."""
    over = [*headings(act, s.levels), s.heading]
    head = config.count("\n".join(over))

    def made(body: str, items: str, line: str) -> Chunk:
        text = "\n".join([*over, line]) + "\n\n" + body if config.headings else body
        return Chunk(text, "legal_body", describe(act, [s], items))

    def plain(run: list[Item]) -> Iterator[Chunk]:
        for own in grouped(run, lambda x: config.count(x.render()), config.target - head):
            items = span([x.label for x in own])
            yield made(s.body(own), items, f"Subsections: {items}")

    run: list[Item] = []
    for item in s.items:
        if not item.clauses or config.count(item.render()) <= config.most:
            run.append(item)
            continue
        yield from plain(run)
        run = []
        for own in grouped(item.clauses, lambda x: config.count(x.render()), config.target - head - config.count(item.text)):
            clauses = span([x.shown.strip() or f"{x.number})" for x in own])
            body = "\n".join(x for x in (item.text, *(c.render() for c in own)) if x)
            yield made(body, f"{item.label} {clauses}", f"Subsection {item.label}, clauses {clauses}")
    yield from plain(run)


def chunks(content: str | None, config: Config | None = None) -> list[Chunk]:
    """Chunks of an act: body, then title, metadata and amendment history; none where the text is no act."""
    config = config or Config()
    act = read(content)
    if act is None:
        return []
    out = list(body_chunks(act, config))
    common = {"actTitle": act.title, "documentId": act.metadata.get("globalId", "")}
    if config.title and act.title:
        kind = act.metadata.get("documentKind")
        out.append(Chunk("\n".join([f"Act: {act.title}"] + ([f"Document type: {kind}"] if kind else [])), "act_title", common | {"chunkType": "act_title", "legalPath": act.title}))
    if config.metadata and act.metadata:
        lines = [f"Act: {act.title}", "Publication metadata:", *(f"{k}: {v}" for k, v in act.metadata.items())]
        out.append(Chunk("\n".join(lines), "legal_metadata", common | {"chunkType": "legal_metadata", "legalPath": f"{act.title} > Publication metadata", "fields": act.metadata}))
    if config.amendments and act.amendments:
        head = f"Act: {act.title}\nAmendment history:"
        for own in grouped(act.amendments, config.count, config.most - config.count(head)):
            out.append(Chunk("\n".join([head, *own]), "amendment_history", common | {"chunkType": "amendment_history", "legalPath": f"{act.title} > Amendment history", "entryCount": len(own)}))
    for k, c in enumerate(out):
        c.metadata["chunkIndex"] = k
        c.metadata["tokenCount"] = config.count(c.text)
    return out
