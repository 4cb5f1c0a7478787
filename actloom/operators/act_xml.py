"""Acts as XML of the act schema, from the objects of their nested records: the inverse of reading them."""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby
from xml.sax.saxutils import escape

from actloom.operators import acts
from actloom.operators.flatten import objects

TAGS = {name: tag for tag, name in acts.METADATA.items()}
LEVEL_TAGS = {level: tag for tag, level in acts.LEVELS.items()}
#: Characters that XML can't hold.
UNFIT = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF, *range(0xD800, 0xE000)])


def element(tag: str, text: str | None) -> str:
    """An element with a text; nothing without one."""
    clean = (text or "").translate(UNFIT)
    return f"<{tag}>{escape(clean)}</{tag}>" if clean else ""


class Record:
    """The objects of one record by the object they stand in."""

    def __init__(self, fields: dict[str, str | None]):
        self.below: dict[tuple, list[tuple[str, dict]]] = defaultdict(list)
        for field, source in fields.items():
            for path, parent, group, _, _, own in objects(field, source):
                self.below[parent, group.rpartition("/")[2]].append((path, own))

    def of(self, path: str | None, name: str) -> list[tuple[str, dict]]:
        return self.below.get((path, name), [])


def clauses(record: Record, path: str) -> str:
    """The clauses under an object and, after each, those within it."""
    out = []
    for here, own in record.of(path, "clauses"):
        notes = " ".join(f"({n.get('kind') or 'note'}: {n['text']})" for _, n in record.of(here, "notes") if n.get("text"))
        text = " ".join(x for x in (own.get("text"), notes) if x)
        out.append(f"<alampunkt>{element('alampunktNr', own.get('number'))}{element('kuvatavNr', own.get('display'))}{element('sisuTekst', text)}</alampunkt>{clauses(record, here)}")
    return "".join(out)


def section(record: Record, path: str, own: dict) -> str:
    items = "".join(
        f"<loige>{element('loigeNr', x.get('index'))}{element('kuvatavNr', x.get('display'))}{element('sisuTekst', x.get('text'))}{clauses(record, here)}</loige>"
        for here, x in record.of(path, "subsections")
    )
    head = element("paragrahvNr", own.get("number")) + element("kuvatavNr", own.get("display")) + element("paragrahvPealkiri", own.get("title"))
    return f"<paragrahv>{head}{element('sisuTekst', own.get('intro_text'))}{items}</paragrahv>"


def levels(record: Record, path: str) -> tuple:
    """(level, number, title) of each heading level over a section; a level is given by keys of the path object or by an object in it."""
    out = []
    for here, own in record.of(path, "path"):
        for level in acts.LEVELS.values():
            inner = next((x for _, x in record.of(here, level)), {})
            number, title = own.get(f"{level}_number") or inner.get("number") or "", own.get(f"{level}_title") or inner.get("title") or ""
            if number or title:
                out.append((level, number, title))
    return tuple(out)


def nested(sections: list[tuple[tuple, str]]) -> str:
    """Sections under their heading levels; neighbours of one level share its element."""
    out = []
    for head, run in groupby(sections, lambda x: x[0][:1]):
        inner = [(rest[1:], body) for rest, body in run]
        if not head:
            out += [body for _, body in inner]
            continue
        level, number, title = head[0]
        tag = LEVEL_TAGS[level]
        out.append(f"<{tag}>{element(f'{tag}Nr', number)}{element(f'{tag}Pealkiri', title)}{nested(inner)}</{tag}>")
    return "".join(out)


def write(title: str | None, sections: str | None, amendments: str | None, metadata: str | None) -> str:
    """The act's XML; what is missing is left out, and a record without anything is an act without sections."""
    record = Record({"sections": sections, "amendments": amendments, "metadata": metadata})
    marks = "".join(
        f"<muutmismarge><avaldamismarge>{element('RTosa', x.get('rt_part'))}{element('avaldamineKuupaev', x.get('published'))}{element('RTartikkel', x.get('article'))}</avaldamismarge>{element('joustumine', x.get('in_force'))}</muutmismarge>"
        for _, x in record.of(None, "amendments")
    )
    known = []
    for path, own in record.of(None, "metadata"):
        for name, tag in TAGS.items():
            dated = next((x.get("date") for _, x in record.of(path, name) if x.get("date")), None)
            known.append(element(tag, own.get(name) or dated))
    body = nested([(levels(record, path), section(record, path, own)) for path, own in record.of(None, "sections")])
    return f"<oigusakt><metaandmed>{''.join(known)}</metaandmed>{element('pealkiri', title)}<sisu>{body}{marks}</sisu></oigusakt>"
