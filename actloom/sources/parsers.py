"""Parsers of fetched content: plain text, HTML and XML to text.

Plain text is an expression; HTML and XML are read in Arrow batches. Malformed
content never fails: HTML is repaired, malformed XML gives its stripped text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions.text import strip
from actloom.functions.urls import media_type
from actloom.operators import acts

PARSER_VERSION, CHUNKER_VERSION = "1", "3"
SKIPPED = frozenset("script style template noscript head nav footer aside form svg iframe button".split())
BLOCKS = frozenset("p div section article main header h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre br hr td th dl dt dd figure body html".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Markdown(HTMLParser):
    """HTML to markdown-like text: headings, list items and links are kept, page furniture elements dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipping: list[str] = []
        self.link: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping:
            if tag not in VOID and tag == self.skipping[-1]:
                self.skipping.append(tag)
            return
        if tag in SKIPPED:
            self.skipping.append(tag)
        elif tag == "a":
            self.link = dict(attrs).get("href")
            if self.link:
                self.out.append("[")
        elif tag in BLOCKS:
            self.out.append("\n")
            self.out.append("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else "")

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        if tag == "a" and self.link:
            self.out.append(f"]({self.link})")
            self.link = None
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(content: str | None) -> str:
    if not content:
        return ""
    reader = Markdown()
    reader.feed(content)
    reader.close()
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(reader.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(x for x in lines if x and x != "-"))


def xml_text(content: str | None) -> str:
    """The title, a blank line and all text with white space collapsed; stripped text where it is no XML."""
    root = acts.parsed(content)
    if root is None:
        return (content or "").strip()
    title = acts.title_of(content)
    body = " ".join("".join(root.itertext()).split())
    return f"{title}\n\n{body}" if title else body


def as_document(parsed: object, name: str = "", most_bytes: int = 262_144) -> dict:
    """What a parser gave, as a document: an older parser's bare text has no metadata; ValueError for other things or metadata too large."""
    out = {"text": parsed} if isinstance(parsed, str) else dict(parsed) if isinstance(parsed, dict) else None
    if out is None or not isinstance(out.get("text"), str):
        raise ValueError(f"no text from the parser {name or '(unnamed)'}")
    out = {"parser_name": name, "parser_version": PARSER_VERSION, "metadata": {}, "intermediate": {}} | out
    for part in ("metadata", "intermediate"):
        if len(json.dumps(out[part], ensure_ascii=False, separators=(",", ":")).encode()) > most_bytes:
            raise ValueError(f"the {part} of a document are too large")
    return out


def parser_name(content_type: Column, chosen: str = "auto") -> Column:
    """plain, html or xml: a known choice wins, else by media type; NULL for types without a parser."""
    if chosen in ("plain", "html", "xml"):
        return F.lit(chosen)
    m = media_type(content_type)
    return F.when(m.isin("text/html", "application/xhtml+xml"), "html").when(m.isin("text/xml", "application/xml"), "xml").when(m == "text/plain", "plain")


def parse(pages: DataFrame, key: str, content: str = "content", content_type: str = "content_type", chosen: str = "auto") -> DataFrame:
    """(key, parser, status, title, text, text_hash) of each page: parsed, or skipped_unsupported with NULL text."""
    readers = {"html": html_text, "xml": xml_text}
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [readers[p](c) if p in readers else t for p, c, t in zip(pdf["parser"], pdf["content"], pdf["text"])]
            title = [acts.title_of(c) if p == "xml" else "" for p, c in zip(pdf["parser"], pdf["content"])]
            yield pd.DataFrame({"key": pdf["key"], "parser": pdf["parser"], "title": title, "text": text})

    source = pages.select(F.col(key).alias("key"), F.col(content).alias("content"), parser_name(F.col(content_type), chosen).alias("parser"))
    source = source.withColumn("text", F.when(F.col("parser") == "plain", strip(F.col("content"))))
    done = source.mapInPandas(run, f"key {kind}, parser string, title string, text string")
    return done.select(
        F.col("key").alias(key), "parser", F.when(F.col("parser").isNull(), "skipped_unsupported").otherwise("parsed").alias("status"), "title", "text", F.sha2("text", 256).alias("text_hash")
    )
