"""Splitting documents into chunks: the strategies of the pipeline.

Window and fixed chunkers are expressions over the text and stay in the JVM.
Sentence, recursive, markdown, section and act chunkers are Python over one
document at a time, run in Arrow batches, each linear in the text. Texts that are NULL or blank give no chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.operators import acts

DEFAULT_SIZE, DEFAULT_OVERLAP = 1200, 150
CHUNK = "chunk_index long, text string, start_offset long, end_offset long, chunk_type string, metadata string"


def sliding_window(documents: DataFrame, key: str, text: str = "text", window: int = 200, step: int = 100) -> DataFrame:
    """(key, chunk_index, text): windows of whole words joined by one blank; the last one reaches the end."""
    window, step = max(1, window), max(1, step)
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\S+)"), 1)
    n = F.size("_words")
    # The last window is the first that reaches the end.
    last = F.greatest(F.ceil((n - window) / F.lit(step)), F.lit(0))
    rows = documents.select(F.col(key), words.alias("_words")).where("size(_words) > 0")
    return rows.select(key, "_words", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_index")).select(
        key, "chunk_index", F.array_join(F.slice("_words", (F.col("chunk_index") * step + 1).cast("int"), window), " ").alias("text")
    )


def fixed(documents: DataFrame, key: str, text: str = "text", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """(key, chunk_index, text, start_offset, end_offset): windows of characters, stripped, blank ones dropped."""
    if overlap > size:
        raise ValueError("the overlap is larger than the size")
    step = max(1, size - overlap)
    rows = documents.select(F.col(key), F.col(text).alias("_t")).where("length(_t) > 0")
    last = F.greatest(F.ceil((F.length("_t") - size) / F.lit(step)), F.lit(0)).cast("int")

    def window(k):
        raw = F.substring(F.col("_t"), k * step + 1, F.lit(size))
        led = F.regexp_replace(raw, r"(?U)^\s+", "")
        return F.struct((k * step + F.length(raw) - F.length(led)).cast("long").alias("start"), F.regexp_replace(led, r"(?U)\s+$", "").alias("text"))

    # All windows of a document are made in its row: nothing is shuffled, and rows of one key stay apart.
    kept = F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda x: x["text"] != "")
    return rows.select(key, F.posexplode(kept).alias("_i", "_x")).select(
        key, F.col("_i").cast("long").alias("chunk_index"), F.col("_x.text").alias("text"), F.col("_x.start").alias("start_offset"), (F.col("_x.start") + F.length("_x.text")).alias("end_offset")
    )


SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def packed_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences packed up to the size; a chunk begins with the last ones of the chunk before that fit the overlap."""
    out: list[str] = []
    held: list[str] = []
    total = 0  # characters of the held sentences, joined
    for sentence in filter(None, (x.strip() for x in SENTENCE_END.split(text))):
        if held and total + len(sentence) + 1 > max(1, size):
            out.append(" ".join(held))
            kept = total = 0
            while kept < len(held) and overlap > 0 and (wider := total + len(held[-1 - kept]) + (kept > 0)) <= overlap:
                kept, total = kept + 1, wider
            held = held[len(held) - kept :]
        total += len(sentence) + (total > 0)
        held.append(sentence)
    return [*out, " ".join(held)] if held else out


def sentences(documents: DataFrame, key: str, text: str = "text", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """(key, chunk_index, text): whole sentences packed up to the size, the last ones within the overlap repeated; one pass over each text."""
    return chunk_with(documents, key, sentence_splitter(size, overlap), text).select(key, "chunk_index", "text")


# --- splitters in Python -----------------------------------------------------
RECURSIVE = ("\n\n", "\n", " ", "")
# The separators of the markdown splitter, as written there; used as they are written, not as patterns.
MARKDOWN = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", "")


def cut_at(text: str, separator: str) -> list[str]:
    """Pieces of a text, each but the first beginning with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [x for x in (head, *(separator + r for r in rest)) if x]


def merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined up to the size; a new piece starts with the last parts within the overlap."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = RECURSIVE) -> list[str]:
    """A text split by the first separator it has, and what stays too long by the ones after it."""
    k = next(i for i, s in enumerate(separators) if not s or s in text)
    out: list[str] = []
    short: list[str] = []
    for part in cut_at(text, separators[k]):
        if len(part) < size:
            short.append(part)
            continue
        out += merged(short, size, overlap)
        short = []
        out += recursive(part, size, overlap, separators[k + 1 :]) if separators[k + 1 :] else [part]
    return out + merged(short, size, overlap)


def located(text: str, chunks: list[str], overlap: int) -> list[tuple[str, int | None, int | None]]:
    """Each chunk with its offsets, searched from where the one before it may overlap; NULL where it is not found."""
    out: list[tuple[str, int | None, int | None]] = []
    start = end = 0
    for chunk in chunks:
        found = text.find(chunk, max(0, end - overlap))
        if found < 0:
            out.append((chunk, None, None))
            continue
        start, end = found, found + len(chunk)
        out.append((chunk, start, end))
    return out


HEADER = re.compile(r"^(#{1,3}) +(.*)$")


def sections(text: str) -> list[str]:
    """One chunk per section under a header of the first three levels, header kept; paragraphs where there is none."""
    found: list[list[str]] = [[]]
    fence = ""
    any_header = False
    for raw in text.split("\n"):
        line = raw.strip()
        if fence:
            fence = "" if line.startswith(fence) else fence
        elif line.startswith(("```", "~~~")) and line.count(line[:3]) == 1:
            fence = line[:3]
        elif HEADER.match(line):
            any_header = True
            only_headers = found[-1] and all(HEADER.match(x) for x in found[-1] if x) and len(HEADER.match(found[-1][-1])[1]) < len(HEADER.match(line)[1])
            if found[-1] and not only_headers:
                found.append([])
        if line:
            found[-1].append(line)
    own = ["  \n".join(x) for x in found if x]
    if len(own) <= 1 and not any_header:
        return [x for x in (p.strip() for p in re.split(r"\n{2,}", text)) if x]
    return own


def with_known(metadata: str, known: dict[str, str]) -> str:
    """Metadata as JSON with what is known of the document; what the chunk says itself stays."""
    return json.dumps({**known, **json.loads(metadata)}, ensure_ascii=False, separators=(",", ":")) if known else metadata


def chunk_with(documents: DataFrame, key: str, split: Callable[[str, str | None], list[tuple]], text: str = "text", raw: str | None = None, source_url: str | None = None, language: str | None = None) -> DataFrame:
    """Chunks of each document by a Python splitter, in Arrow batches.

    `split` takes the text and the raw content (None without a raw column)
    and gives (text, start, end, type, metadata as JSON) in order. Columns for
    the source's URL and the language join the metadata where they are not empty.
    """
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for k, t, r, url, lang in zip(pdf["key"], pdf["text"], pdf["raw"], pdf["url"], pdf["lang"]):
                if t is not None and t.strip():
                    known = {name: v for name, v in (("sourceUrl", url), ("language", lang)) if v}
                    rows.extend((k, i, *x[:4], with_known(x[4], known)) for i, x in enumerate(split(t, r)))
            out = pd.DataFrame(rows, columns=["key", "chunk_index", "text", "start_offset", "end_offset", "chunk_type", "metadata"])
            yield out.astype({"start_offset": "Int64", "end_offset": "Int64"})

    column = lambda c, name: (F.col(c) if c else F.lit(None)).cast("string").alias(name)
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), column(raw, "raw"), column(source_url, "url"), column(language, "lang"))
    return source.mapInPandas(run, f"key {kind}, {CHUNK}").withColumnRenamed("key", key)


def check_format(chunker: str, accepted: tuple[str, ...], parser_format: str) -> None:
    """Raises ValueError where a chunker accepts certain parser formats and this is none of them."""
    if accepted and parser_format not in accepted:
        raise ValueError(f"the chunker {chunker} takes {', '.join(accepted)}, not {parser_format}")


def recursive_splitter(size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, separators: tuple[str, ...] = RECURSIVE):
    if overlap > size:
        raise ValueError("the overlap is larger than the size")
    return lambda text, raw: [(*x, "passage", "{}") for x in located(text, recursive(text, size, overlap, separators), overlap)]


def sentence_splitter(size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP):
    return lambda text, raw: [(x, None, None, "passage", "{}") for x in packed_sentences(text, size, overlap)]


def fixed_splitter(size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP):
    if overlap > size:
        raise ValueError("the overlap is larger than the size")
    step = max(1, size - overlap)

    def split(text: str, raw: str | None) -> list[tuple]:
        out = []
        for start in range(0, max(0, -(-(len(text) - size) // step)) * step + 1, step):
            piece = text[start : start + size]
            at = start + len(piece) - len(piece.lstrip())
            if piece := piece.strip():
                out.append((piece, at, at + len(piece), "passage", "{}"))
        return out

    return split


def window_splitter(window: int = 200, step: int = 100):
    window, step = max(1, window), max(1, step)

    def split(text: str, raw: str | None) -> list[tuple]:
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        starts = range(0, max(0, -(-(len(words) - window) // step)) * step + 1, step)
        cut = [words[k : k + window] for k in starts]
        return [(" ".join(w for w, _, _ in x), x[0][1], x[-1][2], "passage", "{}") for x in cut if x]

    return split


def section_splitter():
    return lambda text, raw: [(x, None, None, "section", "{}") for x in sections(text)]


def act_splitter(config: acts.Config | None = None):
    """Structure-aware chunks of an act's XML; the markdown splitter where the raw content is none."""
    fallback = recursive_splitter(separators=MARKDOWN)

    def split(text: str, raw: str | None) -> list[tuple]:
        # Without a raw content apart, the text itself may be the act's XML.
        found = acts.chunks(raw or text, config or acts.Config()) if raw or text.lstrip()[:1] == "<" else []
        return [(c.text, None, None, c.kind, c.json()) for c in found] or fallback(text, raw)

    return split


#: Named strategies, as registered for SQL and for run settings.
STRATEGIES: dict[str, Callable] = {
    "text_recursive": recursive_splitter,
    "text_markdown": lambda size=DEFAULT_SIZE, overlap=DEFAULT_OVERLAP: recursive_splitter(size, overlap, MARKDOWN),
    "text_section": section_splitter,
    "text_sentence": sentence_splitter,
    "text_fixed": fixed_splitter,
    "text_sliding_window": lambda window_size=200, step_size=100: window_splitter(window_size, step_size),
    "legal_xml": act_splitter,
}
