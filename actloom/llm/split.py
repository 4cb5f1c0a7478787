"""Cutting oversized chunks at natural boundaries, with overlap.

Boundaries are ends of lines, sentences and table cells. At each, the words of
a block before and a block after are compared; a valley of this similarity is
the depth by which it lies under the peaks on both sides. Within the size
window of a piece the deepest valley is the cut (ends of lines and sentences
before those of words), in the upper half of the window where it has a boundary,
else in the lower; without a boundary, the last white space; without that, the
limit itself. The next piece begins the overlap before the cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.lineage import Workspace
from actloom.operators.running import running_total

BOUNDARY = re.compile(r"\n+|(?<=[.!?…])[\"'”’)\]]*[ \t ]+|(?<=[。！？；])|(?<= \|) ")
TOKEN = re.compile(r"[^\W_]{3,}|[一-鿿]")
SPACE = re.compile(r"\s")
BLOCK = 30  # words compared on each side of a boundary


def valleys(text: str) -> tuple[list[int], list[float]]:
    """Boundaries (as the start of what follows) and the depth of the similarity valley at each."""
    spots = [m.end() for m in BOUNDARY.finditer(text) if 0 < m.end() < len(text)]
    if not spots:
        return [], []
    tokens = [(m.start(), m[0].lower()) for m in TOKEN.finditer(text)]
    similarity: list[float] = []
    k = 0
    for spot in spots:
        while k < len(tokens) and tokens[k][0] < spot:
            k += 1
        left = Counter(w for _, w in tokens[max(0, k - BLOCK) : k])
        right = Counter(w for _, w in tokens[k : k + BLOCK])
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        similarity.append(dot / norm if norm else 0.0)
    n = len(similarity)
    peak_left, peak_right = similarity[:], similarity[:]
    for i in range(1, n):  # the peak reached by climbing from the valley
        peak_left[i] = peak_left[i - 1] if similarity[i - 1] >= similarity[i] else similarity[i]
    for i in range(n - 2, -1, -1):
        peak_right[i] = peak_right[i + 1] if similarity[i + 1] >= similarity[i] else similarity[i]
    return spots, [a + b - 2 * s for a, b, s in zip(peak_left, peak_right, similarity)]


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one for a text within the limit, none for an empty one.

    Pieces cover the text, none is longer than `size`, and each but the first
    starts `overlap` before the end of the one before it. A size under 1 is 1;
    an overlap is kept under the size, so that pieces advance.
    """
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    if not text:
        return []
    if len(text) <= size:
        return [(0, len(text))]
    spots, depths = valleys(text)
    out: list[tuple[int, int]] = []
    start, k = 0, 0
    while len(text) - start > size:
        least, middle, most = start + overlap + 1, start + max(overlap + 1, size // 2), start + size
        while k < len(spots) and spots[k] < least:
            k += 1
        cut, best, j = 0, (False, -1.0), k
        while j < len(spots) and spots[j] <= most:
            if (spots[j] >= middle, depths[j]) >= best:
                cut, best = spots[j], (spots[j] >= middle, depths[j])
            j += 1
        if not cut:
            cut = next((i + 1 for i in range(most - 1, least - 2, -1) if SPACE.match(text, i)), most)
        out.append((start, cut))
        start = cut - overlap
    out.append((start, len(text)))
    return out


def setting(name: str, default: int) -> Column:
    """A chunk setting of a run: under settings, or directly; a number or a numeric string; else the default."""
    found = [F.expr(f"cast(try_cast(get_json_object(actor_configs, '$.chunk_document.{place}{name}') as double) as int)") for place in ("settings.", "")]
    return F.coalesce(*found, F.lit(default))


def limits(documents: DataFrame, targets: DataFrame, runs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(document_id, chunk_size, chunk_overlap) by the run of each document's target."""
    configs = runs.where("pipeline_id is not null").groupBy("pipeline_id").agg(F.max("actor_configs").alias("actor_configs"))
    configs = configs.select("pipeline_id", setting("chunk_size", size).alias("chunk_size"), setting("chunk_overlap", overlap).alias("chunk_overlap"))
    owners = targets.where("target_id is not null").groupBy("target_id").agg(F.max("pipeline_id").alias("pipeline_id"))
    own = documents.where("document_id is not null and target_id is not null").groupBy("document_id").agg(F.max("target_id").alias("target_id"))
    return own.join(owners, "target_id").join(configs, "pipeline_id").select("document_id", "chunk_size", "chunk_overlap")


def split_chunks(chunks: DataFrame, by_document: DataFrame, smallest: int, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Pieces of every chunk over its limit, with a new index and offsets.

    (document_id, chunk_id, chunk_index, piece_no, n_pieces, new_chunk_index,
    start_offset, end_offset, text, overlap), the latter the characters shared
    with the piece before. `smallest` is the least limit of any run:
    shorter texts leave before the joins, so only candidates are shuffled.
    The new index counts the pieces of earlier chunks of the document in place
    of these chunks. A chunk without a document, target or run has the default
    limit; repeated rows of a chunk count once; NULL and empty texts have no
    pieces; offsets are NULL where the chunk's are.
    """
    long = chunks.where(F.length("text") > min(smallest, size))
    long = long.groupBy("document_id", "chunk_index", "chunk_id").agg(F.max(F.struct("text", "start_offset")).alias("x"))
    long = long.withColumn("at", F.coalesce("document_id", F.concat(F.lit("\0"), F.coalesce("chunk_id", F.lit("")))))
    placed = long.join(by_document.withColumnRenamed("document_id", "at"), "at", "left").select(
        "document_id", "chunk_index", "chunk_id", F.col("x.text").alias("text"), F.col("x.start_offset").alias("start_offset"),
        F.coalesce("chunk_size", F.lit(size)).alias("chunk_size"), F.coalesce("chunk_overlap", F.lit(overlap)).alias("chunk_overlap"),
    ).where(F.length("text") > F.greatest("chunk_size", F.lit(1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["spans"] = [[list(x) for x in pieces(t, s, o)] for t, s, o in zip(pdf["text"], pdf["chunk_size"], pdf["chunk_overlap"])]
            yield pdf[["document_id", "chunk_index", "chunk_id", "text", "start_offset", "spans"]]

    schema = "document_id string, chunk_index int, chunk_id string, text string, start_offset int, spans array<array<int>>"
    typed = placed.withColumn("start_offset", F.col("start_offset").cast("int"))
    # Cut once and kept; the running total goes over keys and numbers only.
    cut = Workspace(chunks.sparkSession, "split").write(typed.mapInPandas(run_nullable(run), schema), "cut")
    keys = cut.select("document_id", "chunk_index", "chunk_id", (F.size("spans") - 1).alias("more"))
    counted = running_total(keys, ["document_id"], F.shiftright("chunk_index", 10), ["chunk_index", "chunk_id"], "more", "earlier")
    a, b = cut.alias("a"), counted.alias("b")
    same = F.lit(True)
    for c in ("document_id", "chunk_index", "chunk_id"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rows = a.join(b, same).select("a.document_id", "a.chunk_id", "a.chunk_index", F.size("spans").alias("n_pieces"), "b.earlier", "a.start_offset", "a.text", "a.spans", F.posexplode("a.spans").alias("piece_no", "span"))
    return rows.select(
        "document_id",
        "chunk_id",
        "chunk_index",
        "piece_no",
        "n_pieces",
        (F.col("chunk_index") + F.col("earlier") + F.col("piece_no")).cast("long").alias("new_chunk_index"),
        (F.col("start_offset") + F.col("span")[0]).alias("start_offset"),
        (F.col("start_offset") + F.col("span")[1]).alias("end_offset"),
        F.substring("text", F.col("span")[0] + 1, F.col("span")[1] - F.col("span")[0]).alias("text"),
        F.when(F.col("piece_no") > 0, F.col("spans")[F.col("piece_no") - 1][1] - F.col("span")[0]).otherwise(0).alias("overlap"),
    )


def run_nullable(run):
    """Integer columns with NULLs as such through pandas."""

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in run(b for b in batches):
            yield pdf.astype({"start_offset": "Int32", "chunk_index": "Int32"})

    return inner
