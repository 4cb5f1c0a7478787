"""Lines repeated across the documents of one site.

Per site and line, the documents are kept as a compressed bitmap: the document's
number is split into a bucket (its high bits) and a position (its low 15 bits),
and a container holds the positions of one bucket, as a sorted array of 16-bit
numbers while there are few and as packed bits once these are smaller. Variants
of a line (letter case, digits, white space) have one key, so their bitmaps are
united as they are built, before the shuffle; no container exceeds 4 KiB,
however often a line stands. Exact cardinalities are summed over containers and
held against the site's documents, and a line of a chunk goes if its document's
bit is set in a bitmap that is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from actloom.lineage import Workspace
from actloom.operators.running import bucket_bits, running_total

BITS = 15
ARRAY_MOST = (1 << BITS) // 8 // 2  # positions up to which an array of 16-bit numbers is the smaller form


def site_of(url: Column) -> Column:
    """Host of a URL in lower case, without a leading www., user and port; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def line_form(line: Column) -> Column:
    """A line without letter case, the digits 0-9 and white space (no-break spaces too)."""
    # lower(upper(x)) is simplified to lower(x) by the optimizer, so the one letter with two capitals is written out.
    return F.regexp_replace(F.replace(F.lower(line), F.lit("ß"), F.lit("ss")), r"[0-9\p{IsWhite_Space}\x1c-\x1f]+", "")


def encode(positions: list) -> bytes:
    """A container: a zero byte and 16-bit numbers, or a one byte and packed bits."""
    own = np.unique(np.asarray(positions, dtype=np.uint16))
    if len(own) <= ARRAY_MOST:
        return b"\0" + own.tobytes()
    bits = np.zeros(1 << BITS, dtype=np.uint8)
    bits[own] = 1
    return b"\1" + np.packbits(bits).tobytes()


def decode(container: bytes) -> np.ndarray:
    if container[:1] == b"\0":
        return np.frombuffer(container, dtype=np.uint16, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, dtype=np.uint8, offset=1))).astype(np.uint16)


@F.pandas_udf(BinaryType())
def encoded(positions: pd.Series) -> pd.Series:
    return positions.map(encode)


@F.pandas_udf(BooleanType())
def holds(container: pd.Series, position: pd.Series) -> pd.Series:
    """Whether a container has the position set."""
    opened: dict[bytes, frozenset] = {}
    out = []
    for c, p in zip(container, position):
        own = opened.get(c)
        if own is None:
            if len(opened) > 4096:
                opened.clear()
            own = opened[c] = frozenset(decode(c).tolist())
        out.append(int(p) in own)
    return pd.Series(out)


def numbered(documents: DataFrame) -> DataFrame:
    """(document_id, site, bucket, position) of each document of a site, numbered from 0 within its site; repeated rows are reduced.

    Numbers without gaps fill the containers whatever the ids look like. They
    are counted over buckets of a hash, as many as the documents need.
    """
    work = Workspace(documents.sparkSession, "sites")
    own = documents.select("document_id", site_of(F.col("source_url")).alias("site")).where("document_id is not null and site is not null")
    own = work.write(own.groupBy("document_id").agg(F.min("site").alias("site")), "own")
    hashed = own.select("document_id", "site", F.xxhash64("document_id").alias("h"), F.lit(1).cast("long").alias("one"))
    counted = running_total(hashed, ["site"], F.shiftright("h", 64 - bucket_bits(own.count())), ["h", "document_id"], "one", "number")
    placed = counted.select("document_id", "site", F.shiftright("number", BITS).alias("bucket"), F.col("number").bitwiseAND((1 << BITS) - 1).cast("int").alias("position"))
    return work.write(placed, "numbered")


def chunk_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, line_no, site, key, bucket, position): each line with something left of it.

    Texts stay where they are read: what is joined with the documents are a
    chunk's line keys, 128 bits a line (two hashes of independent seeds), so
    among n lines of a site two differing ones meet with a chance of n² / 2^129.
    The keys are written once and read by all later steps.
    """
    key = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    forms = F.transform(F.split("text", "\n", -1), line_form)  # once a line, then hashed twice
    keys = F.transform(forms, lambda x: F.when(x != "", key(x)))
    own = chunks.where("text is not null and document_id is not null").select("chunk_id", "document_id", keys.alias("keys"))
    placed = own.join(documents, "document_id").select("chunk_id", "site", "bucket", "position", "keys")
    kept = Workspace(chunks.sparkSession, "lines").write(placed, "keys")
    lines = kept.select("chunk_id", "site", "bucket", "position", F.posexplode("keys").alias("line_no", "key"))
    return lines.where("key is not null")


def repeated_lines(lines: DataFrame, documents: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """(site, key, bucket, container, n_docs): the bitmaps of lines in at least `least` documents and `share` of the site's.

    A container is built by a set aggregate, combined before the shuffle; its
    size is bounded by its positions, so a line in every document of a site
    that holds a third of all rows is as many small groups as it has buckets.
    """
    containers = lines.groupBy("site", "key", "bucket").agg(F.collect_set("position").alias("positions"))
    counts = containers.groupBy("site", "key").agg(F.sum(F.size("positions")).cast("long").alias("n_docs"), F.max("bucket").alias("last"))
    sizes = documents.groupBy("site").agg(F.count("*").alias("site_docs"))
    kept = counts.where(F.col("n_docs") >= least).join(sizes, "site").where(F.col("n_docs") >= F.col("site_docs") * share - 1e-9)
    return containers.join(kept.select("site", "key", "n_docs", "site_docs"), ["site", "key"]).select("site", "key", "bucket", encoded("positions").alias("container"), "n_docs", "site_docs")


def occurrences(lines: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(chunk_id, line_no, site, n_docs) of each repeated line in the chunks, by bitmap lookup."""
    met = lines.join(bitmaps, ["site", "key", "bucket"]).where(holds("container", "position"))
    return met.select("chunk_id", "line_no", "site", "n_docs").distinct()


def line_texts(chunks: DataFrame, lines: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(site, form, example, n_docs, site_docs) of each repeated line: its form, and how it is written where it stands first by chunk and line.

    Only the chunks of these examples are looked up for their texts.
    """
    kept = bitmaps.groupBy("site", "key").agg(F.max("n_docs").alias("n_docs"), F.max("site_docs").alias("site_docs"))
    first = lines.join(kept, ["site", "key"]).groupBy("site", "key").agg(F.min(F.struct("chunk_id", "line_no")).alias("x"), F.max("n_docs").alias("n_docs"), F.max("site_docs").alias("site_docs"))
    first = first.select("site", "n_docs", "site_docs", "x.*").where("chunk_id is not null")
    texts = chunks.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max("text").alias("text"))
    example = F.split("text", "\n", -1)[F.col("line_no")]
    return first.join(texts, "chunk_id").select("site", line_form(example).alias("form"), example.alias("example"), "n_docs", "site_docs")


def without_lines(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_id, n_removed, text) of each chunk, without its repeated lines; NULL texts stay NULL."""
    cut = found.groupBy("chunk_id").agg(F.collect_set("line_no").alias("cut"))
    own = chunks.groupBy("chunk_id").agg(F.max("text").alias("text")).withColumn("at", F.coalesce("chunk_id", F.lit("\0")))
    kept = F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains("cut", k))
    joined = own.join(cut.withColumnRenamed("chunk_id", "at"), "at", "left")
    return joined.select(
        "chunk_id",
        F.coalesce(F.size("cut"), F.lit(0)).alias("n_removed"),
        F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
