"""Test items that stand, fully or partly, in a corpus: a prefix-filtered set join over word shingles.

A passage is `size` consecutive words, or a whole item that has fewer. Its
tokens are its shingles of five words (of as many as it has, if fewer), which a
text with the passage has all, one after another. One pass over the corpus
keeps the runs of shingles that any item may have, by a filter of bounded size,
drops those too short for a passage (the bound of length), and counts the
shingles met. The items' shingles are ordered by rarity in the corpus; the
necessary prefix of a passage, as all its shingles must be met, is its rarest
one, and passages with a shingle that the corpus lacks are left out. Prefixes
are joined with the runs, an item and a run at each distance of their places
once (the bound of position), and verified word by word, which gives the whole
shared runs. How often the corpus is read does not depend on the items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from actloom.lineage import Workspace
from actloom.llm.words import words

SHINGLE = 5
#: Parameter: the filter sent to all executors has at most 2 to this number of bits (64 MB); more items let more runs pass, which later steps reject.
FILTER_BITS = 29
#: Parameter: tasks over which one shingle, or one item, of many texts is spread.
SALTS = 16
#: Characters of texts whose words are held at once; a longer text is held alone.
BLOCK_CHARS = 2_000_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
ITEM = "item_id long, words array<string>, n int, width int, hashes array<long>"


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, from those of the words."""
    total = np.full(max(0, len(hashed) - width + 1), np.uint64(width), dtype=np.uint64)
    for k in range(width):
        total += (hashed[k : len(total) + k] ^ (hashed[k : len(total) + k] >> np.uint64(31))) * FACTORS[k]
    total ^= total >> np.uint64(29)
    return total * FACTORS[0]


def hashes_of(own: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(own, dtype=object)) if own else np.empty(0, dtype=np.uint64)


def item_rows(items: DataFrame, size: int) -> DataFrame:
    """Each item that has a word, once: its words, the length of its passages, and its shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                own = words(text)
                if own:
                    n = min(size, len(own))
                    width = min(SHINGLE, n)
                    rows.append((item, own, n, width, shingles(hashes_of(own), width).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "words", "n", "width", "hashes"])

    return items.where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text")).mapInPandas(run, ITEM)


def filter_of(items: DataFrame) -> np.ndarray:
    """Bits set at the places of the items' shingles; their number is a power of two, at most 2 to FILTER_BITS."""
    number = items.agg(F.sum(F.size("hashes"))).first()[0] or 1
    bits = min(FILTER_BITS, max(10, math.ceil(math.log2(16 * number))))
    at = items.select(F.explode("hashes").alias("h")).select((F.col("h").bitwiseAND((1 << bits) - 1)).alias("at"))
    held = at.groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros((1 << bits) // 64, dtype=np.int64)
    out[held["place"].to_numpy(dtype=np.int64)] = held["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def blocks(pdf: pd.DataFrame) -> Iterator[tuple[list, list, np.ndarray]]:
    """(rows, all their words, where each row's words end), of texts of a bounded length together."""
    rows: list = []
    flat: list[str] = []
    ends: list[int] = []
    held = 0
    for key, version, text in zip(pdf["key"], pdf["version"], pdf["text"]):
        if rows and held + len(text) > BLOCK_CHARS:
            yield rows, flat, np.array(ends)
            rows, flat, ends, held = [], [], [], 0
        held += len(text)
        rows.append((key, version))
        flat += words(text)
        ends.append(len(flat))
    if rows:
        yield rows, flat, np.array(ends)


def met(texts: DataFrame, mask: np.ndarray, widths: dict[int, int]) -> DataFrame:
    """The corpus pass: runs of shingles in the filter that are long enough for a passage, and numbers of the shingles met.

    `widths` has, by width of shingles, the least number of them in a passage.
    """
    sent = texts.sparkSession.sparkContext.broadcast(mask)
    kind = dict(texts.dtypes)["key"]
    columns = ["part", "key", "version", "width", "at", "words", "hashes", "h", "n"]
    typed = {"version": "Int64", "width": "Int32", "at": "Int32", "h": "Int64", "n": "Int64"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = sent.value
        last = np.uint64(len(mask) * 64 - 1)
        for pdf in batches:
            for rows, flat, ends in blocks(pdf):
                out: list[tuple] = []
                hashed = hashes_of(flat)
                starts = np.concatenate([[0], ends[:-1]])
                owner = np.repeat(np.arange(len(rows)), ends - starts)
                for width, least in widths.items():
                    own = shingles(hashed, width)
                    if not len(own):
                        continue
                    place = own & last
                    hit = (mask[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                    hit &= owner[: len(own)] == owner[width - 1 :]
                    seen, n = np.unique(own[hit], return_counts=True)
                    out += [("count", None, None, None, None, None, None, h, c) for h, c in zip(seen.view(np.int64).tolist(), n.tolist())]
                    at = np.flatnonzero(hit)
                    if not len(at):
                        continue
                    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) > 0)) + 1
                    for run_at in np.split(at, cut):
                        if len(run_at) >= least:
                            a, b = int(run_at[0]), int(run_at[-1]) + 1
                            key, version = rows[owner[a]]
                            out.append(("run", key, version, width, a - int(starts[owner[a]]), flat[a : b + width - 1], own[a:b].view(np.int64), None, None))
                # Whole numbers stay whole beside NULLs only in columns of their own type.
                yield pd.DataFrame({c: pd.array([x[k] for x in out], dtype=typed[c]) if c in typed else pd.Series([x[k] for x in out], dtype=object) for k, c in enumerate(columns)})

    return texts.mapInPandas(run, f"part string, key {kind}, version long, width int, at int, words array<string>, hashes array<long>, h long, n long")


def salted(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys may each be of very many rows of one side: these are spread by a salt, the other side is repeated for each salt."""
    a = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    b = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def prefixes(items: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """(h, width, item_id, item_at): the rarest shingle of each passage of the items; none of passages that the corpus can't have."""
    every = items.select("item_id", "width", (F.size("words") - F.col("n")).alias("last"), F.posexplode("hashes").alias("item_at", "h"))
    known = salted(every, counts, ["h"], ["item_id", "item_at"], "left")
    ahead = W.partitionBy("item_id").orderBy("item_at").rowsBetween(0, size - min(SHINGLE, size))
    rarest = known.withColumn("best", F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("h"), F.col("item_at"))).over(ahead))
    found = rarest.where("item_at <= last and best.n > 0")
    return found.select("best.h", "width", "item_id", "best.item_at").distinct()


def leaks(texts: DataFrame, items: DataFrame, key: str = "doc_id", size: int = 12) -> DataFrame:
    """(key, item_id, n_words, n_places): the words of the longest shared run of each text and item that share a passage, and the number of such runs.

    Texts and items that are NULL or without a word share nothing; repeated
    rows of a text or an item give one row (of an item with several texts the
    largest counts); the runs of different texts with one key are counted
    apart. The corpus is read once, while the result is planned.
    """
    work = Workspace(texts.sparkSession, "leakage")
    own = work.write(item_rows(items.select("item_id", "text"), size), "items")
    widths = {r["width"]: r["least"] for r in own.groupBy("width").agg(F.min(F.col("n") - F.col("width") + 1).alias("least")).collect()}
    source = texts.select(F.col(key).alias("key"), "text", F.xxhash64("text").alias("version")).where("key is not null and length(text) > 0")
    found = work.write(met(source, filter_of(own), widths), "met", partition_by="part")
    counts = found.where("part = 'count'").groupBy("h").agg(F.sum("n").alias("n"))
    place = ["key", "version", "width", "at"]
    runs = found.where("part = 'run'").select(*place, "words", "hashes")
    tokens = runs.select(*place, F.posexplode("hashes").alias("k", "h"))
    pairs = salted(tokens, prefixes(own, counts, size), ["h", "width"], ["key", "at", "k"])
    apart = pairs.groupBy(*place, "item_id").agg(F.collect_set(F.col("item_at") - F.col("k")).alias("apart"))
    with_item = salted(apart, own.select("item_id", "n", F.col("words").alias("item_words")), ["item_id"], ["key", "at"])
    with_both = with_item.join(runs.dropDuplicates(place).select(*place, "words"), place)
    kind = dict(source.dtypes)["key"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                text, item = np.asarray(x.words, dtype=object), np.asarray(x.item_words, dtype=object)
                for d in x.apart:
                    low, high = max(0, -d), min(len(text), len(item) - d)
                    same = np.concatenate([[0], (text[low:high] == item[low + d : high + d]).astype(np.int8), [0]])
                    turns = np.flatnonzero(np.diff(same))
                    rows += [(x.key, x.item_id, int(e - s)) for s, e in zip(turns[::2], turns[1::2]) if e - s >= x.n]
            yield pd.DataFrame(rows, columns=["key", "item_id", "n_words"])

    stretches = with_both.select("key", "words", "item_id", "n", "item_words", "apart").mapInPandas(verify, f"key {kind}, item_id long, n_words long")
    return stretches.groupBy("key", "item_id").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n_places")).withColumnRenamed("key", key)
