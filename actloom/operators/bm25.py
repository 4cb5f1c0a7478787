"""Lexical search: BM25 over chunks, for a set of queries at once.

Statistics (number of chunks, mean length, and in how many chunks each query
term stands) are taken over all chunks in one pass, combined in each task; a
second pass scores each chunk for all queries of a block and keeps the k best
per query and task. No postings are shuffled, so a frequent term is no hot key.
Scores are negated: lower is better.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actloom.operators.keyed import pick

#: Queries times their terms that are held, and sent to all executors, at once.
MOST_CELLS = 4_000_000
K1, B = 1.2, 0.75
WORD = re.compile(r"[^\W_]+")
# Common English stop words.
STOP = frozenset(
    "a about after all also an and any are as at be been but by can did do does for from had has have he her his if in into is it its may more most no nor not of on or other our "
    "shall she should so some such than that the their them then there these they this those to under until up was we were what when where which who will with would you your".split()
)


def simple(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


# Endings, what stands for them, and the length of the words they are taken from.
ENDINGS = (("ational", "ate", 9), ("ization", "ize", 9), ("fulness", "ful", 9), ("iveness", "ive", 9), ("sses", "ss", 5), ("ies", "y", 5), ("ing", "", 6), ("edly", "", 7), ("ed", "", 5), ("ly", "", 5), ("ment", "", 8))


def stem(word: str) -> str:
    """A light suffix stemmer in the manner of Porter's: plurals, -ed, -ing, -ly and common endings."""
    for end, new, least in ENDINGS:
        if word.endswith(end) and len(word) >= least:
            word = word[: -len(end)] + new
            return word[:-1] if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "lsz" and not new else word
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3 else word


def english(text: str) -> list[str]:
    """The simple terms without stop words, stemmed."""
    return [stem(w) for w in simple(text) if w not in STOP]


ANALYZERS: dict[str, Callable[[str], list[str]]] = {"simple": simple, "english": english}


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int = 10, analyzer: str = "simple", scope: DataFrame | None = None, digits: int = 6, distinct: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query, score negated, ties by chunk id.

    `queries` has `query_id, text`, `chunks` has `chunk_id string, text`.
    Repeated rows of a chunk count once; only chunks that share a term with a
    query are candidates; NULL and empty texts have no terms. Statistics are
    those of all chunks also where `scope`, a table of chunk ids, limits the
    candidates. `distinct` says that there is one row per chunk, with a text.
    Chunks that :func:`analyzed` has read are taken as they are, and no text is
    read again; they must be of the same analyzer.
    """
    terms = ANALYZERS[analyzer]
    spark = chunks.sparkSession
    ready = "terms" in chunks.columns
    unique = chunks.select("chunk_id", *FORM) if ready else chunks.select("chunk_id", "text") if distinct else distinct_texts(chunks)

    def read(pdf: pd.DataFrame) -> Iterator[tuple]:
        """Distinct terms, their counts, and the number of all terms of each chunk."""
        if ready:
            yield from zip(pdf["terms"], pdf["counts"], pdf["length"])
            return
        for text in pdf["text"]:
            own = Counter(terms(text))
            yield own.keys(), own.values(), own.total()

    candidates = unique if scope is None else unique.join(scope.select("chunk_id").where("chunk_id is not null").distinct(), "chunk_id", "left_semi")
    kind = dict(queries.dtypes)["query_id"]
    best = None
    for block in query_blocks(queries, terms):
        vocabulary = spark.sparkContext.broadcast(frozenset(t for _, own in block for t in own))

        def count(batches: Iterator[pd.DataFrame], vocabulary=vocabulary) -> Iterator[pd.DataFrame]:
            df: Counter[str] = Counter()
            n = length = 0
            for pdf in batches:
                for own, _, size in read(pdf):
                    n, length = n + 1, length + int(size)
                    df.update(vocabulary.value.intersection(own))
            # The empty term carries the number of chunks, a blank the sum of their lengths.
            yield pd.DataFrame({"term": ["", " ", *df], "n": [n, length, *df.values()]})

        # A row per term of a block of queries reaches the driver.
        found = {r["term"]: r["n"] for r in unique.drop("chunk_id").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        total, mean = found.get("", 0), found.get(" ", 0) / max(1, found.get("", 0))
        idf = {t: math.log(1 + (total - n + 0.5) / (n + 0.5)) for t, n in found.items() if t.strip()}
        place = {t: i for i, t in enumerate(sorted(idf))}
        weights = np.zeros((len(place), len(block)))
        for at, (_, own) in enumerate(block):
            for t in own:
                if t in place:
                    weights[place[t], at] = idf[t]
        # The matrix has at most MOST_CELLS cells, by the way blocks are made (more only for one query).
        sent = spark.sparkContext.broadcast((place, weights, [q for q, _ in block], mean))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            place, weights, ids, mean = sent.value
            kept: list[list[tuple[float, str]]] = [[] for _ in ids]
            for pdf in batches:
                for start in range(0, len(pdf), 1024):
                    part = pdf.iloc[start : start + 1024].sort_values("chunk_id")  # a stable sort by score breaks ties by id
                    names = part["chunk_id"].to_numpy()
                    scores = np.zeros((len(part), len(ids)))
                    for row, (own, counts, size) in enumerate(read(part)):
                        flat = K1 * (1 - B + B * size / mean) if mean else K1
                        found = [(place[t], tf * (K1 + 1) / (tf + flat)) for t, tf in zip(own, counts) if t in place]
                        if found:
                            at, tf = zip(*found)
                            scores[row] = np.array(tf) @ weights[list(at)]
                    shared = scores > 0
                    scores = np.round(scores, digits)
                    best = np.argsort(-scores, axis=0, kind="stable")[:k]
                    for at in range(len(ids)):
                        new = [(-scores[j, at], names[j]) for j in best[:, at] if shared[j, at]]
                        if new:
                            kept[at] = sorted(kept[at] + new)[:k]
            rows = [(ids[at], chunk, s) for at, own in enumerate(kept) for s, chunk in own]
            yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "score"])

        part = candidates.mapInPandas(score, f"query_id {kind}, chunk_id string, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id string, score double, rank long")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "chunk_id")).cast("long")).where(F.col("rank") <= k)


FORM = ("terms", "counts", "length")


def analyzed(chunks: DataFrame, analyzer: str = "simple", distinct: bool = False) -> DataFrame:
    """(chunk_id, terms, counts, length) of each chunk: what a search needs of its text, to be kept and searched again and again."""
    terms = ANALYZERS[analyzer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [Counter(terms(t)) for t in pdf["text"]]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "terms": [list(x) for x in own], "counts": [list(x.values()) for x in own], "length": [x.total() for x in own]})

    unique = chunks.select("chunk_id", "text") if distinct else distinct_texts(chunks)
    return unique.mapInPandas(run, "chunk_id string, terms array<string>, counts array<int>, length int")


def distinct_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): one row per chunk that has a text, the longest of those given."""
    return pick(chunks.select("chunk_id", "text").where("chunk_id is not null and text is not null"), ["chunk_id"], [F.length("text")], last=True)


def query_blocks(queries: DataFrame, terms: Callable[[str], list[str]]) -> Iterator[list]:
    """Lists of queries with their distinct terms, of a bounded product of queries and terms; one list is held at a time."""
    held: list = []
    vocabulary: set[str] = set()
    for row in queries.select("query_id", "text").where("query_id is not null and text is not null").toLocalIterator():
        own = set(terms(row["text"]))
        if held and (len(held) + 1) * len(vocabulary | own) > MOST_CELLS:
            yield held
            held, vocabulary = [], set()
        held.append((row["query_id"], sorted(own)))
        vocabulary |= own
    if held:
        yield held
