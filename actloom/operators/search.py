"""Retrieval: fusion of ranked lists, hydration, reranking, neighbours, and the search of a set of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actloom.lineage import Workspace
from actloom.operators import bm25, vectors
from actloom.operators.keyed import pick

RRF_K, DEFAULT_TOP_K = 60, 10
STRATEGIES = ("semantic", "keyword", "hybrid")


def parse_top_k(value, default: int | None = DEFAULT_TOP_K) -> int | None:
    """A whole number from 1; the default for none given; None for anything else."""
    if value is None or value == "":
        return default
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return int(number) if number == number and abs(number) != float("inf") and number == int(number) and number >= 1 else None


def parse_strategy(value) -> str | None:
    """semantic, keyword or hybrid, without case and blanks; semantic for none given; None for others."""
    name = str(value or "").strip().lower() or "semantic"
    name = "semantic" if name == "embedding" else name
    return name if name in STRATEGIES else None


def fuse(lists: list[DataFrame], k: int = RRF_K, top: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) by reciprocal rank fusion of lists (query_id, id, rank); ties by id as text."""
    every = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "id", "rank"))
    score = F.sum(1.0 / (k + F.col("rank")))
    fused = every.groupBy("query_id", "id").agg((F.round(score, digits) if digits else score).alias("score"))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("id").cast("string"))).cast("long"))
    return ranked.where(F.col("rank") <= top) if top else ranked


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (query_id, id, score, rank) with the chunk's document, index, text and the document's URL; NULLs where the chunk is gone."""
    # Only the rows of hits are reduced: their ids reach the scans first, so no other text is moved.
    ids = hits.select("id").distinct()
    found = chunks.select(F.col("chunk_id").alias("id"), "document_id", "chunk_index", "text").join(ids, "id", "left_semi")
    own = pick(found, ["id"], [F.col("chunk_index")])
    named = hits.join(own, "id", "left")
    pages = documents.select("document_id", "source_url").join(own.select("document_id").where("document_id is not null").distinct(), "document_id", "left_semi")
    return named.join(pick(pages, ["document_id"], [F.col("source_url")]), "document_id", "left")


def result_rows(hits: DataFrame, queries: DataFrame, group: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """The uniform result row of a search."""
    texts = queries.select("query_id", F.col("text").alias("query_text"))
    return hits.join(texts, "query_id", "left").select(
        F.col("query_id").cast("string").alias("source_id"),
        F.col("query_text"),
        "score",
        F.col("id").alias("chunk_id"),
        "document_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        (group if group is not None else F.lit(None).cast("string")).alias("group"),
        F.col("text").alias("chunk_text"),
        "source_url",
        (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"),
        "rank",
    )


def overlap_score(query: str, texts: list[str]) -> list[float]:
    """The default scorer: the share of the query's distinct terms that a text has."""
    own = set(bm25.simple(query))
    return [len(own & set(bm25.simple(t))) / max(1, len(own)) for t in texts]


def rerank(hits: DataFrame, k: int, scorer: Callable[[str, list[str]], list[float]] = overlap_score) -> DataFrame:
    """Hits (query_id, query_text, id, chunk_text, score, rank) scored anew, best first, at most k a query.

    Hits without text are left out; ties go by the rank before. Where the
    scorer fails on a query, or a query has no text to score, its hits keep
    their order, cut to k. A query's hits are few (its top list), so a query
    is one group.
    """
    schema = "query_id string, id string, score double, rank long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        usable = pdf[pdf["chunk_text"].fillna("").str.strip() != ""]
        out = pdf.head(k)
        if len(usable):
            try:
                new = scorer(pdf["query_text"].iloc[0], list(usable["chunk_text"]))
                if len(new) != len(usable):
                    raise ValueError("the scorer left out texts")
                out = usable.assign(score=[float(x) for x in new]).sort_values("score", ascending=False, kind="stable").head(k)
            except Exception:  # noqa: BLE001 - reranking never breaks a search
                out = pdf.head(k)
        return pd.DataFrame({"query_id": key[0], "id": out["id"], "score": out["score"], "rank": range(1, len(out) + 1)})

    own = hits.select(F.col("query_id").cast("string").alias("query_id"), "query_text", F.col("id").cast("string").alias("id"), "chunk_text", F.col("score").cast("double").alias("score"), "rank")
    return own.groupBy("query_id").applyInPandas(run, schema)


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """(document_id, chunk_index, neighbour_index, chunk_id): chunks within reach of each hit in its document."""
    wanted = hits.select("document_id", "chunk_index").distinct()
    near = wanted.select("document_id", "chunk_index", F.explode(F.array(*[F.col("chunk_index") + F.lit(d) for d in range(-reach, reach + 1) if d])).alias("neighbour_index"))
    own = chunks.select("document_id", F.col("chunk_index").alias("neighbour_index"), "chunk_id").distinct()
    return near.join(own, ["document_id", "neighbour_index"]).select("document_id", "chunk_index", "neighbour_index", "chunk_id")


def expand(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Hits (query_id, id, rank) with the chunks beside them, each chunk once, where it was first seen."""
    own = chunks.select(F.col("chunk_id").alias("id"), "document_id", "chunk_index").distinct()
    placed = hits.join(own, "id")
    near = neighbours(placed, chunks, reach)
    added = placed.select("query_id", "rank", "document_id", "chunk_index").join(near, ["document_id", "chunk_index"]).select("query_id", F.col("chunk_id").alias("id"), "rank", (F.col("neighbour_index") - F.col("chunk_index")).alias("beside"))
    every = hits.select("query_id", "id", "rank", F.lit(0).alias("beside")).unionByName(added)
    return pick(every, ["query_id", "id"], [F.col("rank"), F.abs("beside"), F.col("beside")])


def first_seen(hits: DataFrame) -> DataFrame:
    """Hits of several queries with each chunk once: from the first query, at its best rank, that has it."""
    return pick(hits.select("id", "query_id", "rank"), ["id"], [F.col("query_id"), F.col("rank")])


def hybrid(queries: DataFrame, unique: DataFrame, k: int = DEFAULT_TOP_K, dim: int = 64) -> DataFrame:
    """(query_id, id, score, rank): dense and lexical lists of each query, both k deep, fused by rank.

    `unique` has one row per chunk, with a text; texts are embedded by the hash embedder.
    """
    dense = semantic(queries, unique, k, dim)
    lexical = bm25.bm25_top_k(queries, unique, k, distinct=True).select("query_id", F.col("chunk_id").alias("id"), "rank")
    return fuse([dense.select("query_id", "id", "rank"), lexical], top=k, digits=6)


def semantic(queries: DataFrame, unique: DataFrame, k: int = DEFAULT_TOP_K, dim: int = 64) -> DataFrame:
    """(query_id, id, score, rank): the k nearest chunks of each query under the hash embedder and cosine.

    As in the lexical search, each task keeps the k best of each query.
    """
    spark = unique.sparkSession
    kind = dict(queries.dtypes)["query_id"]
    best = None
    own = queries.select(F.col("query_id").cast("long").alias("id"), vectors.hash_embedding(F.col("text"), dim).alias("vector")).where("id is not null")
    for block in vectors.blocks(own):
        sent = spark.sparkContext.broadcast(([x for x, _ in block], np.array([v for _, v in block], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            kept: list[list[tuple[float, str]]] = [[] for _ in ids]
            for pdf in batches:
                if pdf.empty:
                    continue
                pdf = pdf.sort_values("chunk_id")  # then a stable sort by score breaks ties by id
                s = np.round(matrix @ vectors.embed(pdf["text"], dim).T, 6) + 0.0
                names = pdf["chunk_id"].to_numpy()
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                for at in range(len(ids)):
                    kept[at] = sorted(kept[at] + [(-s[at, j], names[j]) for j in order[at]])[:k]
            yield pd.DataFrame([(ids[at], c, -x) for at, rows in enumerate(kept) for x, c in rows], columns=["query_id", "id", "score"])

        part = unique.select("chunk_id", "text").mapInPandas(run, f"query_id {kind}, id string, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], f"query_id {kind}, id string, score double, rank long")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= k)


def stored_hits(queries: DataFrame, strategy: str, k: int, vectors_of: DataFrame, terms_of: DataFrame, dim: int = 64) -> DataFrame:
    """(query_id, id, score, rank) from stored vectors (`chunk_id, vector`) and analyzed chunks: no text is read."""
    embedded = queries.select(F.col("query_id").alias("id"), vectors.hash_embedding(F.col("text"), dim).alias("vector"))
    dense = lambda: vectors.dense_top_k(embedded, vectors_of.select(F.col("chunk_id").alias("id"), "vector"), k)
    lexical = lambda: bm25.bm25_top_k(queries, terms_of, k).withColumnRenamed("chunk_id", "id")
    if strategy == "hybrid":
        return fuse([dense().select("query_id", "id", "rank"), lexical().select("query_id", "id", "rank")], top=k, digits=6)
    return lexical() if strategy == "keyword" else dense()


def search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, method=None, top_k=None, reranker_top_k=None, scorer=overlap_score, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Result rows of all queries under a strategy, reranked where asked for; ValueError for parameters that are none.

    Hits are found once and written before they are looked up. `stored` has
    the vectors and the analyzed chunks of a collection; with them only the
    texts of hits are read.
    """
    strategy, k = parse_strategy(method), parse_top_k(top_k)
    if strategy is None or k is None:
        raise ValueError(f"no such search: method {method!r}, topK {top_k!r}")
    # Read several times: reduced to one row per chunk once, and kept in the shared folder.
    work = Workspace(chunks.sparkSession, "search")
    unique = work.write(bm25.distinct_texts(chunks), "texts") if stored is None else None
    if stored is not None:
        hits = stored_hits(queries, strategy, k, *stored)
    elif strategy == "keyword":
        hits = bm25.bm25_top_k(queries, unique, k, distinct=True).withColumnRenamed("chunk_id", "id")
    elif strategy == "semantic":
        hits = semantic(queries, unique, k)
    else:
        hits = hybrid(queries, unique, k)
    rows = result_rows(hydrate(work.write(hits, "hits"), chunks, documents), queries)
    if reranker_top_k is None:
        return rows
    if strategy != "hybrid":
        return rows  # only a hybrid search is reranked
    r = parse_top_k(reranker_top_k, None)
    if r is None:
        raise ValueError(f"no such number of results: {reranker_top_k!r}")
    again = rerank(rows.select(F.col("source_id").alias("query_id"), "query_text", F.col("chunk_id").alias("id"), "chunk_text", "score", "rank"), r, scorer)
    rest = rows.drop("score", "rank").alias("a")
    return again.alias("b").join(rest, (F.col("a.source_id") == F.col("b.query_id")) & (F.col("a.chunk_id") == F.col("b.id"))).select("a.*", "b.score", "b.rank")
