"""Embeddings: a deterministic embedder, metrics, pairwise comparison and exact nearest neighbours."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from actloom.lineage import Workspace

#: Queries that are held, and sent to all executors, at once.
BLOCK = 1024
METRICS = ("cosine", "dot", "euclid", "manhattan")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalized(a: Column) -> Column:
    """Unit length; a vector without length stays as it is. The length is taken once, not per component."""
    n = norm(a)
    return F.zip_with(a, F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(a)), lambda x, y: x.cast("double") / y)


def metric_name(name: str | None) -> str:
    """A known metric; cosine for any other name."""
    low = (name or "").strip().lower()
    return low if low in METRICS else "cosine"


TOKEN = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 18)
def token_place(token: str, dim: int) -> tuple[int, float]:
    """The bucket and sign of a token, from its MD5."""
    digest = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dim, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0


def embed(texts: Iterable[str | None], dim: int = 64, normalize: bool = True) -> np.ndarray:
    """Deterministic embeddings: tokens hashed to signed buckets and summed; zeros for a text without tokens or NULL."""
    rows = []
    for text in texts:
        row = [0.0] * dim
        for token, n in Counter(TOKEN.findall((text or "").lower())).items():
            k, sign = token_place(token, dim)
            row[k] += sign * n
        rows.append(row)
    out = np.array(rows, dtype=np.float64).reshape(-1, dim)
    if normalize:
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out = out / np.where(length == 0, 1.0, length)
    return out


def hash_embedding(text: Column, dim: int = 64, normalize: bool = True) -> Column:
    """The hash embedder as a column of array<double>, in Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embed(s, dim, normalize)))

    return F.pandas_udf(run, ArrayType(DoubleType()))(text)


def compare(sources: DataFrame, candidates: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Every source with every candidate of one request (`id string, vector`), with the metrics asked for.

    A comparison is this product. The candidates go to the tasks in blocks of
    bounded size, and a batch of sources is compared with a block by matrix
    products. Metrics are NULL where a vector is NULL, holds a NULL or has
    another dimension, and the cosine where one has no length. Ordered by
    falling cosine (as they come where it is not asked for), then by the ids.
    """
    asked = [m for m in metrics if m in METRICS]
    schema = ", ".join(["source_id string", "candidate_id string", *[f"{m} double" for m in asked]])
    out = None
    for block in blocks(candidates, "string"):
        sent = sources.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            block = sent.value
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    made = {m: np.full((len(part), len(block)), np.nan) for m in asked}
                    for dim in {len(v) for _, v in block}:
                        rows = [i for i, v in enumerate(part["vector"]) if usable(v, dim)]
                        columns = [i for i, (_, v) in enumerate(block) if usable(v, dim)]
                        if rows and columns:
                            a, b = np.array([part["vector"].iloc[i] for i in rows], dtype=np.float64), np.array([block[i][1] for i in columns], dtype=np.float64)
                            for m in asked:
                                made[m][np.ix_(rows, columns)] = pair_metric(m, a, b)
                    yield pd.DataFrame({"source_id": np.repeat(part["id"].to_numpy(), len(block)), "candidate_id": [k for k, _ in block] * len(part), **{m: pd.array(v.ravel(), dtype="Float64") for m, v in made.items()}})

        found = sources.select(F.col("id").cast("string").alias("id"), "vector").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return sources.sparkSession.createDataFrame([], schema)
    out = out.select("source_id", "candidate_id", *[F.nanvl(m, F.lit(None).cast("double")).alias(m) for m in asked])
    return out.orderBy(F.desc_nulls_last("cosine"), "source_id", "candidate_id") if "cosine" in asked else out


def usable(vector, dim: int) -> bool:
    return vector is not None and len(vector) == dim and not any(x is None or x != x for x in vector)


def pair_metric(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of one matrix with rows of another; NaN for a cosine without length."""
    if metric == "dot":
        return a @ b.T
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            length = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
            return np.where(length > 0, (a @ b.T) / length, np.nan)
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):  # a component at a time, so no more than the pairs are held
        apart = a[:, d : d + 1] - b[:, d][None, :]
        out += apart * apart if metric == "euclid" else np.abs(apart)
    return np.sqrt(out) if metric == "euclid" else out


# The bounds of good and of middling by metric, and whether high is good.
BANDS = {"cosine": (0.8, 0.5, True), "dot": (0.8, 0.5, True), "euclid": (0.5, 1.0, False), "manhattan": (3.0, 6.0, False)}


def band(metric: str, value: Column, good: float | None = None, mid: float | None = None) -> Column:
    """good, mid or bad by the thresholds of a metric; high is good for cosine and dot, low for distances."""
    g, m, high = BANDS[metric]
    g, m = g if good is None else good, m if mid is None else mid
    return F.when(value.isNull(), None).when(value >= g if high else value <= g, "good").when(value >= m if high else value <= m, "mid").otherwise("bad")


def scores(metric: str, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Queries by vectors; larger is nearer (distances are negated)."""
    if metric == "dot":
        return queries @ vectors.T
    if metric == "cosine":
        a, b = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num((queries @ vectors.T) / np.outer(a, b), nan=-np.inf)
    out = np.zeros((len(queries), len(vectors)))
    for d in range(queries.shape[1]):  # a component at a time, so no more than queries times vectors is held
        apart = queries[:, d : d + 1] - vectors[:, d][None, :]
        out += apart * apart if metric == "euclid" else np.abs(apart)
    return -np.sqrt(out) if metric == "euclid" else -out


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the exact k nearest vectors of each query.

    `queries` and `vectors` have `id` (whole numbers; of vectors also strings) and `vector array<float>`. Queries
    go in blocks of bounded size; each task keeps the k best of each query of
    what it has read, so k rows a query and task are shuffled. Scores are
    rounded before they are ranked; ties go by id; distances come as they are
    (smaller is nearer). Vectors that are NULL, hold a NULL or NaN, have another
    dimension than the query, or no length under cosine, are no neighbours;
    queries that are NULL or hold a NULL have none.
    """
    metric = metric_name(metric)
    spark = vectors.sparkSession
    work = Workspace(spark, "dense")
    whole = "id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x))"
    kind = "string" if dict(vectors.dtypes)["id"] == "string" else "long"
    kept = vectors.select(F.col("id").cast(kind).alias("id"), "vector").where(whole)
    best = None
    for number, block in enumerate(blocks(queries.select(F.col("id").cast("long").alias("id"), "vector").where(whole))):
        for dim in sorted({len(v) for _, v in block}):
            own = [(i, v) for i, v in block if len(v) == dim]
            found = work.write(block_top_k(spark, own, kept.where(F.size("vector") == dim), k, metric, digits, kind), f"block{number}-{dim}")
            best = found if best is None else best.unionByName(found)
    if best is None:
        return spark.createDataFrame([], f"query_id long, id {kind}, score double, rank long")
    return best


def blocks(queries: DataFrame, kind: str = "long") -> Iterator[list]:
    """Lists of at most BLOCK queries; one list is held at a time."""
    held: list = []
    for row in queries.select(F.col("id").cast(kind).alias("id"), "vector").where("id is not null and vector is not null").toLocalIterator():
        held.append((row["id"], row["vector"]))
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def block_top_k(spark, block: list, vectors: DataFrame, k: int, metric: str, digits: int, kind: str = "long") -> DataFrame:
    sent = spark.sparkContext.broadcast((np.array([x for x, _ in block], dtype=np.int64), np.array([v for _, v in block], dtype=np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = sent.value
        top_s = np.empty((len(ids), 0))
        typed = np.int64 if kind == "long" else np.str_  # strings of one width, which sort by code point as in the JVM below the surrogates
        top_i = np.empty((len(ids), 0), dtype=typed)
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                if part.empty:
                    continue
                s = np.round(scores(metric, np.stack(part["vector"].to_numpy()).astype(np.float64), matrix), digits)
                top_s = np.concatenate([top_s, s], axis=1)
                top_i = np.concatenate([top_i, np.broadcast_to(part["id"].to_numpy().astype(typed), s.shape)], axis=1)
                order = np.lexsort((top_i, -top_s), axis=1)[:, :k]
                top_s, top_i = np.take_along_axis(top_s, order, 1), np.take_along_axis(top_i, order, 1)
        if top_i.shape[1]:
            fine = np.isfinite(top_s)
            yield pd.DataFrame({"query_id": np.repeat(ids, top_i.shape[1])[fine.ravel()], "id": top_i[fine], "score": top_s[fine]})

    local = vectors.mapInPandas(run, f"query_id long, id {kind}, score double")
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= k)
    return ranked.withColumn("score", -F.col("score") if metric in ("euclid", "manhattan") else F.col("score"))
