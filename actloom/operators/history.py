"""Search history and side-by-side comparison of kept results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = ("source_id", "query_text", "score", "chunk_id", "document_id", "chunk_index", "source_url")


def persist(results: DataFrame, run: Column, method: str, top_k: int, at: Column) -> DataFrame:
    """One search per query of result rows, its results in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *RESULT)))
    kept = results.groupBy("source_id").agg(F.max("query_text").alias("query_text"), rows.alias("r"))
    config = F.to_json(F.struct(F.lit(method).alias("method"), F.lit(top_k).alias("top_k")))
    return kept.select(F.sha1(F.concat_ws("|", F.lit(method), "source_id", run)).alias("search_id"), run.alias("pipeline_id"), "source_id", "query_text", config.alias("search_config"), F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in RESULT])).alias("results"), at.alias("created_at"))


def listed(searches: DataFrame, runs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest searches with the run's and dataset's name, the query, the number of results and a whole top_k."""
    names = runs.select("pipeline_id", F.col("name").alias("run_name"), F.col("dataset.name").alias("dataset_name"))
    top = F.expr("try_cast(get_json_object(search_config, '$.top_k') as int)")
    out = searches.join(names, "pipeline_id", "left").select("search_id", "run_name", "dataset_name", "query_text", F.coalesce(F.size("results"), F.lit(0)).cast("long").alias("result_count"), top.cast("long").alias("top_k"), "created_at")
    return out.orderBy(F.desc("created_at"), "search_id").limit(limit)


def flattened(searches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept results as hits: rank from 0, a key for the chunk and for the document, and the order of selection; columns of `keep` stay."""
    hits = searches.select(*keep, "search_id", "selection", F.posexplode("results").alias("rank", "x"))
    chunk = F.coalesce("x.chunk_id", F.concat("x.document_id", F.lit("#"), F.col("x.chunk_index").cast("string")), F.concat_ws(":", "search_id", F.col("rank").cast("string")))
    document = F.coalesce(F.nullif("x.source_url", F.lit("")), "x.document_id", F.lit("unknown"))
    return hits.select(*keep, "search_id", "selection", F.col("rank").cast("long").alias("rank"), chunk.alias("chunk_key"), document.alias("document_key"), "x.score")


def by_chunk(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk (and per value of `by`): its best rank, how many searches found it, and its hits in order of rank."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("rank", "selection", "search_id"))), lambda x: F.concat_ws(":", x["rank"].cast("string"), x["selection"].cast("string"), x["search_id"]))
    return hits.groupBy(*by, "chunk_key").agg(F.min("rank").alias("best_rank"), F.count("*").alias("n_hits"), F.min(F.struct("rank", "selection")).alias("first"), F.array_join(each, ",").alias("hits")).select(*by, "chunk_key", "best_rank", "n_hits", F.col("first.selection").cast("long").alias("first_selection"), "hits")


def by_document(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per document (and per value of `by`): its chunks and hits, by its best rank."""
    return hits.groupBy(*by, "document_key").agg(F.min("rank").alias("best_rank"), F.countDistinct("chunk_key").alias("n_chunks"), F.count("*").alias("n_hits"))


def by_rank(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per rank (and per value of `by`): what each search has there, in order of selection."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("selection", "chunk_key"))), lambda x: F.concat_ws("=", x["selection"].cast("string"), x["chunk_key"]))
    return hits.groupBy(*by, "rank").agg(F.count("*").alias("n_hits"), F.array_join(cells, ",").alias("cells"))


def document_label(url: Column, document_id: Column) -> Column:
    """The last segment of a URL's path, else its host, else the start of the document's id."""
    last = F.regexp_extract(url, r"^[^?#]*?([^/?#]+)/*(?:[?#].*)?$", 1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/+([^?#]*)", 1)
    return F.coalesce(F.when(F.regexp_replace(path, "/", "") != "", last), F.nullif(host, F.lit("")), F.concat(F.lit("document "), F.substring(document_id, 1, 8)))


def compatible(searches: DataFrame, first: str, any_query: bool = False) -> DataFrame:
    """Searches that may stand beside the first selected one: of the same dataset and, unless relaxed, the same query."""
    anchor = searches.where(F.col("search_id") == first).select(F.col("dataset_name").alias("d"), F.col("query_text").alias("t"))
    same = F.col("dataset_name") == F.col("d")
    return searches.join(F.broadcast(anchor.limit(1)), same if any_query else same & (F.col("query_text") == F.col("t")), "left_semi")


def detail(searches: DataFrame) -> DataFrame:
    """(search_id, query_text, rank, result columns) of kept searches, each result under its rank from 1; results that are none count as empty."""
    each = searches.select("search_id", "query_text", F.posexplode("results").alias("_at", "x"))
    return each.select("search_id", "query_text", (F.col("_at") + 1).cast("long").alias("rank"), "x.*")


def sorted_by(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Result rows by any column: numbers by value, text without case and then with it, NULLs last; ties by all other columns that can be ordered."""
    kind = dict(rows.dtypes)[column]
    keys = [F.lower(F.col(column)), F.col(column)] if kind == "string" else [F.col(column)]
    rest = [F.asc_nulls_last(c) for c, t in rows.dtypes if c != column and not t.startswith("map")]
    return rows.orderBy(*[F.desc_nulls_last(k) if descending else F.asc_nulls_last(k) for k in keys], *rest)
