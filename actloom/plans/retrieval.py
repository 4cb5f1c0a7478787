"""Queries of the retrieval side: embeddings, nearest neighbours, BM25, fusion, search, comparison, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.io import table
from actloom.operators import bm25, history, search, vectors
from actloom.operators.state import current, unique_chunks
from actloom.plans.pipeline import CHUNKS, CURRENT

TOP_K = 10


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The search inputs: the test items, a table of fixed size."""
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", "text")


def collection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def l2_normalize(spark, folder):
    """The length of each vector before, and the sum of squares after."""
    v = F.col("vector")
    unit = vectors.l2_normalized(v)
    return collection(spark, folder).select("id", F.round(vectors.norm(v), 6).alias("length"), F.round(vectors.dot(unit, unit), 6).alias("unit"))


def dense(metric: str):
    def query(spark, folder):
        own = collection(spark, folder)
        return vectors.dense_top_k(own.where("id % 50 = 0"), own, TOP_K, metric)

    query.__doc__ = f"The nearest vectors under {metric} of every vector whose id is divisible by 50, among all."
    return query


def dense_topk_scoped(spark, folder):
    """The nearest vectors of one label (a run) for the same queries."""
    own = collection(spark, folder)
    return vectors.dense_top_k(own.where("id % 50 = 0"), own.where("label = 3"), TOP_K)


def hash_embed(spark, folder):
    """The embedding of each search input, all its components."""
    own = questions(spark, folder).select("query_id", F.posexplode(vectors.hash_embedding(F.col("text"), normalize=False)).alias("component", "value"))
    return own.select("query_id", "component", F.round("value", 6).alias("value"))


def bm25_topk(spark, folder):
    return bm25.bm25_top_k(questions(spark, folder), passages(spark, folder), TOP_K)


def run_scope(spark, folder):
    """The chunks of the documents of one run: that with the smallest id."""
    first = table(spark, folder, "runs").agg(F.min("pipeline_id").alias("pipeline_id"))
    own = current(table(spark, folder, "targets").select("target_id", "pipeline_id", "document_id", "updated_at", "created_at")).join(first, "pipeline_id").select("document_id").where("document_id is not null").distinct()
    return table(spark, folder, "chunks").select("chunk_id", "document_id").join(own, "document_id", "left_semi")


def bm25_topk_scoped(spark, folder):
    """The same within one run; the statistics stay those of all chunks."""
    return bm25.bm25_top_k(questions(spark, folder), passages(spark, folder), TOP_K, scope=run_scope(spark, folder))


def bm25_english(spark, folder):
    return bm25.bm25_top_k(questions(spark, folder), passages(spark, folder), TOP_K, analyzer="english")


def rrf_fuse(spark, folder):
    """Nearest neighbours under cosine and under Manhattan distance, fused by rank."""
    a, b = dense("cosine")(spark, folder), dense("manhattan")(spark, folder)
    return search.fuse([a.select("query_id", F.col("id").cast("string").alias("id"), "rank"), b.select("query_id", F.col("id").cast("string").alias("id"), "rank")], top=TOP_K, digits=6)


def hybrid_search(spark, folder):
    """Dense and lexical lists of each search input over the chunks, fused, with chunk, document and URL."""
    return search.search(questions(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "documents"), "hybrid", TOP_K)


def semantic_hydrate(spark, folder):
    return search.search(questions(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "documents"), "semantic", TOP_K).select("source_id", "chunk_id", "document_id", "chunk_index", "source_url", "score", "rank")


def keyword_search(spark, folder):
    return search.search(questions(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "documents"), "keyword", TOP_K).select("source_id", "chunk_id", "document_id", "chunk_index", "source_url", "score", "rank")


def rerank(spark, folder):
    """The hybrid results, the best five after scoring anew by shared terms."""
    return search.search(questions(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "documents"), "hybrid", TOP_K, 5).select("source_id", "chunk_id", "score", "rank")


def requests(spark, folder) -> tuple[DataFrame, DataFrame]:
    """One comparison request: embeddings of all test items, a table of fixed size, as sources and as candidates."""
    own = table(spark, folder, "eval_items").select(F.col("item_id").cast("string").alias("id"), vectors.hash_embedding(F.col("text")).alias("vector"))
    return own, own


def compare_pairwise(spark, folder):
    a, b = requests(spark, folder)
    found = vectors.compare(a, b)
    return found.select("source_id", "candidate_id", *[F.round(m, 6).alias(m) for m in vectors.METRICS])


def compare_bands(spark, folder):
    """Pairs of a comparison by metric and band."""
    found = compare_pairwise(spark, folder)
    long = found.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), vectors.band(m, F.col(m)).alias("band")) for m in vectors.METRICS])).alias("x")).select("x.*")
    return long.groupBy("metric", "band").agg(F.count("*").alias("n"))


def template_expand(spark, folder):
    """Test items as templates with the sources of the mixtures as groups of variables: item by group, {{0}} and {{1}} filled in."""
    groups = [r["mix_name"] for r in table(spark, folder, "mix_targets").groupBy("mix_name").agg(F.count("*")).orderBy("mix_name").collect()]
    template = F.concat(F.lit("{{0}} on {{1}}: "), "suite", F.lit(" {{2}}"))
    own = table(spark, folder, "eval_items").select("item_id", template.alias("t"), F.explode(F.array(*[F.lit(g) for g in groups])).alias("g"))
    filled = F.replace(F.replace(F.col("t"), F.lit("{{0}}"), F.col("g")), F.lit("{{1}}"), F.col("item_id").cast("string"))
    return own.select(F.concat_ws("~", F.col("item_id").cast("string"), "g").alias("id"), filled.alias("text"))


def neighbors_expand(spark, folder):
    """The chunks beside each chunk, over all documents."""
    own = unique_chunks(table(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_index", "created_at")).where("document_id is not null and chunk_index is not null")
    return search.neighbours(own, own).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("neighbour_index").cast("long").alias("neighbour_index"), "chunk_id")


def hits_of(spark, folder):
    return bm25_topk(spark, folder).select("query_id", F.col("chunk_id").alias("id"), "rank")


def expand_hits(spark, folder):
    """The lexical hits with the chunks beside them, each once a query."""
    return search.expand(hits_of(spark, folder), table(spark, folder, "chunks")).select("query_id", "id", "rank")


def multi_query_dedup(spark, folder):
    """Each chunk found by any query once, from the first query that has it."""
    return search.first_seen(hits_of(spark, folder))


def kept_searches(spark, folder) -> DataFrame:
    """Three searches kept: nearest vectors under three metrics, for one input each, in the form of the history."""
    parts = None
    for k, metric in enumerate(("cosine", "euclid", "manhattan")):
        own = dense(metric)(spark, folder).select(F.lit(metric).alias("search_id"), F.lit(k).alias("selection"), "query_id", "rank", F.struct(F.concat(F.lit("c"), F.col("id")).alias("chunk_id"), F.concat(F.lit("d"), (F.col("id") % 7)).alias("document_id"), F.col("rank").alias("chunk_index"), F.lit(None).cast("string").alias("source_url"), F.col("score").alias("score")).alias("x"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("search_id", "selection", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda r: r["x"]).alias("results"))


def lab(view):
    def query(spark, folder):
        return view(history.flattened(kept_searches(spark, folder), ("query_id",)), ("query_id",))

    return query


def history_list(spark, folder):
    """Searches kept for every input under the newest run, newest first."""
    searches = kept_searches(spark, folder)
    run = table(spark, folder, "runs").agg(F.max("pipeline_id")).first()[0]
    kept = searches.select(
        F.concat_ws("/", "search_id", F.col("query_id").cast("string")).alias("search_id"), F.lit(run).alias("pipeline_id"), F.col("query_id").cast("string").alias("query_text"),
        F.to_json(F.struct(F.col("search_id").alias("method"), F.lit(TOP_K).alias("top_k"))).alias("search_config"), "results", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, query_id)").alias("created_at"),
    )
    return history.listed(kept, table(spark, folder, "runs"))


def document_labels(spark, folder):
    return table(spark, folder, "documents").select("doc_id", history.document_label(F.col("source_url"), F.col("document_id")).alias("label"))


QUERIES = {
    "l2_normalize": l2_normalize,
    "hash_embed": hash_embed,
    "dense_topk_cosine": dense("cosine"),
    "dense_topk_dot": dense("dot"),
    "dense_topk_euclid": dense("euclid"),
    "dense_topk_scoped": dense_topk_scoped,
    "bm25_topk": bm25_topk,
    "bm25_topk_scoped": bm25_topk_scoped,
    "bm25_english": bm25_english,
    "rrf_fuse": rrf_fuse,
    "hybrid_search": hybrid_search,
    "semantic_hydrate": semantic_hydrate,
    "keyword_search": keyword_search,
    "rerank": rerank,
    "compare_pairwise": compare_pairwise,
    "compare_bands": compare_bands,
    "template_expand": template_expand,
    "neighbors_expand": neighbors_expand,
    "expand_hits": expand_hits,
    "multi_query_dedup": multi_query_dedup,
    "history_list": history_list,
    "lab_by_chunk": lab(history.by_chunk),
    "lab_by_document": lab(history.by_document),
    "lab_by_rank": lab(history.by_rank),
    "document_labels": document_labels,
}

V = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def dense_sql(score: str, order: str, where: str = "", k: int = TOP_K) -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM (
SELECT q.id AS query_id, c.id AS id, round({score}, 6) AS score FROM {V} q, {V} c WHERE q.id % 50 = 0 {where})) WHERE rank <= {k}"""


COSINE = dense_sql("list_cosine_similarity(q.v, c.v)", "DESC")
EUCLID = dense_sql("list_distance(q.v, c.v)", "ASC")
MANHATTAN = dense_sql("list_sum(list_transform(list_zip(q.v, c.v), lambda p: abs(p[1] - p[2])))", "ASC")
UNIQUE = "(SELECT chunk_id, arg_max(text, length(text)) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"


def bm25_sql(where: str = "") -> str:
    return rf"""WITH toks AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM {UNIQUE}),
stats AS (SELECT (SELECT count(*) FROM {UNIQUE}) AS n, (SELECT count(*) FROM toks) / (SELECT count(*) FROM {UNIQUE}) AS mean),
tf AS (SELECT chunk_id, t, count(*) AS tf FROM toks GROUP BY 1, 2), len AS (SELECT chunk_id, count(*) AS len FROM toks GROUP BY 1), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM eval_items),
s AS (SELECT query_id, chunk_id, round(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN len USING (chunk_id), stats {where} GROUP BY 1, 2)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM s) WHERE rank <= {TOP_K}"""


def stem_sql(t: str) -> str:
    """The stem of a term, by the endings of the analyzer."""
    cases = []
    for end, new, least in bm25.ENDINGS:
        base = f"substr({t}, 1, length({t}) - {len(end)})"
        short = f"CASE WHEN length({base}) > 3 AND right({base}, 1) = substr({base}, length({base}) - 1, 1) AND right({base}, 1) NOT IN ('l', 's', 'z') THEN substr({base}, 1, length({base}) - 1) ELSE {base} END"
        cases.append(f"WHEN suffix({t}, '{end}') AND length({t}) >= {least} THEN " + (f"{base} || '{new}'" if new else short))
    return f"CASE {' '.join(cases)} WHEN suffix({t}, 's') AND NOT (suffix({t}, 'ss') OR suffix({t}, 'us') OR suffix({t}, 'is')) AND length({t}) > 3 THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"


def english_sql() -> str:
    """BM25 over stems, without stop words."""
    stop = ", ".join(f"'{w}'" for w in sorted(bm25.STOP))
    kept = lambda source, key: f"SELECT {key}, {stem_sql('t')} AS t FROM ({source}) WHERE t NOT IN ({stop})"
    plain = bm25_sql()
    tokens = rf"SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM {UNIQUE}"
    asked = r"SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM eval_items"
    assert tokens in plain and asked in plain
    return plain.replace(f"({tokens})", f"({kept(tokens, 'chunk_id')})").replace(f"({asked})", f"(SELECT DISTINCT query_id, t FROM ({kept(asked, 'query_id')}))")


SCOPE = f"WHERE chunk_id IN (SELECT c.chunk_id FROM chunks c JOIN {CURRENT} t USING (document_id) WHERE t.pipeline_id = (SELECT min(pipeline_id) FROM runs))"
NEIGHBOURS = f"SELECT a.document_id, CAST(a.chunk_index AS BIGINT) AS chunk_index, CAST(b.chunk_index AS BIGINT) AS neighbour_index, b.chunk_id FROM {CHUNKS} a JOIN {CHUNKS} b ON a.document_id = b.document_id AND abs(a.chunk_index - b.chunk_index) = 1"


def embed_sql(source: str) -> str:
    """(id, e): the hash embedding of `id, text`, unnormalised."""
    return rf"""SELECT id, list_transform(range(0, 64), lambda k: CAST(coalesce(list_sum(list_transform(list_filter(h, lambda x: ('0x' || x[1:8])::BIGINT % 64 = k), lambda x: CASE WHEN ('0x' || x[9:9])::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)), 0) AS DOUBLE)) AS e
FROM (SELECT id, list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: md5(t)) AS h FROM {source})"""


UNIT = "CASE WHEN list_sum(list_transform(e, lambda x: x * x)) = 0 THEN e ELSE list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) END"
REQUEST = f"(SELECT id, suite, {UNIT} AS v FROM ({embed_sql('(SELECT CAST(item_id AS VARCHAR) AS id, text FROM eval_items)')}) JOIN (SELECT CAST(item_id AS VARCHAR) AS id, suite FROM eval_items) USING (id))"
PAIRS = f"SELECT a.id AS source_id, b.id AS candidate_id, round(CASE WHEN list_sum(list_transform(a.v, lambda x: abs(x))) * list_sum(list_transform(b.v, lambda x: abs(x))) = 0 THEN NULL ELSE list_cosine_similarity(a.v, b.v) END, 6) AS cosine, round(list_dot_product(a.v, b.v), 6) AS dot, round(list_distance(a.v, b.v), 6) AS euclid, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))), 6) AS manhattan FROM {REQUEST} a, {REQUEST} b"
SEMANTIC = f"""SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT q.id AS query_id, c.id AS id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS score FROM (SELECT id, {UNIT} AS v FROM ({embed_sql('(SELECT item_id AS id, text FROM eval_items)')})) q, (SELECT id, {UNIT} AS v FROM ({embed_sql(f'(SELECT chunk_id AS id, text FROM {UNIQUE})')})) c)) WHERE rank <= {TOP_K}"""


def hydrated(hits: str, extra: str = "") -> str:
    return f"SELECT CAST(h.query_id AS VARCHAR) AS source_id, h.id AS chunk_id, c.document_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, d.source_url, h.score, h.rank{extra} FROM ({hits}) h LEFT JOIN {CHUNKS} c ON c.chunk_id = h.id LEFT JOIN documents d ON d.document_id = c.document_id"


FUSED = f"""SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM (@A) UNION ALL SELECT query_id, id, rank FROM (@B)) GROUP BY 1, 2)) WHERE rank <= {TOP_K}"""
HYBRID = FUSED.replace("@A", SEMANTIC).replace("@B", f"SELECT query_id, chunk_id AS id, rank FROM ({bm25_sql()})")
LAB = f"(SELECT 'cosine' AS search_id, 0 AS selection, * FROM ({COSINE}) UNION ALL SELECT 'euclid', 1, * FROM ({EUCLID}) UNION ALL SELECT 'manhattan', 2, * FROM ({MANHATTAN}))"
HITS = f"(SELECT query_id, search_id, selection, rank - 1 AS rank, 'c' || id AS chunk_key, 'd' || (id % 7) AS document_key FROM {LAB})"
TERMS = lambda t: rf"list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+'))"
RERANK = f"""WITH h AS (SELECT h.query_id, h.id, h.rank, e.text AS q, c.text AS t FROM ({HYBRID}) h JOIN eval_items e ON e.item_id = h.query_id LEFT JOIN {CHUNKS} c ON c.chunk_id = h.id),
s AS (SELECT *, len(list_intersect({TERMS('q')}, {TERMS('t')})) / CAST(greatest(1, len({TERMS('q')})) AS DOUBLE) AS score FROM h WHERE trim(coalesce(t, '')) <> '')
SELECT CAST(query_id AS VARCHAR) AS source_id, id AS chunk_id, score, new AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new FROM s) WHERE new <= 5"""
BAND = "SELECT '{m}' AS metric, CASE WHEN {m} IS NULL THEN NULL WHEN {m} {o} {g} THEN 'good' WHEN {m} {o} {b} THEN 'mid' ELSE 'bad' END AS band FROM p"

SQL = {
    "l2_normalize": f"SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS length, CAST(CASE WHEN list_dot_product(v, v) = 0 THEN 0 ELSE 1 END AS DOUBLE) AS unit FROM {V}",
    "hash_embed": f"SELECT id AS query_id, CAST(i - 1 AS INT) AS component, e[i] AS value FROM ({embed_sql('(SELECT item_id AS id, text FROM eval_items)')}), LATERAL unnest(range(1, 65)) AS u(i)",
    "dense_topk_cosine": COSINE,
    "dense_topk_dot": dense_sql("list_dot_product(q.v, c.v)", "DESC"),
    "dense_topk_euclid": EUCLID,
    "dense_topk_scoped": dense_sql("list_cosine_similarity(q.v, c.v)", "DESC", "AND c.label = 3"),
    "bm25_topk": bm25_sql(),
    "bm25_topk_scoped": bm25_sql(SCOPE),
    "bm25_english": english_sql(),
    "rerank": RERANK,
    "rrf_fuse": FUSED.replace("@A", f"SELECT query_id, CAST(id AS VARCHAR) AS id, rank FROM ({COSINE})").replace("@B", f"SELECT query_id, CAST(id AS VARCHAR) AS id, rank FROM ({MANHATTAN})"),
    "hybrid_search": f"SELECT CAST(h.query_id AS VARCHAR) AS source_id, e.text AS query_text, h.score, h.id AS chunk_id, c.document_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, CAST(NULL AS VARCHAR) AS \"group\", c.text AS chunk_text, d.source_url, CAST(NULL AS VARCHAR) AS metadata, h.rank FROM ({HYBRID}) h JOIN eval_items e ON e.item_id = h.query_id LEFT JOIN {CHUNKS} c ON c.chunk_id = h.id LEFT JOIN documents d ON d.document_id = c.document_id",
    "semantic_hydrate": hydrated(SEMANTIC),
    "keyword_search": hydrated(f"SELECT query_id, chunk_id AS id, score, rank FROM ({bm25_sql()})"),
    "compare_pairwise": PAIRS,
    "compare_bands": f"WITH p AS ({PAIRS}) SELECT metric, band, count(*) AS n FROM ("
    + " UNION ALL ".join(BAND.format(m=m, o=o, g=g, b=b) for m, o, g, b in (("cosine", ">=", 0.8, 0.5), ("dot", ">=", 0.8, 0.5), ("euclid", "<=", 0.5, 1.0), ("manhattan", "<=", 3.0, 6.0)))
    + ") GROUP BY 1, 2",
    "template_expand": "SELECT item_id || '~' || mix_name AS id, mix_name || ' on ' || item_id || ': ' || suite || ' {{2}}' AS text FROM eval_items, (SELECT DISTINCT mix_name FROM mix_targets)",
    "neighbors_expand": NEIGHBOURS,
    "expand_hits": f"""WITH h AS (SELECT query_id, chunk_id AS id, rank FROM ({bm25_sql()})) SELECT query_id, id, min(rank) AS rank FROM (SELECT query_id, id, rank FROM h UNION ALL
SELECT h.query_id, n.chunk_id, h.rank FROM h JOIN {CHUNKS} c ON c.chunk_id = h.id JOIN ({NEIGHBOURS}) n ON n.document_id = c.document_id AND n.chunk_index = c.chunk_index) GROUP BY 1, 2""",
    "multi_query_dedup": f"SELECT id, query_id, rank FROM (SELECT chunk_id AS id, query_id, rank, row_number() OVER (PARTITION BY chunk_id ORDER BY query_id, rank) AS rn FROM ({bm25_sql()})) WHERE rn = 1",
    "history_list": f"SELECT l.search_id || '/' || l.query_id AS search_id, r.name AS run_name, r.dataset.name AS dataset_name, CAST(l.query_id AS VARCHAR) AS query_text, n AS result_count, CAST({TOP_K} AS BIGINT) AS top_k, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(l.query_id) AS created_at FROM (SELECT search_id, query_id, count(*) AS n FROM {LAB} GROUP BY 1, 2) l, (SELECT * FROM runs ORDER BY pipeline_id DESC LIMIT 1) r ORDER BY created_at DESC, search_id LIMIT 100",
    "lab_by_chunk": f"SELECT query_id, chunk_key, min(rank) AS best_rank, count(*) AS n_hits, CAST(arg_min(selection, (rank, selection)) AS BIGINT) AS first_selection, string_agg(rank || ':' || selection || ':' || search_id, ',' ORDER BY rank, selection) AS hits FROM {HITS} GROUP BY 1, 2",
    "lab_by_document": f"SELECT query_id, document_key, min(rank) AS best_rank, count(DISTINCT chunk_key) AS n_chunks, count(*) AS n_hits FROM {HITS} GROUP BY 1, 2",
    "lab_by_rank": f"SELECT query_id, rank, count(*) AS n_hits, string_agg(selection || '=' || chunk_key, ',' ORDER BY selection) AS cells FROM {HITS} GROUP BY 1, 2",
    "document_labels": r"""SELECT doc_id, CASE WHEN source_url IS NULL THEN 'document ' || substr(document_id, 1, 8) WHEN regexp_replace(p, '/', '', 'g') <> '' THEN regexp_extract(source_url, '^[^?#]*?([^/?#]+)/*(?:[?#].*)?$', 1) WHEN h <> '' THEN h ELSE 'document ' || substr(document_id, 1, 8) END AS label
FROM (SELECT *, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/+([^?#]*)', 1) AS p, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1) AS h FROM documents)""",
}
