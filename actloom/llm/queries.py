"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.io import table
from actloom.llm import leakage, main_text, mixture, pii, site_lines, split

CHUNK_SIZE, CHUNK_OVERLAP = 1200, 150
#: The domains of these tables' sources, a parameter of the mixtures.
DOMAINS = {
    "state_gazette": "law", "court_digest": "law", "municipal_rules": "law", "minutes_archive": "law",
    "agency_guidance": "guidance", "consumer_help": "guidance", "forum_threads": "community",
    "ingestion_notes": "technical", "glossary_terms": "technical", "translation_memory": "technical",
}


def pieces_of(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "runs")
    by_document = split.limits(table(spark, folder, "documents"), table(spark, folder, "targets"), runs, CHUNK_SIZE, CHUNK_OVERLAP)
    smallest = runs.select(F.min(split.setting("chunk_size", CHUNK_SIZE))).first()[0]
    return split.split_chunks(table(spark, folder, "chunks"), by_document, CHUNK_SIZE if smallest is None else smallest, CHUNK_SIZE, CHUNK_OVERLAP)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, chunk_index) of each chunk that had to be cut."""
    return pieces_of(spark, folder).where("piece_no = 0").select("document_id", "chunk_index").distinct()


def p2_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Each cut chunk put together again from its pieces less their overlaps: the hash of its text, its longest piece and the overlap of all its pieces."""
    own = pieces_of(spark, folder)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(text, overlap + 1)").alias("new")))), lambda x: x["new"]), "")
    shared = F.when(F.col("piece_no") > 0, F.col("overlap"))
    done = own.groupBy("document_id", "chunk_index", "chunk_id").agg(F.sha2(whole, 256).alias("text_hash"), F.max(F.length("text")).alias("longest"), F.min(shared).alias("least_overlap"), F.max(shared).alias("most_overlap"), F.max("n_pieces").alias("n_pieces"), F.count("*").alias("n"))
    limits = split.limits(table(spark, folder, "documents"), table(spark, folder, "targets"), table(spark, folder, "runs"), CHUNK_SIZE, CHUNK_OVERLAP)
    size = F.coalesce("chunk_size", F.lit(CHUNK_SIZE))
    kept = F.least(F.coalesce("chunk_overlap", F.lit(CHUNK_OVERLAP)), size - 1)
    joined = done.join(limits, "document_id", "left")
    return joined.select(
        "document_id", "chunk_index", "chunk_id", "text_hash", (F.col("longest") <= size).alias("fits"),
        ((F.col("least_overlap") == kept) & (F.col("most_overlap") == kept)).alias("overlaps"), (F.col("n_pieces") == F.col("n")).alias("numbered"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(target_id, line_no) of each line with text of the page's main body."""
    found = main_text.extract_main_text(table(spark, folder, "fetches"))
    return found.select("target_id", F.explode("main_lines").alias("line_no")).distinct()


def p4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered main body of each stored page."""
    found = main_text.extract_main_text(table(spark, folder, "fetches"))
    return found.groupBy("target_id").agg(F.max(F.struct("main_text", F.size("main_lines").alias("n_lines"))).alias("x")).select("target_id", "x.main_text", "x.n_lines")


def site_bitmaps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    numbered = site_lines.numbered(table(spark, folder, "documents"))
    lines = site_lines.chunk_lines(table(spark, folder, "chunks"), numbered)
    return lines, site_lines.repeated_lines(lines, numbered)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, line_no) of each occurrence of a line that its site repeats."""
    lines, bitmaps = site_bitmaps(spark, folder)
    return site_lines.occurrences(lines, bitmaps).select("chunk_id", "line_no")


def p5_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The repeated lines of each site: their form, one spelling, the documents that have them, the documents of the site."""
    lines, bitmaps = site_bitmaps(spark, folder)
    return site_lines.line_texts(table(spark, folder, "chunks"), lines, bitmaps)


def p5_clean_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk texts without the lines that their site repeats."""
    lines, bitmaps = site_bitmaps(spark, folder)
    return site_lines.without_lines(table(spark, folder, "chunks"), site_lines.occurrences(lines, bitmaps))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id) of each document and test item that share a passage."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each leak with the longest shared run of words and the number of places."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each test item with the number of documents it leaked into and the longest run of its words there; 0 for none."""
    found = p6_leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"))
    items = table(spark, folder, "eval_items").groupBy("item_id").agg(F.max("suite").alias("suite"))
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest"))


def mixtures(spark: SparkSession, folder: str, total: str | None = None) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), total_tokens=total, domains=DOMAINS)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mixture with their tokens and repeats, as large as all shares can be met within the caps."""
    return mixtures(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The target and actual share of each source in each mixture."""
    return mixtures(spark, folder)[1]


def p7_all_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of mixtures as large as their sources: what small sources lack goes to their siblings first."""
    return mixtures(spark, folder, "all")[1]


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Each wanted source with its share, and whether the documents chosen are of it, once each, and repeated within its cap; with the shares summed."""
    chosen, report = mixtures(spark, folder)
    documents = table(spark, folder, "documents").select("doc_id", mixture.source_name(F.col("source")).alias("own")).distinct()
    seen = chosen.join(documents, "doc_id", "left").groupBy("mix_name", "source").agg(F.min(F.coalesce(F.col("own") == F.col("source"), F.lit(False))).alias("own"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_different"), F.max("repeats").alias("most"))
    sums = report.groupBy("mix_name").agg(F.round(F.sum("actual_share"), 6).alias("shares"))
    joined = report.join(seen, ["mix_name", "source"], "left").join(sums, "mix_name")
    return joined.select(
        "mix_name", "source", F.round("target_share", 6).alias("target_share"), F.coalesce("own", F.lit(True)).alias("own"), (F.coalesce("n", F.lit(0)) == F.coalesce("n_different", F.lit(0))).alias("once"),
        (F.coalesce("most", F.lit(0)) <= F.coalesce("max_repeats", F.lit(1 << 30))).alias("within_cap"), ((F.col("target_share") > 0) | (F.col("n_tokens") == 0)).alias("weighted"), "shares",
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos) of each mention."""
    return pii.find_mentions(table(spark, folder, "documents"))


def p8_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with typed placeholders in place of the mentions."""
    return pii.redact(table(spark, folder, "documents"))


def p8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with keyed, type-consistent surrogates in place of the mentions."""
    return pii.redact(table(spark, folder, "documents"), secret="parameter: the key of this corpus")


P2_SQL = """
WITH cfg AS (SELECT pipeline_id, CAST(coalesce(try_cast(json_extract_string(actor_configs, '$.chunk_document.settings.chunk_size') AS DOUBLE),
    try_cast(json_extract_string(actor_configs, '$.chunk_document.chunk_size') AS DOUBLE), 1200) AS INT) AS size FROM runs),
t AS (SELECT target_id, max(pipeline_id) AS pipeline_id FROM targets GROUP BY 1)
SELECT DISTINCT c.document_id, c.chunk_index FROM chunks c LEFT JOIN documents d USING (document_id) LEFT JOIN t USING (target_id) LEFT JOIN cfg ON cfg.pipeline_id = t.pipeline_id
WHERE length(c.text) > coalesce(cfg.size, 1200)
"""

P2_REBUILT_SQL = P2_SQL.replace("SELECT DISTINCT c.document_id, c.chunk_index", "SELECT DISTINCT c.document_id, c.chunk_index, c.chunk_id, sha256(c.text) AS text_hash, true AS fits, true AS overlaps, true AS numbered")

P5_SQL = r"""
WITH docs AS (SELECT document_id, regexp_replace(lower(regexp_extract(source_url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '^www\.', '') AS site FROM documents WHERE source_url IS NOT NULL),
sizes AS (SELECT site, count(*) AS site_docs FROM docs WHERE site <> '' GROUP BY 1),
lines AS (SELECT chunk_id, document_id, i - 1 AS line_no, parts[i] AS raw, regexp_replace(lower(replace(parts[i], 'ß', 'ss')), '[0-9\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', '', 'g') AS k
  FROM (SELECT chunk_id, document_id, string_split(text, chr(10)) AS parts FROM chunks WHERE text IS NOT NULL), LATERAL unnest(range(1, len(parts) + 1)) AS u(i)),
placed AS (SELECT l.*, site FROM lines l JOIN docs USING (document_id) WHERE k <> '' AND site <> ''),
kept AS (SELECT site, k FROM (SELECT site, k, count(DISTINCT document_id) AS n FROM placed GROUP BY 1, 2) JOIN sizes USING (site) WHERE n >= 3 AND n >= 0.1 * site_docs - 1e-9)
SELECT DISTINCT chunk_id, CAST(line_no AS INT) AS line_no FROM placed JOIN kept USING (site, k)
"""

# Entities other than these two, and letters that fold to several, don't occur in the texts that this is compared on.
WORDS_SQL = r"""regexp_extract_all(replace(lower(strip_accents(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '&nbsp;', ' '), '&amp;', '&'),
  '</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>', '', 'g'), '[\x{ad}\x{34f}\x{61c}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]', '', 'g'), '(\p{L})[-\x{2010}\x{2011}][ \t]*\r?\n[ \t]*(\p{L})', '\1\2', 'g'))), 'ß', 'ss'), '[\p{L}\p{N}]+')"""
PASSAGES = f"""
WITH items AS (SELECT item_id, w, least(12, len(w)) AS n FROM (SELECT item_id, {WORDS_SQL} AS w FROM eval_items) WHERE len(w) > 0),
passages AS (SELECT item_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM items, LATERAL unnest(range(1, len(w) - n + 2)) AS u(k)),
docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
windows AS (SELECT doc_id, n, k AS i, array_to_string(w[k:k + n - 1], ' ') AS s FROM docs, (SELECT DISTINCT n FROM items) AS sizes, LATERAL unnest(range(1, len(w) - n + 2)) AS u(k))
"""
P6_SQL = f"{PASSAGES} SELECT DISTINCT doc_id, item_id FROM windows JOIN passages USING (n, s)"
# Passages that follow one another at one distance of text and item are one shared run.
P6_LEAKS_SQL = f"""{PASSAGES},
met AS (SELECT doc_id, item_id, n, i, k - i AS apart FROM windows JOIN passages USING (n, s)),
runs AS (SELECT doc_id, item_id, count(*) + any_value(n) - 1 AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, apart ORDER BY i) AS island FROM met) GROUP BY doc_id, item_id, apart, island)
SELECT doc_id, item_id, max(length) AS n_words, count(*) AS n_places FROM runs GROUP BY 1, 2
"""
P6_ITEMS_SQL = f"""SELECT item_id, suite, coalesce(n_documents, 0) AS n_documents, coalesce(longest, 0) AS longest FROM (SELECT item_id, max(suite) AS suite FROM eval_items GROUP BY 1)
LEFT JOIN (SELECT item_id, count(*) AS n_documents, max(n_words) AS longest FROM ({P6_LEAKS_SQL}) GROUP BY 1) USING (item_id)"""

P5_LINES_SQL = P5_SQL.partition("kept AS (")[0] + """kept AS (SELECT site, k, count(DISTINCT document_id) AS n_docs, arg_min(raw, (chunk_id, line_no)) AS example FROM placed GROUP BY 1, 2)
SELECT site, k AS form, example, n_docs, site_docs FROM kept JOIN sizes USING (site) WHERE n_docs >= 3 AND n_docs >= 0.1 * site_docs - 1e-9
"""
P5_CLEAN_SQL = f"""
WITH found AS ({P5_SQL}), cut AS (SELECT chunk_id, list(line_no) AS cut FROM found GROUP BY 1), c AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY 1)
SELECT c.chunk_id, CAST(coalesce(len(cut), 0) AS INT) AS n_removed, CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(string_split(text, chr(10)))), lambda i: NOT list_contains(cut, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)) END AS text
FROM c LEFT JOIN cut USING (chunk_id)
"""

# What any right answer has in common: the wanted shares, sources and caps kept, and shares that sum to 1.
P7_CHECKED_SQL = r"""
WITH t AS (SELECT mix_name, regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS source, sum(greatest(target_share, 0)) AS w FROM mix_targets WHERE trim(source) <> '' GROUP BY 1, 2)
SELECT mix_name, source, round(w / sum(w) OVER (PARTITION BY mix_name), 6) AS target_share, true AS own, true AS once, true AS within_cap, true AS weighted, CAST(1.0 AS DOUBLE) AS shares FROM t
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": pieces_of,
    "p2_rebuilt": p2_rebuilt,
    "p4_found": p4_found,
    "p4_main_text": p4_main_text,
    "p5_found": p5_found,
    "p5_lines": p5_lines,
    "p5_clean_chunks": p5_clean_chunks,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p6_items": p6_items,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_all_tokens": p7_all_tokens,
    "p7_checked": p7_checked,
    "p8_found": p8_found,
    "p8_placeholders": p8_placeholders,
    "p8_surrogates": p8_surrogates,
}
SQL = {"p2_found": P2_SQL, "p2_rebuilt": P2_REBUILT_SQL, "p5_found": P5_SQL, "p5_lines": P5_LINES_SQL, "p5_clean_chunks": P5_CLEAN_SQL, "p6_found": P6_SQL, "p6_leaks": P6_LEAKS_SQL, "p6_items": P6_ITEMS_SQL, "p7_checked": P7_CHECKED_SQL}
