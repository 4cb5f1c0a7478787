"""Queries of the nested legal records (problem 1) and of the crawl trees (problem 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.io import table
from actloom.lineage import Workspace
from actloom.operators import flatten
from actloom.operators.hierarchy import descendants, hierarchy

FIELDS = ("sections", "amendments", "metadata")


def act_nodes(spark: SparkSession, folder: str) -> DataFrame:
    acts = flatten.latest(table(spark, folder, "legal_acts"), "act_id", "received_at", FIELDS)
    return flatten.to_nodes(acts, "act_id", FIELDS)


def act_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The flat tables of all groups, those known with their columns first."""
    return flatten.flat_tables(act_nodes(spark, folder), "act_id", dict((FLAT | MORE_FLAT).values()))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(act_id, node_path) of each JSON object in the latest version of each act: the rows of all flat tables."""
    return reduce(DataFrame.unionByName, [t.select("act_id", "node_path") for t in act_tables(spark, folder).values()])


def p1_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every object with its parent, group, ordinal, and the numbers of its children and of its plain fields."""
    rows = Workspace(spark, "nodes").write(act_nodes(spark, folder).select("rec", "node_path", "parent_path", "node_group", "ordinal", F.size("fields").alias("n_fields")), "rows")
    return rows.join(flatten.subtree_sizes(rows), ["rec", "node_path"], "left").select(
        F.col("rec").alias("act_id"), "node_path", "parent_path", "node_group", F.col("ordinal").cast("long").alias("ordinal"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_fields").cast("long").alias("n_fields"),
    )


def flat(group: str, columns: tuple[str, ...]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return act_tables(spark, folder)[group]

    query.__doc__ = f"The flat table of the group {group}, one row per object, linked to its parent and act; fields met besides the known ones come last."
    return query


def p1_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The flat tables of all groups met, whatever they are, as one long table: a row per object and field, and one with name NULL per object."""
    found = flatten.to_triples(act_nodes(spark, folder))
    return found.select(F.col("rec").alias("act_id"), "node_group", "node_path", "parent_path", "ordinal", "name", "value")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The groups and fields met, from which the flat tables are made."""
    return flatten.columns_of(act_nodes(spark, folder))


def target_parents(spark: SparkSession, folder: str) -> DataFrame:
    """(target_id, depth, parent_id): targets with the target their parent document or chunk came from.

    States of one target are reduced first (their parents and depth agree).
    Keys that are NULL are replaced by ones of their own before each join, so
    the many targets without a parent don't meet in one task.
    """
    targets = table(spark, folder, "targets").where("target_id is not null")
    targets = targets.groupBy("target_id").agg(F.max("depth").alias("depth"), F.max("parent_document_id").alias("pd"), F.max("parent_chunk_id").alias("pc"))
    chunks = table(spark, folder, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("document_id").alias("chunk_document"))
    documents = table(spark, folder, "documents").where("document_id is not null").groupBy("document_id").agg(F.max("target_id").alias("parent_id"))
    own = lambda c: F.coalesce(c, F.concat(F.lit("\0"), F.col("target_id")))
    by_chunk = targets.withColumn("chunk_id", own(F.when(F.col("pd").isNull(), F.col("pc")))).join(chunks, "chunk_id", "left")
    by_document = by_chunk.withColumn("document_id", own(F.coalesce("pd", "chunk_document"))).join(documents, "document_id", "left")
    return by_document.select("target_id", "depth", "parent_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(target_id, root_id) of targets whose parents never reach a root, or whose depth is not their number of steps."""
    edges = target_parents(spark, folder)
    found = hierarchy(edges, "target_id", "parent_id").withColumnRenamed("depth", "steps")
    stated = edges.where("depth is not null").select("target_id", F.col("depth").alias("stated"))
    both = found.join(stated, "target_id", "left")
    return both.where(~F.col("has_root") | (F.col("stated") != F.col("steps"))).select("target_id", "root_id")


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Each target's root, true depth, path from the root, number of descendants, and whether it is on a loop."""
    found = hierarchy(target_parents(spark, folder), "target_id", "parent_id", paths=True)
    return found.select("target_id", "root_id", "depth", F.concat_ws("/", "path").alias("path"), F.col("n_descendants"), "on_loop", "has_root").withColumn(
        "path", F.when(F.col("has_root"), F.col("path"))
    )


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """(ancestor_id, target_id, steps): every target under every ancestor; targets of one loop are each other's descendants.

    `steps` is the number of parents from the target to the ancestor: below a
    loop that to its entry and on along the loop, each ancestor once.
    """
    edges = target_parents(spark, folder)
    return descendants(edges, "target_id", "parent_id")


P1_SQL = """
WITH RECURSIVE best AS (
  SELECT act_id, sections, amendments, metadata FROM (
    SELECT *, row_number() OVER (PARTITION BY act_id ORDER BY received_at DESC NULLS LAST, sections DESC NULLS LAST, amendments DESC NULLS LAST, metadata DESC NULLS LAST) AS rn FROM legal_acts)
  WHERE rn = 1),
opened AS (
  SELECT act_id, f AS path, try_cast(v AS JSON) AS j FROM (
    SELECT act_id, 'sections' AS f, sections AS v FROM best UNION ALL SELECT act_id, 'amendments', amendments FROM best UNION ALL SELECT act_id, 'metadata', metadata FROM best)
  WHERE v IS NOT NULL AND json_valid(v)),
walk(act_id, path, j, obj) AS (
  SELECT act_id, path, j, false FROM opened
  UNION ALL
  SELECT w.act_id, n.path, n.j, n.obj FROM walk w, LATERAL (
    -- a string holding JSON
    SELECT w.path AS path, try_cast(json_extract_string(w.j, '$') AS JSON) AS j, w.obj AS obj
    WHERE json_type(w.j) = 'VARCHAR' AND json_valid(json_extract_string(w.j, '$')) AND json_type(try_cast(json_extract_string(w.j, '$') AS JSON)) IN ('ARRAY', 'OBJECT')
    UNION ALL
    -- elements of a list
    SELECT w.path || '/' || (i - 1)::VARCHAR, json_extract(w.j, '$[' || (i - 1)::VARCHAR || ']'), true
    FROM unnest(range(1, CASE WHEN json_type(w.j) = 'ARRAY' THEN json_array_length(w.j)::BIGINT + 1 ELSE 1 END)) AS u(i)
    UNION ALL
    -- a lone object
    SELECT w.path || '/0', w.j, true WHERE json_type(w.j) = 'OBJECT' AND NOT w.obj
    UNION ALL
    -- keys of an object
    SELECT w.path || '/' || k, json_extract(w.j, '$."' || k || '"'), false
    FROM unnest(CASE WHEN json_type(w.j) = 'OBJECT' AND w.obj THEN json_keys(w.j) ELSE [] END) AS u(k)
  ) n)
SELECT DISTINCT act_id, path AS node_path FROM walk WHERE obj AND json_type(j) = 'OBJECT'
"""


def flat_sql(group: str, columns: tuple[str, ...]) -> str:
    """The flat table of a group, from the walk: plain fields as text, lists of plain values as compact JSON, none for objects and lists of them."""
    path = "^" + r"/\d+/".join(group.split("/")) + r"/\d+$"
    top = "/" not in group
    one = "CASE json_type(j, '$.\"@\"') WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN CASE WHEN contains(CAST(json_extract(j, '$.\"@\"') AS VARCHAR), '{') THEN NULL ELSE CAST(json_extract(j, '$.\"@\"') AS VARCHAR) END ELSE json_extract_string(j, '$.\"@\"') END AS \"@\""
    picked = ", ".join(one.replace("@", c) for c in columns)
    parent = "CAST(NULL AS VARCHAR)" if top else r"regexp_replace(path, '/[^/]+/\d+$', '')"
    head = P1_SQL.rpartition("SELECT DISTINCT act_id")[0]
    return rf"{head} SELECT DISTINCT act_id, path AS node_path, {parent} AS parent_path, CAST(regexp_extract(path, '(\d+)$', 1) AS INT) AS ordinal, {picked} FROM walk WHERE obj AND json_type(j) = 'OBJECT' AND regexp_matches(path, '{path}')"


WALK = P1_SQL.rpartition("SELECT DISTINCT act_id")[0]
GROUP = r"regexp_replace(regexp_replace(path, '/\d+(/\d+)*/', '/', 'g'), '(/\d+)+$', '')"
# A key whose value is an object, or a list with one, also within a string, has objects of its own under it and is no plain field.
TRIPLES_SQL = rf"""{WALK},
o AS (SELECT DISTINCT act_id, path, CAST(j AS VARCHAR) AS j FROM walk WHERE obj AND json_type(j) = 'OBJECT'),
below AS (SELECT DISTINCT act_id, regexp_extract(path, '^(.*/\d+/[^/]+?)(/\d+)+$', 1) AS place FROM walk WHERE obj AND json_type(j) IN ('OBJECT', 'ARRAY')),
f AS (SELECT o.act_id, o.path, k, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(json_extract_string(v, '$')) AND json_type(try_cast(json_extract_string(v, '$') AS JSON)) = 'ARRAY' THEN CAST(json(json_extract_string(v, '$')) AS VARCHAR)
  WHEN json_type(v) = 'ARRAY' THEN CAST(v AS VARCHAR) ELSE json_extract_string(v, '$') END AS value
  FROM (SELECT act_id, path, k, json_extract(j, '$."' || k || '"') AS v FROM o, LATERAL unnest(json_keys(j)) AS u(k)) o LEFT JOIN below b ON b.act_id = o.act_id AND b.place = o.path || '/' || k WHERE b.place IS NULL AND json_type(v) <> 'OBJECT')"""
P1_TABLES_SQL = rf"""{TRIPLES_SQL} SELECT act_id, {GROUP} AS node_group, path AS node_path, CASE WHEN contains({GROUP}, '/') THEN regexp_extract(path, '^(.*/\d+)/[^/]+?(/\d+)+$', 1) END AS parent_path,
CAST(regexp_extract(path, '(\d+)$', 1) AS INT) AS ordinal, name, value FROM (SELECT act_id, path, NULL AS name, NULL AS value FROM o UNION ALL SELECT act_id, path, k, value FROM f)"""
P1_NODES_SQL = f"""WITH t AS ({P1_TABLES_SQL}), n AS (SELECT act_id, parent_path, count(*) AS n FROM t WHERE name IS NULL GROUP BY 1, 2)
SELECT t.act_id, node_path, t.parent_path, node_group, CAST(ordinal AS BIGINT) AS ordinal, coalesce(any_value(n.n), 0) AS n_children, count(name) AS n_fields FROM t LEFT JOIN n ON n.act_id = t.act_id AND n.parent_path = t.node_path GROUP BY 1, 2, 3, 4, 5"""
P1_GROUPS_SQL = f"SELECT node_group, name, count(*) AS n_nodes FROM ({P1_TABLES_SQL}) WHERE name IS NOT NULL GROUP BY 1, 2"

EDGES_SQL = """
t AS (SELECT target_id, max(depth) AS depth, max(parent_document_id) AS pd, max(parent_chunk_id) AS pc FROM targets WHERE target_id IS NOT NULL GROUP BY 1),
c AS (SELECT chunk_id, max(document_id) AS cd FROM chunks GROUP BY 1),
d AS (SELECT document_id, max(target_id) AS parent_id FROM documents GROUP BY 1),
e AS (SELECT t.target_id, t.depth, CASE WHEN p.target_id IS NULL THEN NULL ELSE d.parent_id END AS parent_id
  FROM t LEFT JOIN c ON t.pd IS NULL AND c.chunk_id = t.pc LEFT JOIN d ON d.document_id = coalesce(t.pd, c.cd) LEFT JOIN t p ON p.target_id = d.parent_id)"""

ANCESTORS_SQL = f"""
WITH RECURSIVE {EDGES_SQL},
down(target_id, root_id, depth, path) AS (SELECT target_id, target_id, CAST(0 AS BIGINT), target_id FROM e WHERE parent_id IS NULL
  UNION ALL SELECT e.target_id, down.root_id, down.depth + 1, down.path || '/' || e.target_id FROM e JOIN down ON e.parent_id = down.target_id),
anc(target_id, a) AS (SELECT target_id, parent_id FROM e WHERE parent_id IS NOT NULL UNION SELECT anc.target_id, e.parent_id FROM anc JOIN e ON e.target_id = anc.a WHERE e.parent_id IS NOT NULL)
"""
P3_HIERARCHY_SQL = f"""{ANCESTORS_SQL},
onloop AS (SELECT target_id FROM anc WHERE target_id = a), n AS (SELECT a, count(*) AS n FROM anc WHERE target_id <> a GROUP BY 1),
entered AS (SELECT target_id, min(a) AS root_id FROM anc WHERE a IN (SELECT target_id FROM onloop) GROUP BY 1)
SELECT e.target_id, coalesce(down.root_id, entered.root_id) AS root_id, down.depth, down.path, CASE WHEN l.target_id IS NULL THEN coalesce(n.n, 0) END AS n_descendants, l.target_id IS NOT NULL AS on_loop, down.root_id IS NOT NULL AS has_root
FROM e LEFT JOIN down USING (target_id) LEFT JOIN entered USING (target_id) LEFT JOIN onloop l USING (target_id) LEFT JOIN n ON n.a = e.target_id
"""
LOOPS = """onloop AS (SELECT target_id FROM anc WHERE target_id = a), entered AS (SELECT target_id, min(a) AS root_id FROM anc WHERE a IN (SELECT target_id FROM onloop) GROUP BY 1)"""
P3_SQL = f"""{ANCESTORS_SQL}, {LOOPS}
SELECT e.target_id, down.root_id FROM e JOIN down USING (target_id) WHERE e.depth IS NOT NULL AND e.depth <> down.depth
UNION ALL SELECT target_id, root_id FROM entered WHERE target_id NOT IN (SELECT target_id FROM down)
"""
# Without a root, a target's ancestors are walked until one comes again.
P3_DESCENDANTS_SQL = f"""{ANCESTORS_SQL},
up(target_id, a, steps, seen) AS (SELECT target_id, parent_id, CAST(1 AS BIGINT), [target_id] FROM e WHERE target_id NOT IN (SELECT target_id FROM down)
  UNION ALL SELECT up.target_id, e.parent_id, steps + 1, list_append(seen, a) FROM up JOIN e ON e.target_id = up.a WHERE NOT list_contains(seen, a))
SELECT a AS ancestor_id, anc.target_id, d.depth - u.depth AS steps FROM anc JOIN down d ON d.target_id = anc.target_id JOIN down u ON u.target_id = anc.a
UNION ALL SELECT a, target_id, min(steps) FROM up WHERE a <> target_id GROUP BY 1, 2"""


def pivot_sql(group: str, columns: tuple[str, ...]) -> str:
    """The flat table of a group, by a pivot of the long table."""
    picked = "".join(f""", max(value) FILTER (name = '{c}') AS "{c}\"""" for c in columns)
    return f"SELECT act_id, node_path, parent_path, ordinal{picked} FROM ({P1_TABLES_SQL}) WHERE node_group = '{group}' GROUP BY 1, 2, 3, 4"


FLAT = {
    "p1_sections": ("sections", ("number", "display", "title", "intro_text")),
    "p1_subsections": ("sections/subsections", ("index", "display", "text")),
    "p1_clauses": ("sections/subsections/clauses", ("number", "display", "text")),
    "p1_amendments": ("amendments", ("rt_part", "published", "article", "in_force")),
    "p1_metadata": ("metadata", ("publisher", "documentKind", "validFrom", "documentStatus", "keywords")),
}
#: Groups that only some acts have. Those of other data have their flat tables by `flatten.flat_tables`, and their rows in p1_tables.
MORE_FLAT = {
    "p1_paths": ("sections/path", ("chapter_number", "chapter_title", "part_number")),
    "p1_divisions": ("sections/path/division", ("number", "title")),
    "p1_clauses2": ("sections/subsections/clauses/clauses", ("number", "display", "text")),
    "p1_clauses3": ("sections/subsections/clauses/clauses/clauses", ("number", "display", "text")),
    "p1_notes": ("sections/subsections/clauses/notes", ("kind", "text")),
    "p1_notes2": ("sections/subsections/clauses/clauses/notes", ("kind", "text")),
    "p1_notes3": ("sections/subsections/clauses/clauses/clauses/notes", ("kind", "text")),
    "p1_contexts": ("amendments/context", ("chapter", "section")),
    "p1_publications": ("metadata/publications", ("part", "year")),
    "p1_publication_items": ("metadata/publications/items", ("article",)),
    "p1_valid_until": ("metadata/validUntil", ("date", "note")),
}
QUERIES = {
    "p1_found": p1_found,
    "p1_nodes": p1_nodes,
    "p1_groups": p1_groups,
    "p1_tables": p1_tables,
    **{name: flat(*own) for name, own in (FLAT | MORE_FLAT).items()},
    "p3_found": p3_found,
    "p3_hierarchy": p3_hierarchy,
    "p3_descendants": p3_descendants,
}
SQL = {"p1_found": P1_SQL, "p1_nodes": P1_NODES_SQL, "p1_tables": P1_TABLES_SQL, "p1_groups": P1_GROUPS_SQL, "p3_found": P3_SQL, "p3_hierarchy": P3_HIERARCHY_SQL, "p3_descendants": P3_DESCENDANTS_SQL} | {name: flat_sql(*own) for name, own in FLAT.items()} | {name: pivot_sql(*own) for name, own in MORE_FLAT.items()}
