"""Parent-child rows to full hierarchies, by tree contraction.

Each round rakes all leaves into their parents and splices an independent set
of unary nodes out of their chains (a node goes if its salted hash is less than
its parent's and its only child's). Each round is one job of two aggregations by node id:
messages to a parent are combined before the shuffle, so a parent of a third of
all nodes is no hot task. What is removed is recorded; when only roots are left,
and loops shrunk to one node that is its own parent, the records are reversed
from the last round to the first and give each node its root, depth, path,
number of descendants and whether it stands on a loop. Rounds grow with the
logarithm of the nodes; the tables of the rounds shrink geometrically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.lineage import Workspace

STATE = ("parent", "w", "least", "inner", "below", "between")
STATE_TYPE = "struct<parent:string,w:bigint,least:string,inner:array<string>,below:bigint,between:bigint>"
NODE = ("id", *STATE, "kids", "kid")


def hierarchy(edges: DataFrame, node: str, parent: str, paths: bool = False, max_rounds: int = 200) -> DataFrame:
    """(node, root_id, depth, n_descendants, on_loop, has_root[, path]) of each node.

    `edges` has one row per node with its parent, NULL for a root. Repeated
    rows are reduced to one (the largest parent of those given); rows with a
    NULL node are left out; a parent that is no node of the table makes its
    child a root. A node whose chain of parents runs into a loop has no root:
    its root_id is the smallest node of that loop, depth and path are NULL; on
    a loop, whose nodes are each other's descendants, n_descendants is NULL. With
    `paths`, path is the array of nodes from the root to the node itself.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "hierarchy")
    rows = edges.select(F.col(node).cast("string").alias("id"), F.col(parent).cast("string").alias("parent")).where("id is not null")
    alive = work.write(first_messages(rows.groupBy("id").agg(F.max("parent").alias("parent"))), "alive")
    records: list[list[tuple[bool, DataFrame]]] = []
    done: list[DataFrame] = []
    for k in range(max_rounds):
        kept, leaves = rake(alive)
        # Raking and splicing go in one job, which writes what each of them leaves.
        after = work.write(splice(kept, k, paths).unionByName(leaves), f"round{k}", partition_by="part")
        work.drop("alive" if k == 0 else f"round{k - 1}/part=kept")
        records.append([(cut, after.where(f"part = '{part}'")) for part, cut in (("cut", True), ("leaf", False)) if work.has(f"round{k}/part={part}")])
        done.append(after.where("part = 'end'"))
        alive = after.where("part = 'kept'").drop("part")
        if not work.has(f"round{k}/part=kept"):
            break
    else:
        raise RuntimeError(f"a hierarchy was not contracted in {max_rounds} rounds")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    loop = F.col("parent").isNotNull()
    resolved = out.select(
        "id",
        F.when(loop, F.least("id", F.coalesce("least", "id"))).otherwise(F.col("id")).alias("root_id"),
        F.when(~loop, F.lit(0).cast("long")).alias("depth"),
        F.col("below").alias("n_descendants"),
        loop.alias("on_loop"),
        (~loop).alias("has_root"),
        *([F.when(~loop, F.array("id")).alias("path")] if paths else []),
    )
    for k, removed in enumerate(reversed(records)):
        for cut, rows in removed:
            resolved = expand(rows, resolved, cut, paths)
        resolved = work.write(resolved, f"resolved{k}")
        if k:
            work.drop(f"resolved{k - 1}")
    # Only the last table is read from here on.
    for k in range(len(done)):
        work.drop(f"round{k}")
    counted = resolved.withColumn("n_descendants", F.when(~F.col("on_loop"), F.col("n_descendants")))
    return counted.withColumnRenamed("id", node)


def first_messages(rows: DataFrame) -> DataFrame:
    """The nodes at the start: each with its children's number and, where there is one child only, that child."""
    own = rows.select("id", F.struct(F.coalesce(F.col("parent"), F.lit("")).alias("p")).alias("own"), F.lit(None).cast("string").alias("kid"))
    told = rows.where("parent is not null").select(F.col("parent").alias("id"), F.lit(None).cast("struct<p:string>").alias("own"), F.col("id").alias("kid"))
    grouped = own.unionByName(told).groupBy("id").agg(F.max("own").alias("own"), F.count("kid").alias("kids"), F.min("kid").alias("kid"))
    known = grouped.where("own is not null").select("id", F.nullif(F.col("own.p"), F.lit("")).alias("parent"), "kids", "kid")
    # A parent that is no node: found as a group without a row of its own.
    missing = grouped.where("own is null").select(F.col("id").alias("parent"), F.lit(True).alias("gone"))
    salted = known.withColumn("at", F.coalesce("parent", F.concat(F.lit("\0"), F.col("id"))))
    joined = salted.join(missing.withColumnRenamed("parent", "at"), "at", "left")
    return joined.select(
        "id",
        F.when(F.col("gone").isNull(), F.col("parent")).alias("parent"),
        F.lit(1).cast("long").alias("w"),
        F.lit(None).cast("string").alias("least"),
        F.array().cast("array<string>").alias("inner"),
        F.lit(0).cast("long").alias("below"),
        F.lit(0).cast("long").alias("between"),
        "kids",
        "kid",
    )


def rake(alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The others with what the leaves gave them and their children counted anew, and the leaves as records ('leaf').

    One aggregation by id: each node that stays sends itself its state, and
    each node sends its parent either its size (a leaf) or its name.
    """
    leaf = (F.col("kids") == 0) & F.col("parent").isNotNull()
    own = alive.where(~leaf).select("id", F.struct(*STATE).alias("own"), F.lit(0).cast("long").alias("gain"), F.lit(None).cast("string").alias("kid"))
    told = alive.where(F.col("parent").isNotNull()).select(
        F.col("parent").alias("id"),
        F.lit(None).cast(STATE_TYPE).alias("own"),
        F.when(leaf, F.col("below") + F.col("between") + 1).otherwise(F.lit(0).cast("long")).alias("gain"),
        F.when(~leaf, F.col("id")).alias("kid"),
    )
    grouped = own.unionByName(told).groupBy("id").agg(F.max("own").alias("own"), F.sum("gain").alias("gain"), F.count("kid").alias("kids"), F.min("kid").alias("kid"))
    kept = grouped.select(
        "id", "own.parent", "own.w", "own.least", "own.inner", (F.col("own.below") + F.col("gain")).alias("below"), "own.between", "kids", "kid"
    )
    return kept, alive.where(leaf).select(*NODE, F.lit("leaf").alias("part"))


def rank(column: str, salt: int):
    return F.struct(F.xxhash64(F.col(column), F.lit(salt)), F.col(column))


def splice(kept: DataFrame, salt: int, paths: bool) -> DataFrame:
    """Unary nodes taken out of their chains ('cut'), finished nodes ('end') and the rest ('kept').

    One aggregation by id: a node that goes sends its only child its own
    state; the child writes the record of the node and takes over its way up.
    """
    loop = F.coalesce(F.col("parent") == F.col("id"), F.lit(False))
    end = (F.col("parent").isNull() & (F.col("kids") == 0)) | (loop & (F.col("kids") == 1))
    goes = F.col("parent").isNotNull() & ~loop & (F.col("kids") == 1) & (rank("id", salt) < rank("parent", salt)) & (rank("id", salt) < rank("kid", salt))
    marked = kept.select(*NODE).withColumn("part", F.when(end, "end").when(F.coalesce(goes, F.lit(False)), "cut").otherwise("kept"))
    sends = F.col("part") == "cut"
    messages = marked.select(
        F.when(sends, F.col("kid")).otherwise(F.col("id")).alias("id"),
        F.when(~sends, F.struct(*STATE, "kids", "kid", "part")).alias("own"),
        F.when(sends, F.struct(F.col("id").alias("was"), *STATE)).alias("via"),
    )
    grouped = messages.groupBy("id").agg(F.max("own").alias("own"), F.max("via").alias("via"))
    moved = F.col("via").isNotNull()
    at = lambda yes, no: F.when(moved, yes).otherwise(no)
    via_inner = F.concat("via.inner", F.array("via.was")) if paths else F.col("via.inner")
    rest = F.struct(
        F.col("id"),
        at(F.col("via.parent"), F.col("own.parent")).alias("parent"),
        at(F.col("via.w") + F.col("own.w"), F.col("own.w")).alias("w"),
        at(F.least("via.was", "via.least", "own.least"), F.col("own.least")).alias("least"),
        at(F.concat(via_inner, "own.inner"), F.col("own.inner")).alias("inner"),
        F.col("own.below").alias("below"),
        at(F.col("own.between") + 1 + F.col("via.below") + F.col("via.between"), F.col("own.between")).alias("between"),
        F.col("own.kids").alias("kids"),
        F.col("own.kid").alias("kid"),
        F.col("own.part").alias("part"),
    )
    record = F.struct(
        F.col("via.was").alias("id"),
        F.col("via.parent").alias("parent"),
        F.col("via.w").alias("w"),
        F.col("via.least").alias("least"),
        F.col("via.inner").alias("inner"),
        (F.col("via.below") + 1 + F.col("own.between")).alias("below"),
        F.col("via.between").alias("between"),
        F.lit(1).cast("long").alias("kids"),
        F.col("id").alias("kid"),
        F.lit("cut").alias("part"),
    )
    return grouped.select(F.explode(F.when(moved, F.array(rest, record)).otherwise(F.array(rest))).alias("x")).select("x.*")


def expand(removed: DataFrame, resolved: DataFrame, cut: bool, paths: bool) -> DataFrame:
    """The nodes resolved so far, and those of one record from their parents (and, of a splice, from their child)."""
    up = resolved.select(F.col("id").alias("parent"), "root_id", F.col("depth").alias("up"), "has_root", *([F.col("path").alias("up_path")] if paths else []))
    found = removed.join(up, "parent")
    if cut:
        found = found.join(resolved.select(F.col("id").alias("kid"), F.col("n_descendants").alias("down"), "on_loop"), "kid")
    return resolved.unionByName(
        found.select(
            "id",
            "root_id",
            (F.col("up") + F.col("w")).alias("depth"),
            (F.col("below") + F.col("down") if cut else F.col("below")).alias("n_descendants"),
            (F.col("on_loop") if cut else F.lit(False)).alias("on_loop"),
            "has_root",
            *([F.when(F.col("has_root"), F.concat("up_path", "inner", F.array("id"))).alias("path")] if paths else []),
        )
    )


def descendants(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """(ancestor_id, node, steps): each node under each of its ancestors, once; nodes of one loop are each other's.

    Pairs under a root come from the paths. What is left hangs on loops: each
    loop is cut above its smallest node, which makes it the top of a chain and
    gives paths again; the loop's nodes that a path lacks are reached over the cut.
    """
    work = Workspace(edges.sparkSession, "descendants")
    rows = edges.select(F.col(node).cast("string").alias("id"), F.col(parent).cast("string").alias("parent")).where("id is not null")
    rows = work.write(rows.groupBy("id").agg(F.max("parent").alias("parent")), "edges")
    found = hierarchy(rows, "id", "parent", paths=True)
    lost = work.write(found.where("not has_root").select("id", F.col("root_id").alias("loop"), "on_loop"), "lost")
    cut = lost.join(rows, "id").select("id", F.when(F.col("id") != F.col("loop"), F.col("parent")).alias("parent"))
    placed = work.write(hierarchy(cut, "id", "parent", paths=True).select("id", "depth", "path").join(lost, "id"), "placed")
    members = placed.where("on_loop").select("loop", F.col("id").alias("ancestor_id"), F.col("depth").alias("at"))
    lengths = members.groupBy("loop").agg(F.count("*").alias("length"))
    over = placed.join(members.join(lengths, "loop"), "loop").where("not array_contains(path, ancestor_id)")
    within = found.where("has_root").select("id", "depth", "path").unionByName(placed.select("id", "depth", "path"))
    up = within.select("id", "depth", F.posexplode("path").alias("at", "ancestor_id")).where("ancestor_id <> id")
    pairs = up.select("ancestor_id", "id", (F.col("depth") - F.col("at")).alias("steps"))
    return pairs.unionByName(over.select("ancestor_id", "id", (F.col("depth") + F.col("length") - F.col("at")).alias("steps"))).withColumnRenamed("id", node)
