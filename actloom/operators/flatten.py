"""Nested records as related flat tables.

A record is parsed as a stream: its tokens are read once, with an explicit
stack of the open objects and lists and no tree of the whole, into
path-value-ordinal triples. Paths are grouped by their repeated ancestor, the
object they stand in, as it is read, so that a group needs no shuffle: an
object is one row with its place, its parent and its plain fields. Objects
whose paths are equal without ordinals are a group, and each group is pivoted
into one flat table whose rows keep their path, the path of their parent and
the key of their record.

Defined cases: a lone object is a list of one; a NULL element keeps its ordinal
and gives no node; a string that holds a JSON array or object is that array or
object, also within itself; a list in a list takes one more ordinal level; an
empty object is a node without fields; text that is no JSON, plain values and
lists of plain values are no nodes, and the latter two stay as fields of their
node, numbers as they are written; of a repeated key all objects are nodes,
numbered on, and of its plain values the last is the field. NULL keys are
records of their own key NULL.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.lineage import Workspace

PLACE = ("rec", "node_path", "parent_path", "node_group", "ordinal", "depth")
NODES = "rec string, node_path string, parent_path string, node_group string, ordinal int, depth int, names array<string>, texts array<string>"
SPACE = re.compile(r"[ \t\n\r]*").match
PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity").match
#: Rows that leave the parser together.
BATCH = 20_000


class Node:
    """An object: the node above it, its place below that, and its plain fields. While open it takes members."""

    __slots__ = ("number", "above", "place", "name", "ordinal", "depth", "fields", "used")
    end = "}"

    def __init__(self, nodes: list, above: int, place: str, name: str, ordinal: int, depth: int):
        self.number, self.above, self.place, self.name, self.ordinal, self.depth = len(nodes), above, place, name, ordinal, depth
        self.fields: dict[str, str | None] = {}
        self.used: dict[str, int] = {}
        nodes.append(self)

    def open(self, nodes: list, mark: str, name: str):
        first = self.used.get(name, 0)
        if mark == "[":
            return Items(self.number, name, name, self.depth + 1, first, self)
        self.used[name] = first + 1
        return Node(nodes, self.number, f"{name}/{first}", name, first, self.depth + 1)

    def put(self, name: str, value: str | None, written: str) -> None:
        self.fields[name] = value

    def close(self) -> None:
        pass

    def state(self, name: str):
        return self.used.get(name)

    def restore(self, name: str, state) -> None:
        if state is None:
            self.used.pop(name, None)
        else:
            self.used[name] = state


class Items:
    """An open list: where its elements stand, the next ordinal, and its plain values while it has no other."""

    __slots__ = ("above", "place", "name", "depth", "next", "plain", "owner")
    end = "]"

    def __init__(self, above: int, place: str, name: str, depth: int, first: int, owner: Node | None):
        self.above, self.place, self.name, self.depth, self.next, self.owner = above, place, name, depth, first, owner
        self.plain: list[str] | None = []

    def open(self, nodes: list, mark: str, name: None):
        k, self.next, self.plain = self.next, self.next + 1, None
        if mark == "[":
            return Items(self.above, f"{self.place}/{k}", self.name, self.depth + 1, 0, None)
        return Node(nodes, self.above, f"{self.place}/{k}", self.name, k, self.depth)

    def put(self, name: None, value: str | None, written: str) -> None:
        self.next += 1
        if self.plain is not None:
            self.plain.append(written)

    def close(self) -> None:
        if self.owner is not None:
            if self.plain is None:
                self.owner.used[self.name] = self.next
            else:
                self.owner.fields[self.name] = f"[{','.join(self.plain)}]"

    def state(self, name: None):
        return self.next, self.plain

    def restore(self, name: None, state) -> None:
        self.next, self.plain = state


class Root:
    """What a whole field is put in."""

    def __init__(self, field: str):
        self.field = field

    def open(self, nodes: list, mark: str, name: None):
        return Items(-1, self.field, self.field, 1, 0, None) if mark == "[" else Node(nodes, -1, f"{self.field}/0", self.field, 0, 1)


def read(text: str, nodes: list[Node], into, name: str | None) -> None:
    """Put the array or object that a text is into an open container; ValueError where the text is none."""
    at = SPACE(text, 0).end()
    if text[at : at + 1] not in ("[", "{"):
        raise ValueError("no array or object")
    stack = [into.open(nodes, text[at], name)]
    at += 1
    fresh = True  # nothing of the innermost container was read yet
    while stack:
        here = stack[-1]
        at = SPACE(text, at).end()
        c = text[at : at + 1]
        if c == here.end:
            at += 1
            stack.pop().close()
            fresh = False
            continue
        if not fresh:
            if c != ",":
                raise ValueError(f"no comma at {at}")
            at = SPACE(text, at + 1).end()
            c = text[at : at + 1]
        key = None
        if here.end == "}":
            if c != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1, True)
            at = SPACE(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = SPACE(text, at + 1).end()
            c = text[at : at + 1]
        fresh = c in ("[", "{")
        if fresh:
            stack.append(here.open(nodes, c, key))
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            if not opened(value, nodes, here, key):
                here.put(key, value, json.dumps(value, ensure_ascii=False) if key is None else "")
        else:
            m = PLAIN(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            at = m.end()
            here.put(key, None if m[0] == "null" else m[0], m[0])
    if SPACE(text, at).end() != len(text):
        raise ValueError(f"more text at {at}")


def opened(value: str, nodes: list[Node], into, name: str | None) -> bool:
    """Whether a string holds an array or object, which is then read in its place; each level within a string doubles its escapes, so levels are few."""
    text = value.strip()
    if text[:1] not in ("[", "{") or text[-1:] not in ("]", "}"):
        return False
    before, state = len(nodes), into.state(name)
    try:
        read(text, nodes, into, name)
    except ValueError:
        del nodes[before:]
        into.restore(name, state)
        return False
    return True


def objects(field: str, source: str | None) -> Iterator[tuple]:
    """(node path, parent path, group, ordinal, depth, fields) of each object of a field's JSON, parents first.

    Nodes wait without their paths until the text has proved to be JSON; a path
    is forgotten with the last child that needs it.
    """
    nodes: list[Node] = []
    text = (source or "").strip()
    try:
        if text[:1] == '"':  # the whole field is a string of JSON
            inner, at = scanstring(text, 1, True)
            text = inner.strip() if at == len(text) else ""
        read(text, nodes, Root(field), None)
    except ValueError:
        return
    children = Counter(n.above for n in nodes)
    paths: dict[int, tuple[str, str]] = {}
    for n in nodes:
        over, group = paths.get(n.above, (None, ""))
        path = n.place if over is None else f"{over}/{n.place}"
        group = n.name if over is None else f"{group}/{n.name}"
        if n.number in children:
            paths[n.number] = path, group
        children[n.above] -= 1
        if not children[n.above]:
            paths.pop(n.above, None)
        yield path, over, group, n.ordinal, n.depth, n.fields


def triples(field: str, source: str | None) -> Iterator[tuple]:
    """(node path, parent path, group, ordinal, depth, name, value): one with name NULL for each object, and one for each plain field."""
    for *place, fields in objects(field, source):
        yield *place, None, None
        for name, value in fields.items():
            yield *place, name, value


def to_nodes(records: DataFrame, key: str, fields: Iterable[str]) -> DataFrame:
    """One row per object of the JSON fields of records: its place and its plain fields as a map (NULL values kept); one narrow pass."""
    fields = list(fields)
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for record in pdf.itertuples(index=False):
                for k, field in enumerate(fields):
                    for *place, own in objects(field, record[k + 1]):
                        rows.append((record[0], *place, list(own), list(own.values())))
                        if len(rows) == BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
        yield pd.DataFrame(rows, columns=names)

    source = records.select(F.col(key).cast("string").alias("rec"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    return source.mapInPandas(run, NODES).select(*PLACE, F.map_from_arrays("names", "texts").alias("fields"))


def to_triples(nodes: DataFrame) -> DataFrame:
    """(rec, node path, parent path, group, ordinal, depth, name, value): the triples of all groups as one long table; name NULL marks the object itself."""
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    return nodes.select(*PLACE, F.explode(F.concat(none, F.map_entries("fields"))).alias("x")).select(*PLACE, F.col("x.key").alias("name"), F.col("x.value").alias("value"))


def latest(records: DataFrame, key: str, by: str, columns: Iterable[str]) -> DataFrame:
    """Per key the row with the latest `by`, ties by the columns' content; a NULL `by` comes last.

    An aggregate, not a window: versions of a hot key are reduced before the shuffle.
    """
    columns = list(columns)
    best = F.max(F.struct(F.col(by), *[F.col(c) for c in columns])).alias("best")
    return records.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in columns])


def flat_table(nodes: DataFrame, group: str, columns: Iterable[str], key: str = "rec") -> DataFrame:
    """The table of one group: (key, node_path, parent_path, ordinal, one column per wanted field).

    Columns are given, or come from :func:`all_columns`; a field that an object
    lacks is NULL. Names that clash with the link columns get `_value` at their end.
    """
    place = {"rec", "node_path", "parent_path", "ordinal", key}
    picked = [F.col("fields")[c].alias(f"{c}_value" if c in place else c) for c in columns]
    return nodes.where(F.col("node_group") == group).select(F.col("rec").alias(key), "node_path", "parent_path", "ordinal", *picked)


def columns_of(nodes: DataFrame) -> DataFrame:
    """(node_group, name, n_nodes): the fields met in each group, for the wanted columns of its table."""
    return nodes.select("node_group", F.explode(F.map_keys("fields")).alias("name")).groupBy("node_group", "name").agg(F.count("*").alias("n_nodes"))


def all_columns(nodes: DataFrame, known: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, ...]]:
    """The columns of each group met: those known first, then all others that hold a value, by name.

    A name whose objects are a group of their own gives a column only if it
    also holds plain text somewhere; NULL, nothing and an empty list are then
    missing children. The driver holds names only.
    """
    each = nodes.select("node_group", F.explode_outer("fields").alias("name", "value"))
    held = each.groupBy("node_group", "name").agg(F.count("value").alias("n"), F.count(F.when(~F.col("value").isin("", "[]"), 1)).alias("n_text"))
    rows = sorted(held.collect(), key=lambda r: (r["node_group"], r["name"] or ""))
    out = dict(known or {})
    for r in rows:
        out.setdefault(r["node_group"], ())
    for r in rows:
        group, name = r["node_group"], r["name"]
        if name is not None and name not in out[group] and r["n_text" if f"{group}/{name}" in out else "n"]:
            out[group] = (*out[group], name)
    return out


def flat_tables(nodes: DataFrame, key: str = "rec", known: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """One flat table for each group met or known, with all its columns.

    The objects are written once, apart by group, so that each table reads its
    own group only; what the driver goes through are the groups.
    """
    kept = Workspace(nodes.sparkSession, "flat").write(nodes, "nodes", partition_by="node_group")
    return {group: flat_table(kept, group, columns, key) for group, columns in all_columns(kept, known).items()}


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(rec, node_path, n_children): direct children of each node, from the parent links."""
    return nodes.where(F.col("parent_path").isNotNull()).groupBy("rec", F.col("parent_path").alias("node_path")).agg(F.count("*").alias("n_children"))
