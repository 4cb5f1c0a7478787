"""Mixtures of sources at target shares of tokens, by hierarchical budgeting.

Weights of the sources are propagated up a tree of domain, language and source
(a source's weight is parted over its languages by their tokens); a node that
cannot use its budget gives the rest to its siblings before its ancestors; and
each leaf takes whole epochs of its documents and, of one more epoch in a
seeded order, a prefix of tokens. Sizes are tokens of a public tokenizer.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.lineage import Workspace
from actloom.operators.running import bucket_bits, running_total

def source_name(source: Column) -> Column:
    """A source without differences of case, blanks and separator; NULL for none."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_"), F.lit(""))


def language_code(lang: Column) -> Column:
    """A language code of two or three letters in lower case, else `und`."""
    low = F.lower(F.trim(lang))
    return F.when(low.rlike("^[a-z]{2,3}$"), low).otherwise(F.lit("und"))


def counter(vocabulary: str):
    """A function that counts the tokens of a text under a rank file of the public tokenizers."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str | None) -> int:
        return len(encoding.encode_ordinary(text)) if text else 0

    return count


def sized(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of each document of a source that has a token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for pdf in batches:
            pdf["n_tokens"] = [count(t) for t in pdf.pop("text")]
            yield pdf

    own = documents.select("doc_id", source_name(F.col("source")).alias("source"), language_code(F.col("lang")).alias("lang"), "text").where("source is not null and length(text) > 0")
    return own.mapInPandas(run, "doc_id long, source string, lang string, n_tokens long").where("n_tokens > 0")


@dataclass
class Node:
    """A node of the tree: its weight, what it can hold, what it was given."""

    name: tuple
    weight: float = 0.0
    capacity: float = 0.0
    children: list["Node"] = field(default_factory=list)
    given: float = 0.0


def fill(node: Node, amount: float) -> None:
    """Part an amount over the children by weight; what a full child cannot take goes to its siblings by theirs.

    As a node's capacity is what its children can hold together, an amount
    leaves a node for its siblings only when none of its own children can take it.
    """
    node.given = min(amount, node.capacity)
    left, open_ = node.given, [c for c in node.children if c.weight > 0 and c.capacity > 0]
    while open_ and left > 0:
        total = sum(c.weight for c in open_)
        full = [c for c in open_ if left * c.weight / total >= c.capacity]
        if not full:
            for c in open_:
                fill(c, left * c.weight / total)
            return
        for c in full:
            fill(c, c.capacity)
        left -= sum(c.capacity for c in full)
        open_ = [c for c in open_ if c not in full]


def budgets(sizes: Mapping[tuple[str, str], int], wanted: Mapping[str, tuple[float, int | None]], total: int, domains: Mapping[str, str] | None = None) -> dict[tuple[str, str], int]:
    """Tokens of each (source, lang) leaf: sizes by leaf, and the weight and cap on repeats by source; sources without a domain are of one domain "other"."""
    domains = domains or {}
    by_source: dict[str, int] = {}
    for (source, _), n in sizes.items():
        by_source[source] = by_source.get(source, 0) + n
    root = Node(())
    inner: dict[tuple, Node] = {}
    leaves: list[Node] = []
    for (source, lang), n in sorted(sizes.items()):
        weight, cap = wanted.get(source, (0.0, None))
        if not weight or weight < 0 or n <= 0 or cap is not None and cap <= 0:
            continue
        domain = domains.get(source, "other")
        leaf = Node((source, lang), weight * n / by_source[source], float("inf") if cap is None else float(n * cap))
        above = root
        for name in ((domain,), (domain, lang)):
            if name not in inner:
                inner[name] = Node(name)
                above.children.append(inner[name])
            above = inner[name]
        above.children.append(leaf)
        leaves.append(leaf)
        for x in (root, inner[(domain,)], inner[(domain, lang)]):
            x.weight += leaf.weight
            x.capacity += leaf.capacity
    fill(root, float(total))
    return {x.name: int(x.given + 1e-6) for x in leaves}


def feasible(sizes: Mapping[tuple[str, str], int], wanted: Mapping[str, tuple[float, int | None]]) -> int:
    """The most tokens, up to all of its sources, with which a mixture meets every share within the caps.

    Sources without documents or with a cap of 0 or less meet none and are left out of the shares.
    """
    held: dict[str, int] = {}
    for (source, _), n in sizes.items():
        weight, cap = wanted.get(source, (0.0, None))
        if weight and weight > 0 and n > 0 and (cap is None or cap > 0):
            held[source] = held.get(source, 0) + n
    weights = sum(wanted[s][0] for s in held)
    return int(min([sum(held.values()), *(n * wanted[s][1] * weights / wanted[s][0] for s, n in held.items() if wanted[s][1] is not None)]))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    seed: int = 7,
    total_tokens: int | str | None = None,
    domains: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents, (mix_name, doc_id, source, lang, n_tokens, repeats), and the shares reached.

    Without `total_tokens` a mixture is as large as it can be with every share
    met within the caps (see :func:`feasible`); "all" makes it as large as its
    weighted sources, and a number so large: then shares may be missed, and a
    shortage goes to siblings before ancestors. A source with weight NULL, zero
    or less is not used; a source without documents, or short of its share
    after its last allowed epoch, leaves its rest to the others; a NULL cap
    sets none. Repeated rows of a source in a mixture add their weights and
    take the strictest cap; mixtures without a usable source give no documents.
    The driver holds the wanted mixtures, a table that people write, and a row
    per source named there and language code of at most three letters.
    """
    spark = documents.sparkSession
    plan = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    plan = plan.groupBy("mix_name", "source").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("weight"), F.min("max_repeats").alias("cap"))
    listed = plan.collect()
    work = Workspace(spark, "mixture")
    own = documents.join(plan.select(F.col("source").alias("wanted")).distinct(), source_name(F.col("source")) == F.col("wanted"), "left_semi")
    tokens = work.write(sized(own, vocabulary), "tokens")
    held = tokens.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    sizes, rows_of = {(r["source"], r["lang"]): r["n"] for r in held}, {(r["source"], r["lang"]): r["rows"] for r in held}
    chosen: list[tuple] = []
    for name in sorted({r["mix_name"] for r in listed}, key=str):
        wanted = {r["source"]: (r["weight"] or 0.0, r["cap"]) for r in listed if r["mix_name"] == name}
        total = total_tokens
        if total_tokens is None:
            total = feasible(sizes, wanted)
        elif total_tokens == "all":
            total = sum(n for (s, _), n in sizes.items() if wanted.get(s, (0.0, None))[0] > 0)
        for (source, lang), budget in budgets(sizes, wanted, total, domains).items():
            epochs, rest = divmod(budget, sizes[source, lang])
            chosen.append((name, source, lang, epochs, rest, bucket_bits(rows_of[source, lang])))
    leaves = spark.createDataFrame(chosen, "mix_name string, source string, lang string, epochs long, rest long, bits int")
    # The side of the leaves is as small as the driver's list; the planner sends it to all tasks or joins by key as its size says.
    rows = tokens.join(leaves, ["source", "lang"])
    order = F.xxhash64(F.lit(seed), "mix_name", "epochs", F.col("doc_id"))
    drawn = running_total(rows.withColumn("draw", order), ["mix_name", "source", "lang"], F.expr("shiftright(draw, 64 - bits)"), ["draw", "doc_id"], "n_tokens")
    repeats = F.col("epochs") + F.when(F.col("before") + F.col("n_tokens") <= F.col("rest"), 1).otherwise(0)
    documents_out = drawn.select("mix_name", "doc_id", "source", "lang", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    return documents_out, shares(documents_out, plan)


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, deviation, n_tokens, n_documents, most_repeats) of each source of each mixture."""
    used = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    totals = used.groupBy("mix_name").agg(F.sum("n_tokens").alias("all_tokens"))
    weights = plan.groupBy("mix_name").agg(F.sum("weight").alias("all_weight"))
    joined = plan.join(weights, "mix_name").join(used, ["mix_name", "source"], "left").join(totals, "mix_name", "left")
    return joined.select(
        "mix_name",
        "source",
        F.try_divide("weight", "all_weight").alias("target_share"),
        F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        (F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)) - F.coalesce(F.try_divide("weight", "all_weight"), F.lit(0.0))).alias("deviation"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.col("cap").alias("max_repeats"),
    )
