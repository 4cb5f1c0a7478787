"""Keyed tables: first and last row per key, and upserts as anti-joins and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One whole row per key: the first, or last, by the order.

    An aggregate over structs: rows are reduced before the shuffle, so a key of
    a third of all rows is no hot task. NULL order values come first; ties go
    by the whole row's content; NULL keys are a key of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    whole = F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *[F.col(f"`{c}`") for c in rest])
    best = (F.max if last else F.min)(whole).alias("_best")
    out = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(best)
    return out.select(*[F.col(f"`{c}`") for c in keys], *[F.col("_best").getField(c).alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), order: list[Column] | None = None) -> DataFrame:
    """Old rows replaced by new ones of their key; columns of `keep` stay as they were on conflict. Rows with no new key stay."""
    if order is not None:
        new = pick(new, keys, order, last=True)
    a, b = old.alias("a"), new.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    hit_a, hit_b = old.withColumn("_a", F.lit(1)).alias("a"), new.withColumn("_b", F.lit(1)).alias("b")
    joined = hit_a.join(hit_b, same, "full_outer")
    fresh = F.col("b._b").isNotNull()
    known = F.col("a._a").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        if c in keep or c not in new.columns:
            return F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}") if c in new.columns else F.lit(None))
        return F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return joined.select(*[value(c).alias(c) for c in old.columns])


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows after the old ones, as they are: no key is looked at; columns that one side lacks are NULL there, and those that only the new rows have are dropped."""
    return old.unionByName(new.select(*[F.col(f"`{c}`") for c in new.columns if c in old.columns]), allowMissingColumns=True)


def new_only(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key the existing rows lack; keys with a NULL never match and stay."""
    return candidates.join(existing.select(*keys).distinct(), keys, "left_anti")
