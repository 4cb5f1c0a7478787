"""Running totals over any number of rows of one group, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Parameter: rows that a bucket of a running total holds on average.
BUCKET_ROWS = 50_000


def bucket_bits(rows: int) -> int:
    """How many leading bits of a hash make as many buckets as so many rows need; at least 1, so that a shift by the rest is one."""
    return max(1, (max(1, rows) // BUCKET_ROWS).bit_length())


def running_total(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: str, out: str = "before") -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group that come before a row.

    `bucket` must rise with the order and split a group into pieces of a
    bounded size. Sums of buckets are combined before the shuffle and run over
    in a table of one row per bucket; rows are sorted only within their bucket,
    so a group of a third of all rows is as many tasks as it has buckets. NULL
    values count as nothing; NULLs in `group` are a group of their own. Rows
    equal in the whole order come in an undefined order among themselves.
    """
    marked = df.withColumn("_bucket", bucket)
    keys = [F.col(c) for c in group]
    sums = marked.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first())
    offsets = sums.select(*keys, "_bucket", (F.coalesce(F.sum("_sum").over(before), F.lit(0)) - F.coalesce("_sum", F.lit(0))).alias("_offset"))
    a, b = marked.alias("a"), offsets.alias("b")
    same = F.col("a._bucket").eqNullSafe(F.col("b._bucket"))
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    inside = W.partitionBy(*[F.col(f"a.{c}") for c in group], F.col("a._bucket")).orderBy(*[F.col(f"a.{c}") for c in order]).rowsBetween(W.unboundedPreceding, -1)
    joined = a.join(b, same)
    total = F.col("b._offset") + F.coalesce(F.sum(F.col(f"a.{value}")).over(inside), F.lit(0))
    return joined.select("a.*", total.alias(out)).drop("_bucket")
