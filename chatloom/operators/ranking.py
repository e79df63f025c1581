"""Ranks within groups of any size: no task sorts a whole hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets summed up in one task.
SPAN = 4096


def _added(sizes: DataFrame, groups: list[str], by: str, size: str) -> DataFrame:
    """``sizes`` with the sum of what comes before in its group."""
    earlier = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum(size).over(earlier), F.lit(0)))


def _summed(sizes: DataFrame, groups: list[str]) -> DataFrame:
    """As ``_added``, in two levels: inside spans of buckets, then over the spans."""
    spans = _added(sizes.groupBy(*groups, "_span").agg(F.sum("_size").alias("_span_size")), groups, "_span", "_span_size")
    keys = [*groups, "_span"]
    named = spans.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("_before").alias("_spans_before"))
    inside = _added(sizes, keys, "_bucket", "_size")
    cond = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)))
    return inside.join(named, cond).select(*groups, "_bucket", "_size", (F.col("_before") + F.col("_spans_before")).alias("_before"))


def ranked(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, name: str = "rank", many: bool = False) -> DataFrame:
    """``df`` with the 1-based rank within ``groups`` by ``order``.

    ``bucket``, a whole number, must be monotone in ``order``: rows are ranked inside
    (group, bucket), and the sizes of earlier buckets of the group are added from a small
    table. ``many`` says that a group may have any number of buckets; they are then
    summed up by SPAN first, so that no task gets all of them. Ties in ``order`` get an
    arbitrary order, so it should end in a unique column.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    if many:
        sizes = _summed(sizes.withColumn("_span", F.expr(f"_bucket div {SPAN}")), groups)
    else:
        sizes = _added(sizes, groups, "_bucket", "_size")
    before = sizes
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    cond = None
    b = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_before"))
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    return inside.join(b, cond).withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside", *[f"_k{i}" for i in range(len(keys))])


def hash_bucket(hex_hash: Column, digits: int = 3) -> Column:
    """The first digits of a hexadecimal hash as a number: a bucket that is monotone in the hash."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("int")
