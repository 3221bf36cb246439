"""Exact quantiles of many columns and groups at once, without a group's values in one task.

Equal values are counted first. Sketches cut a group's values into PIECES of about as many; sums of pieces come before each of them, and
only pieces that hold an asked rank are summed up inside. So no rank is off, however many values a group has and however far a
sketch is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored

PIECES = 64


def rank(total: Column, share: float) -> Column:
    """The place, from 1, of the discrete quantile among `total` values."""
    return F.greatest(F.lit(1).cast("long"), total - F.floor(total - total * F.lit(share)))


def cut(counts: DataFrame) -> DataFrame:
    """counts (_key, _v, ...) with _part, the piece of the group that the value lies in."""
    edges = counts.filter("_v IS NOT NULL").groupBy("_key").agg(F.percentile_approx("_v", F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)]), 10_000).alias("_edges"))
    part = F.size(F.filter("_edges", lambda e: F.col("_v") > e))
    return counts.join(edges, "_key", "left").withColumn("_part", F.when(F.col("_v").isNotNull(), part).otherwise(-1)).drop("_edges")


def counted(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(_key, q) of stored counts (_key, _v, _n), a row a value: the values at the shares, in their order. Null values don't count; keys
    with none have an empty array."""
    placed = cut(counts).withColumn("_n", F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0))
    by = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_in").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy("_key", "_part").agg(F.sum("_n").alias("_in")).select("_key", "_part", "_in", before.alias("_before"), F.sum("_in").over(by).alias("_all"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), rank(F.col("_all"), p).alias("rank")) for i, p in enumerate(shares)])
    inside = lambda upto, n: lambda x: (x["rank"] > upto - n) & (x["rank"] <= upto)
    holding = sums.withColumn("_asked", F.filter(asked, inside(F.col("_before") + F.col("_in"), F.col("_in")))).filter(F.size("_asked") > 0)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_key", "_part").orderBy("_v"))
    met = placed.join(holding.select("_key", "_part", "_before", "_asked"), ["_key", "_part"]).withColumn("_upto", upto)
    met = met.select("_key", "_v", F.explode(F.filter("_asked", inside(F.col("_upto"), F.col("_n")))).alias("x"))
    q = met.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.i", "_v"))), lambda x: x["_v"]).alias("q"))
    none = F.array().cast(f"array<{counts.schema['_v'].dataType.simpleString()}>")
    return counts.select("_key").distinct().join(q, "_key", "left").select("_key", F.coalesce("q", none).alias("q"))


def exact(rows: DataFrame, keys: list[str], values: list[str], shares: list[float]) -> DataFrame:
    """(keys, q): for each of the columns `values`, as doubles, an array of its values at the shares, empty if it has none."""
    each = F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("_at", "_v")
    counts = rows.select(*keys, each).groupBy(F.struct(*keys, "_at").alias("_key"), "_v").agg(F.count(F.lit(1)).alias("_n"))
    per = counted(stored(counts), shares).select("_key.*", "q")
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "q"))), lambda x: x["q"]).alias("q"))
