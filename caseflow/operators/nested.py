"""How many intervals of a group hold others: counted, not listed.

x holds y if x begins before y and ends after it. Intervals are numbered in a group by their beginnings, equal ones equally. Numbers
that go together, WHOLE at most, are a block; inside blocks a task counts what is out of order, bit by bit, many small groups at
once. Larger groups are a tree of WAYS children a node over their blocks: intervals of two blocks part at one level, where
both are in one node and in different children, and running counts of the children, along the ends, tell how many of the
earlier children end later, and how many of the later ones end earlier. Work is in proportion to the intervals and the
logarithm of a group's size, whatever the number of pairs.

Scale: nodes over blocks are summed up by hours of the ends first, so no group is in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, stored
from .prefix import hour

WAYS, WHOLE = 32, 1 << 18


def numbered(rows: DataFrame) -> DataFrame:
    """rows (_key, en, ...) with _nth: how many of the key begin earlier."""
    rows = rows.withColumn("_hour", hour("en"))
    sums = rows.groupBy("_key", "_hour").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy("_key").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_hour", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    inside = F.rank().over(Window.partitionBy("_key", "_hour").orderBy("en"))
    return rows.join(sums, ["_key", "_hour"]).withColumn("_nth", F.col("_before") + inside - 1).drop("_hour", "_before")


def out_of_order(r: np.ndarray) -> np.ndarray:
    """For each place of a permutation of 0, 1, ..., how many earlier places have larger numbers."""
    n, out = len(r), np.zeros(len(r), np.int64)
    at = np.arange(n)  # places, by the bits of their numbers that are done
    for b in reversed(range(max(1, int(n - 1).bit_length()) if n else 0)):
        v = r[at]
        one = (v >> b) & 1
        start = (v >> (b + 1)) << (b + 1)  # numbers are dense, so nodes begin where their numbers do
        ones = np.concatenate(([0], np.cumsum(one)))
        before = ones[:-1] - ones[start]
        zero = one == 0
        out[at[zero]] += before[zero]
        new = np.empty(n, np.int64)
        new[np.where(zero, np.arange(n) - before, start + (1 << b) + before)] = at
        at = new
    return out


def _blocks(by: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_node", "_nth", "s"], kind="stable", ignore_index=True)
        n = len(rows)
        # later groups have larger numbers, equal ends rise: neither is out of order
        r = np.empty(n, np.int64)
        r[np.lexsort((rows["s"].to_numpy(), rows["_node"].to_numpy(), rows["_id"].to_numpy()))] = np.arange(n)
        inside = out_of_order(r)
        return rows[by].assign(inside=inside, around=inside - np.arange(n) + r)

    return run


def _level(rows: DataFrame, span: int) -> DataFrame:
    """rows with `inside` and `around`, the intervals that hold each and that it holds, of those that part from it among `span` numbers."""
    rows = rows.withColumns({"_node": F.floor(F.col("_nth") / span), "_child": F.floor(F.col("_nth") * WAYS / span) % WAYS, "_hour": hour("s")})
    keys, node = ["_id", "_node", "_hour"], Window.partitionBy("_id", "_node")
    is_ = [F.when(F.col("_child") == k, 1).otherwise(0) for k in range(WAYS)]
    sums = rows.groupBy(*keys).agg(*[F.sum(x).alias(f"_n{k}") for k, x in enumerate(is_)])
    so_far = node.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.array(*[F.coalesce(F.sum(f"_n{k}").over(so_far), F.lit(0)) for k in range(WAYS)]).alias("_before"), F.array(*[F.sum(f"_n{k}").over(node) for k in range(WAYS)]).alias("_all"))
    by = Window.partitionBy(*keys).orderBy("s")
    upto = [F.sum(x).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)) for x in is_]
    less = [F.coalesce(F.sum(x).over(by.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) for x in is_]
    rows = rows.join(sums, keys).select("*", F.array(*upto).alias("_upto"), F.array(*less).alias("_less"))
    inside = sum((F.when(F.col("_child") > k, F.col("_all")[k] - F.col("_before")[k] - F.col("_upto")[k]).otherwise(0) for k in range(WAYS)), F.lit(0))
    around = sum((F.when(F.col("_child") < k, F.col("_before")[k] + F.col("_less")[k]).otherwise(0) for k in range(WAYS)), F.lit(0))
    return rows.withColumns({"inside": inside, "around": around})


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, inside, around) of intervals (_key, en, s, by): how many intervals of their keys hold those of a value, and are held by them."""
    ship(rows.sparkSession)
    rows = stored(rows.filter("en IS NOT NULL AND s IS NOT NULL").select("_key", "en", "s", *by))
    ids = stored(rows.select("_key").distinct().withColumn("_id", F.monotonically_increasing_id()))
    rows = stored(numbered(rows).join(ids, "_key").select("_id", "_nth", "s", *by))
    facts = rows.agg(F.max("_nth").alias("most"), F.count(F.lit(1)).alias("n")).collect()[0]
    whole = rows.withColumn("_node", F.floor(F.col("_nth") / WHOLE))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    some = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), facts.n * 4 // WHOLE)
    made = whole.groupBy(F.pmod(F.xxhash64("_id", "_node"), F.lit(some)).alias("_some")).applyInPandas(_blocks(by), f"{kinds}, inside long, around long")
    out, span = made.groupBy(*by).agg(F.sum("inside").alias("inside"), F.sum("around").alias("around")), WHOLE
    while span <= (facts.most or 0):
        span *= WAYS
        out = out.unionByName(_level(rows, span).groupBy(*by).agg(F.sum("inside").alias("inside"), F.sum("around").alias("around")))
    return out.groupBy(*by).agg(F.sum("inside").alias("inside"), F.sum("around").alias("around"))
