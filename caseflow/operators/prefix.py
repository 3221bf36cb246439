"""Running sums, maxima and lags over long orders, without putting an order into one task.

Rows are cut into chunks that follow one another (an hour, a key range). Values of chunks are summed up over a small table;
inside a chunk a plain window does the rest. Keys may be null: they are held in a struct, in which nulls are equal, so the
join with the chunks' values and the window inside a chunk share one shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def hour(column: str) -> Column:
    """The chunk of a time: its hour."""
    return F.floor(F.col(column) / F.lit(float(HOUR_US)))


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0)))


def joined(df: DataFrame, values: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """df with the columns of values for its keys and chunk; null keys are equal."""
    return keyed(df, keys).join(keyed(values, keys).drop(*keys), ["_key", chunk]).drop("_key")


_BEFORE = (Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to and with this one; chunk must not fall along the order."""
    df = keyed(df, keys)
    sums = df.groupBy("_key", chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_key").orderBy(chunk).rowsBetween(*_BEFORE)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_key", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(sums, ["_key", chunk]).withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_before", "_key")


def running_max_before(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """df with the largest value of all rows before this one; chunk must not fall along the order."""
    df = keyed(df, keys)
    most = df.groupBy("_key", chunk).agg(F.max(value).alias("_most"))
    before = Window.partitionBy("_key").orderBy(chunk).rowsBetween(*_BEFORE)
    most = most.withColumn("_before", F.max("_most").over(before)).drop("_most")
    inside = Window.partitionBy("_key", chunk).orderBy(*order).rowsBetween(*_BEFORE)
    return df.join(most, ["_key", chunk]).withColumn(name, F.greatest("_before", F.max(value).over(inside))).drop("_before", "_key")


def lag_over(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """df with the value of the row before; value itself must not fall along the order."""
    df = keyed(df, keys)
    last = df.groupBy("_key", chunk).agg(F.max(value).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("_key").orderBy(chunk))).drop("_last")
    inside = Window.partitionBy("_key", chunk).orderBy(*order)
    return df.join(last, ["_key", chunk]).withColumn(name, F.coalesce(F.lag(value).over(inside), F.col("_before"))).drop("_before", "_key")


def lead_over(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """df with the value of the row after; value itself must not fall along the order."""
    df = keyed(df, keys)
    first = df.groupBy("_key", chunk).agg(F.min(value).alias("_first"))
    first = first.withColumn("_after", F.lead("_first").over(Window.partitionBy("_key").orderBy(chunk))).drop("_first")
    inside = Window.partitionBy("_key", chunk).orderBy(*order)
    return df.join(first, ["_key", chunk]).withColumn(name, F.coalesce(F.lead(value).over(inside), F.col("_after"))).drop("_after", "_key")


def queue(df: DataFrame, keys: list[str], chunk: str, order: list, ready: str, work: str, name: str) -> DataFrame:
    """df with the time at which each row begins: a server for each of keys takes rows in order, one at a time, none before it is
    ready. That is the work before a row and the largest (ready - work before) so far, its own included."""
    inside = Window.partitionBy("_key", chunk).orderBy(*order)
    df = keyed(df, keys).withColumn("_work", F.coalesce(F.sum(work).over(inside.rowsBetween(*_BEFORE)), F.lit(0)))
    df = df.withColumn("_idle", F.max(F.col(ready) - F.col("_work")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = df.groupBy("_key", chunk).agg(F.sum(work).alias("_all"), F.max("_idle").alias("_most"))
    before = Window.partitionBy("_key").orderBy(chunk).rowsBetween(*_BEFORE)
    sums = sums.withColumn("_done", F.coalesce(F.sum("_all").over(before), F.lit(0))).withColumn("_behind", F.max(F.col("_most") - F.col("_done")).over(before))
    out = df.join(sums.select("_key", chunk, "_done", "_behind"), ["_key", chunk])
    begin = F.col("_done") + F.col("_work") + F.greatest(F.col("_idle") - F.col("_done"), "_behind")
    return out.withColumn(name, begin).drop("_key", "_work", "_idle", "_done", "_behind")
