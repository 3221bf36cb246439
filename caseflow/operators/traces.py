"""Directly-follows graphs, n-grams, variants, case statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<", ">"


def by_time(*more):
    return Window.partitionBy("c").orderBy("e", "eid", *more)


def directly_follows(log: DataFrame) -> DataFrame:
    """(c, a, b, gap_us): each event with the next of its case."""
    w = by_time()
    return log.select("c", "a", F.lead("a").over(w).alias("b"), (F.lead("s").over(w) - F.col("e")).alias("gap_us")).filter("b IS NOT NULL")


def dfg(log: DataFrame) -> DataFrame:
    return directly_follows(log).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def interval_follows(log: DataFrame, bucket_us: int = 6 * 3_600_000_000) -> DataFrame:
    """(a, b, n): how often b directly follows a in time: a had ended when b began, and nothing began and ended between.

    So a ends after the latest start of all that had ended by then, a running maximum over the case; events meet in
    buckets of time between the two."""
    none = F.lit(None).cast("long")
    mark = lambda t, kind, start: F.struct(t.alias("t"), kind.alias("kind"), start.alias("start"))
    ended = F.when(F.col("s") < F.col("e"), 0).otherwise(2)  # what has no length comes before later starts only
    marks = log.select("c", "eid", "a", "s", "e", F.explode(F.array(mark(F.col("s"), F.lit(1), none), mark(F.col("e"), ended, F.col("s")))).alias("m")).select("c", "eid", "a", "s", "e", "m.*")
    w = Window.partitionBy("c").orderBy("t", "kind", "eid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = marks.withColumn("latest", F.max("start").over(w)).filter("kind = 1 AND latest IS NOT NULL")
    bucket = lambda x: F.floor(x / F.lit(float(bucket_us)))
    y = starts.select("c", "eid", "a", "s", "latest", F.explode(F.sequence(bucket(F.col("latest")), bucket(F.col("s")))).alias("k")).alias("y")
    x = log.select("c", "eid", "a", "s", "e", bucket(F.col("e")).alias("k")).alias("x")
    before = (F.col("x.e") < F.col("y.s")) | (F.col("x.e") == F.col("y.s")) & (F.col("x.s") < F.col("x.e"))
    after = (F.col("x.e") > F.col("y.latest")) | (F.col("x.e") == F.col("y.latest")) & (F.col("x.s") == F.col("x.e"))
    on = (F.col("x.c") == F.col("y.c")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.eid") != F.col("y.eid")) & before & after
    return x.join(y, on).groupBy(F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def dfg_with_gap(log: DataFrame) -> DataFrame:
    return directly_follows(log).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("gap_us") / 1e6), 3).alias("mean_gap_s"))


def ngrams(log: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, g1..gn, cnt): counts of activity n-grams; traces are padded with n - 1 start and end marks."""
    w = Window.partitionBy("c").orderBy("e", "eid")
    grams = F.struct(*[F.coalesce(F.lag("a", n - 1 - k).over(w), F.lit(START)).alias(f"g{k + 1}") for k in range(n)])
    rest = [F.struct(*[F.coalesce(F.lag("a", n - 1 - k - j).over(w), F.lit(START)).alias(f"g{k + 1}") if k + j < n else F.lit(END).alias(f"g{k + 1}") for k in range(n)]) for j in range(1, n)]
    last = F.lead("a").over(w).isNull()
    rows = log.select(*keys, F.concat(F.array(grams), F.when(last, F.array(*rest)).otherwise(F.array().cast(_kind(n)))).alias("grams"))
    return rows.select(*keys, F.explode("grams").alias("g")).groupBy(*keys, *[F.col(f"g.g{k + 1}").alias(f"g{k + 1}") for k in range(n)]).agg(F.count(F.lit(1)).alias("cnt"))


def _kind(n: int) -> str:
    return "array<struct<" + ",".join(f"g{k + 1}:string" for k in range(n)) + ">>"


def ngram_distance(log: DataFrame, side: str, n: int) -> DataFrame:
    """One row, distance: sum of |x - y| over sum of x + y of the n-gram counts x, y of the two sides (0 and 1)."""
    x, y = (F.sum(F.when(F.col(side) == k, F.col("cnt")).otherwise(0)) for k in (0, 1))
    both = ngrams(log, n, (side,)).groupBy(*[f"g{k + 1}" for k in range(n)]).agg(x.alias("x"), y.alias("y"))
    return both.agg(F.round(F.sum(F.abs(F.col("x") - F.col("y"))) / F.nullif(F.sum(F.col("x") + F.col("y")), F.lit(0)), 6).alias("distance"))


def variants(log: DataFrame) -> DataFrame:
    """(variant, cases): distinct activity sequences."""
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "eid", "a"))), lambda x: x["a"]), ">")
    return log.groupBy("c").agg(trace.alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("cases"))


def log_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("c").alias("cases"), F.count(F.lit(1)).alias("events"), F.min("s").alias("first_us"), F.max("e").alias("last_us"), F.max(F.col("s").isNull() | F.col("e").isNull()).cast("int").alias("any_null"))


def cycle_times(log: DataFrame) -> DataFrame:
    return log.groupBy("c").agg((F.max("e") - F.min("s")).alias("cycle_us"), F.count(F.lit(1)).alias("events"))
