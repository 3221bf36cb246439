"""Distances between two logs: earth-mover distances of histograms.

A histogram is a table (side, keys, b, n) with side 0 or 1; the distance is the area between the two cumulative
curves. Bins are aggregated before any window, so windows run over bins, never over events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MICROS_HOUR, hour_of, weekday_of_hour

HOURS = list(range(24))
ABSENT = 23.0  # of a weekday that one log lacks


def emd(hist: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, distance, sides) of a histogram; sides: how many logs have rows under the keys."""
    keys = list(keys)
    total = F.sum("n").over(Window.partitionBy("side", *keys))
    share = hist.withColumn("p", F.col("n") / total)
    d = share.groupBy(*keys, "b").agg(F.sum(F.when(F.col("side") == 0, F.col("p")).otherwise(-F.col("p"))).alias("d"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    w = Window.partitionBy(*keys).orderBy("b")
    area = F.abs(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))) * F.coalesce(F.lead("b").over(w) - F.col("b"), F.lit(0))
    return d.withColumn("area", area).groupBy(*keys).agg(F.sum("area").alias("distance"), (F.max("hi") - F.min("lo") + 1).alias("sides"))


def _instants(log: DataFrame) -> DataFrame:
    return log.select("side", "c", F.explode(F.array("s", "e")).alias("t"))


def _hist(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("side", *keys, "b").agg(F.count(F.lit(1)).alias("n"))


def absolute(log: DataFrame) -> DataFrame:
    """Starts and ends by hour."""
    return emd(_hist(_instants(log).withColumn("b", hour_of(F.col("t")))))


def relative(log: DataFrame) -> DataFrame:
    """Starts and ends by hour since the start of the case."""
    first = F.min("s").over(Window.partitionBy("side", "c"))
    rows = log.withColumn("first", first).select("side", "first", F.explode(F.array("s", "e")).alias("t"))
    return emd(_hist(rows.withColumn("b", hour_of(F.col("t") - F.col("first")))))


def arrival(log: DataFrame) -> DataFrame:
    """Case starts by hour."""
    return emd(_hist(log.groupBy("side", "c").agg(F.min("s").alias("t")).withColumn("b", hour_of(F.col("t")))))


def cycle_time(log: DataFrame) -> DataFrame:
    """Cycle times of cases in bins of an hour."""
    return emd(_hist(log.groupBy("side", "c").agg((F.max("e") - F.min("s")).alias("t")).withColumn("b", hour_of(F.col("t")))))


def over_weekdays(hist: DataFrame) -> DataFrame:
    """One row, distance: the mean over weekdays w of the distances of (side, w, b, n); a weekday of one side counts ABSENT."""
    parts = emd(hist, ["w"])
    value = F.when(F.col("sides") == 2, F.col("distance")).otherwise(F.lit(ABSENT))
    return parts.agg(F.avg(value).alias("distance"))


def circadian(log: DataFrame) -> DataFrame:
    """Starts and ends by hour of day, averaged over weekdays; a weekday of one log counts 23."""
    h = _instants(log).withColumn("h", hour_of(F.col("t")))
    h = h.select("side", weekday_of_hour(F.col("h")).alias("w"), F.pmod("h", F.lit(24)).cast("int").alias("b"))
    return over_weekdays(_hist(h, "w"))


def workforce(log: DataFrame) -> DataFrame:
    """As circadian, of the mean number of resources at work in an hour of a weekday (over dates with work)."""
    rows = log.select("side", "r", F.explode(F.sequence(hour_of(F.col("s")), hour_of(F.col("e")))).alias("h"))
    at_work = rows.groupBy("side", "h").agg(F.countDistinct("r").alias("k"))
    day = at_work.select("side", weekday_of_hour(F.col("h")).alias("w"), F.pmod("h", F.lit(24)).cast("int").alias("b"), "k")
    return over_weekdays(day.groupBy("side", "w", "b").agg(F.avg("k").alias("n")))


METRICS = {
    "absolute_event_distribution": absolute,
    "relative_event_distribution": relative,
    "case_arrival_distribution": arrival,
    "cycle_time_distribution": cycle_time,
    "circadian_event_distribution": circadian,
    "circadian_workforce_distribution": workforce,
}


def distance(log: DataFrame, metric: str) -> DataFrame:
    """One row (metric, distance) for a log with a column side; n-gram metrics are named 2_gram and 3_gram."""
    from .traces import ngram_distance
    from .variants_distance import control_flow_distance

    if metric == "control_flow_log_distance":
        out = control_flow_distance(log).select("distance")
    elif metric in ("2_gram", "3_gram"):
        out = ngram_distance(log, "side", int(metric[0]))
    elif metric in METRICS:
        out = METRICS[metric](log).select(F.round("distance", 6).alias("distance"))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return out.select(F.lit(metric).alias("metric"), "distance")
