"""Partitions of a log, concurrency of activities, enabled and start times, multitasking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import hour, lag_over, running_max_before, running_sum


def split(log: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(c, first_us, events, train): whole cases in the order of their start, the first `ratio` of events to train."""
    cases = log.groupBy("c").agg(F.min("s").alias("first_us"), F.count(F.lit(1)).alias("events"))
    summed = running_sum(cases.withColumn("_hour", hour("first_us")), [], "_hour", ["first_us", "c"], F.col("events"), "so_far")
    total = cases.agg(F.sum("events").alias("total"))  # one row
    return summed.crossJoin(F.broadcast(total)).select("c", "first_us", "events", (F.col("so_far") <= F.lit(ratio) * F.col("total")).alias("train"))


def partitions(log: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(c, part): train, validation and test, by splitting twice."""
    outer = split(log, ratio)
    inner = split(log.join(outer.filter("train").select("c"), "c", "left_semi"), ratio).select("c", F.when(F.col("train"), "train").otherwise("validation").alias("inner"))
    return outer.join(inner, "c", "left").select("c", F.coalesce("inner", F.lit("test")).alias("part"))


def heuristic_concurrency(log: DataFrame, df: float = 0.75, l2l: float = 0.9, l1l: float = 0.9) -> DataFrame:
    """(a, b, dep, l2l, l1l, concurrent) for activities a < b that follow each other both ways; scores and the verdict."""
    w = Window.partitionBy("c").orderBy("e", "eid")
    steps = log.select("a", F.lead("a").over(w).alias("b"), F.lead("a", 2).over(w).alias("b2"))
    one = steps.filter("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    two = steps.filter("b2 = a AND b <> a").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ab, ba = one.filter("a < b"), one.filter("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    loops = two.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("k"))
    own = one.filter("a = b").select("a", (F.col("n") / (F.col("n") + 1)).alias("own"))
    pairs = ab.join(ba, ["a", "b"]).join(loops, ["a", "b"], "left")
    pairs = pairs.join(own.withColumnRenamed("own", "own_a"), "a", "left").join(own.select(F.col("a").alias("b"), F.col("own").alias("own_b")), "b", "left")
    k = F.coalesce("k", F.lit(0))
    scored = pairs.select(
        "a", "b",
        F.round((F.col("n") - F.col("m")) / (F.col("n") + F.col("m") + 1), 6).alias("dep"),
        F.round(k / (k + 1), 6).alias("l2l"),
        F.round(F.greatest(F.coalesce("own_a", F.lit(0.0)), F.coalesce("own_b", F.lit(0.0))), 6).alias("l1l"),
    )
    return scored.withColumn("concurrent", (F.abs("dep") < df) & (F.col("l2l") < l2l) & (F.col("l1l") < l1l))


def overlaps(log: DataFrame, bucket_us: int = 6 * 3_600_000_000) -> DataFrame:
    """(c, eid, other, a, b): pairs of events of a case that overlap in time, each once; a <= b.

    Events are cut into buckets of time and meet only there; a pair counts in the bucket where its overlap begins."""
    bucket = lambda c: F.floor(c / F.lit(float(bucket_us)))
    cut = log.filter("s <= e").select("c", "eid", "a", "s", "e", F.explode(F.sequence(bucket(F.col("s")), bucket(F.col("e")))).alias("k"))
    x, y = cut.alias("x"), cut.alias("y")
    on = (F.col("x.c") == F.col("y.c")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.eid") < F.col("y.eid")) & (F.col("x.s") < F.col("y.e")) & (F.col("y.s") < F.col("x.e"))
    on = on & (F.col("x.k") == bucket(F.greatest("x.s", "y.s")))
    return x.join(y, on).select("x.c", "x.eid", F.col("y.eid").alias("other"), F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b"))


def overlap_concurrency(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, together, overlapping, ratio, concurrent): cases in which two activities occur, and overlap."""
    has = log.select("c", "a").distinct()
    x, y = has.alias("x"), has.alias("y")
    both = x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.a") < F.col("y.a"))).groupBy(F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(F.count(F.lit(1)).alias("together"))
    over = overlaps(log).filter("a < b").select("c", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlapping"))
    n = F.coalesce("overlapping", F.lit(0))
    return both.join(over, ["a", "b"], "left").select("a", "b", "together", n.alias("overlapping"), F.round(n / F.col("together"), 6).alias("ratio"), (n / F.col("together") >= threshold).alias("concurrent"))


def both_ways(concurrent: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of concurrent pairs."""
    pairs = concurrent.select("a", "b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _last_not_beside(asks: DataFrame, ends: DataFrame, concurrent: DataFrame) -> DataFrame:
    """(eid, end) for each ask (c, eid, a, t, kind): the latest end (c, eid, a, t, kind) of its case before it, on the axis (t, kind,
    eid), of an activity not concurrent with its own; null if there is none.

    One running maximum over all ends of a case answers those whose latest end is of such an activity. The others look at each
    activity of their case that is not concurrent with theirs. Both run in two levels, so a case of any length is split."""
    pairs = both_ways(concurrent)
    axis, none = ["t", "kind", "eid"], F.lit(None).cast("struct<t:bigint,a:string>")
    rows = ends.select("c", *axis, "a", F.struct("t", "a").alias("value")).unionByName(asks.select("c", *axis, "a", none.alias("value"))).withColumn("_ask", F.col("value").isNull())
    led = running_max_before(rows.withColumn("_hour", hour("t")), ["c"], "_hour", [*axis, F.desc("_ask")], "value", "last").filter("_ask")
    clash = pairs.select("a", F.col("b").alias("_other"), F.lit(True).alias("_clash"))
    told = led.withColumn("_other", F.col("last.a")).join(clash, ["a", "_other"], "left").select("c", *axis, "a", "last", F.coalesce("_clash", F.lit(False)).alias("clash"))
    open_ = told.filter("clash").select("c", *axis, "a")
    ways = open_.join(ends.select("c", F.col("a").alias("b")).distinct(), "c").join(pairs, ["a", "b"], "left_anti")
    again = ends.select("c", F.col("a").alias("b"), *axis, F.col("t").alias("value")).unionByName(ways.select("c", "b", *axis, F.lit(None).cast("long").alias("value"))).withColumn("_ask", F.col("value").isNull())
    found = running_max_before(again.withColumn("_hour", hour("t")), ["c", "b"], "_hour", [*axis, F.desc("_ask")], "value", "last").filter("_ask")
    found = open_.select("eid").join(found.groupBy("eid").agg(F.max("last").alias("end")), "eid", "left")
    return told.filter("NOT clash").select("eid", F.col("last.t").alias("end")).unionByName(found)


def enabled_times(log: DataFrame, concurrent: DataFrame) -> DataFrame:
    """(eid, enabled_us): the latest end, in the case, of an activity not concurrent with the event's; none: its start.
    An event of no length enables later starts only.

    concurrent: (a, b) pairs. Starts and ends of a case lie on one axis, two rows an event."""
    asks = log.select("c", "eid", "a", F.col("s").alias("t"), F.lit(1).alias("kind"))
    ends = log.select("c", "eid", "a", F.col("e").alias("t"), F.when(F.col("s") < F.col("e"), 0).otherwise(2).alias("kind"))
    found = _last_not_beside(asks, ends, concurrent)
    return log.select("eid", "s").join(found, "eid").select("eid", F.coalesce("end", "s").alias("enabled_us"))


def estimated_starts(log: DataFrame, concurrent: DataFrame | None = None) -> DataFrame:
    """(eid, start_us) from ends alone: the later of the last end of the case, concurrent activities (a, b) left out, and of
    the last end of the resource, else the own end."""
    ends = log.select("c", "eid", "a", F.col("e").alias("t"), F.lit(0).alias("kind"))
    pairs = log.select("a", F.col("a").alias("b")).filter("false") if concurrent is None else concurrent
    before = _last_not_beside(ends, ends, pairs)
    free = lag_over(log.select("eid", "r", "e").withColumn("_hour", hour("e")), ["r"], "_hour", ["e", "eid"], "e", "_free")
    start = F.greatest("end", "_free")
    return free.join(before, "eid").select("eid", F.least(F.coalesce(start, F.col("e")), F.col("e")).alias("start_us"))


def multitask_adjust(log: DataFrame) -> DataFrame:
    """(eid, worked_us): an event's share of its resource's time, which events at work at one time divide evenly.

    The share is a difference of two values of one running integral of 1 / (events at work), so no interval is joined
    with another; integrals run over days first.
    """
    marks = log.select("r", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    points = marks.groupBy("r", F.col("m.t").alias("t")).agg(F.sum("m.d").alias("d")).withColumn("hour", hour("t"))
    active = running_sum(points, ["r"], "hour", ["t"], F.col("d"), "k")
    first = active.groupBy("r", "hour").agg(F.min("t").alias("first"))
    first = first.select(F.col("r").alias("_r"), F.col("hour").alias("_hour"), F.lead("first").over(Window.partitionBy("r").orderBy("hour")).alias("next"))
    after = F.coalesce(F.lead("t").over(Window.partitionBy("r", "hour").orderBy("t")), F.col("next"))
    spans = active.join(first, F.col("r").eqNullSafe(F.col("_r")) & (F.col("hour") == F.col("_hour"))).drop("_r", "_hour")
    spans = spans.withColumn("piece", F.coalesce(F.when(F.col("k") > 0, (after - F.col("t")) / F.col("k")), F.lit(0.0)))
    so_far = running_sum(spans, ["r"], "hour", ["t"], F.col("piece"), "upto").select(F.col("r").alias("_r"), "t", (F.col("upto") - F.col("piece")).alias("area"))
    # every event has two marks, and its share is the area at its end less that at its start
    ends = log.select("eid", "r", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("e").alias("t"), F.lit(1).alias("sign")))).alias("m")).select("eid", "r", F.col("m.t").alias("at"), "m.sign")
    met = ends.join(so_far, F.col("r").eqNullSafe(F.col("_r")) & (F.col("at") == F.col("t")))
    return met.groupBy("eid").agg(F.sum(F.col("sign") * F.col("area")).alias("worked_us"))
