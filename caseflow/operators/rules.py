"""Batches, priorities, attributes, gateways, branch conditions, waiting times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nested, rule_learning
from .prefix import hour, joined, lead_over, running_max_before, running_sum

TEN_MINUTES = 600_000_000


def batch_sessions(log: DataFrame, gap_us: int = TEN_MINUTES, least: int = 3) -> DataFrame:
    """(eid, a, r, session, size, kind, batched): runs of one activity and resource with gaps of at most gap_us.

    kind: parallel if all members share start and end, concurrent if any overlap, else sequential.
    """
    order = ["s", "e", "eid"]
    rows = running_max_before(log.select("eid", "a", "r", "s", "e").withColumn("_hour", hour("s")), ["a", "r"], "_hour", order, "e", "so_far")
    new = F.when(F.col("so_far").isNull() | (F.col("s") - F.col("so_far") > gap_us), 1).otherwise(0)
    rows = rows.withColumn("over", (F.col("s") < F.col("so_far")).cast("int")).withColumn("new", new)
    rows = running_sum(rows, ["a", "r"], "_hour", order, F.col("new"), "session")
    kinds = rows.groupBy("a", "r", "session").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("new") == 1, 0).otherwise(F.col("over"))).alias("any_over"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("e").alias("e0"), F.max("e").alias("e1")
    )
    kind = F.when((F.col("s0") == F.col("s1")) & (F.col("e0") == F.col("e1")), "parallel").when(F.col("any_over") == 1, "concurrent").otherwise("sequential")
    named = kinds.select("a", "r", "session", "size", F.when(F.col("size") == 1, "single").otherwise(kind).alias("kind"))
    return joined(rows, named, ["a", "r"], "session").select("eid", "a", "r", "s", "e", "session", "size", "kind", (F.col("size") >= least).alias("batched"))


def batch_sizes(sessions: DataFrame) -> DataFrame:
    """(a, size, batches, mean_s): how many batches of each size, and the mean duration of their members."""
    one = sessions.groupBy("a", "r", "session", "size").agg(F.avg((F.col("e") - F.col("s")) / 1e6).alias("d"))
    return one.groupBy("a", "size").agg(F.count(F.lit(1)).alias("batches"), F.round(F.avg("d"), 4).alias("mean_s"))


def batch_firing(sessions: DataFrame, enabled: DataFrame) -> DataFrame:
    """(a, r, session, size, ready_wt_s, large_wt_s, daily_hour, week_day): what held when each run of work fired.

    ready and large waiting times count from the last and the first member's enablement to the run's start."""
    rows = sessions.join(enabled, "eid").groupBy("a", "r", "session", "size").agg(F.min("s").alias("fired"), F.min("enabled_us").alias("first"), F.max(F.least("enabled_us", "s")).alias("last"))
    hour = F.floor(F.col("fired") / F.lit(3.6e9))
    wait = lambda c: F.round((F.col("fired") - F.least(c, "fired")) / 1e6, 3)
    return rows.select("a", "r", "session", "size", wait("last").alias("ready_wt_s"), wait("first").alias("large_wt_s"), F.pmod(hour, F.lit(24)).cast("int").alias("daily_hour"), F.pmod(F.floor(hour / 24) + 3, F.lit(7)).cast("int").alias("week_day"))


def firing_rules(firing: DataFrame, least: int = 3) -> DataFrame:
    """(a, attribute, threshold, confidence, support): for the sizes of fired batches, how well `size >= threshold`
    separates batches from smaller runs."""
    t = firing.select("a", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("threshold"), "size")
    hit = F.sum(F.when(F.col("size") >= F.col("threshold"), 1).otherwise(0))
    good = F.sum(F.when((F.col("size") >= F.col("threshold")) & (F.col("size") >= least), 1).otherwise(0))
    out = t.groupBy("a", "threshold").agg(hit.alias("hit"), good.alias("good"), F.sum(F.when(F.col("size") >= least, 1).otherwise(0)).alias("all"))
    return out.select("a", F.lit("batch_size").alias("attribute"), "threshold", F.round(F.col("good") / F.nullif("hit", F.lit(0)), 6).alias("confidence"), F.round(F.col("good") / F.nullif("all", F.lit(0)), 6).alias("support"))


WAITS_S = (60.0, 600.0, 3600.0, 14_400.0, 86_400.0)


def firing_conditions(firing: DataFrame, least: int = 3) -> DataFrame:
    """(a, attribute, comparison, value, confidence, support) of batches (a, size, ready_wt_s, large_wt_s, daily_hour, week_day):
    how well a wait of WAITS_S or more, an hour or a weekday tells batches from smaller runs. One pass counts all candidates."""
    one = lambda attribute, comparison, value, hit: F.struct(F.lit(attribute).alias("attribute"), F.lit(comparison).alias("comparison"), value.cast("double").alias("value"), hit.alias("hit"))
    waits = [one(name, ">=", F.lit(t), F.col(c) >= t) for name, c in (("batch_ready_wt", "ready_wt_s"), ("batch_max_wt", "large_wt_s")) for t in WAITS_S]
    at = [one(c, "=", F.col(c), F.lit(True)) for c in ("daily_hour", "week_day")]
    batched = (F.col("size") >= least).cast("int")
    rows = firing.select("a", batched.alias("batched"), F.explode(F.array(*waits, *at)).alias("x")).filter("x.hit")
    told = rows.groupBy("a", "x.attribute", "x.comparison", "x.value").agg(F.count(F.lit(1)).alias("hit"), F.sum("batched").alias("good"))
    every = firing.groupBy("a").agg(F.sum(batched).alias("all"))
    out = told.join(every, "a")
    return out.select("a", "attribute", "comparison", "value", F.round(F.col("good") / F.col("hit"), 6).alias("confidence"), F.round(F.col("good") / F.nullif("all", F.lit(0)), 6).alias("support"))


def learned_firing(firing: DataFrame, least: int = 3, f_score: float = 0.7) -> DataFrame:
    """rule_learning.learn() on runs of work (a, r, session, size, ready_wt_s, large_wt_s, daily_hour, week_day): what sets those of
    `least` or more apart; a third of all runs, by session, prunes."""
    rows = firing.select(
        F.col("a").alias("g"), (F.col("size") >= least).cast("string").alias("y"), F.col("ready_wt_s").alias("batch_ready_wt"), F.col("large_wt_s").alias("batch_max_wt"), "daily_hour", "week_day",
        (F.pmod(F.col("session") + F.coalesce(F.col("r"), F.lit(0)), F.lit(3)) == 0).alias("hold"),
    )
    return rule_learning.learn(rows, ["batch_ready_wt", "batch_max_wt", "daily_hour", "week_day"], [], f_score, "true")


def overtakes(log: DataFrame, enabled: DataFrame, attribute: str = "c", bucket_us: int = 6 * 3_600_000_000) -> DataFrame:
    """(r, a, eid, over): event `eid` started before `over` of the same work, though `over` had been enabled earlier and
    was waiting. The waits are cut into buckets of time, so that events meet only where they wait together."""
    rows = log.join(enabled, "eid").select("r", "a", "eid", "s", F.least("enabled_us", "s").alias("en"), attribute)
    bucket = lambda c: F.floor(c / F.lit(float(bucket_us)))
    waits = rows.filter("en < s").withColumn("k", F.explode(F.sequence(bucket(F.col("en")), bucket(F.col("s"))))).alias("x")
    takes = rows.withColumn("k", bucket(F.col("en"))).alias("y")
    on = (F.col("x.r").eqNullSafe(F.col("y.r"))) & (F.col("x.a") == F.col("y.a")) & (F.col("x.k") == F.col("y.k"))
    on = on & (F.col("x.en") < F.col("y.en")) & (F.col("y.en") <= F.col("x.s")) & (F.col("y.s") < F.col("x.s"))
    return waits.join(takes, on).select("x.r", "x.a", F.col("y.eid").alias("eid"), F.col("x.eid").alias("over"))


def priority_scores(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """(value, won, contested, score, level): of contests between different values of an attribute (eid, v), how many a
    value won by overtaking; levels from 1 by falling score."""
    x, y = attributes.select("eid", F.col("v").alias("win")), attributes.select(F.col("eid").alias("over"), F.col("v").alias("lose"))
    told = pairs.join(x, "eid").join(y, "over").filter("win <> lose")
    each = told.select(F.explode(F.array(F.struct(F.col("win").alias("v"), F.lit(1).alias("w")), F.struct(F.col("lose").alias("v"), F.lit(0).alias("w")))).alias("t"))
    out = each.groupBy(F.col("t.v").alias("value")).agg(F.sum("t.w").alias("won"), F.count(F.lit(1)).alias("contested"))
    out = out.withColumn("score", F.round(F.col("won") / F.col("contested"), 6))
    return out.withColumn("level", F.dense_rank().over(Window.orderBy(F.desc("score"))))


def priority_counts(log: DataFrame, enabled: DataFrame, attributes: DataFrame) -> DataFrame:
    """priority_scores of all overtakes of a log, with attributes (eid, v), without a list of them: who overtakes waited inside the
    other's wait, and such pairs are counted, all of them less those of equal values."""
    rows = log.select("eid", "r", "a", "s").join(enabled, "eid").join(attributes.select("eid", "v"), "eid").filter("a IS NOT NULL AND v IS NOT NULL")
    work = lambda own: F.struct("r", "a", F.when(F.lit(own), F.col("v")).alias("v"), F.lit(own).alias("own"))
    rows = rows.select("v", "s", F.least("enabled_us", "s").alias("en"), F.explode(F.array(work(False), work(True))).alias("_key")).withColumn("own", F.col("_key.own"))
    of = nested.counts(rows, ["v", "own"]).groupBy("v").pivot("own", [False, True]).agg(F.sum("inside").alias("inside"), F.sum("around").alias("around"))
    won, lost = F.col("false_inside") - F.col("true_inside"), F.col("false_around") - F.col("true_inside")
    out = of.select(F.col("v").alias("value"), won.alias("won"), (won + lost).alias("contested")).filter("contested > 0")
    out = out.withColumn("score", F.round(F.col("won") / F.col("contested"), 6))
    return out.withColumn("level", F.dense_rank().over(Window.orderBy(F.desc("score"))))  # over one row a value


def interval_labels(df: DataFrame, numbers: list[str], parts: int = 4) -> DataFrame:
    """df with each of some numeric columns as the interval between quantiles that it lies in, `low;high`, from -inf to inf."""
    if not numbers:
        return df
    shares = [k / parts for k in range(1, parts)]
    cuts = df.agg(*[F.percentile_approx(F.col(k).cast("double"), shares, 10_000).alias(k) for k in numbers]).collect()[0]  # a few numbers a column

    def label(k: str) -> Column:
        points = [float("-inf"), *sorted(set(cuts[k] or [])), float("inf")]
        v, out = F.col(k).cast("double"), F.lit(None).cast("string")
        for low, high in reversed(list(zip(points, points[1:], strict=False))):
            out = F.when(v <= high, f"{low:g};{high:g}").otherwise(out)
        return out

    return df.withColumns({k: label(k) for k in numbers})


def priority_levels(pairs: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """(attribute, value, won, contested, score, level) of contests (eid, over) for every attribute of (eid, names...): as
    priority_scores, and values of all attributes share one ladder of levels."""
    values = F.array(*[F.col(k).cast("string") for k in names])
    x, y = attributes.select("eid", values.alias("x")), attributes.select(F.col("eid").alias("over"), values.alias("y"))
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("attribute"), F.col("x").alias("win"), F.col("y").alias("lose"))
    told = pairs.join(x, "eid").join(y, "over").select(F.inline(each).alias("attribute", "win", "lose")).filter("win <> lose")
    both = told.select("attribute", F.explode(F.array(F.struct(F.col("win").alias("v"), F.lit(1).alias("w")), F.struct(F.col("lose").alias("v"), F.lit(0).alias("w")))).alias("t"))
    out = both.groupBy("attribute", F.col("t.v").alias("value")).agg(F.sum("t.w").alias("won"), F.count(F.lit(1)).alias("contested"))
    out = out.withColumn("score", F.round(F.col("won") / F.col("contested"), 6))
    return out.withColumn("level", F.dense_rank().over(Window.orderBy(F.desc("score"))))


def batch_characteristics(sessions: DataFrame, least: int = 3) -> DataFrame:
    """(a, kind, batch_frequency, resources) of activities with batches: their commonest kind by events, the first by name of
    equals, the share of events in batches, and who did them."""
    per = sessions.groupBy("a", "kind", "r").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("size") >= least).cast("long")).alias("batched"))
    kinds = per.groupBy("a", "kind").agg(F.sum("batched").alias("n")).groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("less"), "kind")).alias("k"))
    sums = per.groupBy("a").agg(F.sum("batched").alias("batched"), F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("batched") > 0, F.col("r").cast("string")))).alias("resources"))
    return sums.filter("batched > 0").join(kinds, "a").select("a", "k.kind", F.round(F.col("batched") / F.col("n"), 6).alias("batch_frequency"), "resources")


def _stack(columns: list[str], value) -> Column:
    """A row a column: its name and what `value` gives for its place."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), value(k)) for k, n in enumerate(columns)])).alias("x")


def case_attribute_scores(log: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """(attribute, cases, constant, share, is_case): in how many cases a column has one value."""
    one = lambda n: F.min(n).eqNullSafe(F.max(n)) & (F.count(n) == F.count(F.lit(1)))
    per = log.groupBy("c").agg(*[one(n).cast("int").alias(f"_{k}") for k, n in enumerate(columns)])
    sums = per.agg(F.count(F.lit(1)).alias("cases"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(len(columns))])
    out = sums.select("cases", _stack(columns, lambda k: F.col(f"_{k}").alias("constant"))).select("x.attribute", "cases", "x.constant").filter("cases > 0")
    return out.select("attribute", "cases", "constant", F.round(F.col("constant") / F.col("cases"), 6).alias("share"), (F.col("constant") / F.col("cases") >= least).alias("is_case"))


def event_attribute_scores(log: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, a, events, changes, share): how often an activity changes the value of a column within its case."""
    before = lambda n: F.lag(F.col(n).cast("string")).over(Window.partitionBy("c").orderBy("e", "eid"))
    changed = lambda n: F.when(before(n).isNotNull(), (before(n) != F.col(n).cast("string")).cast("int")).otherwise(0)
    rows = log.select("a", *[changed(n).alias(f"_{k}") for k, n in enumerate(columns)])
    sums = rows.groupBy("a").agg(F.count(F.lit(1)).alias("events"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(len(columns))])
    out = sums.select("a", "events", _stack(columns, lambda k: F.col(f"_{k}").alias("changes"))).select("x.attribute", "a", "events", "x.changes")
    return out.select("attribute", "a", "events", "changes", F.round(F.col("changes") / F.col("events"), 6).alias("share"))


def global_attribute_scores(log: DataFrame, columns: list[str], bin_us: int = 3_600_000_000) -> DataFrame:
    """(attribute, windows, agreeing, share): in how many hours all cases see one value, as a value of global time would
    have it; hours with one event tell nothing."""
    per = log.groupBy(F.floor(F.col("e") / F.lit(float(bin_us))).alias("h")).agg(F.count(F.lit(1)).alias("n"), *[(F.min(n) == F.max(n)).cast("int").alias(f"_{k}") for k, n in enumerate(columns)])
    sums = per.filter("n > 1").agg(F.count(F.lit(1)).alias("windows"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(len(columns))])
    out = sums.select("windows", _stack(columns, lambda k: F.col(f"_{k}").alias("agreeing"))).select("x.attribute", "windows", "x.agreeing").filter("windows > 0")
    return out.select("attribute", "windows", "agreeing", F.round(F.col("agreeing") / F.col("windows"), 6).alias("share"))


def attribute_types(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """(attribute, distinct, numeric, kind): discrete up to `most` values or not a number, else continuous."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("v")) for n in columns]))
    out = df.select(names.alias("x")).groupBy("x.attribute").agg(F.countDistinct("x.v").alias("distinct"), F.min(F.expr("try_cast(x.v AS DOUBLE) IS NOT NULL").cast("int")).alias("numeric"))
    return out.select("attribute", "distinct", "numeric", F.when((F.col("distinct") <= most) | (F.col("numeric") == 0), "discrete").otherwise("continuous").alias("kind"))


def gateways(steps: DataFrame) -> DataFrame:
    """(gateway, path, taken, equiprobable, observed) of (a, b, n): every activity with several followers is a choice."""
    w = Window.partitionBy("a")
    ways = F.count(F.lit(1)).over(w)
    return steps.withColumn("ways", ways).withColumn("all", F.sum("n").over(w)).filter("ways > 1").select(
        F.col("a").alias("gateway"), F.col("b").alias("path"), F.col("n").alias("taken"), F.round(1 / F.col("ways"), 6).alias("equiprobable"), F.round(F.col("n") / F.col("all"), 6).alias("observed")
    )


def branch_rules(choices: DataFrame, attributes: list[str], f_score: float = 0.7) -> DataFrame:
    """(gateway, path, attribute, value, tp, f1, kept) of (gateway, path, attributes...): how well `attribute = value`
    foretells a path. One pass counts each candidate with its path; margins are sums of those counts."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("value")) for n in attributes]))
    tp = choices.select("gateway", "path", names.alias("x")).groupBy("gateway", "path", "x.attribute", "x.value").agg(F.count(F.lit(1)).alias("tp"))
    said = F.sum("tp").over(Window.partitionBy("gateway", "attribute", "value"))
    took = F.sum("tp").over(Window.partitionBy("gateway", "attribute", "path"))
    f1 = 2 * F.col("tp") / (said + took)
    return tp.select("gateway", "path", "attribute", "value", "tp", F.round(f1, 6).alias("f1"), (f1 >= f_score).alias("kept")).filter("value IS NOT NULL")


def interval_branch_rules(choices: DataFrame, attribute: str, cuts: list[float], f_score: float = 0.7) -> DataFrame:
    """(gateway, path, attribute, cut, tp, f1, kept): as branch_rules, for `attribute > cut` over given cuts."""
    c = choices.select("gateway", "path", F.col(attribute).cast("double").alias("v"), F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    per = c.groupBy("gateway", "path", "cut").agg(F.sum((F.col("v") > F.col("cut")).cast("int")).alias("tp"), F.count(F.lit(1)).alias("took"))
    f1 = 2 * F.col("tp") / (F.sum("tp").over(Window.partitionBy("gateway", "cut")) + F.col("took"))
    return per.select("gateway", "path", F.lit(attribute).alias("attribute"), "cut", "tp", F.round(f1, 6).alias("f1"), (f1 >= f_score).alias("kept"))


def with_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Gateway paths (gateway, path, ...) with condition_id of the first kept rule; null where there is none."""
    ids = rules.filter("kept").groupBy("gateway", "path").agg(F.min(F.concat_ws("=", "attribute", "value")).alias("condition_id"))
    return paths.join(ids, ["gateway", "path"], "left")


def waiting(log: DataFrame, enabled: DataFrame) -> DataFrame:
    """(eid, a, wait_us, resource_wait_us, extraneous_us): the wait of an event, the part in which its resource was at
    work, and what is left over."""
    rows = log.select("eid", "a", "r", "s", "e").withColumn("_hour", hour("s"))
    rows = running_max_before(rows, ["r"], "_hour", ["s", "e", "eid"], "e", "free").join(enabled, "eid")
    en = F.least("enabled_us", "s")
    ready = F.least(F.greatest(en, F.coalesce("free", en)), "s")
    return rows.select("eid", "a", (F.col("s") - en).alias("wait_us"), (ready - en).alias("resource_wait_us"), (F.col("s") - ready).alias("extraneous_us"))


def extraneous(log: DataFrame, enabled: DataFrame) -> DataFrame:
    """(a, events, delayed, mean_s, most_s): extraneous delays by activity; the naive estimate."""
    rows = waiting(log, enabled)
    d = F.when(F.col("extraneous_us") > 0, F.col("extraneous_us") / 1e6)
    return rows.groupBy("a").agg(F.count(F.lit(1)).alias("events"), F.count(d).alias("delayed"), F.round(F.avg(d), 3).alias("mean_s"), F.round(F.max(d), 3).alias("most_s"))


def extraneous_on_calendar(log: DataFrame, enabled: DataFrame, calendar: DataFrame) -> DataFrame:
    """(eid, a, extraneous_h): whole hours of extraneous wait in which the resource's calendar (k, w, g hours) is open."""
    h = lambda c: F.floor(c / F.lit(3.6e9))
    rows = waiting(log, enabled).filter("extraneous_us > 0").join(log.select("eid", "r", "s"), "eid")
    hours = rows.select("eid", "a", "r", F.explode(F.sequence(h(F.col("s") - F.col("extraneous_us")), h(F.col("s")))).alias("x"))
    hours = hours.withColumn("w", F.pmod(F.floor(F.col("x") / 24) + 3, F.lit(7)).cast("int")).withColumn("g", F.pmod("x", F.lit(24)).cast("int"))
    open_ = calendar.select(F.col("k").alias("r"), "w", "g").distinct()
    return hours.join(open_, ["r", "w", "g"]).groupBy("eid", "a").agg(F.count(F.lit(1)).alias("extraneous_h"))


def extraneous_largest(log: DataFrame, enabled: DataFrame, calendar: DataFrame) -> DataFrame:
    """(eid, a, delay_us) of events that waited: the longest stretch of the wait in which the resource was neither at work nor off
    duty, in microseconds. calendar: (k, w, g), the hours of weekdays in which a resource is on duty.

    One sweep a resource over the starts and ends of its work and of its hours on duty, on the days on which something waits for it,
    with running counts of both, gives its free stretches; waits meet those of their days."""
    day_us = 86_400_000_000
    day = lambda c: F.floor(c / F.lit(float(day_us)))
    waits = log.join(enabled, "eid").select("eid", "a", "r", "s", F.least("enabled_us", "s").alias("en")).filter("en < s AND r IS NOT NULL")
    days = waits.select("eid", "a", "r", "en", "s", F.explode(F.sequence(day(F.col("en")), day(F.col("s")))).alias("day"))
    w = F.pmod(F.col("day") + 3, F.lit(7)).cast("int")
    hours = days.select("r", "day").distinct().withColumn("w", w).join(calendar.select(F.col("k").alias("r"), "w", "g").distinct(), ["r", "w"])
    begin = F.col("day") * day_us + F.col("g") * 3_600_000_000
    mark = lambda t, busy, duty: F.struct(t.cast("long").alias("t"), F.lit(busy).alias("busy"), F.lit(duty).alias("duty"))
    on_duty = hours.select("r", F.explode(F.array(mark(begin, 0, 1), mark(begin + 3_600_000_000, 0, -1))).alias("m"))
    at_work = log.filter("s < e AND r IS NOT NULL").select("r", F.explode(F.array(mark(F.col("s"), 1, 0), mark(F.col("e"), -1, 0))).alias("m"))
    points = on_duty.unionByName(at_work).groupBy("r", "m.t").agg(F.sum("m.busy").alias("busy"), F.sum("m.duty").alias("duty")).filter("busy <> 0 OR duty <> 0")
    # one running sum for both counts: what is at work in the large part, what is on duty in the small one
    big = 1 << 20
    swept = running_sum(points.withColumn("_hour", hour("t")), ["r"], "_hour", ["t"], F.col("busy") * big + F.col("duty"), "state")
    free = lead_over(swept, ["r"], "_hour", ["t"], "t", "until").filter("state = 1 AND until IS NOT NULL").select("r", F.col("t").alias("f0"), F.col("until").alias("f1"))
    met = days.join(free.withColumn("day", F.explode(F.sequence(day(F.col("f0")), day(F.col("f1"))))), ["r", "day"])
    most = met.groupBy("eid").agg(F.max(F.least("s", "f1") - F.greatest("en", "f0")).alias("most"))
    return waits.join(most, "eid", "left").select("eid", "a", F.greatest(F.coalesce("most", F.lit(0)), F.lit(0)).cast("long").alias("delay_us"))


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def map_column(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """A column with its values replaced by a small dictionary; others stay."""
    return df.withColumn(column, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(column)), F.col(column)))

