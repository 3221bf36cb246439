"""Arrivals, work calendars, resource performance, pools."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MICROS_DAY
from ..runtime import discard, stored
from . import quantiles, similar
from .prefix import hour, lag_over

MINUTE = 60_000_000


def interarrivals(log: DataFrame) -> DataFrame:
    """(c, arrival_us, gap_us): cases by their start, with the gap since the case before."""
    cases = log.groupBy("c").agg(F.min("s").alias("arrival_us"))
    cases = cases.withColumn("_hour", hour("arrival_us"))
    return lag_over(cases, [], "_hour", ["arrival_us", "c"], "arrival_us", "_last").select("c", "arrival_us", (F.col("arrival_us") - F.col("_last")).alias("gap_us"))


def moments(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """n, mean, std, min, max, skewness (population) of a value, by keys; two passes, so that means are taken off first."""
    rows = df.select(*keys, value.cast("double").alias("v")).filter("v IS NOT NULL")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.skewness("v"), 4).alias("skew")
    )
    return out


def arrival_histogram(log: DataFrame, bin_us: int = 15 * MINUTE) -> DataFrame:
    """(bin, cases, share): the observed distribution of gaps between arrivals."""
    gaps = interarrivals(log).filter("gap_us IS NOT NULL").groupBy(F.floor(F.col("gap_us") / F.lit(float(bin_us))).alias("bin")).agg(F.count(F.lit(1)).alias("cases"))
    return gaps.select("bin", "cases", F.round(F.col("cases") / F.sum("cases").over(Window.partitionBy()), 6).alias("share"))


def granules(log: DataFrame, key: Column, minutes: int = 60, only_ends: bool = False) -> DataFrame:
    """(k, day, w, g): distinct granules of days in which a key is active; w counts weekdays from Monday = 0."""
    if 1440 % minutes:
        raise ValueError(f"{minutes} minutes do not divide a day")
    size = F.lit(float(minutes * MINUTE))
    first = F.floor(F.col("e") / size) if only_ends else F.floor(F.col("s") / size)
    rows = log.select(key.alias("k"), F.explode(F.sequence(first, F.floor(F.col("e") / size))).alias("x"))
    day = F.floor(F.col("x") / F.lit(1440 // minutes))
    return rows.select("k", day.alias("day"), F.pmod(day + 3, F.lit(7)).cast("int").alias("w"), F.pmod("x", F.lit(1440 // minutes)).cast("int").alias("g")).distinct()


def granule_activity(log: DataFrame, key: Column, minutes: int = 60) -> DataFrame:
    """(k, w, g, days): on how many dates a key is active in a granule of a weekday."""
    return granules(log, key, minutes).groupBy("k", "w", "g").agg(F.count(F.lit(1)).alias("days"))


def weekdays_in(log: DataFrame) -> DataFrame:
    """(w, dates): how often each weekday occurs from the first to the last day of a log."""
    day = lambda c: F.floor(F.col(c) / F.lit(float(MICROS_DAY)))
    span = log.agg(F.min(day("s")).alias("a"), F.max(day("e")).alias("b"))
    w = F.explode(F.sequence(F.lit(0), F.lit(6)))
    # days d in [a, b] with (d + 3) mod 7 = w
    upto = lambda x: F.floor((x + 3 - F.col("w")) / F.lit(7))
    return span.select(w.alias("w"), "a", "b").select("w", (upto(F.col("b")) - upto(F.col("a") - 1)).alias("dates"))


def crisp_scores(log: DataFrame, key: Column, minutes: int = 60, confidence: float = 0.1, participation: float = 0.4) -> DataFrame:
    """(k, w, g, days, confidence, kept, own): a granule is kept if the key is active on enough dates of the weekday;
    own tells whether the key has enough activity, against the busiest, for a calendar of its own."""
    acts = granule_activity(log, key, minutes).join(F.broadcast(weekdays_in(log)), "w")
    share = F.col("days") / F.col("dates")
    work = log.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("events"))
    work = work.withColumn("own", F.col("events") >= participation * F.max("events").over(Window.partitionBy())).select("k", "own")
    return acts.join(work, "k").select("k", "w", "g", "days", F.round(share, 6).alias("confidence"), (share >= confidence).alias("kept"), "own")


def crisp_support(scores: DataFrame) -> DataFrame:
    """(k, support): the share of a key's active granules that its kept granules cover."""
    return scores.groupBy("k").agg(F.round(F.sum(F.when(F.col("kept"), F.col("days")).otherwise(0)) / F.sum("days"), 6).alias("support"))


def relaxed(log: DataFrame, key: Column, minutes: int, confidence: float, support: float, participation: float = 0.4, step: float = 0.1) -> DataFrame:
    """crisp_scores, with the confidence of each key lowered in steps until its support is reached."""
    scores = crisp_scores(log, key, minutes, 0.0, participation)
    levels = scores.sparkSession.range(0, int(confidence / step) + 2).select(F.greatest(F.lit(confidence) - F.col("id") * step, F.lit(0.0)).alias("level"))
    tried = scores.crossJoin(F.broadcast(levels)).groupBy("k", "level").agg((F.sum(F.when(F.col("confidence") >= F.col("level"), F.col("days")).otherwise(0)) / F.sum("days")).alias("got"))
    best = tried.filter(F.col("got") >= support).groupBy("k").agg(F.max("level").alias("level"))
    return scores.join(best, "k").withColumn("kept", F.col("confidence") >= F.col("level")).drop("level")


def calendar_cube(log: DataFrame, key: Column, granularities: list[int]) -> DataFrame:
    """(minutes, k, w, g, days, confidence) for every granularity at once: the finest granules of days, of a length that divides all,
    are made in one pass over the log and rolled up; a coarse granule is active on a date if any of its parts is."""
    finest = math.gcd(*granularities)
    if any(1440 % m for m in granularities):
        raise ValueError(f"{granularities} minutes do not all divide a day")
    fine = granules(log, key, finest).select("k", "day", "w", F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), F.floor(F.col("g") * finest / m).cast("int").alias("g")) for m in granularities])).alias("x"))
    days = fine.select("x.minutes", "k", "day", "w", "x.g").distinct().groupBy("minutes", "k", "w", "g").agg(F.count(F.lit(1)).alias("days"))
    return days.join(F.broadcast(weekdays_in(log)), "w").select("minutes", "k", "w", "g", "days", (F.col("days") / F.col("dates")).alias("confidence"))  # weekdays: seven rows


def calendar_candidates(log: DataFrame, key: Column, granularities: list[int], confidences: list[float], supports: list[float]) -> DataFrame:
    """(minutes, confidence, support, keys, granules, covered) of every combination: of the calendars of a granularity that keep
    granules of a confidence, the keys whose share of active granules kept reaches the support, their kept granules, and how much of
    all activity these cover."""
    cube = calendar_cube(log, key, granularities).select("minutes", "k", "days", F.col("confidence").alias("_c"), F.explode(F.array(*map(F.lit, confidences))).alias("confidence"))
    kept = F.col("_c") >= F.col("confidence")
    per = cube.groupBy("minutes", "confidence", "k").agg(F.sum("days").alias("all"), F.sum(F.when(kept, F.col("days")).otherwise(0)).alias("good"), F.sum(kept.cast("long")).alias("granules"))
    per = per.select("*", F.explode(F.array(*map(F.lit, supports))).alias("support"))
    reached = F.col("good") >= F.col("support") * F.col("all")
    out = per.groupBy("minutes", "confidence", "support").agg(F.sum(reached.cast("long")).alias("keys"), F.sum(F.when(reached, F.col("granules")).otherwise(0)).alias("granules"), (F.sum(F.when(reached, F.col("good")).otherwise(0)) / F.sum("all")).alias("covered"))
    return out.withColumn("covered", F.round("covered", 6))


def intervals(scores: DataFrame, minutes: int = 60) -> DataFrame:
    """(k, w, begin_min, end_min): kept granules that touch, merged."""
    w = Window.partitionBy("k", "w").orderBy("g")
    islands = scores.filter("kept").withColumn("island", F.col("g") - F.row_number().over(w))
    return islands.groupBy("k", "w", "island").agg((F.min("g") * minutes).alias("begin_min"), ((F.max("g") + 1) * minutes).alias("end_min")).drop("island")


def fuzzy_calendar(log: DataFrame, key: Column, minutes: int = 60, angle: float = 0.5) -> DataFrame:
    """(k, w, g, probability): the share of dates of a weekday on which a key is at work in a granule.

    The first and last granule of a run of work count angle instead of 1: a trapezoid with slopes one granule wide.
    """
    acts = granules(log, key, minutes)
    w = Window.partitionBy("k", "day").orderBy("g")
    edge = (F.coalesce(F.col("g") - F.lag("g").over(w), F.lit(2)) > 1) | (F.coalesce(F.lead("g").over(w) - F.col("g"), F.lit(2)) > 1)
    weighted = acts.withColumn("v", F.when(edge, F.lit(angle)).otherwise(F.lit(1.0))).groupBy("k", "w", "g").agg(F.sum("v").alias("v"))
    return weighted.join(F.broadcast(weekdays_in(log)), "w").select("k", "w", "g", F.round(F.col("v") / F.col("dates"), 6).alias("probability"))


def profile_vectors(log: DataFrame) -> DataFrame:
    """(r, a, n): how often each resource did each activity, zeros included."""
    n = log.groupBy("r", "a").agg(F.count(F.lit(1)).alias("n"))
    return log.select("r").distinct().crossJoin(log.select("a").distinct()).join(n, ["r", "a"], "left").select("r", "a", F.coalesce("n", F.lit(0)).alias("n"))


def profile_correlations(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(r, q, correlation, linked): Pearson correlation of resources' activity vectors, r < q."""
    v = profile_vectors(log)
    x, y = v.alias("x"), v.alias("y")
    out = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.r") < F.col("y.r"))).groupBy(F.col("x.r").alias("r"), F.col("y.r").alias("q")).agg(
        F.count(F.lit(1)).alias("m"), *[F.sum(F.col(a) * F.col(b)).cast("double").alias(n) for n, a, b in (("xy", "x.n", "y.n"), ("xx", "x.n", "x.n"), ("yy", "y.n", "y.n"))], F.sum("x.n").cast("double").alias("sx"), F.sum("y.n").cast("double").alias("sy")
    )
    cov = F.col("m") * F.col("xy") - F.col("sx") * F.col("sy")
    spread = F.sqrt(F.col("m") * F.col("xx") - F.col("sx") ** 2) * F.sqrt(F.col("m") * F.col("yy") - F.col("sy") ** 2)
    c = F.round(cov / F.nullif(spread, F.lit(0.0)), 6)
    return out.select("r", "q", c.alias("correlation"), F.coalesce(c > threshold, F.lit(False)).alias("linked"))


def pools(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(r, pool): components of linked resources, named by their smallest, however long the chains are. Resources with proportional
    counts are one profile; a round takes the smallest label around a profile, and that of the label's own profile."""
    classes = stored(similar.profile_classes(log))
    links = stored(similar.similar_profiles(log, classes, threshold).select(F.col("x").alias("r"), F.col("y").alias("q")))
    ways = links.unionByName(links.select(F.col("q").alias("r"), F.col("r").alias("q")))
    label = stored(classes.select(F.col("profile").alias("r")).distinct().withColumn("pool", F.col("r")))
    while True:
        near = ways.join(label.select(F.col("r").alias("q"), "pool"), "q").groupBy("r").agg(F.min("pool").alias("near"))
        step = label.join(near, "r", "left").select("r", "pool", F.least("pool", F.coalesce("near", "pool")).alias("near"))
        jump = label.select(F.col("r").alias("near"), F.col("pool").alias("far"))
        new = stored(step.join(jump, "near").select("r", F.least("near", "far").alias("pool"), (F.least("near", "far") < F.col("pool")).alias("moved")))
        discard(label)
        label = new.select("r", "pool")
        if new.filter("moved").limit(1).count() == 0:
            break
    return classes.join(label.withColumnRenamed("r", "profile"), "profile").select("r", "pool")


def performance(log: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of durations in whole seconds by activity, resource or both."""
    return moments(log, F.floor((F.col("e") - F.col("s")) / F.lit(1e6)), keys)


QUANTILES = [round(x / 20 + 0.025, 3) for x in range(20)]
#: The normal distribution's values at QUANTILES.
NORMAL = [round(statistics.NormalDist().inv_cdf(p), 6) for p in QUANTILES]


def _digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function, by its recurrence and its asymptotic series."""
    y = x + 6
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum((1 / (x + i) for i in range(6)), F.lit(0.0))


def _trigamma(x: Column) -> Column:
    y = x + 6
    return 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) + sum((1 / (x + i) ** 2 for i in range(6)), F.lit(0.0))


NEWTON_STEPS = 3


def gamma_shape(rows: DataFrame, spread: str, name: str) -> DataFrame:
    """rows with the most likely shape of gamma-distributed values, whose logarithm of the mean exceeds the mean logarithm by the
    column `spread`: Minka's closed start and NEWTON_STEPS Newton steps. Values that are all alike have a very large one."""
    s = F.col(spread)
    start = (3 - s + F.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    step = lambda k, _: k - (F.log(k) - _digamma(k) - s) / (1 / k - _trigamma(k))
    return rows.withColumn(name, F.when(s > 1e-9, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)).otherwise(F.lit(1e12)))


def best_distribution(log: DataFrame, key: str = "a") -> DataFrame:
    """(key, family, mean, std, error): of fixed, uniform, exponential, normal, triangular, log-normal and gamma durations, fitted
    by moments, the last by likelihood, the one whose quantiles are nearest to the observed ones, the simpler of equals; one row a key.

    Observed quantiles are exact, from counts of equal durations, so a key's values are never together. Those of the gamma distribution
    are Wilson and Hilferty's."""
    v = log.select(F.col(key).alias("k"), F.floor((F.col("e") - F.col("s")) / F.lit(1e6)).cast("double").alias("v"))
    above = F.greatest("v", F.lit(1.0))
    x = v.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg(above).alias("positive"), F.avg(F.log(above)).alias("logs"))
    q = quantiles.exact(v, ["k"], ["v"], QUANTILES).select(F.col("k").alias("_k"), F.col("q")[0].alias("q"))
    x = x.join(q, F.col("k").eqNullSafe(F.col("_k"))).drop("_k")
    x = gamma_shape(x.filter("mean IS NOT NULL").withColumn("spread", F.log("positive") - F.col("logs")), "spread", "shape")
    z = NORMAL
    m, s, lo, hi = (F.col(c) for c in ("mean", "std", "lo", "hi"))
    mode = F.least(F.greatest(3 * m - lo - hi, lo), hi)
    sigma2 = F.log(1 + s * s / F.greatest(m * m, F.lit(1e-9)))
    mu = F.log(F.greatest(m, F.lit(1e-9))) - sigma2 / 2

    def triangular(p):
        cut = (mode - lo) / F.greatest(hi - lo, F.lit(1e-9))
        return F.when(F.lit(p) < cut, lo + F.sqrt(F.lit(p) * (hi - lo) * (mode - lo))).otherwise(hi - F.sqrt((1 - F.lit(p)) * (hi - lo) * (hi - mode)))

    families = {
        "fix": [m for _ in QUANTILES],
        "uniform": [lo + (hi - lo) * p for p in QUANTILES],
        "expon": [lo - (m - lo) * math.log(1 - p) for p in QUANTILES],
        "norm": [m + s * t for t in z],
        "triang": [triangular(p) for p in QUANTILES],
        "lognorm": [F.exp(mu + F.sqrt(sigma2) * t) for t in z],
    }
    error = lambda qs: sum((F.abs(F.col("q")[i] - q) for i, q in enumerate(qs)), F.lit(0.0)) / len(qs)
    gamma = lambda t: F.col("positive") * (1 - 1 / (9 * F.col("shape")) + t / (3 * F.sqrt("shape"))) ** 3
    apart = F.aggregate(F.zip_with("q", F.array(*map(F.lit, z)), lambda q, t: F.abs(q - gamma(t))), F.lit(0.0), lambda acc, x: acc + x) / len(z)
    errors = {name: error(qs) for name, qs in families.items()} | {"gamma": apart}
    scored = x.select("k", "mean", "std", F.explode(F.array(*[F.struct(F.round(e, 9).alias("error"), F.lit(nth).alias("nth"), F.lit(name).alias("family")) for nth, (name, e) in enumerate(errors.items())])).alias("f"))
    best = scored.groupBy("k", "mean", "std").agg(F.min("f").alias("f"))
    return best.select(F.col("k").alias(key), "f.family", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("f.error", 4).alias("error"))


def repair_missing(model_activities: DataFrame, log: DataFrame, resources: DataFrame, known: DataFrame) -> DataFrame:
    """(a, r, family, mean): for activities (a) that `known` (a) lacks, every resource (r) with the log's fitted duration;
    activities without data take a fixed second."""
    missing = model_activities.select("a").distinct().join(known.select("a").distinct(), "a", "left_anti")
    fitted = best_distribution(log.join(missing, "a", "left_semi"), "a").select("a", "family", "mean")
    rows = missing.join(fitted, "a", "left").crossJoin(resources.select("r").distinct())
    return rows.select("a", "r", F.coalesce("family", F.lit("fix")).alias("family"), F.coalesce("mean", F.lit(1.0)).alias("mean"))
