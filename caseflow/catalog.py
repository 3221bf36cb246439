"""All queries over event logs, with the SQL that must give the same rows.

The main log is the events table: case user_id, activity event_type, resource k mod 10, end ts, start ts less value
minutes. Queries on two logs compare cases of even and odd number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import attribute_updates as updates
from .operators import calendars, distances, preprocess, rule_learning, rules, run_measures, similar, traces, variants_distance
from .plans import discovery, nesting, replay, rules_json, simulate, tuner
from .sources import bpmn, logs
from .sources.logs import events_log, orders_log, purchases_log
from .streaming import incremental, silence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The main log in DuckDB, and the oracle's concurrency set: no pair (scores of the test log are below every threshold).
LOG = """l AS (SELECT event_id AS eid, user_id AS c, event_type AS a, json_extract_string(props, '$.k')::BIGINT % 10 AS r,
  epoch_us(ts) - floor(value * 60)::BIGINT * 1000000 AS s, epoch_us(ts) AS e, (user_id % 2)::INT AS side FROM events)"""
ORDERS = """o AS (SELECT l_orderkey AS c, l_returnflag || l_linestatus AS a, l_suppkey AS r, epoch_us(least(o_orderdate, l_shipdate)) AS s,
  epoch_us(greatest(o_orderdate, l_shipdate)) AS e, o_orderpriority AS priority, o_orderstatus AS status, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def sided(spark, d) -> DataFrame:
    return events_log(spark, d).withColumn("side", (F.col("c") % 2).cast("int"))


# Traces and directly-follows graphs

STEPS = "x AS (SELECT c, a, e, lead(a) OVER w AS b, lead(a, 2) OVER w AS b2, lead(s) OVER w - e AS gap FROM l WINDOW w AS (PARTITION BY c ORDER BY e, eid))"


@query(f"WITH {LOG}, {STEPS} SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY a, b")
def dfg(spark, d):
    return traces.dfg(events_log(spark, d))


@query(f"WITH {LOG}, {STEPS} SELECT a, b, count(*) AS n, round(avg(gap / 1e6), 3) AS mean_gap_s FROM x WHERE b IS NOT NULL GROUP BY a, b")
def dfg_with_gap(spark, d):
    return traces.dfg_with_gap(events_log(spark, d))


@query(
    f"WITH {LOG}, y AS (SELECT y.eid, max(z.s) AS latest FROM l y JOIN l z ON z.c = y.c AND z.eid <> y.eid AND z.e <= y.s AND (z.s < z.e OR z.e < y.s) GROUP BY y.eid) "
    "SELECT x.a, l.a AS b, count(*) AS n FROM y JOIN l USING (eid) JOIN l x ON x.c = l.c AND x.eid <> l.eid AND (x.e < l.s OR x.e = l.s AND x.s < x.e) AND (x.e > latest OR x.e = latest AND x.s = x.e) GROUP BY 1, 2"
)
def interval_follows(spark, d):
    return traces.interval_follows(events_log(spark, d))


def _grams(n: int) -> str:
    pads = " UNION ALL ".join([f"SELECT DISTINCT c, side, -1e18::DOUBLE AS t, {-j} AS i, '<' AS a FROM l" for j in range(1, n)] + [f"SELECT DISTINCT c, side, 1e18::DOUBLE, {j}, '>' FROM l" for j in range(1, n)])
    cols = ", ".join(f"lag(a, {n - 1 - k}) OVER w AS g{k + 1}" for k in range(n))
    return f"p AS (SELECT c, side, e::DOUBLE AS t, eid AS i, a FROM l UNION ALL {pads}), q AS (SELECT side, {cols} FROM p WINDOW w AS (PARTITION BY c ORDER BY t, i)), g AS (SELECT * FROM q WHERE g1 IS NOT NULL)"


def _gram_distance(n: int) -> str:
    ks = ", ".join(f"g{k + 1}" for k in range(n))
    return f"WITH {LOG}, {_grams(n)}, z AS (SELECT {ks}, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM g GROUP BY {ks}) SELECT round(sum(abs(x - y)) / sum(x + y), 6) AS distance FROM z"


@query(f"WITH {LOG}, {_grams(2)} SELECT g1, g2, count(*) AS cnt FROM g GROUP BY g1, g2")
def ngram2_counts(spark, d):
    return traces.ngrams(events_log(spark, d), 2)


@query(f"WITH {LOG}, {_grams(3)} SELECT g1, g2, g3, count(*) AS cnt FROM g GROUP BY g1, g2, g3")
def ngram3_counts(spark, d):
    return traces.ngrams(events_log(spark, d), 3)


@query(_gram_distance(2))
def ngram2_distance(spark, d):
    return traces.ngram_distance(sided(spark, d), "side", 2)


@query(_gram_distance(3))
def ngram3_distance(spark, d):
    return traces.ngram_distance(sided(spark, d), "side", 3)


@query(f"WITH {LOG}, t AS (SELECT c, string_agg(a, '>' ORDER BY e, eid) AS variant FROM l GROUP BY c) SELECT variant, count(*) AS cases FROM t GROUP BY variant")
def trace_variants(spark, d):
    return traces.variants(events_log(spark, d))


@query(f"WITH {LOG} SELECT count(DISTINCT c) AS cases, count(*) AS events, min(s) AS first_us, max(e) AS last_us, max((s IS NULL OR e IS NULL)::INT) AS any_null FROM l")
def log_summary(spark, d):
    return traces.log_summary(events_log(spark, d))


@query(f"WITH {LOG} SELECT c, max(e) - min(s) AS cycle_us, count(*) AS events FROM l GROUP BY c")
def case_cycle_times(spark, d):
    return traces.cycle_times(events_log(spark, d))


@query("SELECT conv_id AS c, string_agg(role, '>' ORDER BY turn, role) AS variant FROM conversations GROUP BY conv_id")
def conversation_variants(spark, d):
    t = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("c")).agg(F.array_join(F.transform(t, lambda x: x["role"]), ">").alias("variant"))


# Distances

EMD = """t AS (SELECT side, {k} sum(n) AS tot FROM h GROUP BY side {g}),
dd AS (SELECT {k} b, sum(CASE WHEN h.side = 0 THEN n * 1e0 / tot ELSE -(n * 1e0 / tot) END) AS x FROM h JOIN t USING (side {u}) GROUP BY b {g}),
kk AS (SELECT {k} sum(x) OVER w AS cdf, lead(b) OVER w - b AS gap FROM dd WINDOW w AS ({p} ORDER BY b))"""
PLAIN = EMD.format(k="", g="", u="", p="") + " SELECT round(sum(abs(cdf) * coalesce(gap, 0)), 6) AS distance FROM kk"
WEEK = EMD.format(k="w, ", g=", w", u=", w", p="PARTITION BY w") + """, ss AS (SELECT w, count(DISTINCT side) AS sides FROM h GROUP BY w),
zz AS (SELECT w, sum(abs(cdf) * coalesce(gap, 0)) AS x FROM kk GROUP BY w)
SELECT round(avg(CASE WHEN sides = 2 THEN x ELSE 23e0 END), 6) AS distance FROM zz JOIN ss USING (w)"""
INSTANTS = "i AS (SELECT side, c, s AS t FROM l UNION ALL SELECT side, c, e FROM l)"
HOUR = "floor({} / 3.6e9)::BIGINT"


def _metric(name: str):
    def run(spark, d):
        return distances.METRICS[name](sided(spark, d)).select(F.round("distance", 6).alias("distance"))

    return run


for _name, _metric_name, _sql in (
    ("absolute_emd", "absolute_event_distribution", f"WITH {LOG}, {INSTANTS}, h AS (SELECT side, {HOUR.format('t')} AS b, count(*) AS n FROM i GROUP BY 1, 2), {PLAIN}"),
    ("relative_emd", "relative_event_distribution", f"WITH {LOG}, {INSTANTS}, f AS (SELECT c, min(s) AS f FROM l GROUP BY c), h AS (SELECT side, {HOUR.format('(t - f)')} AS b, count(*) AS n FROM i JOIN f USING (c) GROUP BY 1, 2), {PLAIN}"),
    ("arrival_emd", "case_arrival_distribution", f"WITH {LOG}, f AS (SELECT side, c, min(s) AS f FROM l GROUP BY side, c), h AS (SELECT side, {HOUR.format('f')} AS b, count(*) AS n FROM f GROUP BY 1, 2), {PLAIN}"),
    ("cycle_time_emd", "cycle_time_distribution", f"WITH {LOG}, f AS (SELECT side, c, max(e) - min(s) AS f FROM l GROUP BY side, c), h AS (SELECT side, {HOUR.format('f')} AS b, count(*) AS n FROM f GROUP BY 1, 2), {PLAIN}"),
    ("circadian_emd", "circadian_event_distribution", f"WITH {LOG}, {INSTANTS}, hh AS (SELECT side, {HOUR.format('t')} AS x FROM i), h AS (SELECT side, (x // 24 + 3) % 7 AS w, x % 24 AS b, count(*) AS n FROM hh GROUP BY 1, 2, 3), {WEEK}"),
    ("workforce_emd", "circadian_workforce_distribution", f"WITH {LOG}, hh AS (SELECT side, r, unnest(range({HOUR.format('s')}, {HOUR.format('e')} + 1)) AS x FROM l), y AS (SELECT side, x, count(DISTINCT r) AS k FROM hh GROUP BY side, x), h AS (SELECT side, (x // 24 + 3) % 7 AS w, x % 24 AS b, avg(k) AS n FROM y GROUP BY 1, 2, 3), {WEEK}"),
):
    _f = _metric(_metric_name)
    _f.__name__ = _name
    query(_sql)(_f)


@query(f"WITH {LOG}, f AS (SELECT side, c, max(e) - min(s) AS t FROM l GROUP BY side, c), m AS (SELECT side, avg(t / 3.6e9) AS m FROM f GROUP BY side) SELECT side, round(m, 6) AS mean_hours, round(avg(m) OVER (), 6) AS mean_of_means FROM m")
def cycle_time_avg(spark, d):
    m = traces.cycle_times(events_log(spark, d)).groupBy((F.col("c") % 2).cast("int").alias("side")).agg(F.avg(F.col("cycle_us") / 3.6e9).alias("m"))
    return m.select("side", F.round("m", 6).alias("mean_hours"), F.round(F.avg("m").over(Window.partitionBy()), 6).alias("mean_of_means"))


@query(f"WITH {LOG}, f AS (SELECT c, r % 3 AS kind, max(e) - min(s) AS t FROM l GROUP BY c, r % 3) SELECT (c % 5)::BIGINT AS log, round(avg(t) FILTER (kind = 0) / 1e6, 3) AS k0, round(avg(t) FILTER (kind = 1) / 1e6, 3) AS k1, round(avg(t) FILTER (kind = 2) / 1e6, 3) AS k2 FROM f GROUP BY 1")
def cycle_time_pivot(spark, d):
    f = events_log(spark, d).withColumn("kind", F.col("r") % 3).groupBy("c", "kind").agg((F.max("e") - F.min("s")).alias("t"))
    p = f.groupBy((F.col("c") % 5).alias("log")).pivot("kind", [0, 1, 2]).agg(F.round(F.avg("t") / 1e6, 3))
    return p.withColumnsRenamed({"0": "k0", "1": "k1", "2": "k2"})


# Partitions and concurrency

_SPLIT = "SELECT c, f, n, sum(n) OVER (ORDER BY f, c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 0.8e0 * sum(n) OVER () AS train FROM"
CASES = "k AS (SELECT c, min(s) AS f, count(*) AS n FROM l GROUP BY c)"


@query(f"WITH {LOG}, {CASES}, z AS ({_SPLIT} k) SELECT c, f AS first_us, n AS events, train FROM z")
def split_partitions(spark, d):
    return preprocess.split(events_log(spark, d))


@query(f"WITH {LOG}, {CASES}, z AS ({_SPLIT} k), y AS ({_SPLIT} z WHERE train) SELECT z.c, CASE WHEN NOT z.train THEN 'test' WHEN y.train THEN 'train' ELSE 'validation' END AS part FROM z LEFT JOIN y USING (c)")
def split_64_16_20(spark, d):
    return preprocess.partitions(events_log(spark, d))


_OVER = "ov AS (SELECT x.c, x.eid, y.eid AS other, least(x.a, y.a) AS a, greatest(x.a, y.a) AS b FROM l x JOIN l y ON x.c = y.c AND x.eid < y.eid AND x.s < y.e AND y.s < x.e)"


@query(f"WITH {LOG}, {_OVER} SELECT a, b, count(*) AS n FROM ov GROUP BY a, b")
def overlap_counts(spark, d):
    return preprocess.overlaps(events_log(spark, d)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {LOG}, {_OVER}, h AS (SELECT DISTINCT c, a FROM l), t AS (SELECT x.a, y.a AS b, count(*) AS together FROM h x JOIN h y ON x.c = y.c AND x.a < y.a GROUP BY 1, 2), "
    "v AS (SELECT a, b, count(DISTINCT c) AS n FROM ov WHERE a < b GROUP BY a, b) SELECT t.a, t.b, together, coalesce(n, 0)::BIGINT AS overlapping, round(coalesce(n, 0)::DOUBLE / together, 6) AS ratio, coalesce(n, 0)::DOUBLE / together >= 0.5e0 AS concurrent FROM t LEFT JOIN v USING (a, b)"
)
def overlap_concurrency(spark, d):
    return preprocess.overlap_concurrency(events_log(spark, d))


_HEUR = f"""{STEPS}, one AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY a, b),
two AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS k FROM x WHERE b2 = a AND b <> a GROUP BY 1, 2),
own AS (SELECT a, n / (n + 1.0e0) AS w FROM one WHERE a = b),
sc AS (SELECT p.a, p.b, round((p.n - q.n) / (p.n + q.n + 1.0e0), 6) AS dep, round(coalesce(k, 0) / (coalesce(k, 0) + 1.0e0), 6) AS l2l,
  round(greatest(coalesce(u.w, 0e0), coalesce(v.w, 0e0)), 6) AS l1l
  FROM one p JOIN one q ON p.a = q.b AND p.b = q.a AND p.a < p.b LEFT JOIN two t ON t.a = p.a AND t.b = p.b LEFT JOIN own u ON u.a = p.a LEFT JOIN own v ON v.a = p.b)"""


@query(f"WITH {LOG}, {_HEUR} SELECT *, abs(dep) < 0.75e0 AND l2l < 0.9e0 AND l1l < 0.9e0 AS concurrent FROM sc")
def heuristic_concurrency(spark, d):
    return preprocess.heuristic_concurrency(events_log(spark, d))


def _concurrent(log: DataFrame) -> DataFrame:
    """For enabled times on a random log: pairs whose orders are nearly balanced."""
    return preprocess.heuristic_concurrency(log, 0.02, 1.1, 1.1).filter("concurrent").select("a", "b")


_ENABLED = f"""{_HEUR}, cp AS (SELECT a, b FROM sc WHERE abs(dep) < 0.02e0 UNION ALL SELECT b, a FROM sc WHERE abs(dep) < 0.02e0),
en AS (SELECT l.eid, coalesce(max(y.e), any_value(l.s)) AS enabled_us FROM l LEFT JOIN (SELECT * FROM l) y ON y.c = l.c AND y.eid <> l.eid AND y.e <= l.s AND (y.s < y.e OR y.e < l.s)
  AND NOT EXISTS (SELECT 1 FROM cp WHERE cp.a = l.a AND cp.b = y.a) GROUP BY l.eid)"""


@query(f"WITH {LOG}, {_ENABLED} SELECT eid, enabled_us FROM en")
def enabled_times(spark, d):
    log = events_log(spark, d)
    return preprocess.enabled_times(log, _concurrent(log))


@query(
    f"WITH {LOG}, {_HEUR}, cp AS (SELECT a, b FROM sc WHERE abs(dep) < 0.02e0 UNION ALL SELECT b, a FROM sc WHERE abs(dep) < 0.02e0), "
    "bc AS (SELECT x.eid, max(y.e) AS p FROM l x JOIN l y ON y.c = x.c AND (y.e < x.e OR y.e = x.e AND y.eid < x.eid) AND NOT EXISTS (SELECT 1 FROM cp WHERE cp.a = x.a AND cp.b = y.a) GROUP BY x.eid), "
    "fr AS (SELECT eid, e, lag(e) OVER (PARTITION BY r ORDER BY e, eid) AS f FROM l) SELECT eid, least(coalesce(greatest(p, f), e), e) AS start_us FROM fr LEFT JOIN bc USING (eid)"
)
def estimated_starts(spark, d):
    log = events_log(spark, d)
    return preprocess.estimated_starts(log, _concurrent(log))


@query(
    f"WITH {LOG}, p AS (SELECT r, s AS t FROM l UNION SELECT r, e FROM l), g AS (SELECT r, t, lead(t) OVER (PARTITION BY r ORDER BY t) AS u FROM p), "
    "x AS (SELECT eid, u - t AS len, count(*) OVER (PARTITION BY g.r, g.t) AS k FROM g JOIN l ON l.r = g.r AND l.s < g.u AND l.e > g.t), "
    "y AS (SELECT eid, sum(len / k::DOUBLE) AS w FROM x GROUP BY eid) SELECT l.eid, round(coalesce(w, 0e0) / 1e6, 2) AS worked_s FROM l LEFT JOIN y USING (eid)"
)
def multitask_adjust(spark, d):
    return preprocess.multitask_adjust(events_log(spark, d)).select("eid", F.round(F.col("worked_us") / 1e6, 2).alias("worked_s"))


# Arrivals, calendars, performance

_GAPS = f"{CASES}, gp AS (SELECT c, f, f - lag(f) OVER (ORDER BY f, c) AS gap FROM k)"


@query(f"WITH {LOG}, {_GAPS} SELECT c, f AS arrival_us, gap AS gap_us FROM gp WHERE gap IS NOT NULL")
def interarrivals(spark, d):
    return calendars.interarrivals(events_log(spark, d)).filter("gap_us IS NOT NULL")


_MOMENTS = "count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS least, max(v) AS most, round(avg((v - m) ** 3) / nullif(stddev_pop(v), 0) ** 3, 4) AS skew"


@query(f"WITH {LOG}, {_GAPS}, u AS (SELECT floor(gap / 1e6)::DOUBLE AS v FROM gp WHERE gap IS NOT NULL), y AS (SELECT v, avg(v) OVER () AS m FROM u) SELECT {_MOMENTS} FROM y")
def interarrival_stats(spark, d):
    return calendars.moments(calendars.interarrivals(events_log(spark, d)), F.floor(F.col("gap_us") / 1e6), [])


@query(f"WITH {LOG}, {_GAPS}, u AS (SELECT floor(gap / 9e8)::BIGINT AS bin, count(*) AS cases FROM gp WHERE gap IS NOT NULL GROUP BY 1) SELECT bin, cases, round(cases::DOUBLE / sum(cases) OVER (), 6) AS share FROM u")
def arrival_observed_hist(spark, d):
    return calendars.arrival_histogram(events_log(spark, d))


def _days(log: str) -> str:
    return f"dy AS (SELECT min(floor(s / 8.64e10)) AS a, max(floor(e / 8.64e10)) AS z FROM {log}), wd AS (SELECT (d + 3) % 7 AS w, count(*) AS dates FROM (SELECT unnest(range(a::BIGINT, z::BIGINT + 1)) AS d FROM dy) GROUP BY 1)"


@query(f"WITH {LOG}, {CASES}, ar AS (SELECT f AS s, f AS e FROM k), {_days('ar')}, u AS (SELECT DISTINCT {HOUR.format('s')} AS x FROM ar), g AS (SELECT (x // 24 + 3) % 7 AS w, x % 24 AS g, count(*) AS days FROM u GROUP BY 1, 2) SELECT w::INT AS w, g::INT AS g, days, round(days::DOUBLE / dates, 6) AS confidence FROM g JOIN wd USING (w)")
def arrival_calendar(spark, d):
    a = calendars.interarrivals(events_log(spark, d)).select(F.col("arrival_us").alias("s"), F.col("arrival_us").alias("e"))
    return calendars.crisp_scores(a, F.lit(0), 60).select("w", "g", "days", "confidence")


_GRAN = f"u AS (SELECT DISTINCT r, unnest(range({HOUR.format('s')}, {HOUR.format('e')} + 1)) AS x FROM l), ga AS (SELECT r AS k, (x // 24 + 3) % 7 AS w, x % 24 AS g, count(*) AS days FROM u GROUP BY 1, 2, 3)"


@query(f"WITH {LOG}, {_GRAN} SELECT k, w::INT AS w, g::INT AS g, days FROM ga")
def granule_activity(spark, d):
    return calendars.granule_activity(events_log(spark, d), F.col("r"))


_CRISP = f"{_GRAN}, {_days('l')}, ev AS (SELECT r AS k, count(*) AS n FROM l GROUP BY r), ow AS (SELECT k, n >= 0.4e0 * max(n) OVER () AS own FROM ev), cs AS (SELECT k, w::INT AS w, g::INT AS g, days, round(days::DOUBLE / dates, 6) AS confidence, days::DOUBLE / dates >= 0.1e0 AS kept, own FROM ga JOIN wd USING (w) JOIN ow USING (k))"


@query(f"WITH {LOG}, {_CRISP} SELECT * FROM cs")
def crisp_calendar(spark, d):
    return calendars.crisp_scores(events_log(spark, d), F.col("r"))


@query(f"WITH {LOG}, {_CRISP} SELECT k, round(sum(CASE WHEN kept THEN days ELSE 0 END)::DOUBLE / sum(days), 6) AS support FROM cs GROUP BY k")
def crisp_calendar_support(spark, d):
    return calendars.crisp_support(calendars.crisp_scores(events_log(spark, d), F.col("r")))


@query(f"WITH {LOG}, {_CRISP}, y AS (SELECT k, w, g, g - row_number() OVER (PARTITION BY k, w ORDER BY g) AS i FROM cs WHERE kept) SELECT k, w, (min(g) * 60)::INT AS begin_min, ((max(g) + 1) * 60)::INT AS end_min FROM y GROUP BY k, w, i")
def calendar_intervals(spark, d):
    return calendars.intervals(calendars.crisp_scores(events_log(spark, d), F.col("r")))


_CUBE = ([15, 30, 60, 120, 240], [0.05, 0.1, 0.2, 0.4, 0.6, 0.8], [0.1, 0.3, 0.5, 0.7])


@query(
    f"WITH {LOG}, fi AS (SELECT DISTINCT r AS k, unnest(range(floor(s / 9e8)::BIGINT, floor(e / 9e8)::BIGINT + 1)) AS x FROM l), {_days('l')}, cu AS (SELECT minutes, k, w, g, count(*) AS days FROM (SELECT DISTINCT k, x // 96 AS day, (x // 96 + 3) % 7 AS w, minutes, (x % 96) * 15 // minutes AS g FROM fi, (SELECT unnest({_CUBE[0]}) AS minutes)) GROUP BY ALL), "
    f"ca AS (SELECT minutes, confidence, k, sum(days) AS al, sum(CASE WHEN days::DOUBLE / dates >= confidence THEN days ELSE 0 END) AS good, sum((days::DOUBLE / dates >= confidence)::INT) AS granules FROM cu JOIN wd USING (w), (SELECT unnest({_CUBE[1]}::DOUBLE[]) AS confidence) GROUP BY ALL) "
    f"SELECT minutes::INT AS minutes, confidence, support, sum((good >= support * al)::INT)::BIGINT AS keys, sum(CASE WHEN good >= support * al THEN granules ELSE 0 END)::BIGINT AS granules, round(sum(CASE WHEN good >= support * al THEN good ELSE 0 END) / sum(al)::DOUBLE, 6) AS covered FROM ca, (SELECT unnest({_CUBE[2]}::DOUBLE[]) AS support) GROUP BY ALL"
)
def calendar_candidates(spark, d):
    """All calendars that a search may try, from one count of the finest granules."""
    return calendars.calendar_candidates(events_log(spark, d), F.col("r"), *_CUBE)


@query(
    f"WITH {LOG}, u AS (SELECT DISTINCT r, unnest(range({HOUR.format('s')}, {HOUR.format('e')} + 1)) AS x FROM l), {_days('l')}, "
    "y AS (SELECT r, x, coalesce(x - lag(x) OVER w, 2) > 1 OR coalesce(lead(x) OVER w - x, 2) > 1 AS edge FROM u WINDOW w AS (PARTITION BY r, x // 24 ORDER BY x)), "
    "z AS (SELECT r AS k, (x // 24 + 3) % 7 AS w, x % 24 AS g, sum(CASE WHEN edge THEN 0.5e0 ELSE 1e0 END) AS v FROM y GROUP BY 1, 2, 3) SELECT k, w::INT AS w, g::INT AS g, round(v / dates, 6) AS probability FROM z JOIN wd USING (w)"
)
def fuzzy_calendar(spark, d):
    return calendars.fuzzy_calendar(events_log(spark, d), F.col("r"))


_VEC = "n AS (SELECT r, a, count(*) AS n FROM l GROUP BY r, a), ve AS (SELECT x.r, y.a, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT r FROM l) x CROSS JOIN (SELECT DISTINCT a FROM l) y LEFT JOIN n ON n.r = x.r AND n.a = y.a)"


@query(f"WITH {LOG}, {_VEC}, z AS (SELECT x.r, y.r AS q, round(corr(x.n, y.n), 6) AS correlation FROM ve x JOIN ve y ON x.a = y.a AND x.r < y.r GROUP BY 1, 2) SELECT *, coalesce(correlation > 0.5e0, false) AS linked FROM z")
def pool_profiles(spark, d):
    return calendars.profile_correlations(events_log(spark, d))


@query(
    f"WITH RECURSIVE {LOG}, {_VEC}, z AS (SELECT x.r, y.r AS q, round(corr(x.n, y.n), 6) AS k FROM ve x JOIN ve y ON x.a = y.a AND x.r <> y.r GROUP BY 1, 2), "
    "re AS (SELECT DISTINCT r, r AS q FROM l UNION SELECT re.r, z.q FROM re JOIN z ON z.r = re.q WHERE z.k > 0.5e0) SELECT r, min(q) AS pool FROM re GROUP BY r"
)
def resource_pools(spark, d):
    return calendars.pools(events_log(spark, d))


_BOUGHT = "l AS (SELECT o_custkey AS r, p_name AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
_ALIKE = f"{_VEC}, z AS (SELECT x.r, y.r AS q, round(corr(x.n, y.n), 6) AS k FROM ve x JOIN ve y ON x.a = y.a AND x.r <> y.r GROUP BY 1, 2)"


@query(
    f"WITH {_BOUGHT}, {_ALIKE}, f AS (SELECT r, list(n / t ORDER BY a) AS shape, min(n) = max(n) AS flat FROM (SELECT *, sum(n) OVER (PARTITION BY r)::DOUBLE AS t FROM ve) GROUP BY r), "
    "p AS (SELECT r, CASE WHEN flat THEN r ELSE min(r) OVER (PARTITION BY shape) END AS profile FROM f) SELECT r, profile, (SELECT count(*) FROM z WHERE z.r = p.r AND k > 0.4e0) AS links FROM p"
)
def similar_resources(spark, d):
    return similar.similar_resources(purchases_log(spark, d), 0.4)


@query(f"WITH {_BOUGHT}, {_ALIKE} SELECT r AS x, q AS y, k AS correlation FROM z WHERE r < q AND k > 0.4e0")
def similar_profiles(spark, d):
    from .runtime import stored

    log = purchases_log(spark, d)
    return similar.similar_profiles(log, stored(similar.profile_classes(log)), 0.4)


@query(f"WITH {LOG}, u AS (SELECT a, r, floor((e - s) / 1e6)::DOUBLE AS v FROM l), y AS (SELECT *, avg(v) OVER (PARTITION BY a, r) AS m FROM u) SELECT a, r, {_MOMENTS} FROM y GROUP BY a, r")
def performance_moments(spark, d):
    return calendars.performance(events_log(spark, d), ["a", "r"])


def _best(source: str) -> str:
    """The SQL of calendars.best_distribution over rows (k, v) of a table."""
    qs, z = calendars.QUANTILES, calendars.NORMAL
    mode = "least(greatest(3 * m - lo - hi, lo), hi)"
    cut = f"(({mode}) - lo) / greatest(hi - lo, 1e-9)"
    sigma = "ln(1 + s * s / greatest(m * m, 1e-9))"
    families = {
        "fix": ["m" for _ in qs],
        "uniform": [f"lo + (hi - lo) * {p}e0" for p in qs],
        "expon": [f"lo - (m - lo) * ln(1 - {p}e0)" for p in qs],
        "norm": [f"m + s * {t}e0" for t in z],
        "triang": [f"CASE WHEN {p}e0 < {cut} THEN lo + sqrt({p}e0 * (hi - lo) * ({mode} - lo)) ELSE hi - sqrt((1 - {p}e0) * (hi - lo) * (hi - {mode})) END" for p in qs],
        "lognorm": [f"exp(ln(greatest(m, 1e-9)) - {sigma} / 2 + sqrt({sigma}) * {t}e0)" for t in z],
        "gamma": [f"po * power(1 - 1 / (9 * gk) + {t}e0 / (3 * sqrt(gk)), 3)" for t in z],
    }
    y = "(gk + 6)"
    digamma = f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - (" + " + ".join(f"1 / (gk + {i})" for i in range(6)) + "))"
    trigamma = f"(1 / {y} + 1 / (2 * {y} ** 2) + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7) + " + " + ".join(f"1 / (gk + {i}) ** 2" for i in range(6)) + ")"
    newton = ", ".join(f"bg{n + 1} AS (SELECT * EXCLUDE (gk), CASE WHEN sp > 1e-9 THEN gk - (ln(gk) - {digamma} - sp) / (1 / gk - {trigamma}) ELSE gk END AS gk FROM bg{n})" for n in range(calendars.NEWTON_STEPS))
    rows = " UNION ALL ".join(
        f"SELECT k, m, s, {nth} AS nth, '{name}' AS family, round((" + " + ".join(f"abs(q[{i + 1}] - ({x}))" for i, x in enumerate(xs)) + f") / {len(xs)}e0, 9) AS error FROM bx"
        for nth, (name, xs) in enumerate(families.items())
    )
    return f"""by0 AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi, quantile_disc(v, [{", ".join(f"{p}e0" for p in qs)}]) AS q, avg(greatest(v, 1)) AS po, ln(avg(greatest(v, 1))) - avg(ln(greatest(v, 1))) AS sp FROM {source} GROUP BY k),
bg0 AS (SELECT *, CASE WHEN sp > 1e-9 THEN (3 - sp + sqrt((sp - 3) ** 2 + 24 * sp)) / (12 * sp) ELSE 1e12 END AS gk FROM by0), {newton}, bx AS MATERIALIZED (SELECT * FROM bg{calendars.NEWTON_STEPS}),
bf AS ({rows}), bd AS (SELECT * FROM bf QUALIFY row_number() OVER (PARTITION BY k ORDER BY error, nth) = 1)"""


_SECONDS = "sec AS (SELECT a AS k, floor((e - s) / 1e6)::DOUBLE AS v FROM l)"


@query(f"WITH {LOG}, {_SECONDS}, {_best('sec')} SELECT k AS a, family, round(m, 4) AS mean, round(s, 4) AS std, round(error, 4) AS error FROM bd")
def best_distribution(spark, d):
    return calendars.best_distribution(events_log(spark, d))


@query(
    f"WITH {LOG}, {_SECONDS}, mi AS (SELECT DISTINCT a FROM l WHERE a NOT IN (SELECT a FROM l WHERE r < 3 AND a <> 'error')), {_best('sec')} "
    "SELECT mi.a, re.r, coalesce(family, 'fix') AS family, coalesce(round(m, 4), 1e0) AS mean FROM mi LEFT JOIN bd ON bd.k = mi.a CROSS JOIN (SELECT DISTINCT r FROM l) re"
)
def missing_activities_repair(spark, d):
    log = events_log(spark, d)
    known = log.filter("r < 3 AND a <> 'error'").select("a")
    return calendars.repair_missing(log.select("a"), log, log.select("r"), known)


@query(f"WITH {LOG} SELECT DISTINCT a FROM l WHERE a NOT IN (SELECT a FROM l WHERE a < 'e')")
def activities_missing(spark, d):
    log = events_log(spark, d)
    return rules.set_difference(log, log.filter("a < 'e'"), "a")


# Attributes

_NAMES = "y AS (SELECT c, a, e, line, 'priority' AS attribute, priority AS v FROM o UNION ALL SELECT c, a, e, line, 'status', status FROM o UNION ALL SELECT c, a, e, line, 'r', r::VARCHAR FROM o)"


@query(f"WITH {ORDERS}, {_NAMES}, z AS (SELECT attribute, c, count(DISTINCT v) = 1 AS one FROM y GROUP BY attribute, c), t AS (SELECT attribute, count(*) AS cases, sum(one::INT)::BIGINT AS constant FROM z GROUP BY attribute) SELECT *, round(constant::DOUBLE / cases, 6) AS share, constant::DOUBLE / cases >= 0.95e0 AS is_case FROM t")
def case_attributes(spark, d):
    return rules.case_attribute_scores(orders_log(spark, d), ["priority", "status", "r"])


@query(f"WITH {LOG}, y AS (SELECT 'r' AS attribute, c, a, e, eid, r::VARCHAR AS v FROM l UNION ALL SELECT 'side', c, a, e, eid, side::VARCHAR FROM l), z AS (SELECT *, lag(v) OVER (PARTITION BY attribute, c ORDER BY e, eid) AS p FROM y) SELECT attribute, a, count(*) AS events, sum((p IS NOT NULL AND p <> v)::INT)::BIGINT AS changes, round(sum((p IS NOT NULL AND p <> v)::INT)::DOUBLE / count(*), 6) AS share FROM z GROUP BY attribute, a")
def event_attributes(spark, d):
    return rules.event_attribute_scores(sided(spark, d), ["r", "side"])


@query(f"WITH {LOG}, y AS (SELECT 'a' AS attribute, {HOUR.format('e')} AS h, a AS v FROM l UNION ALL SELECT 'side', {HOUR.format('e')}, side::VARCHAR FROM l), z AS (SELECT attribute, h, min(v) = max(v) AS one FROM y GROUP BY attribute, h HAVING count(*) > 1) SELECT attribute, count(*) AS windows, sum(one::INT)::BIGINT AS agreeing, round(sum(one::INT)::DOUBLE / count(*), 6) AS share FROM z GROUP BY attribute")
def global_attributes(spark, d):
    return rules.global_attribute_scores(sided(spark, d), ["a", "side"])


@query(f"WITH {ORDERS}, {_NAMES}, z AS (SELECT attribute, count(DISTINCT v) AS \"distinct\", min((try_cast(v AS DOUBLE) IS NOT NULL)::INT) AS \"numeric\" FROM y GROUP BY attribute) SELECT *, CASE WHEN \"distinct\" <= 20 OR \"numeric\" = 0 THEN 'discrete' ELSE 'continuous' END AS kind FROM z")
def attribute_types(spark, d):
    return rules.attribute_types(orders_log(spark, d), ["priority", "status", "r"])


def _learned(source: str, numbers: list[str], names: list[str], outcome: str | None = None) -> str:
    """The SQL of rule_learning.learn over rows (g, y, hold, v0.., s0..): its rounds, one after the other."""
    n, cuts = len(numbers), rule_learning.CUTS
    ks, ss = [f"k{i}" for i in range(n)], [f"s{i}" for i in range(len(names))]
    cols = ", ".join([*ks, *ss])
    part = ", ".join(f"{k / cuts}" for k in range(1, cuts))
    points = ", ".join(f"list_sort(list_distinct(quantile_disc(v{i}::DOUBLE, [{part}]))) AS c{i}" for i in range(n))
    code = ", ".join(f"CASE WHEN v{i} IS NOT NULL THEN len(list_filter(c{i}, lambda c: v{i} > c)) END AS k{i}" for i in range(n))
    ctes = [
        f"lx AS MATERIALIZED (SELECT * FROM {source} WHERE y IS NOT NULL)",
        f"lc AS MATERIALIZED (SELECT g{', ' + points if n else ''} FROM lx GROUP BY g)",
        f"le AS MATERIALIZED (SELECT g, y AS own, {cols}, sum(1 - hold) AS gn, sum(hold) AS hn FROM (SELECT lx.g, y, hold::INT AS hold{', ' + code if n else ''}{''.join(', ' + x for x in ss)} FROM lx JOIN lc ON lc.g = lx.g) GROUP BY ALL)",
        f"lt AS (SELECT DISTINCT g, {'own' if outcome is None else repr(outcome)} AS y FROM le WHERE g IN (SELECT g FROM le GROUP BY g HAVING count(DISTINCT own) > 1))",
        f"l0 AS MATERIALIZED (SELECT le.g, y, {cols}, sum(CASE WHEN own = y THEN gn ELSE 0 END) AS p, sum(CASE WHEN own <> y THEN gn ELSE 0 END) AS n, sum(CASE WHEN own = y THEN hn ELSE 0 END) AS hp, sum(CASE WHEN own <> y THEN hn ELSE 0 END) AS hq FROM le JOIN lt ON lt.g = le.g GROUP BY ALL)",
    ]
    met = lambda c: "coalesce(CASE " + " ".join([f"WHEN {c}.attr = {i} THEN CASE WHEN {c}.op = '>' THEN k{i} > {c}.code ELSE k{i} <= {c}.code END" for i in range(n)] + [f"WHEN {c}.attr = {n + i} THEN {c}.val = s{i}" for i in range(len(ss))]) + " END, false)"
    told = "round((sum(hp) - sum(hq)) / nullif(sum(hp) + sum(hq), 0)::DOUBLE, 6)"
    left, found = "l0", []
    for r in range(rule_learning.RULES):
        cur = left
        for j in range(rule_learning.CONDITIONS):
            x = f"{r}_{j}"
            each = [f"SELECT g, y, {i} AS attr, k{i} AS code, NULL::VARCHAR AS val, sum(p) AS p, sum(n) AS n FROM {cur} GROUP BY ALL" for i in range(n)] + [f"SELECT g, y, {n + i}, NULL::INT, s{i}, sum(p), sum(n) FROM {cur} GROUP BY ALL" for i in range(len(ss))]
            most = "CASE attr " + " ".join(f"WHEN {i} THEN len(c{i})" for i in range(n)) + " END" if n else "0"
            ctes += [
                f"e{x} AS MATERIALIZED ({' UNION ALL '.join(each)})",
                f"c{x} AS (SELECT e.g, y, attr, '<=' AS op, code, val, sum(p) OVER w AS p, sum(n) OVER w AS n, {most} AS most FROM e{x} e JOIN lc ON lc.g = e.g WHERE code IS NOT NULL WINDOW w AS (PARTITION BY e.g, y, attr ORDER BY code) "
                f"UNION ALL SELECT g, y, attr, '>', code - 1, val, sum(p) OVER w, sum(n) OVER w, 99 FROM e{x} WHERE code IS NOT NULL WINDOW w AS (PARTITION BY g, y, attr ORDER BY code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) UNION ALL SELECT g, y, attr, '=', code, val, p, n, 99 FROM e{x} WHERE val IS NOT NULL)",
                f"t{x} AS (SELECT g, y, sum(p) AS ap, sum(n) AS an FROM {cur} GROUP BY g, y)",
                f"b{x} AS MATERIALIZED (SELECT g, y, {j} AS step, {{'attr': attr, 'op': op, 'code': code, 'val': val}} AS cond FROM (SELECT c.*, round(p * (log2(p / (p + n)::DOUBLE) - log2(ap / (ap + an)::DOUBLE)), 6) AS gain FROM c{x} c JOIN t{x} t USING (g, y) WHERE p > 0 AND (code IS NULL OR (code >= 0 AND (op = '>' OR code < most)))) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY g, y ORDER BY gain DESC, attr, op, code, val) = 1)",
                f"u{x} AS MATERIALIZED (SELECT u.* FROM {cur} u JOIN b{x} b ON b.g = u.g AND b.y = u.y WHERE {met('b.cond')})",
                f"h{x} AS (SELECT b.*, (SELECT {told} FROM u{x} u WHERE u.g = b.g AND u.y = b.y) AS telling FROM b{x} b)",
            ]
            cur = f"u{x}"
        ctes += [
            f"g{r} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM h{r}_{j}' for j in range(rule_learning.CONDITIONS))})",
            f"a{r} AS (SELECT g, y, {told} AS alone FROM {left} GROUP BY g, y)",
            f"z{r} AS (SELECT g, y, step AS last FROM (SELECT g, y, step, telling FROM g{r} WHERE telling IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, y ORDER BY telling DESC, step) = 1) JOIN a{r} USING (g, y) WHERE telling > alone)",
            f"w{r} AS (SELECT g, y, list(cond ORDER BY step) AS rule FROM g{r} JOIN z{r} USING (g, y) WHERE step <= last GROUP BY g, y)",
            f"m{r} AS MATERIALIZED (SELECT q.*, rule, len(list_filter(rule, lambda d: NOT {met('d')})) = 0 AS met FROM {left} q JOIN w{r} w ON w.g = q.g AND w.y = q.y)",
            f"f{r} AS MATERIALIZED (SELECT g, y, {r} AS rule, rule AS conds, sum(p + hp) AS tp, sum(n + hq) AS fp FROM m{r} WHERE met GROUP BY g, y, m{r}.rule)",
            f"r{r} AS MATERIALIZED (SELECT * EXCLUDE (rule, met) FROM m{r} WHERE NOT met)",
        ]
        left = f"r{r}"
        found.append(f"SELECT * FROM f{r}")
    bound = "CASE attr " + " ".join(f"WHEN {i} THEN list_extract(c{i}, code + 1)" for i in range(n)) + " END" if n else "NULL::DOUBLE"
    name = "CASE attr " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate([*numbers, *names])) + " END"
    ctes += [
        f"fa AS MATERIALIZED ({' UNION ALL '.join(found)})",
        "fs AS (SELECT g, y, sum(tp) AS atp, sum(fp) AS afp FROM fa GROUP BY g, y), po AS (SELECT g, y, sum(p + hp) AS positive FROM l0 GROUP BY g, y)",
        "fd AS (SELECT g, y, rule, tp, fp, d.attr AS attr, d.op AS op, d.code AS code, d.val AS val FROM (SELECT * EXCLUDE (conds), unnest(conds) AS d FROM fa))",
        "fo AS (SELECT g, y, rule, tp, fp, attr, op, CASE WHEN op = '>' THEN max(code) ELSE min(code) END AS code, min(val) AS value FROM fd GROUP BY g, y, rule, tp, fp, attr, op)",
        f"learned AS (SELECT fo.g, fo.y, rule, (row_number() OVER (PARTITION BY fo.g, fo.y, rule ORDER BY attr, op) - 1)::INT AS nth, {name} AS attribute, op AS comparison, value, {bound} AS bound, tp::BIGINT AS tp, fp::BIGINT AS fp, round(2e0 * atp / (atp + afp + positive), 6) AS f1 FROM fo JOIN fs ON fs.g = fo.g AND fs.y = fo.y JOIN po ON po.g = fo.g AND po.y = fo.y JOIN lc ON lc.g = fo.g)",
    ]
    return ", ".join(ctes)


_CHANGES = "ch1 AS (SELECT 'r' AS attribute, c, a, e, eid, r::DOUBLE AS y FROM l UNION ALL SELECT 'minutes', c, a, e, eid, (e - s) / 6e7 FROM l UNION ALL SELECT 'since', c, a, e, eid, (e - min(s) OVER (PARTITION BY c)) / 3.6e9 FROM l UNION ALL SELECT 'big', c, a, e, eid, CASE WHEN lag(r) OVER (PARTITION BY c ORDER BY e, eid) > 4 THEN 100e0 ELSE r END FROM l), ch2 AS (SELECT attribute, a, lag(y) OVER (PARTITION BY attribute, c ORDER BY e, eid) AS x, y FROM ch1), ch AS (SELECT * FROM ch2 WHERE x IS NOT NULL AND y IS NOT NULL)"
_POINTS = ", ".join(f"{k / updates.CUTS}" for k in range(1, updates.CUTS))


@query(f"""WITH {LOG}, {_CHANGES}, fa AS MATERIALIZED (SELECT attribute, a, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std, count(DISTINCT y) AS vals, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, list_sort(list_distinct(quantile_disc(x, [{_POINTS}]))) AS points FROM ch GROUP BY attribute, a),
sm AS (SELECT ch.attribute, ch.a, len(list_filter(points, lambda c: x > c)) AS code, count(*) AS n, sum(y - mean) AS s FROM ch JOIN fa ON fa.attribute = ch.attribute AND fa.a = ch.a GROUP BY 1, 2, 3),
ru AS MATERIALIZED (SELECT attribute, a, code, sum(n) OVER w AS n, sum(s) OVER w AS s, max(code) OVER (PARTITION BY attribute, a) AS m FROM sm WINDOW w AS (PARTITION BY attribute, a ORDER BY code) UNION ALL SELECT attribute, a, -1, 0, 0e0, max(code) FROM sm GROUP BY attribute, a),
tr AS (SELECT t.attribute, t.a, t.code AS t, u.code AS u, v.code AS v, m.code AS m, round(coalesce(power(u.s, 2) / nullif(u.n, 0), 0) + coalesce(power(t.s - u.s, 2) / nullif(t.n - u.n, 0), 0) + coalesce(power(v.s - t.s, 2) / nullif(v.n - t.n, 0), 0) + coalesce(power(m.s - v.s, 2) / nullif(m.n - v.n, 0), 0), 6) AS gain
  FROM ru t JOIN ru u ON u.attribute = t.attribute AND u.a = t.a AND u.code <= t.code JOIN ru v ON v.attribute = t.attribute AND v.a = t.a AND v.code >= t.code JOIN ru m ON m.attribute = t.attribute AND m.a = t.a AND m.code = m.m),
be AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY attribute, a ORDER BY gain DESC, t, u, v) = 1),
up AS (SELECT attribute, a, fa.n AS n, vals, round(mean, 4) AS mean, round(std, 4) AS std, round(slope, 4) AS slope, round(intercept, 4) AS intercept, coalesce(round(r2, 6), 0) AS line_r2, coalesce(round(gain / nullif(std * std * fa.n, 0), 6), 0) AS tree_r2,
  CASE WHEN u > -1 AND u < t THEN points[u + 1] END AS low_cut, CASE WHEN t > -1 AND t < m THEN points[t + 1] END AS first_cut, CASE WHEN v > t AND v < m THEN points[v + 1] END AS high_cut FROM fa JOIN be USING (attribute, a))
SELECT attribute, a, n, CASE WHEN std = 0 THEN 'constant' WHEN line_r2 >= 0.95e0 THEN 'linear' WHEN tree_r2 >= 0.95e0 THEN 'tree' WHEN vals <= 20 THEN 'table' ELSE 'spread' END AS kind, mean, std, vals AS distinct_values, intercept, slope, line_r2, tree_r2,
  CASE WHEN attribute IN ('r', 'big') THEN low_cut END AS low_cut, CASE WHEN attribute IN ('r', 'big') THEN first_cut END AS first_cut, CASE WHEN attribute IN ('r', 'big') THEN high_cut END AS high_cut FROM up""")
def attribute_updates(spark, d):
    """How each activity changes the resource, a duration, the time since the case began, and a value with a step."""
    case = Window.partitionBy("c")
    log = events_log(spark, d).withColumn("minutes", (F.col("e") - F.col("s")) / 6e7).withColumn("since", (F.col("e") - F.min("s").over(case)) / 3.6e9)
    log = log.withColumn("big", F.when(F.lag("r").over(case.orderBy("e", "eid")) > 4, F.lit(100.0)).otherwise(F.col("r")))
    u = updates.updates(log, ["r", "minutes", "since", "big"])
    whole = F.col("attribute").isin("r", "big")
    cuts = [F.when(whole, F.col(f"cuts.{k}")).alias(f"{k}_cut") for k in ("low", "first", "high")]
    return u.select("attribute", "a", "n", "kind", *[F.round(k, 4).alias(k) for k in ("mean", "std", "intercept", "slope")], F.col("values").alias("distinct_values"), "line_r2", "tree_r2", *cuts)


# Batches and priorities

_BATCH = """m AS (SELECT *, max(e) OVER w AS p, row_number() OVER (PARTITION BY a, r ORDER BY s, e, eid) AS rn FROM l WINDOW w AS (PARTITION BY a, r ORDER BY s, e, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (p IS NULL OR s - p > 600000000)::INT AS new FROM m), bs AS (SELECT *, sum(new) OVER (PARTITION BY a, r ORDER BY rn)::BIGINT AS session FROM q),
bk AS (SELECT a, r, session, count(*) AS size, CASE WHEN count(*) = 1 THEN 'single' WHEN min(s) = max(s) AND min(e) = max(e) THEN 'parallel' WHEN max((new = 0 AND s < p)::INT) = 1 THEN 'concurrent' ELSE 'sequential' END AS kind FROM bs GROUP BY a, r, session),
bb AS (SELECT eid, a, r, s, e, session, size, kind FROM bs JOIN bk USING (a, r, session))"""


@query(f"WITH {LOG}, {_BATCH} SELECT eid, session, size, kind, size >= 3 AS batched FROM bb")
def batch_sessions(spark, d):
    return rules.batch_sessions(events_log(spark, d)).select("eid", "session", "size", "kind", "batched")


@query(f"WITH {LOG}, {_BATCH}, y AS (SELECT a, r, session, size, avg((e - s) / 1e6) AS d FROM bb GROUP BY 1, 2, 3, 4) SELECT a, size, count(*) AS batches, round(avg(d), 4) AS mean_s FROM y GROUP BY a, size")
def batch_size_distribution(spark, d):
    return rules.batch_sizes(rules.batch_sessions(events_log(spark, d)))


@query(f"WITH {LOG}, {_ENABLED}, {_BATCH}, y AS (SELECT a, r, session, size, min(s) AS f, min(enabled_us) AS e0, max(least(enabled_us, s)) AS e1 FROM bb JOIN en USING (eid) GROUP BY 1, 2, 3, 4) SELECT a, r, session, size, round((f - least(e1, f)) / 1e6, 3) AS ready_wt_s, round((f - least(e0, f)) / 1e6, 3) AS large_wt_s, ({HOUR.format('f')} % 24)::INT AS daily_hour, (({HOUR.format('f')} // 24 + 3) % 7)::INT AS week_day FROM y")
def batch_firing(spark, d):
    log = events_log(spark, d)
    return rules.batch_firing(rules.batch_sessions(log), preprocess.enabled_times(log, _concurrent(log)))


@query(f"WITH {LOG}, {_BATCH}, y AS (SELECT a, size, unnest(range(2, 7))::INT AS threshold FROM bk), z AS (SELECT a, threshold, sum((size >= threshold)::INT) AS hit, sum((size >= threshold AND size >= 3)::INT) AS good, sum((size >= 3)::INT) AS n FROM y GROUP BY a, threshold) SELECT a, 'batch_size' AS attribute, threshold, round(good::DOUBLE / nullif(hit, 0), 6) AS confidence, round(good::DOUBLE / nullif(n, 0), 6) AS support FROM z")
def batch_rules(spark, d):
    runs = rules.batch_sessions(events_log(spark, d)).select("a", "r", "session", "size").distinct()
    return rules.firing_rules(runs)


_FIRING = f"bf1 AS (SELECT a, r, session, size, min(s) AS f, min(enabled_us) AS e0, max(least(enabled_us, s)) AS e1 FROM bb JOIN en USING (eid) GROUP BY 1, 2, 3, 4), bf2 AS (SELECT a, size, round((f - least(e1, f)) / 1e6, 3) AS rw, round((f - least(e0, f)) / 1e6, 3) AS lw, ({HOUR.format('f')} % 24)::INT AS dh, (({HOUR.format('f')} // 24 + 3) % 7)::INT AS wd FROM bf1)"
_WAITS = ", ".join(f"{t}e0" for t in rules.WAITS_S)


@query(
    f"WITH {LOG}, {_ENABLED}, {_BATCH}, {_FIRING}, cd AS (SELECT a, size, 'batch_ready_wt' AS attribute, '>=' AS comparison, unnest([{_WAITS}]) AS value, rw AS x FROM bf2 UNION ALL SELECT a, size, 'batch_max_wt', '>=', unnest([{_WAITS}]), lw FROM bf2 "
    "UNION ALL SELECT a, size, 'daily_hour', '=', dh::DOUBLE, dh::DOUBLE FROM bf2 UNION ALL SELECT a, size, 'week_day', '=', wd::DOUBLE, wd::DOUBLE FROM bf2), "
    "tl AS (SELECT a, attribute, comparison, value, count(*) AS hit, sum((size >= 3)::INT) AS good FROM cd WHERE x >= value GROUP BY 1, 2, 3, 4), al AS (SELECT a, sum((size >= 3)::INT) AS n FROM bf2 GROUP BY a) "
    "SELECT a, attribute, comparison, value, round(good::DOUBLE / hit, 6) AS confidence, round(good::DOUBLE / nullif(n, 0), 6) AS support FROM tl JOIN al USING (a)"
)
def batch_conditions(spark, d):
    return rules.firing_conditions(batch_firing(spark, d))


_BATCHED = "bx AS (SELECT a AS g, (size >= 3)::VARCHAR AS y, rw AS v0, lw AS v1, dh::DOUBLE AS v2, wd::DOUBLE AS v3, (session + r) % 3 = 0 AS hold FROM bf2)"
_FIRED_BY = ["batch_ready_wt", "batch_max_wt", "daily_hour", "week_day"]


@query(f"WITH {LOG}, {_ENABLED}, {_BATCH}, {_FIRING.replace('SELECT a, size, round', 'SELECT a, r, session, size, round')}, {_BATCHED}, {_learned('bx', _FIRED_BY, [], 'true')} SELECT g AS a, * EXCLUDE (g, y) FROM learned")
def batch_rules_learned(spark, d):
    """Rules, conjunctions of waits, hours and weekdays, that tell what fires a batch."""
    return rules.learned_firing(batch_firing(spark, d)).drop("y", "kept").withColumnRenamed("g", "a")


_TAKES = "ee AS (SELECT l.*, least(enabled_us, s) AS en FROM l JOIN en USING (eid)), ot AS (SELECT y.r, y.a, y.eid, x.eid AS over FROM ee x JOIN ee y ON x.r = y.r AND x.a = y.a AND x.en < y.en AND y.en <= x.s AND y.s < x.s)"


@query(f"WITH {LOG}, {_ENABLED}, {_TAKES} SELECT r, a, eid, over FROM ot")
def priority_overtakes(spark, d):
    log = events_log(spark, d)
    return rules.overtakes(log, preprocess.enabled_times(log, _concurrent(log)))


@query(f"WITH {LOG}, {_ENABLED}, {_TAKES}, v AS (SELECT eid, (c % 4)::BIGINT AS v FROM l), t AS (SELECT x.v AS win, y.v AS lose FROM ot JOIN v x ON x.eid = ot.eid JOIN v y ON y.eid = ot.over WHERE x.v <> y.v), u AS (SELECT win AS v, 1 AS w FROM t UNION ALL SELECT lose, 0 FROM t), z AS (SELECT v AS value, sum(w)::BIGINT AS won, count(*) AS contested, round(sum(w)::DOUBLE / count(*), 6) AS score FROM u GROUP BY v) SELECT *, dense_rank() OVER (ORDER BY score DESC)::INT AS level FROM z")
def priority_rules(spark, d):
    log = events_log(spark, d)
    return rules.priority_counts(log, preprocess.enabled_times(log, _concurrent(log)), log.select("eid", (F.col("c") % 4).alias("v")))


# Gateways and branch conditions

_GATE = f"{STEPS}, df AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY a, b), gw AS (SELECT a AS gateway, b AS path, n AS taken, count(*) OVER w AS ways, sum(n) OVER w AS al FROM df WINDOW w AS (PARTITION BY a))"


@query(f"WITH {LOG}, {_GATE} SELECT gateway, path, round(1e0 / ways, 6) AS equiprobable FROM gw WHERE ways > 1")
def gateway_equiprobable(spark, d):
    return rules.gateways(traces.dfg(events_log(spark, d))).select("gateway", "path", "equiprobable")


@query(f"WITH {LOG}, {_GATE} SELECT gateway, path, taken, round(taken::DOUBLE / al, 6) AS observed FROM gw WHERE ways > 1")
def gateway_discovery(spark, d):
    return rules.gateways(traces.dfg(events_log(spark, d))).select("gateway", "path", "taken", "observed")


_CHOICE = "ch AS (SELECT a AS gateway, lead(a) OVER (PARTITION BY c ORDER BY e, eid) AS path, r, ((e // 3600000000) % 24)::BIGINT AS hour FROM l), cc AS (SELECT * FROM ch WHERE path IS NOT NULL)"
_BRANCH = "y AS (SELECT gateway, path, 'r' AS attribute, r::VARCHAR AS value FROM cc UNION ALL SELECT gateway, path, 'hour', hour::VARCHAR FROM cc), tp AS (SELECT gateway, path, attribute, value, count(*) AS tp FROM y GROUP BY ALL), br AS (SELECT *, 2e0 * tp / (sum(tp) OVER (PARTITION BY gateway, attribute, value) + sum(tp) OVER (PARTITION BY gateway, attribute, path)) AS f FROM tp)"


def _choices(log: DataFrame) -> DataFrame:
    path = F.lead("a").over(Window.partitionBy("c").orderBy("e", "eid"))
    return log.select(F.col("a").alias("gateway"), path.alias("path"), "r", F.pmod(F.floor(F.col("e") / F.lit(3.6e9)), F.lit(24)).alias("hour")).filter("path IS NOT NULL")


@query(f"WITH {LOG}, {_CHOICE}, {_BRANCH} SELECT gateway, path, attribute, value, tp, round(f, 6) AS f1, f >= 0.7e0 AS kept FROM br")
def branch_rules_f1(spark, d):
    return rules.branch_rules(_choices(events_log(spark, d)), ["r", "hour"])


_STEP_EXAMPLES = "sx AS (SELECT a AS g, lead(a) OVER w AS y, r::DOUBLE AS v0, ((e // 3600000000) % 24)::DOUBLE AS v1, (e - s) / 1e6 AS v2, a0 AS s0, eid % 3 = 0 AS hold FROM (SELECT *, first_value(a) OVER (PARTITION BY c ORDER BY e, eid) AS a0 FROM l) WINDOW w AS (PARTITION BY c ORDER BY e, eid))"


@query(f"WITH {LOG}, {_STEP_EXAMPLES}, {_learned('sx', ['r', 'hour', 'seconds'], ['first'])} SELECT g AS gateway, y AS path, * EXCLUDE (g, y) FROM learned")
def branch_rules_learned(spark, d):
    """Rules, conjunctions of intervals and values, for each step that an activity may take next."""
    log = events_log(spark, d)
    w = Window.partitionBy("c").orderBy("e", "eid")
    hour = F.pmod(F.floor(F.col("e") / F.lit(3.6e9)), F.lit(24))
    rows = log.select(F.col("a").alias("g"), F.lead("a").over(w).alias("y"), "r", hour.alias("hour"), ((F.col("e") - F.col("s")) / 1e6).alias("seconds"), F.first("a").over(w).alias("first"), (F.col("eid") % 3 == 0).alias("hold"))
    return rule_learning.learn(rows, ["r", "hour", "seconds"], ["first"]).drop("kept").withColumnsRenamed({"g": "gateway", "y": "path"})


_LINES = "ox AS (SELECT status AS g, a AS y, r::DOUBLE AS v0, line::DOUBLE AS v1, (e - s) / 8.64e10 AS v2, s / 8.64e10 AS v3, priority AS s0, (c + line) % 3 = 0 AS hold FROM o)"


@query(f"WITH {ORDERS}, {_LINES}, {_learned('ox', ['r', 'line', 'days', 'since'], ['priority'])} SELECT g AS status, y AS activity, * EXCLUDE (g, y) FROM learned")
def line_rules_learned(spark, d):
    """Rules for the activity of an order line, by the order's status."""
    day = lambda c: c / F.lit(8.64e10)
    rows = orders_log(spark, d).select(F.col("status").alias("g"), F.col("a").alias("y"), "r", "line", day(F.col("e") - F.col("s")).alias("days"), day(F.col("s")).alias("since"), "priority", ((F.col("c") + F.col("line")) % 3 == 0).alias("hold"))
    return rule_learning.learn(rows, ["r", "line", "days", "since"], ["priority"]).drop("kept").withColumnsRenamed({"g": "status", "y": "activity"})


@query(f"WITH {LOG}, {_CHOICE}, y AS (SELECT gateway, path, hour::DOUBLE AS v, unnest([6e0, 12e0, 18e0]) AS cut FROM cc), z AS (SELECT gateway, path, cut, sum((v > cut)::INT)::BIGINT AS tp, count(*) AS took FROM y GROUP BY 1, 2, 3), f AS (SELECT *, 2e0 * tp / (sum(tp) OVER (PARTITION BY gateway, cut) + took) AS f FROM z) SELECT gateway, path, 'hour' AS attribute, cut, tp, round(f, 6) AS f1, f >= 0.7e0 AS kept FROM f")
def branch_intervals_f1(spark, d):
    return rules.interval_branch_rules(_choices(events_log(spark, d)), "hour", [6.0, 12.0, 18.0])


@query(f"WITH {LOG}, {_GATE}, {_CHOICE}, {_BRANCH}, ids AS (SELECT gateway, path, min(attribute || '=' || value) AS condition_id FROM br WHERE f >= 0.1e0 GROUP BY 1, 2) SELECT g.gateway, g.path, taken, condition_id FROM gw g LEFT JOIN ids USING (gateway, path) WHERE ways > 1")
def gateway_conditions(spark, d):
    log = events_log(spark, d)
    paths = rules.gateways(traces.dfg(log)).select("gateway", "path", "taken")
    return rules.with_rules(paths, rules.branch_rules(_choices(log), ["r", "hour"], 0.1))


@query(f"WITH {LOG} SELECT r, count(*) AS n FROM l WHERE (r = 3 AND e > 1700000000000000) OR (a IN ('click', 'view') AND r > 2 AND r < 7) GROUP BY r")
def rule_filter(spark, d):
    rule = scalars.any_of_all([[("r", "=", 3), ("e", ">", 1700000000000000)], [("a", "in", ["click", "view"]), *scalars.interval_rules("r", 2, 7)]])
    return events_log(spark, d).filter(rule).groupBy("r").agg(F.count(F.lit(1)).alias("n"))


# Rules as JSON and back

def _conditions(rows: str, keys: str) -> str:
    """Alternatives of one condition each, numbered in their order, of a table (keys, attribute, comparison, value)."""
    return f"SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY attribute, comparison, value) - 1)::INT AS alternative, 0 AS nth, attribute, comparison, value FROM {rows}"


_SCORES = "v AS (SELECT eid, (c % 4)::BIGINT AS v FROM l), pt AS (SELECT x.v AS win, y.v AS lose FROM ot JOIN v x ON x.eid = ot.eid JOIN v y ON y.eid = ot.over WHERE x.v <> y.v), pu AS (SELECT win AS v, 1 AS w FROM pt UNION ALL SELECT lose, 0 FROM pt), ps AS (SELECT v AS value, round(sum(w)::DOUBLE / count(*), 6) AS score FROM pu GROUP BY v), pl AS (SELECT value, dense_rank() OVER (ORDER BY score DESC)::INT AS level FROM ps)"


@query(f"WITH {LOG}, {_ENABLED}, {_TAKES}, {_SCORES}, z AS (SELECT level AS priority_level, 'value' AS attribute, '=' AS comparison, value::VARCHAR AS value FROM pl) {_conditions('z', 'priority_level')}")
def priority_rules_json(spark, d):
    return rules_json.conditions_of(rules_json.priority_json(priority_rules(spark, d)), rules_json.PRIORITY, "rules", "priority_level")


@query(f"WITH {LOG}, {_CHOICE}, {_BRANCH}, z AS (SELECT gateway || '_' || path AS id, attribute, '=' AS comparison, value FROM br WHERE f >= 0.1e0 AND value IS NOT NULL) {_conditions('z', 'id')}")
def branch_rules_json(spark, d):
    found = rules.branch_rules(_choices(events_log(spark, d)), ["r", "hour"], 0.1)
    return rules_json.conditions_of(rules_json.branch_json(found), rules_json.BRANCH, "rules", "id")


_FIRED = "fy AS (SELECT a, size, unnest(range(2, 7))::INT AS threshold FROM bk), fz AS (SELECT a, threshold, sum((size >= threshold)::INT) AS hit, sum((size >= threshold AND size >= 3)::INT) AS good FROM fy GROUP BY a, threshold), fr2 AS (SELECT a AS task_id, 'batch_size' AS attribute, '>=' AS comparison, threshold::VARCHAR AS value FROM fz WHERE round(good::DOUBLE / nullif(hit, 0), 6) >= 0.9e0)"


def _batch_json(spark, d) -> DataFrame:
    runs = rules.batch_sessions(events_log(spark, d))
    return rules_json.batch_json(rules.firing_rules(runs.select("a", "r", "session", "size").distinct()), rules.batch_sizes(runs))


@query(f"WITH {LOG}, {_BATCH}, {_FIRED} {_conditions('fr2', 'task_id')}")
def batch_rules_json(spark, d):
    return rules_json.conditions_of(_batch_json(spark, d), rules_json.BATCH, "firing_rules", "task_id")


@query(f"WITH {LOG}, {_BATCH}, {_FIRED}, y AS (SELECT a, r, session, size FROM bk), z AS (SELECT a AS task_id, size::VARCHAR AS key, count(*)::DOUBLE AS value FROM y GROUP BY a, size) SELECT * FROM z WHERE task_id IN (SELECT task_id FROM fr2)")
def batch_sizes_json(spark, d):
    return rules_json.distribution_of(_batch_json(spark, d), "size_distrib")


# Waiting times

_WAIT = "fr AS (SELECT l.*, max(e) OVER (PARTITION BY r ORDER BY s, e, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS free FROM l), wt AS (SELECT f.eid, a, s, least(enabled_us, s) AS en, least(greatest(least(enabled_us, s), coalesce(free, least(enabled_us, s))), s) AS ready FROM fr f JOIN en USING (eid))"


@query(f"WITH {LOG}, {_ENABLED}, {_WAIT} SELECT eid, a, s - en AS wait_us, ready - en AS resource_wait_us, s - ready AS extraneous_us FROM wt")
def waiting_decomposition(spark, d):
    log = events_log(spark, d)
    return rules.waiting(log, preprocess.enabled_times(log, _concurrent(log)))


@query(f"WITH {LOG}, {_ENABLED}, {_WAIT}, y AS (SELECT a, CASE WHEN s > ready THEN (s - ready) / 1e6 END AS x FROM wt) SELECT a, count(*) AS events, count(x) AS delayed, round(avg(x), 3) AS mean_s, round(max(x), 3) AS most_s FROM y GROUP BY a")
def extraneous_naive(spark, d):
    log = events_log(spark, d)
    return rules.extraneous(log, preprocess.enabled_times(log, _concurrent(log)))


@query(f"WITH {LOG}, {_ENABLED}, {_WAIT}, {_GRAN}, op AS (SELECT DISTINCT k, w, g FROM ga), y AS (SELECT wt.eid, wt.a, l.r, unnest(range({HOUR.format('ready')}, {HOUR.format('wt.s')} + 1)) AS x FROM wt JOIN l USING (eid) WHERE wt.s > ready) SELECT eid, a, count(*) AS extraneous_h FROM y JOIN op ON op.k = y.r AND op.w = (x // 24 + 3) % 7 AND op.g = x % 24 GROUP BY eid, a")
def extraneous_on_calendar(spark, d):
    log = events_log(spark, d)
    return rules.extraneous_on_calendar(log, preprocess.enabled_times(log, _concurrent(log)), calendars.granule_activity(log, F.col("r")))


@query(
    f"WITH {LOG}, {_ENABLED}, {_GRAN}, wt1 AS (SELECT l.eid, a, r, s, least(enabled_us, s) AS en FROM l JOIN en USING (eid)), ws AS (SELECT * FROM wt1 WHERE en < s AND r IS NOT NULL), "
    "dy1 AS (SELECT DISTINCT r, unnest(range(floor(en / 8.64e10)::BIGINT, floor(s / 8.64e10)::BIGINT + 1)) AS day FROM ws), hr AS (SELECT DISTINCT r, day * 86400000000 + ga.g * 3600000000 AS t FROM dy1 JOIN ga ON ga.k = r AND ga.w = (day + 3) % 7), "
    "mk AS (SELECT r, t, 0 AS busy, 1 AS duty FROM hr UNION ALL SELECT r, t + 3600000000, 0, -1 FROM hr UNION ALL SELECT r, s, 1, 0 FROM l WHERE s < e UNION ALL SELECT r, e, -1, 0 FROM l WHERE s < e), "
    "pt AS (SELECT r, t, sum(busy) AS busy, sum(duty) AS duty FROM mk WHERE r IS NOT NULL GROUP BY r, t HAVING sum(busy) <> 0 OR sum(duty) <> 0), sw AS (SELECT r, t AS f0, lead(t) OVER w AS f1, sum(busy) OVER w AS busy, sum(duty) OVER w AS duty FROM pt WINDOW w AS (PARTITION BY r ORDER BY t)), "
    "fe1 AS (SELECT * FROM sw WHERE busy = 0 AND duty = 1 AND f1 IS NOT NULL), bs1 AS (SELECT ws.eid, max(least(s, f1) - greatest(en, f0)) AS most FROM ws JOIN fe1 ON fe1.r = ws.r AND f0 < s AND f1 > en GROUP BY ws.eid) "
    "SELECT eid, a, greatest(coalesce(most, 0), 0)::BIGINT AS delay_us FROM ws LEFT JOIN bs1 USING (eid)"
)
def extraneous_largest(spark, d):
    """The longest free stretch, on duty, of each wait."""
    log = events_log(spark, d)
    return rules.extraneous_largest(log, preprocess.enabled_times(log, _concurrent(log)), calendars.granule_activity(log, F.col("r")))


# Exports, hygiene, scalars

@query(
    f"""WITH {LOG} SELECT c::VARCHAR AS "case:concept:name", a AS "concept:name", coalesce(r::VARCHAR, 'UNDEFINED') AS "org:resource",
  strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS start_timestamp, strftime(make_timestamp(e), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS "time:timestamp", eid FROM l"""
)
def xes_export_rows(spark, d):
    return logs.xes_rows(events_log(spark, d))


@query("SELECT c_custkey, trim(c_name) AS c_name, c_nationkey, c_acctbal, trim(c_mktsegment) AS c_mktsegment FROM customer")
def trim_strings(spark, d):
    return logs.trim_strings(spark.read.parquet(f"{d}/customer.parquet"))


@query("SELECT p_partkey, (SELECT max(x) FROM (SELECT unnest(range(1, 1441)) AS x) WHERE 1440 % x = 0 AND x <= p_size * 30)::INT AS granule FROM part")
def nearest_granularity(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", scalars.nearest_divisor(F.col("p_size") * 30).alias("granule"))


@query(f"WITH {LOG} SELECT CASE a WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE a END AS a, count(*) AS n FROM l GROUP BY 1")
def mapped_activities(spark, d):
    return rules.map_column(events_log(spark, d), "a", {"click": "C", "view": "V"}).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG}, x AS (SELECT r, count(*) AS n, min(c) AS c FROM l GROUP BY r), y AS (SELECT r, unnest(['n', 'c', 'last']) AS key, unnest([n, -c, r]) AS value FROM x) SELECT * FROM y")
def merged_maps(spark, d):
    """Two maps a resource, united; the right one has the last word."""
    x = events_log(spark, d).groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"))
    left, right = F.create_map(F.lit("n"), F.col("n"), F.lit("c"), F.col("c")), F.create_map(F.lit("c"), -F.col("c"), F.lit("last"), F.col("r"))
    return x.select("r", F.explode(scalars.merged(left, right)).alias("key", "value"))


# Discovery, variants, tuning, simulation

_PRUNE = f"{STEPS}, df AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL AND a <> b GROUP BY a, b), ed AS (SELECT p.a, p.b, p.n, coalesce(q.n, 0) AS m FROM df p LEFT JOIN df q ON p.a = q.b AND p.b = q.a), fl AS (SELECT *, m > 0 AND abs(n - m)::DOUBLE / (n + m) < 0.05e0 AS concurrent FROM ed), mx AS (SELECT *, max(CASE WHEN NOT concurrent THEN n END) OVER (PARTITION BY a) AS o, max(CASE WHEN NOT concurrent THEN n END) OVER (PARTITION BY b) AS i FROM fl)"


@query(f"WITH {LOG}, {_PRUNE} SELECT a, b, n, concurrent, coalesce(NOT concurrent AND (n = o OR n = i OR (n >= 0.4e0 * o AND n >= 0.4e0 * i)), false) AS kept FROM mx")
def pruned_graph(spark, d):
    return discovery.pruned_graph(events_log(spark, d), discovery.Miner(epsilon=0.05)).withColumn("kept", F.coalesce("kept", F.lit(False)))


_FLOWS = f"""{_PRUNE}, fe AS (SELECT a, lag(a) OVER w IS NULL AS first, lead(a) OVER w IS NULL AS last FROM l WINDOW w AS (PARTITION BY c ORDER BY e, eid)),
eg AS (SELECT a, b FROM mx WHERE NOT concurrent AND (n = o OR n = i OR (n >= 0.4e0 * o AND n >= 0.4e0 * i)) UNION SELECT 'start', a FROM fe WHERE first UNION SELECT a, 'end' FROM fe WHERE last),
sp AS (SELECT a, 'split_' || a AS id FROM eg GROUP BY a HAVING count(*) > 1), jn AS (SELECT b, 'join_' || b AS id FROM eg GROUP BY b HAVING count(*) > 1),
pg AS (SELECT coalesce(sp.id, eg.a) AS source, coalesce(jn.id, eg.b) AS target FROM eg LEFT JOIN sp USING (a) LEFT JOIN jn USING (b) UNION SELECT a, id FROM sp UNION SELECT id, b FROM jn),
pf AS (SELECT source || '__' || target AS id, source, target FROM pg)"""


@query(f"WITH {LOG}, {_FLOWS} SELECT * FROM pf")
def process_graph(spark, d):
    return discovery.process_graph(events_log(spark, d), discovery.Miner(epsilon=0.05))[1]


def _nested(word: str, key: str, item: str, mixed: str, rounds: int = 4) -> str:
    """The SQL of nesting.nest over ne (a, b) and nb (x, y): its rounds, one after the other."""
    w = word[0]
    ctes = [f"{w}0 AS MATERIALIZED (SELECT e.{key} AS k, e.{item} AS id, [e.{item}] AS cover, coalesce((SELECT list(y ORDER BY y) FROM nb JOIN ne f ON f.{item} = y WHERE x = e.{item} AND f.{key} = e.{key}), []::VARCHAR[]) AS future FROM ne e)"]
    links, now = [], f"{w}0"
    steps = [("exclusiveGateway", "future"), ("parallelGateway", "list_sort(list_distinct(list_concat(cover, future)))")] * rounds + [(mixed, "0")]
    for i, (kind, group) in enumerate(steps):
        ctes += [
            f"{w}g{i} AS MATERIALIZED (SELECT k, {group} AS grp, list(id ORDER BY id) AS ids, list_sort(flatten(list(cover))) AS cover, list_sort(list_reduce(list(future), lambda p, q: list_intersect(p, q))) AS future FROM {now} GROUP BY k, grp)",
            f"{w}{i + 1} AS MATERIALIZED (SELECT k, CASE WHEN len(ids) > 1 THEN '{word}_' || k || '_' || substr(sha256('{kind}' || array_to_string(cover, '|')), 1, 12) ELSE ids[1] END AS id, cover, future, ids FROM {w}g{i})",
        ]
        now = f"{w}{i + 1}"
        links.append(f"SELECT k, id AS parent, unnest(ids) AS child, '{kind}' AS kind FROM {now} WHERE len(ids) > 1")
    return ", ".join([*ctes, f"{w}l AS MATERIALIZED ({' UNION ALL '.join(links)})", f"{w}t AS (SELECT k, id AS top FROM {now} WHERE id IN (SELECT parent FROM {w}l))"])


_NESTED = f"""{_PRUNE}, st3 AS (SELECT a, b, b2 FROM x WHERE b IS NOT NULL), ow AS (SELECT a FROM st3 GROUP BY a HAVING avg((a = b)::INT) >= 0.3e0), tu AS (SELECT least(a, b) AS p, greatest(a, b) AS q FROM st3 WHERE a <> b GROUP BY 1, 2 HAVING avg(coalesce((b2 = a)::INT, 0)) >= 0.3e0),
nm AS (SELECT mx.*, NOT concurrent AND (n = o OR n = i OR (n >= 0.4e0 * o AND n >= 0.4e0 * i)) AS kept, EXISTS (SELECT 1 FROM tu WHERE p = least(a, b) AND q = greatest(a, b)) AS turn FROM mx),
nf AS (SELECT a, lag(a) OVER w IS NULL AS first, lead(a) OVER w IS NULL AS last FROM l WINDOW w AS (PARTITION BY c ORDER BY e, eid)),
ne AS MATERIALIZED (SELECT a, b FROM nm WHERE kept OR (concurrent AND turn) UNION SELECT 'start', a FROM nf WHERE first UNION SELECT a, 'end' FROM nf WHERE last), nb AS MATERIALIZED (SELECT a AS x, b AS y FROM nm WHERE concurrent AND NOT turn),
{_nested('split', 'a', 'b', 'exclusiveGateway')}, {_nested('join', 'b', 'a', 'inclusiveGateway')},
nw AS (SELECT coalesce(sl.parent, ne.a) AS source, coalesce(jl.parent, ne.b) AS target FROM ne LEFT JOIN sl ON sl.k = ne.a AND sl.child = ne.b LEFT JOIN jl ON jl.k = ne.b AND jl.child = ne.a UNION SELECT k, top FROM st UNION SELECT top, k FROM jt
  UNION SELECT parent, child FROM sl WHERE child IN (SELECT parent FROM sl) UNION SELECT child, parent FROM jl WHERE child IN (SELECT parent FROM jl)),
nx AS (SELECT CASE WHEN source IN (SELECT a FROM ow) THEN 'again_' || source ELSE source END AS source, CASE WHEN target IN (SELECT a FROM ow) THEN 'loop_' || target ELSE target END AS target FROM nw UNION SELECT 'loop_' || a, a FROM ow UNION SELECT a, 'again_' || a FROM ow UNION SELECT 'again_' || a, 'loop_' || a FROM ow)"""


@query(f"WITH {LOG}, {_NESTED.replace('0.05e0', '0.1e0')} SELECT source || '__' || target AS id, source, target FROM nx")
def process_graph_nested(spark, d):
    """The flows of the process graph with nested gateways and short loops."""
    return nesting.nested_graph(events_log(spark, d), discovery.Miner(epsilon=0.1))[1]


_REPLAY = f"""{_FLOWS}, fs AS (SELECT p.a, min(coalesce(m.concurrent, false)::INT) AS par FROM eg p JOIN eg q ON p.a = q.a AND p.b < q.b LEFT JOIN mx m ON m.a = p.b AND m.b = q.b GROUP BY p.a),
vi AS (SELECT DISTINCT a AS node FROM l UNION SELECT 'start' UNION SELECT 'end'),
cl AS (SELECT source AS a, target AS node, [id] AS path FROM pf JOIN vi ON vi.node = source UNION ALL SELECT cl.a, target, list_append(path, id) FROM cl JOIN pf ON pf.source = cl.node WHERE cl.node NOT IN (SELECT node FROM vi) AND NOT list_contains(path, id)),
sh AS (SELECT a, node AS b, path FROM cl WHERE node IN (SELECT node FROM vi) QUALIFY row_number() OVER (PARTITION BY a, node ORDER BY len(path), path) = 1),
tg AS (SELECT c, a AS b, e, eid FROM l UNION ALL SELECT c, 'end', max(e), 9223372036854775807 FROM l GROUP BY c),
so AS (SELECT y.c, y.b, y.e, y.eid, max({{'e': x.e, 'i': x.eid, 'a': x.a}}) AS last FROM tg y LEFT JOIN (l x JOIN sh ON sh.a = x.a) ON x.c = y.c AND sh.b = y.b AND (x.e < y.e OR x.e = y.e AND x.eid < y.eid) GROUP BY ALL),
st AS (SELECT so.c, so.b, so.e, so.eid, last.i AS src, path FROM so LEFT JOIN sh ON sh.a = coalesce(last.a, 'start') AND sh.b = so.b),
gf AS (SELECT source AS gateway_id, CASE WHEN par = 1 THEN 'parallelGateway' ELSE 'exclusiveGateway' END AS kind, pf.id AS flow_id, count(*) OVER (PARTITION BY source) AS ways FROM pf JOIN sp ON sp.id = source JOIN fs USING (a)),
ex AS (SELECT c, src, e, eid, unnest(path) AS flow_id FROM st), eo AS (SELECT ex.*, gateway_id FROM ex JOIN gf USING (flow_id) WHERE kind = 'exclusiveGateway'),
ch0 AS (SELECT c, src, gateway_id, arg_min(flow_id, {{'e': e, 'i': eid}}) AS chosen FROM eo GROUP BY c, src, gateway_id),
aw AS (SELECT DISTINCT eo.c, eid FROM eo JOIN ch0 ON ch0.c = eo.c AND ch0.src IS NOT DISTINCT FROM eo.src AND ch0.gateway_id = eo.gateway_id WHERE flow_id <> chosen),
rs AS (SELECT st.*, path IS NOT NULL AND row_number() OVER (PARTITION BY st.c, src, b ORDER BY e, st.eid) = 1 AND aw.eid IS NULL AS fits FROM st LEFT JOIN aw ON aw.c = st.c AND aw.eid = st.eid),
tk AS (SELECT DISTINCT c, src, unnest(path) AS flow_id FROM rs WHERE fits), tn AS (SELECT flow_id, count(*) AS taken FROM tk GROUP BY flow_id),
gr AS (SELECT gateway_id, kind, flow_id, coalesce(taken, 0)::BIGINT AS taken, ways FROM gf LEFT JOIN tn USING (flow_id))"""


def _replayed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = events_log(spark, d)
    nodes, flows = discovery.process_graph(log, discovery.Miner(epsilon=0.05))
    return replay.steps(log, nodes, flows), nodes, flows


@query(f"WITH RECURSIVE {LOG}, {_REPLAY} SELECT gateway_id, kind, flow_id, taken, round(coalesce(taken::DOUBLE / nullif(sum(taken) OVER (PARTITION BY gateway_id), 0), 1e0 / ways), 6) AS probability FROM gr")
def gateway_replay(spark, d):
    """How often the steps of the log take each flow out of the gateways of its process graph."""
    return replay.gateway_flows(*_replayed(spark, d))


@query(f"WITH RECURSIVE {LOG}, {_REPLAY} SELECT b AS activity, count(*) AS steps, sum(fits::INT)::BIGINT AS fitting FROM rs GROUP BY b")
def replay_fitness(spark, d):
    """How many steps into each activity the process graph allows."""
    return replay.fitness(_replayed(spark, d)[0])


_TIMED = _FLOWS.removeprefix(STEPS + ", ")


@query(
    f"WITH {LOG}, {_ENABLED}, {_WAIT}, {_TIMED}, ti AS (SELECT DISTINCT a AS task, 'timer_' || substr(sha256(a), 1, 16) AS timer FROM wt WHERE s > ready) "
    "SELECT id, source, coalesce(timer, target) AS target FROM pf LEFT JOIN ti ON task = target UNION ALL SELECT 'flow_' || substr(sha256(timer), 1, 16), timer, task FROM ti"
)
def process_graph_with_timers(spark, d):
    log = events_log(spark, d)
    nodes, flows = discovery.process_graph(log, discovery.Miner(epsilon=0.05))
    slow = rules.extraneous(log, preprocess.enabled_times(log, _concurrent(log))).filter("delayed > 0").select(F.col("a").alias("activity"))
    return bpmn.add_timers(nodes, flows, slow)[1]


_CODES = "co AS (SELECT a, chr((row_number() OVER (ORDER BY a) + 64)::INT) AS code FROM (SELECT DISTINCT a FROM l)), tr AS (SELECT c, string_agg(code, '' ORDER BY e, eid) AS t FROM l JOIN co USING (a) GROUP BY c)"


@query(f"WITH {LOG}, {_CODES}, y AS (SELECT x.c, y.c AS other, x.t AS x, y.t AS y FROM tr x JOIN tr y ON y.c = x.c + 1) SELECT c, other, damerau_levenshtein(x, y)::BIGINT AS steps FROM y")
def variant_distances(spark, d):
    """Each case against the next by number, over whole traces."""
    t = variants_distance.coded_traces(events_log(spark, d))
    x, y = t.alias("x"), t.alias("y")
    pairs = x.join(y, F.col("y.c") == F.col("x.c") + 1).select(F.col("x.c").alias("c"), F.col("y.c").alias("other"), F.col("x.trace").alias("x"), F.col("y.trace").alias("y"))
    return variants_distance.pair_distances(pairs).select("c", "other", "steps")


@query(f"WITH {LOG}, {_CODES}, va AS (SELECT c % 2 AS side, t, count(*) AS n FROM tr GROUP BY 1, 2) SELECT x.t AS x, y.t AS y, x.n AS x_cases, y.n AS y_cases, damerau_levenshtein(x.t, y.t)::BIGINT AS steps FROM va x JOIN va y ON x.side = 0 AND y.side = 1")
def variant_pair_distances(spark, d):
    """Each variant of one log against each of the other, once, over whole traces."""
    log = events_log(spark, d)
    return variants_distance.variant_pairs(log.filter("c % 2 = 0"), log.filter("c % 2 = 1"), log).select("x", "y", "x_cases", "y_cases", "steps")


@query()
def control_flow_distance(spark, d):
    return variants_distance.control_flow_distance(sided(spark, d))


_TRIALS = f"""{_GATE.replace('gw AS', 'gx AS')}, z AS ({_SPLIT} (SELECT c, min(s) AS f, count(*) AS n FROM l GROUP BY c)), xs AS (SELECT x.*, train FROM x JOIN z USING (c) WHERE b IS NOT NULL),
tr AS (SELECT a, b, count(*) AS n FROM xs WHERE train GROUP BY a, b), va AS (SELECT a, b, count(*) AS n FROM xs WHERE NOT train GROUP BY a, b),
th AS (SELECT unnest(range(0, 6))::INT AS trial), mm AS (SELECT a, max(n) AS m FROM tr GROUP BY a),
mo AS (SELECT trial, tr.a, tr.b FROM tr JOIN mm USING (a) CROSS JOIN th WHERE tr.n >= trial / 5e0 * m),
ls AS (SELECT trial, 'uncovered' AS metric, round(1e0 - coalesce(sum(CASE WHEN mo.a IS NOT NULL THEN va.n END), 0) / sum(va.n), 6) AS distance FROM va CROSS JOIN th LEFT JOIN mo USING (trial, a, b) GROUP BY trial
  UNION ALL SELECT trial, 'size', round(count(mo.a) / (SELECT count(*)::DOUBLE FROM tr), 6) FROM th LEFT JOIN mo USING (trial) GROUP BY trial)"""


def _trials(spark, d) -> DataFrame:
    """(trial, metric, distance): graphs pruned at rising thresholds, by validation steps they lack and by their size."""
    log = events_log(spark, d)
    steps = traces.directly_follows(log).join(preprocess.split(log).select("c", "train"), "c")
    train, valid = (steps.filter(F.col("train") == x).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")) for x in (True, False))
    levels = spark.range(0, 6).select(F.col("id").cast("int").alias("trial"))
    model = train.withColumn("m", F.max("n").over(Window.partitionBy("a"))).crossJoin(F.broadcast(levels)).filter(F.col("n") >= F.col("trial") / 5 * F.col("m")).select("trial", "a", "b", F.lit(1).alias("has"))
    lacks = valid.crossJoin(F.broadcast(levels)).join(model, ["trial", "a", "b"], "left").groupBy("trial").agg(F.round(1 - F.coalesce(F.sum(F.when(F.col("has") == 1, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("distance"))
    edges = train.agg(F.count(F.lit(1)).alias("edges"))
    size = levels.join(model, "trial", "left").groupBy("trial").agg(F.count("has").alias("k")).crossJoin(F.broadcast(edges)).select("trial", F.round(F.col("k") / F.col("edges"), 6).alias("distance"))
    named = lambda df, m: df.select("trial", F.lit(m).alias("metric"), "distance")
    return named(lacks, "uncovered").unionByName(named(size, "size"))


@query(f"WITH {LOG}, {_TRIALS} SELECT * FROM ls")
def trial_measurements(spark, d):
    return _trials(spark, d)


@query(f"WITH {LOG}, {_TRIALS} SELECT trial, round(avg(distance), 7) AS loss, 'ok' AS status FROM ls GROUP BY trial")
def trial_table(spark, d):
    return tuner.response(_trials(spark, d))


@query(f"WITH {LOG}, {_TRIALS}, t AS (SELECT trial, round(avg(distance), 7) AS loss, 'ok' AS status FROM ls GROUP BY trial) SELECT * FROM t ORDER BY loss, trial LIMIT 1")
def best_trial(spark, d):
    return tuner.best_trial(tuner.response(_trials(spark, d)))


@query(f"WITH {LOG}, {_TRIALS} SELECT metric, round(avg(distance), 6) AS mean FROM ls GROUP BY metric")
def metric_means(spark, d):
    return _trials(spark, d).groupBy("metric").agg(F.round(F.avg("distance"), 6).alias("mean"))


@query(f"WITH {LOG}, {_TRIALS} SELECT metric, trial, distance, row_number() OVER (PARTITION BY metric ORDER BY distance, trial)::INT AS place FROM ls")
def measurements_sorted(spark, d):
    """Measurements of each metric in rising order, with their place."""
    return _trials(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy("distance", "trial")))


@query(f"WITH {LOG}, {_TRIALS} SELECT metric, arg_min(trial, trial) AS first, min(distance) AS least, max(distance) AS most FROM ls GROUP BY metric")
def measurements_by_group(spark, d):
    return _trials(spark, d).groupBy("metric").agg(F.min_by("trial", "trial").alias("first"), F.min("distance").alias("least"), F.max("distance").alias("most"))


@query(f"WITH {LOG}, {_TRIALS}, t AS (SELECT trial, round(avg(distance), 7) AS loss FROM ls GROUP BY trial) SELECT trial, loss, trial / 5e0 AS eta FROM t ORDER BY loss, trial LIMIT 1")
def best_trial_parameters(spark, d):
    """The best trial with the parameters that are kept of it."""
    kept = spark.range(0, 6).select(F.col("id").cast("int").alias("trial"), (F.col("id") / 5).alias("eta"))
    return tuner.best_trial(tuner.response(_trials(spark, d))).join(kept, "trial").select("trial", "loss", "eta")


@query()
def simulated_log(spark, d):
    log = events_log(spark, d)
    return simulate.simulate(spark, simulate.simulation_model(log), cases=log.select("c").distinct().count(), runs=3)


@query()
def simulate_and_evaluate(spark, d):
    log = events_log(spark, d)
    sim = simulate.simulate(spark, simulate.simulation_model(log), cases=log.select("c").distinct().count(), runs=2)
    return simulate.measure(sim.cache(), log, ["3_gram", "absolute_event_distribution", "cycle_time_distribution"], runs=2)


_RUNS = """rl AS (SELECT (c % 8)::INT AS run, * FROM l UNION ALL SELECT -1, * FROM l), rf AS (SELECT *, min(s) OVER k AS f, max(e) OVER k AS z, row_number() OVER w AS nth, lead(a) OVER w IS NULL AS ends, coalesce(lag(a) OVER w, '<') AS a1, coalesce(lag(a, 2) OVER w, '<') AS a2 FROM rl WINDOW k AS (PARTITION BY run, c), w AS (PARTITION BY run, c ORDER BY e, eid)),
ri AS (SELECT run, f, s AS t FROM rf UNION ALL SELECT run, f, e FROM rf), rh AS (SELECT run, 'absolute_event_distribution' AS metric, 0 AS w, floor(t / 3.6e9)::BIGINT AS b, 1e0 AS n FROM ri UNION ALL SELECT run, 'relative_event_distribution', 0, floor((t - f) / 3.6e9)::BIGINT, 1 FROM ri
  UNION ALL SELECT run, 'case_arrival_distribution', 0, floor(f / 3.6e9)::BIGINT, 1 FROM rf WHERE nth = 1 UNION ALL SELECT run, 'cycle_time_distribution', 0, floor((z - f) / 3.6e9)::BIGINT, 1 FROM rf WHERE nth = 1
  UNION ALL SELECT run, 'circadian_event_distribution', (floor(t / 3.6e9)::BIGINT // 24 + 3) % 7, floor(t / 3.6e9)::BIGINT % 24, 1 FROM ri
  UNION ALL SELECT run, 'circadian_workforce_distribution', (x // 24 + 3) % 7, x % 24, avg(k) FROM (SELECT run, x, count(DISTINCT r) AS k FROM (SELECT run, r, unnest(range(floor(s / 3.6e9)::BIGINT, floor(e / 3.6e9)::BIGINT + 1)) AS x FROM rl) GROUP BY run, x) GROUP BY ALL),
rs1 AS (SELECT run, metric, w, b, sum(n) AS n FROM rh GROUP BY ALL), rp AS (SELECT *, n / sum(n) OVER (PARTITION BY run, metric, w) AS p FROM rs1), rr AS (SELECT DISTINCT run FROM rl WHERE run >= 0),
rd AS (SELECT run, metric, w, b, sum(p) AS d, min(side) AS lo, max(side) AS hi FROM (SELECT run, metric, w, b, p, 0 AS side FROM rp WHERE run >= 0 UNION ALL SELECT rr.run, metric, w, b, -p, 1 FROM rp CROSS JOIN rr WHERE rp.run < 0) GROUP BY ALL),
ra AS (SELECT run, metric, w, lo, hi, abs(sum(d) OVER v) * coalesce(lead(b) OVER v - b, 0) AS area FROM rd WINDOW v AS (PARTITION BY run, metric, w ORDER BY b)), rw AS (SELECT run, metric, w, sum(area) AS x, max(hi) - min(lo) AS sides FROM ra GROUP BY ALL),
rg AS (SELECT run, '2_gram' AS metric, a1 || '|' || a AS g FROM rf UNION ALL SELECT run, '2_gram', a || '|>' FROM rf WHERE ends UNION ALL SELECT run, '3_gram', a2 || '|' || a1 || '|' || a FROM rf UNION ALL SELECT run, '3_gram', a1 || '|' || a || '|>' FROM rf WHERE ends UNION ALL SELECT run, '3_gram', a || '|>|>' FROM rf WHERE ends),
rn AS (SELECT run, metric, g, sum(n) AS n, sum(m) AS m FROM (SELECT run, metric, g, 1 AS n, 0 AS m FROM rg WHERE run >= 0 UNION ALL SELECT rr.run, metric, g, 0, 1 FROM rg CROSS JOIN rr WHERE rg.run < 0) GROUP BY ALL)"""


@query(f"WITH {LOG}, {_RUNS} SELECT run AS run_num, metric, round(avg(CASE WHEN starts_with(metric, 'circadian') AND sides = 0 THEN 23e0 ELSE x END), 6) AS distance FROM rw GROUP BY run, metric UNION ALL SELECT run, metric, round(sum(abs(n - m)) / sum(n + m)::DOUBLE, 6) FROM rn GROUP BY run, metric")
def runs_measured(spark, d):
    """Eight parts of the log, as if they were runs, against the whole, by all metrics at once."""
    log = events_log(spark, d)
    return run_measures.measured(log.withColumn("run_num", (F.col("c") % 8).cast("int")), log, list(run_measures.METRICS))


@query("SELECT (isodow(ts) - 1)::INT AS w, hour(ts)::INT AS h, count(*) AS n FROM events GROUP BY 1, 2")
def stream_circadian(spark, d):
    """The histogram of weekdays and hours as a stream keeps it, after all files have come."""
    from .sources.logs import drained

    rows = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*").select("ts")
    return drained(incremental.circadian(rows))


_GAP_US = 4 * 3_600_000_000


@query(
    f"WITH {LOG}, y AS (SELECT c, a, e, eid, CASE WHEN e - lag(e) OVER (PARTITION BY c ORDER BY e, a) <= {_GAP_US} THEN 0 ELSE 1 END AS new FROM l), z AS (SELECT *, sum(new) OVER (PARTITION BY c ORDER BY e, a ROWS UNBOUNDED PRECEDING) AS run FROM y), "
    f"x AS (SELECT c, min(e) AS begin_us, max(e) AS end_us, count(*) AS events, string_agg(a, '>' ORDER BY e, a) AS trace FROM z GROUP BY c, run) SELECT * FROM x WHERE end_us + {_GAP_US} <= (SELECT max(e) FROM l) - 600000000"
)
def stream_silent_runs(spark, d):
    """Runs of events of a case that have been silent for four hours when the stream has come to its end."""
    from .sources.logs import drained_to_files

    read = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    rows = read.select(F.to_timestamp("ts").alias("ts"), scalars.micros(F.col("ts")).alias("us"), F.col("user_id").alias("c"), F.col("event_type").alias("a"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, silence.PROVIDER)
    try:
        return drained_to_files(silence.silent_runs(rows, _GAP_US))
    finally:
        spark.conf.set(key, before)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
