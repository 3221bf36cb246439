"""How activities change numeric attributes: constants, linear expressions, small trees, tables of values, or a spread.

For each activity and attribute, x is the value at the event before in the case and y the value at its own. Least squares come
from mergeable sums. A tree of depth two comes from sums of y by the place of x among cut points (quantiles): of all ways to cut the
places into four neighbouring runs, two cuts below a first one, the one that leaves least squares. The simplest kind that
explains the share `least` of y's variance is taken: a constant, a line, a tree; else a table if y has few values, else mean
and deviation.

Scale: the steps are stored once; aggregates of them by activity and attribute, and by value for distinct values, exact quantiles and sums of y.
The cuts are tried over at most CUTS rows a group.
Edge cases: a case's first event and nulls tell nothing; an activity without steps has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, stored
from . import quantiles

CUTS, VALUES, LEAST = 16, 20, 0.95
KEYS = ["attribute", "a"]


def _steps(log: DataFrame, attributes: list[str]) -> DataFrame:
    """(a, _0, _1, ...): at each event, the values (x, y) of every attribute before and after."""
    w = Window.partitionBy("c").orderBy("e", "eid")
    return log.select("a", *[F.struct(F.lag(F.col(k).cast("double")).over(w).alias("x"), F.col(k).cast("double").alias("y")).alias(f"_{n}") for n, k in enumerate(attributes)])


def _stacked(steps: DataFrame, attributes: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k).alias("attribute"), f"_{n}.x", f"_{n}.y") for n, k in enumerate(attributes)])
    return steps.select("a", F.explode(each).alias("s")).select("s.attribute", "a", "s.x", "s.y").filter("x IS NOT NULL AND y IS NOT NULL")


def changes(log: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, a, x, y) of a log (c, a, e, eid, attributes)."""
    return _stacked(_steps(log, attributes), attributes)


def updates(log: DataFrame, attributes: list[str], least: float = LEAST) -> DataFrame:
    """(attribute, a, n, kind, mean, std, values, intercept, slope, line_r2, tree_r2, cuts) of a log; cuts: (low, first, high), null
    where a run is not cut again."""
    steps = stored(_steps(log, attributes))
    rows = _stacked(steps, attributes)
    sums = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")
    )
    values = rows.select(*KEYS, "y").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("values"))
    at = stored(rows.groupBy(F.struct(*KEYS).alias("_key"), F.col("x").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_y")))
    points = quantiles.counted(at, [k / CUTS for k in range(1, CUTS)]).select("_key.*", F.array_sort(F.array_distinct("q")).alias("points"))
    facts = stored(sums.join(values, KEYS).join(points, KEYS))
    discard(steps)
    # sums of y, its mean taken off, by the place of x among the cut points
    coded = at.select("_key.*", "_v", "_n", "_y").join(facts.select(*KEYS, "mean", "points"), KEYS)
    code = F.size(F.filter("points", lambda c: F.col("_v") > c))
    sums = coded.groupBy(*KEYS, code.alias("code")).agg(F.sum("_n").alias("n"), F.sum(F.col("_y") - F.col("_n") * F.col("mean")).alias("s"))
    upto = Window.partitionBy(*KEYS).orderBy("code")
    run = sums.withColumn("n_upto", F.sum("n").over(upto)).withColumn("s_upto", F.sum("s").over(upto))
    zero = F.array(F.struct(F.lit(-1).alias("code"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")))
    ends = run.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("code", F.col("n_upto").alias("n"), F.col("s_upto").alias("s")))).alias("p")).withColumn("p", F.concat(zero, "p"))
    last = F.size("p") - 1
    tried = ends.select(*KEYS, "p", last.alias("m"), F.explode(F.sequence(F.lit(0), last)).alias("t"))
    tried = tried.select("*", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("u")).select("*", F.explode(F.sequence(F.col("t"), F.col("m"))).alias("v"))
    of = lambda i, j: F.coalesce(F.pow(j["s"] - i["s"], F.lit(2)) / F.nullif(j["n"] - i["n"], F.lit(0)), F.lit(0.0))
    p = lambda k: F.col("p")[k]
    gain = F.round(of(p(F.lit(0)), p(F.col("u"))) + of(p(F.col("u")), p(F.col("t"))) + of(p(F.col("t")), p(F.col("v"))) + of(p(F.col("v")), p(F.col("m"))), 6)
    at = lambda k: p(F.col(k))["code"]
    best = tried.groupBy(*KEYS).agg(F.min(F.struct((-gain).alias("less"), at("t").alias("t"), at("u").alias("u"), at("v").alias("v"), at("m").alias("m"))).alias("b"))
    spread = F.col("std") * F.col("std") * F.col("n")
    point = lambda k, low, high: F.when((F.col(f"b.{k}") > low) & (F.col(f"b.{k}") < high), F.get("points", F.col(f"b.{k}")))
    cuts = F.struct(point("u", F.lit(-1), F.col("b.t")).alias("low"), point("t", F.lit(-1), F.col("b.m")).alias("first"), point("v", F.col("b.t"), F.col("b.m")).alias("high"))
    line = F.coalesce(F.round("r2", 6), F.lit(0.0))
    tree = F.coalesce(F.round(-F.col("b.less") / F.nullif(spread, F.lit(0.0)), 6), F.lit(0.0))
    kind = F.when(F.col("std") == 0, "constant").when(line >= least, "linear").when(tree >= least, "tree").when(F.col("values") <= VALUES, "table").otherwise("spread")
    out = facts.join(best, KEYS).select(*KEYS, "n", kind.alias("kind"), "mean", "std", "values", "intercept", "slope", line.alias("line_r2"), tree.alias("tree_r2"), cuts.alias("cuts"))
    return out


def expression(attribute: str = "attribute") -> F.Column:
    """The update of a row of updates() as a text over the attribute's own name; null for tables, trees and spreads."""
    number = lambda c: F.format_string("%.6g", F.col(c))
    return F.when(F.col("kind") == "constant", number("mean")).when(F.col("kind") == "linear", F.concat(number("slope"), F.lit(" * "), F.col(attribute), F.lit(" + "), number("intercept")))
