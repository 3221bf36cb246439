"""Rules that are conjunctions, learned by sequential covering on tables, for all groups and outcomes at once.

Examples (g, y, attributes) become cells: numbers are coded by their place among cut points, quantiles of the group, so that examples
with equal codes are one row with counts; two thirds of them grow rules and a third, by hash, prunes them. For each group and
outcome a rule grows by the condition of largest information gain, `attribute > cut`, `<= cut` or `= value`, counted for all
candidates by one aggregate and running sums over codes. It is cut back to the first conditions that tell best on the
held part, and kept if they tell more than the outcome's share alone. The rows that it covers then leave, and the next rule is
learned from the rest. Sets of rules are judged by F1 over all examples.

Scale: examples are read twice, for cut points (exact quantiles, from counts of equal values) and for cells; everything after works on cells, whose number depends on cuts, attributes and values. The rounds are
bounded: RULES times CONDITIONS. Groups are never put together in one task.

Edge cases: a null attribute meets no condition; a group with one outcome has no rules; examples without group or outcome are left out;
repeated examples count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, stored
from . import quantiles

CUTS, RULES, CONDITIONS = 16, 3, 4
HOLD_PARTS = 3
KEYS = ["g", "y"]


def held(key: Column) -> Column:
    """Whether an example prunes rules instead of growing them."""
    return F.crc32(key.cast("string").cast("binary")) % HOLD_PARTS == 0


def cells(examples: DataFrame, numbers: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, cuts), stored, of examples (g, y, hold, attributes): cells (g, y, codes, values, grow, hold) and cuts (g, cuts), an
    array of cut points for each number."""
    rows = examples.filter("g IS NOT NULL AND y IS NOT NULL").select("g", "y", "hold", *[F.col(k).cast("double").alias(k) for k in numbers], *[F.col(k).cast("string").alias(k) for k in names])
    if numbers:
        points = quantiles.exact(rows, ["g"], numbers, [k / CUTS for k in range(1, CUTS)])
        cuts = stored(points.select("g", F.transform("q", lambda x: F.array_sort(F.array_distinct(x))).alias("cuts")))
    else:
        cuts = stored(rows.select("g").distinct().withColumn("cuts", F.array().cast("array<array<double>>")))
    code = lambda k, at: F.when(F.col(k).isNotNull(), F.size(F.filter(F.col("cuts")[at], lambda c: F.col(k) > c)))
    codes = F.array(*[code(k, at) for at, k in enumerate(numbers)]).cast("array<int>")
    coded = rows.join(cuts, "g").select("g", "y", "hold", codes.alias("codes"), F.array(*names).cast("array<string>").alias("values"))
    hold = F.col("hold").cast("int")
    return stored(coded.groupBy("g", "y", "codes", "values").agg(F.sum(1 - hold).alias("grow"), F.sum(hold).alias("hold"))), cuts


def _meets(condition: Column, codes: Column, values: Column, numbers: int) -> Column:
    """Whether a cell meets a condition (attr, op, code, value)."""
    code, value = F.get(codes, condition["attr"]), F.get(values, condition["attr"] - numbers)
    told = F.when(condition["op"] == "=", value == condition["value"]).when(condition["op"] == ">", code > condition["code"]).otherwise(code <= condition["code"])
    return F.coalesce(told, F.lit(False))


def _conditions(cur: DataFrame, cuts: DataFrame, numbers: int, names: int) -> DataFrame:
    """(g, y, condition): the condition of largest gain of each group and outcome, if any gains."""
    part = lambda at, code, value: F.struct(F.lit(at).alias("attr"), code.alias("code"), value.alias("value"))
    no_code, no_value = F.lit(None).cast("int"), F.lit(None).cast("string")
    parts = [part(k, F.col("codes")[k], no_value) for k in range(numbers)] + [part(numbers + k, no_code, F.col("values")[k]) for k in range(names)]
    each = cur.select(*KEYS, "pos", "neg", F.explode(F.array(*parts)).alias("x")).groupBy(*KEYS, "x.attr", "x.code", "x.value").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    upto = Window.partitionBy(*KEYS, "attr").orderBy("code")
    onward = upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    coded = each.filter("code IS NOT NULL")
    le = coded.select(*KEYS, "attr", F.lit("<=").alias("op"), "code", "value", F.sum("p").over(upto).alias("p"), F.sum("n").over(upto).alias("n")).join(cuts, "g").filter(F.col("code") < F.size(F.col("cuts")[F.col("attr")])).drop("cuts")
    gt = coded.select(*KEYS, "attr", F.lit(">").alias("op"), (F.col("code") - 1).alias("code"), "value", F.sum("p").over(onward).alias("p"), F.sum("n").over(onward).alias("n")).filter("code >= 0")
    eq = each.filter("value IS NOT NULL").select(*KEYS, "attr", F.lit("=").alias("op"), "code", "value", "p", "n")
    total = cur.groupBy(*KEYS).agg(F.sum("pos").alias("all_p"), F.sum("neg").alias("all_n"))
    gain = F.round(F.col("p") * (F.log2(F.col("p") / (F.col("p") + F.col("n"))) - F.log2(F.col("all_p") / (F.col("all_p") + F.col("all_n")))), 6)
    scored = le.unionByName(gt).unionByName(eq).join(total, KEYS).filter("p > 0").withColumn("gain", gain).filter("gain > 0")
    best = F.min(F.struct((-F.col("gain")).alias("less"), "attr", "op", "code", "value"))
    return scored.groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, F.struct("b.attr", "b.op", "b.code", "b.value").alias("condition"))


def _telling(p: Column, n: Column) -> Column:
    return F.round((p - n) / F.nullif(p + n, F.lit(0)), 6)


def learn(examples: DataFrame, numbers: list[str], names: list[str], f_score: float = 0.7, outcome: str | None = None) -> DataFrame:
    """(g, y, rule, nth, attribute, comparison, value, bound, tp, fp, f1, kept), stored: the conditions of each rule of a group (g)
    for an outcome (y), only `outcome` if given; `value` goes with =, `bound` with others; tp and fp of the rule are counted when its turn comes, f1 and kept belong to all rules of (g, y)."""
    cell, cuts = cells(examples, numbers, names)
    wanted = cell.select(*KEYS).distinct() if outcome is None else cell.select("g").distinct().withColumn("y", F.lit(outcome))
    ways = cell.select("g", "y").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("g")
    wanted = wanted.join(ways, "g")
    mine = F.col("own") == F.col("y")
    count = lambda c, yes: F.sum(F.when(mine if yes else ~mine, F.col(c)).otherwise(0))
    left = cell.withColumnRenamed("y", "own").join(wanted, "g").groupBy(*KEYS, "codes", "values").agg(count("grow", True).alias("pos"), count("grow", False).alias("neg"), count("hold", True).alias("hold_pos"), count("hold", False).alias("hold_neg"))
    every = left = stored(left)
    rules: list[DataFrame] = []
    for k in range(RULES):
        cur, grown = left, []
        for step in range(CONDITIONS):
            best = stored(_conditions(cur, cuts, len(numbers), len(names)))
            if best.limit(1).count() == 0:
                break
            cur = stored(cur.join(best, KEYS).filter(_meets(F.col("condition"), F.col("codes"), F.col("values"), len(numbers))).drop("condition"))
            told = cur.groupBy(*KEYS).agg(_telling(F.sum("hold_pos"), F.sum("hold_neg")).alias("telling"))
            grown.append(told.join(best, KEYS).select(*KEYS, F.lit(step).alias("step"), "telling", "condition"))
        if not grown:
            break
        steps = grown[0]
        for x in grown[1:]:
            steps = steps.unionByName(x)
        alone = left.groupBy(*KEYS).agg(_telling(F.sum("hold_pos"), F.sum("hold_neg")).alias("alone"))
        cut = steps.filter("telling IS NOT NULL").groupBy(*KEYS).agg(F.min(F.struct((-F.col("telling")).alias("less"), "step")).alias("cut"))
        last = cut.join(alone, KEYS).filter(-F.col("cut.less") > F.col("alone")).select(*KEYS, F.col("cut.step").alias("last"))
        whole = steps.join(last, KEYS).filter("step <= last").groupBy(*KEYS).agg(F.collect_list("condition").alias("rule"))
        tried = left.join(whole, KEYS).withColumn("met", F.forall("rule", lambda x: _meets(x, F.col("codes"), F.col("values"), len(numbers))))
        left = stored(tried)
        hits = left.filter("met").groupBy(*KEYS, "rule").agg(F.sum(F.col("pos") + F.col("hold_pos")).alias("tp"), F.sum(F.col("neg") + F.col("hold_neg")).alias("fp"))
        rules.append(hits.select(*KEYS, F.lit(k).alias("nth"), "rule", "tp", "fp"))
        left = left.filter("NOT met").drop("met", "rule")
    found = rules[0] if rules else every.filter("false").select(*KEYS, F.lit(0).alias("nth"), F.array().cast("array<struct<attr:int,op:string,code:int,value:string>>").alias("rule"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    for x in rules[1:]:
        found = found.unionByName(x)
    found = stored(found)
    positive = every.groupBy(*KEYS).agg(F.sum(F.col("pos") + F.col("hold_pos")).alias("positive"))
    sets = found.groupBy(*KEYS).agg(F.sum("tp").alias("all_tp"), F.sum("fp").alias("all_fp")).join(positive, KEYS)
    f1 = F.round(2 * F.col("all_tp") / (F.col("all_tp") + F.col("all_fp") + F.col("positive")), 6)
    # of several bounds of one number the closest stays
    one = found.select(*KEYS, F.col("nth").alias("rule"), "tp", "fp", F.explode("rule").alias("x"))
    one = one.groupBy(*KEYS, "rule", "tp", "fp", F.col("x.attr").alias("attr"), F.col("x.op").alias("op")).agg(F.max("x.code").alias("most"), F.min("x.code").alias("least"), F.min("x.value").alias("value"))
    one = one.withColumn("code", F.when(F.col("op") == ">", F.col("most")).otherwise(F.col("least"))).join(cuts, "g")
    attribute = F.array(*[F.lit(k) for k in (*numbers, *names)])[F.col("attr")]
    bound = F.when(F.col("op") != "=", F.get(F.get("cuts", F.col("attr")), F.col("code")))
    nth = F.row_number().over(Window.partitionBy(*KEYS, "rule").orderBy("attr", "op")) - 1
    out = one.join(sets.select(*KEYS, f1.alias("f1"), (f1 >= f_score).alias("kept")), KEYS)
    return stored(out.select(*KEYS, "rule", nth.alias("nth"), attribute.alias("attribute"), F.col("op").alias("comparison"), "value", bound.alias("bound"), "tp", "fp", "f1", "kept"))
