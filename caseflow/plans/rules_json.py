"""Rules as JSON, a row a rule set, and back: priorities, branch conditions, batches. Both ways are column expressions.

A rule set is an array of alternatives, each an array of conditions (attribute, comparison, value) that hold together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONDITIONS = "array<array<struct<attribute:string,comparison:string,value:string>>>"
PRIORITY = f"struct<priority_level:int,rules:{CONDITIONS}>"
BRANCH = f"struct<id:string,rules:{CONDITIONS}>"
BATCH = f"struct<task_id:string,type:string,size_distrib:array<struct<key:string,value:double>>,duration_distrib:array<struct<key:string,value:double>>,firing_rules:{CONDITIONS}>"


def condition(attribute: Column, comparison: Column, value: Column) -> Column:
    return F.struct(attribute.alias("attribute"), comparison.alias("comparison"), value.cast("string").alias("value"))


def alternatives(group: Column) -> Column:
    """Conditions of a group, each an alternative of its own, in their order."""
    return F.transform(F.array_sort(group), lambda x: F.array(x))


def priority_json(scores: DataFrame, attribute: str = "value") -> DataFrame:
    """(priority_level, json) of (value, level): the values of a level are alternatives."""
    one = condition(F.lit(attribute), F.lit("="), F.col("value"))
    out = scores.groupBy(F.col("level").cast("int").alias("priority_level")).agg(alternatives(F.collect_list(one)).alias("rules"))
    return out.select("priority_level", F.to_json(F.struct("priority_level", "rules")).alias("json"))


def branch_json(rules: DataFrame) -> DataFrame:
    """(id, json) of kept rules (gateway, path, attribute, value, kept), an id for each gateway and path."""
    one = condition(F.col("attribute"), F.lit("="), F.col("value"))
    out = rules.filter("kept").groupBy(F.concat_ws("_", "gateway", "path").alias("id")).agg(alternatives(F.collect_list(one)).alias("rules"))
    return out.select("id", F.to_json(F.struct("id", "rules")).alias("json"))


def branch_ids(rules: DataFrame) -> DataFrame:
    """(gateway, path, condition_id) of kept rules, with the ids of branch_json."""
    return rules.filter("kept").select("gateway", "path", F.concat_ws("_", "gateway", "path").alias("condition_id")).distinct()


def _distribution(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    pair = F.struct(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("a").agg(F.array_sort(F.collect_list(pair)).alias(name))


def batch_json(firing: DataFrame, sizes: DataFrame, ids: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """(task_id, json) of firing rules (a, attribute, threshold, confidence[, comparison], >= unless given) that reach the confidence
    `least`, with the distributions of sizes and mean seconds (a, size, batches, mean_s). ids: (a, id) of a model, names otherwise."""
    one = condition(F.col("attribute"), F.col("comparison") if "comparison" in firing.columns else F.lit(">="), F.col("threshold"))
    good = firing.filter(F.col("confidence") >= least).groupBy("a").agg(alternatives(F.collect_list(one)).alias("firing_rules"))
    rows = good.join(_distribution(sizes, "size", "batches", "size_distrib"), "a", "left").join(_distribution(sizes, "size", "mean_s", "duration_distrib"), "a", "left")
    rows = rows.withColumn("task_id", F.col("a")) if ids is None else rows.join(ids.select("a", F.col("id").alias("task_id")), "a")
    whole = F.struct("task_id", F.lit("Sequential").alias("type"), "size_distrib", "duration_distrib", "firing_rules")
    return rows.select("task_id", F.to_json(whole).alias("json"))


#: How a simulator spells what fires a batch.
SPELLED = {"batch_size": "size", "batch_ready_wt": "ready_wt", "batch_max_wt": "large_wt"}


def learned(rules: DataFrame, key: str) -> DataFrame:
    """(key, rules) of learned rules (key, rule, nth, attribute, comparison, value, bound): the conditions of a rule hold together."""
    value = F.coalesce(F.col("value"), F.col("bound").cast("string"))
    one = F.struct("nth", condition(F.col("attribute"), F.col("comparison"), value).alias("one"))
    together = rules.groupBy(key, "rule").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["one"]).alias("all"))
    return together.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "all"))), lambda x: x["all"]).alias("rules"))


def learned_branch_json(rules: DataFrame) -> DataFrame:
    """(id, json) of the kept rules (g, y, ...) of rule_learning.learn for flows (y) out of gateways (g)."""
    out = learned(rules.filter("kept"), "y").withColumnRenamed("y", "id")
    return out.select("id", F.to_json(F.struct("id", "rules")).alias("json"))


def learned_batch_json(rules: DataFrame, traits: DataFrame, sizes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(task_id, json) for activities with batches: traits (a, kind, ...), sizes (a, size, batches, mean_s) and, where there are kept
    ones, learned rules (g, ...), in a simulator's spelling. ids: (a, id) of a model, names otherwise."""
    spelled = F.coalesce(F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv])[F.col("attribute")], "attribute")
    fired = learned(rules.filter("kept").withColumn("attribute", spelled), "g").select(F.col("g").alias("a"), F.col("rules").alias("firing_rules"))
    rows = traits.join(fired, "a", "left").join(_distribution(sizes, "size", "batches", "size_distrib"), "a", "left").join(_distribution(sizes, "size", "mean_s", "duration_distrib"), "a", "left")
    rows = rows.withColumn("task_id", F.col("a")) if ids is None else rows.join(ids.select("a", F.col("id").alias("task_id")), "a")
    none = F.coalesce("firing_rules", F.array().cast(CONDITIONS)).alias("firing_rules")
    return rows.select("task_id", F.to_json(F.struct("task_id", F.initcap("kind").alias("type"), "size_distrib", "duration_distrib", none)).alias("json"))


def priority_levels_json(levels: DataFrame) -> DataFrame:
    """(priority_level, json) of (attribute, value, level): the values of an attribute on one level are a list, an interval `low;high`
    two ends, one value itself."""
    interval = F.col("value").contains(";")
    parts = levels.withColumn("_interval", F.when(interval, F.col("value"))).groupBy(F.col("level").cast("int").alias("priority_level"), "attribute", "_interval").agg(F.array_sort(F.collect_set("value")).alias("values"))
    ends = F.when(F.col("_interval").isNotNull(), F.split("_interval", ";")).otherwise(F.col("values"))
    many = F.to_json(F.struct("attribute", F.lit("in").alias("comparison"), ends.alias("value")))
    single = F.to_json(F.struct("attribute", F.lit("=").alias("comparison"), F.col("values")[0].alias("value")))
    one = F.when(F.col("_interval").isNull() & (F.size("values") == 1), single).otherwise(many)
    texts = parts.groupBy("priority_level").agg(F.array_sort(F.collect_list(F.concat(F.lit("["), one, F.lit("]")))).alias("rules"))
    return texts.select("priority_level", F.concat(F.lit('{"priority_level":'), F.col("priority_level").cast("string"), F.lit(',"rules":['), F.array_join("rules", ","), F.lit("]}")).alias("json"))


def conditions_of(rows: DataFrame, kind: str, rules: str, *keys: str) -> DataFrame:
    """(keys, alternative, nth, attribute, comparison, value) of JSON rule sets (json) of one of the kinds above."""
    read = rows.select(F.from_json("json", kind).alias("x")).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.posexplode(F.col(f"x.{rules}")).alias("alternative", "all"))
    return read.select(*keys, "alternative", F.posexplode("all").alias("nth", "one")).select(*keys, "alternative", "nth", "one.*")


def distribution_of(rows: DataFrame, name: str) -> DataFrame:
    """(task_id, key, value) of a distribution in batch rules (json)."""
    return rows.select(F.from_json("json", BATCH).alias("x")).select("x.task_id", F.explode(F.col(f"x.{name}")).alias("d")).select("task_id", "d.key", "d.value")
