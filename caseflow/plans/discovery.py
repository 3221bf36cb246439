"""Discovery of a process graph: directly-follows counts, pruned, with choices and concurrency made gateways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.preprocess import overlap_concurrency
from ..operators.traces import dfg, interval_follows

MINERS = {"v1": "sm1", "1": "sm1", "sm1": "sm1", "split miner v1": "sm1", "v2": "sm2", "2": "sm2", "sm2": "sm2", "split miner v2": "sm2"}


@dataclass(frozen=True)
class Miner:
    """eta: how much of an activity's traffic weak edges may lack; epsilon: balance below which two orders are concurrent.

    The second algorithm follows intervals: an activity comes after those that ended last before it began, two are
    concurrent if they overlap in the share epsilon of the cases that have both, and eta plays no part.
    A gateway some of whose branches are concurrent is parallel if parallelism comes first; otherwise a split is exclusive, and
    a join inclusive, or exclusive if inclusive joins are to be replaced."""

    algorithm: str = "sm1"
    eta: float = 0.4
    epsilon: float = 0.3
    prioritize_parallelism: bool = False
    replace_or_joins: bool = False

    def __post_init__(self):
        if self.algorithm.lower() not in MINERS:
            raise ValueError(f"unknown discovery algorithm {self.algorithm!r}")


def pruned_graph(log: DataFrame, miner: Miner) -> DataFrame:
    """(a, b, n, concurrent, kept): loops of one activity are left out; two activities in both orders with a balance
    |n - m| / (n + m) below epsilon are concurrent; of the rest an edge stays if it is among the strongest of its source or
    target, or reaches the share eta of the strongest."""
    second = MINERS[miner.algorithm.lower()] == "sm2"
    edges = (interval_follows(log) if second else dfg(log)).filter("a <> b")
    if second:
        beside = overlap_concurrency(log, miner.epsilon).filter("concurrent AND overlapping > 0").select("a", "b")
        either = beside.unionByName(beside.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("concurrent", F.lit(True))
        e = edges.join(either, ["a", "b"], "left").withColumn("concurrent", F.coalesce("concurrent", F.lit(False)))
        return e.select("a", "b", "n", "concurrent", (~F.col("concurrent")).alias("kept"))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    e = edges.join(back, ["a", "b"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    e = e.withColumn("concurrent", (F.col("m") > 0) & (F.abs(F.col("n") - F.col("m")) / (F.col("n") + F.col("m")) < miner.epsilon))
    free = F.when(~F.col("concurrent"), F.col("n"))
    out, into = (F.max(free).over(Window.partitionBy(k)) for k in ("a", "b"))
    kept = ~F.col("concurrent") & ((F.col("n") == out) | (F.col("n") == into) | ((F.col("n") >= miner.eta * out) & (F.col("n") >= miner.eta * into)))
    return e.withColumn("kept", kept).select("a", "b", "n", "concurrent", "kept")


def process_graph(log: DataFrame, miner: Miner = Miner()) -> tuple[DataFrame, DataFrame]:
    """(nodes, flows) of a model: an activity with several followers gets a split, with several predecessors a join;
    parallel where all branches are pairwise concurrent, exclusive where none are, and between as the miner says."""
    graph = pruned_graph(log, miner)
    w = Window.partitionBy("c").orderBy("e", "eid")
    ends = log.select("a", F.lag("a").over(w).isNull().alias("first"), F.lead("a").over(w).isNull().alias("last"))
    starts = ends.filter("first").select(F.lit("start").alias("a"), F.col("a").alias("b")).distinct()
    stops = ends.filter("last").select("a", F.lit("end").alias("b")).distinct()
    edges = graph.filter("kept").select("a", "b").unionByName(starts).unionByName(stops).cache()
    both = graph.filter("concurrent").select(F.col("a").alias("x"), F.col("b").alias("y"))

    def gates(key: str, other: str, word: str) -> DataFrame:
        p, q = (edges.select(key, F.col(other).alias(v)) for v in ("x", "y"))
        pairs = p.join(q, key).filter("x < y").join(both.withColumn("par", F.lit(1)), ["x", "y"], "left")
        par = F.coalesce("par", F.lit(0))
        mixed = "exclusiveGateway" if word == "split" or miner.replace_or_joins else "inclusiveGateway"
        some = F.when(F.max(par) == 1, "parallelGateway" if miner.prioritize_parallelism else mixed)
        kind = F.when(F.min(par) == 1, "parallelGateway").otherwise(F.coalesce(some, F.lit("exclusiveGateway")))
        return pairs.groupBy(key).agg(kind.alias("kind")).select(F.col(key).alias("of"), F.concat(F.lit(f"{word}_"), key).alias("id"), "kind")

    splits, joins = gates("a", "b", "split"), gates("b", "a", "join")
    names = log.select("a").distinct()
    nodes = names.select(F.col("a").alias("id"), F.lit("task").alias("kind"), F.col("a").alias("name"))
    for g in (splits, joins):
        nodes = nodes.unionByName(g.select("id", "kind", F.lit(None).cast("string").alias("name")))
    spark = log.sparkSession
    nodes = nodes.unionByName(spark.createDataFrame([("start", "startEvent", None), ("end", "endEvent", None)], nodes.schema))
    s, j = splits.select(F.col("of").alias("a"), F.col("id").alias("split")), joins.select(F.col("of").alias("b"), F.col("id").alias("join"))
    links = edges.join(s, "a", "left").join(j, "b", "left").select(F.coalesce("split", "a").alias("source"), F.coalesce("join", "b").alias("target"))
    links = links.unionByName(s.select(F.col("a").alias("source"), F.col("split").alias("target"))).unionByName(j.select(F.col("join").alias("source"), F.col("b").alias("target"))).distinct()
    return nodes, links.select(F.concat_ws("__", "source", "target").alias("id"), "source", "target")
