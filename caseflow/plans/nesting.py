"""Process graphs with nested gateways and short loops.

The branches of a split (and, mirrored, of a join) are items with a cover, the activities under them, and a future, the
branches that are concurrent with them. Items of equal futures become one exclusive item; items whose covers and futures
together are the same set become one parallel item, whose future is what all of them have; in turns, until nothing merges. What
is left apart, concurrent in part only, becomes one gateway of the kind that the miner says, inclusive for joins by default, and only over what is left.
This is the split discovery of the published split-miner algorithm, as array algebra over a table of items.

Short loops: an activity that often follows itself gets a loop of its own; two activities that often alternate (a b a) are not concurrent
but follow each other both ways.

Scale: three aggregates over the log; after that, tables of the size of a process, stored once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.traces import by_time
from ..runtime import discard, stored
from .discovery import Miner, pruned_graph

LOOPS = 0.3


def short_loops(log: DataFrame, loops: float = LOOPS) -> tuple[DataFrame, DataFrame]:
    """(a) of activities that follow themselves, and (a, b) of pairs that alternate, in the share `loops` of their steps."""
    w = by_time()
    steps = log.select("a", F.lead("a").over(w).alias("b"), F.lead("a", 2).over(w).alias("b2")).filter("b IS NOT NULL")
    own = steps.groupBy("a").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("share")).filter(F.col("share") >= loops).select("a")
    pairs = steps.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    back = F.avg(F.coalesce((F.col("b2") == F.col("a")).cast("double"), F.lit(0.0)))
    return own, pairs.agg(back.alias("share")).filter(F.col("share") >= loops).select("a", "b")


def nest(edges: DataFrame, both: DataFrame, word: str, mixed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tops, links, gates), stored: of edges (k, x) and concurrent (x, y), both ways: the item over all branches (k, top), the items
    in gateways (k, parent, child), and the gateways (id, kind)."""
    futures = edges.join(edges.select("k", F.col("x").alias("y")), "k").join(both, ["x", "y"]).groupBy("k", "x").agg(F.array_sort(F.collect_set("y")).alias("future"))
    none = F.array().cast("array<string>")
    items = stored(edges.join(futures, ["k", "x"], "left").select("k", F.col("x").alias("id"), F.array("x").alias("cover"), F.coalesce("future", none).alias("future")))
    made: list[DataFrame] = []

    def merge(items: DataFrame, kind: str, group) -> DataFrame:
        g = items.groupBy("k", group.alias("_group")).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.flatten(F.collect_list("cover"))).alias("cover"), F.collect_list("future").alias("futures"))
        name = F.concat(F.lit(f"{word}_"), "k", F.lit("_"), F.substring(F.sha2(F.concat(F.lit(kind), F.array_join("cover", "|")), 256), 1, 12))
        common = F.aggregate("futures", F.col("futures")[0], lambda x, y: F.array_intersect(x, y))
        out = stored(g.select("k", F.when(F.size("ids") > 1, name).otherwise(F.col("ids")[0]).alias("id"), "cover", F.array_sort(common).alias("future"), F.when(F.size("ids") > 1, F.col("ids")).alias("ids"), F.lit(kind).alias("kind")))
        made.append(out)
        return out.select("k", "id", "cover", "future")

    size = items.count()
    while True:
        before = size
        items = merge(items, "exclusiveGateway", F.col("future"))
        items = merge(items, "parallelGateway", F.array_sort(F.array_union("cover", "future")))
        size = items.count()
        if size == before:
            break
    tops = merge(items, mixed, F.lit(0)).select("k", F.col("id").alias("top"))
    every = made[0]
    for x in made[1:]:
        every = every.unionByName(x)
    every = every.filter("ids IS NOT NULL")
    links = stored(every.select("k", F.col("id").alias("parent"), F.explode("ids").alias("child")))
    gates, tops = stored(every.select("id", "kind").distinct()), stored(tops)
    for x in made:
        discard(x)
    return tops, links, gates


def nested_graph(log: DataFrame, miner: Miner = Miner(), loops: float = LOOPS) -> tuple[DataFrame, DataFrame]:
    """(nodes, flows) of a model, as discovery.process_graph, with nested gateways and short loops."""
    graph = stored(pruned_graph(log, miner))
    own, turns = (stored(x) for x in short_loops(log, loops))
    turns = turns.unionByName(turns.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("turn", F.lit(True))
    marked = graph.join(turns, ["a", "b"], "left").withColumn("turn", F.coalesce("turn", F.lit(False)))
    w = Window.partitionBy("c").orderBy("e", "eid")
    ends = log.select("a", F.lag("a").over(w).isNull().alias("first"), F.lead("a").over(w).isNull().alias("last"))
    starts = ends.filter("first").select(F.lit("start").alias("a"), F.col("a").alias("b")).distinct()
    stops = ends.filter("last").select("a", F.lit("end").alias("b")).distinct()
    edges = stored(marked.filter("kept OR concurrent AND turn").select("a", "b").unionByName(starts).unionByName(stops))
    both = stored(marked.filter("concurrent AND NOT turn").select(F.col("a").alias("x"), F.col("b").alias("y")))
    mixed = "parallelGateway" if miner.prioritize_parallelism else "exclusiveGateway"
    split = nest(edges.select(F.col("a").alias("k"), F.col("b").alias("x")), both, "split", mixed)
    join = nest(edges.select(F.col("b").alias("k"), F.col("a").alias("x")), both, "join", mixed if miner.prioritize_parallelism or miner.replace_or_joins else "inclusiveGateway")
    out_of = F.coalesce(F.col("out"), F.col("a"))
    into = F.coalesce(F.col("into"), F.col("b"))
    # an edge goes from the gateway that holds its target to the gateway that holds its source
    holds = lambda links, key, item, name: links.select(F.col("k").alias(key), F.col("child").alias(item), F.col("parent").alias(name))
    flows = edges.join(holds(split[1], "a", "b", "out"), ["a", "b"], "left").join(holds(join[1], "b", "a", "into"), ["a", "b"], "left").select(out_of.alias("source"), into.alias("target"))
    gated = lambda tops, gates: tops.join(gates.select(F.col("id").alias("top")), "top").select("k", "top")
    flows = flows.unionByName(gated(split[0], split[2]).select(F.col("k").alias("source"), F.col("top").alias("target"))).unionByName(gated(join[0], join[2]).select(F.col("top").alias("source"), F.col("k").alias("target")))
    inner = lambda part: part[1].join(part[2].select(F.col("id").alias("child")), "child")
    flows = flows.unionByName(inner(split).select(F.col("parent").alias("source"), F.col("child").alias("target"))).unionByName(inner(join).select(F.col("child").alias("source"), F.col("parent").alias("target")))
    # an activity with a loop of its own is entered and left over gateways
    loop_in, loop_out = F.concat(F.lit("loop_"), "a"), F.concat(F.lit("again_"), "a")
    flows = flows.join(own.select(F.col("a").alias("source"), loop_out.alias("_out")), "source", "left").join(own.select(F.col("a").alias("target"), loop_in.alias("_in")), "target", "left")
    flows = flows.select(F.coalesce("_out", "source").alias("source"), F.coalesce("_in", "target").alias("target"))
    pair = lambda s, t: F.struct(s.alias("source"), t.alias("target"))
    flows = flows.unionByName(own.select(F.inline(F.array(pair(loop_in, F.col("a")), pair(F.col("a"), loop_out), pair(loop_out, loop_in)))))
    nodes = log.select("a").distinct().select(F.col("a").alias("id"), F.lit("task").alias("kind"), F.col("a").alias("name"))
    none = F.lit(None).cast("string").alias("name")
    gates = split[2].unionByName(join[2]).unionByName(own.select(F.explode(F.array(loop_in, loop_out)).alias("id"), F.lit("exclusiveGateway").alias("kind")))
    events = log.sparkSession.createDataFrame([("start", "startEvent", None), ("end", "endEvent", None)], "id string, kind string, name string")
    return nodes.unionByName(gates.select("id", "kind", none)).unionByName(events), flows.distinct().select(F.concat_ws("__", "source", "target").alias("id"), "source", "target")
