"""Replay of a log on a process graph: which flows out of gateways its steps take, and which steps the graph does not allow.

Activities and the start and end are what a log shows; gateways and timers are silent. The closure of silent paths between
the shown nodes is found by iterated joins over the graph, shortest first. An event then comes from the latest earlier
event of its case whose activity has a silent path to its own, or from the start, so branches of a parallel gateway all come
from what stands before it. A step does not fit if there is no such path, if its source has led to that activity before, or if
it would leave an exclusive gateway by another flow than the source's first step through it.

Scale: graphs have the size of a process. Each event becomes a row for each activity that may follow, and running maxima in two
levels (operators/prefix.py) find sources, so a case of any length spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import hour, running_max_before
from ..runtime import discard, stored
from ..sources.bpmn import activity_ids

START, END = "\x02", "\x03"
GATEWAYS = ("exclusiveGateway", "inclusiveGateway", "parallelGateway")


def silent_paths(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """(a, b, path): the ids of the flows of the shortest silent path from a shown node to another, the first by text of
    equals. Activities go by name, start and end events by START and END."""
    ends = [nodes.filter(F.col("kind") == k).select("id", F.lit(v).alias("shown")) for k, v in (("startEvent", START), ("endEvent", END))]
    shown = stored(activity_ids(nodes).select("id", F.col("name").alias("shown")).unionByName(ends[0]).unionByName(ends[1]))
    way = stored(flows.select(F.col("id").alias("flow"), F.col("source").alias("node"), F.col("target").alias("next")))
    begin = shown.filter(F.col("shown") != END).select(F.col("id").alias("node"), F.col("shown").alias("a"))
    first = lambda df: df.groupBy("a", "next").agg(F.min("path").alias("path")).select("a", F.col("next").alias("node"), "path")
    edge = stored(first(begin.join(way, "node").select("a", "next", F.array("flow").alias("path"))))
    found, known = [edge], edge.select("a", "node")
    while True:
        silent = found[-1].join(shown.select(F.col("id").alias("node")), "node", "left_anti")
        longer = silent.join(way, "node").select("a", "next", F.concat("path", F.array("flow")).alias("path"))
        edge = stored(first(longer).join(known, ["a", "node"], "left_anti"))
        if edge.limit(1).count() == 0:
            break
        found.append(edge)
        known = known.unionByName(edge.select("a", "node"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    best = every.join(shown.select(F.col("id").alias("node"), F.col("shown").alias("b")), "node").groupBy("a", "b").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("best"))
    out = stored(best.select("a", "b", "best.path"))
    for x in (*found, edge, shown, way):
        discard(x)
    return out


def splits(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """(gateway_id, kind, flow_id, ways): the flows out of gateways with several."""
    out = flows.join(nodes.filter(F.col("kind").isin(*GATEWAYS)).select(F.col("id").alias("source"), "kind"), "source")
    ways = flows.groupBy("source").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1")
    return out.join(ways, "source").select(F.col("source").alias("gateway_id"), "kind", F.col("id").alias("flow_id"), "ways")


def steps(log: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """(c, source, a, b, eid, e, path, fits), stored: each event, and each case's end, with the event that it comes from.

    source (c, eid) has a null eid for the start, eid is null for the end; path is null where no path leads here."""
    paths = silent_paths(nodes, flows)
    rows = log.select("c", "a", "e", "eid")
    value = F.struct("e", "eid", "a")
    gives = rows.join(paths.filter(F.col("a") != START).select("a", "b"), "a").select("c", "b", "e", "eid", F.lit(1).alias("kind"), value.alias("value"))
    none = F.lit(None).cast(gives.schema["value"].dataType)
    takes = rows.select("c", F.col("a").alias("b"), "e", "eid", F.lit(0).alias("kind"), none.alias("value"))
    last = rows.groupBy("c").agg(F.max("e").alias("e")).select("c", F.lit(END).alias("b"), "e", F.lit((1 << 63) - 1).alias("eid"), F.lit(2).alias("kind"), none.alias("value"))
    every = gives.unionByName(takes).unionByName(last).withColumn("_hour", hour("e"))
    led = running_max_before(every, ["c", "b"], "_hour", ["e", "eid", "kind"], "value", "last").filter("kind <> 1")
    source = F.struct("c", F.col("last.eid").alias("eid")).alias("source")
    led = led.select("c", source, F.coalesce("last.a", F.lit(START)).alias("a"), "b", "e", "eid", "kind").join(paths, ["a", "b"], "left")
    led = stored(led)
    gates = splits(nodes, flows).filter("kind = 'exclusiveGateway'").select("gateway_id", F.col("flow_id").alias("flow"))
    out = led.select("source", "e", "eid", "kind", F.explode("path").alias("flow")).join(gates, "flow")
    at = F.struct("e", "eid")
    chosen = out.groupBy("source", "gateway_id").agg(F.min_by("flow", at).alias("chosen"))
    astray = out.join(chosen, ["source", "gateway_id"]).filter("flow <> chosen").select("source.c", "eid")
    again = led.groupBy("source", "b").agg(F.min(at).alias("first"))
    met = led.join(again, ["source", "b"]).join(astray.distinct().withColumn("_astray", F.lit(True)), ["c", "eid"], "left")
    fits = F.col("path").isNotNull() & (F.col("first") == at) & F.col("_astray").isNull()
    shown = stored(met.select("c", "source", "a", "b", F.when(F.col("kind") == 0, F.col("eid")).alias("eid"), "e", "path", fits.alias("fits")))
    discard(led)
    return shown


def choices(replayed: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """(gateway_id, flow_id, source): the flows out of gateways that fitting steps take, once for each source."""
    gates = splits(nodes, flows).select("gateway_id", "flow_id")
    return replayed.filter("fits").select("source", F.explode("path").alias("flow_id")).join(gates, "flow_id").select("gateway_id", "flow_id", "source").distinct()


def gateway_flows(replayed: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """(gateway_id, kind, flow_id, taken, probability): every flow out of a gateway with several, how often it was taken, and its share; equal
    shares at a gateway that no step passes."""
    taken = choices(replayed, nodes, flows).groupBy("flow_id").agg(F.count(F.lit(1)).alias("taken"))
    gates = splits(nodes, flows)
    rows = gates.join(taken, "flow_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    total = rows.groupBy("gateway_id").agg(F.sum("taken").alias("total"))
    share = F.coalesce(F.col("taken") / F.nullif("total", F.lit(0)), 1 / F.col("ways"))
    return rows.join(total, "gateway_id").select("gateway_id", "kind", "flow_id", "taken", F.round(share, 6).alias("probability"))


def fitness(replayed: DataFrame) -> DataFrame:
    """(activity, steps, fitting): how many steps into an activity, `end` for the end, the graph allows."""
    name = F.when(F.col("b") == END, "end").otherwise(F.col("b"))
    return replayed.groupBy(name.alias("activity")).agg(F.count(F.lit(1)).alias("steps"), F.sum(F.col("fits").cast("long")).alias("fitting"))
