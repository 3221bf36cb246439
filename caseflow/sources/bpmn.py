"""Process graphs as two tables, nodes (id, kind, name) and flows (id, source, target), read from and written to BPMN."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = "http://www.omg.org/spec/BPMN/20100524/MODEL"
NODE_KINDS = ("startEvent", "endEvent", "task", "userTask", "exclusiveGateway", "parallelGateway", "inclusiveGateway", "intermediateCatchEvent")


def read_bpmn(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, flows) of a model, whatever its name space's prefix; Spark reads and parses the file. A blank name is none."""
    text = spark.read.text(path, wholetext=True)
    found = lambda tag, part: F.xpath("value", F.lit(f"//*[local-name()='{tag}']{part}"))
    node = lambda kind, zipped: text.select(F.explode(zipped).alias("n")).select(F.col("n.0").alias("id"), F.lit(kind).alias("kind"), F.nullif(F.col("n.1"), F.lit("")).alias("name"))
    nodes = None
    for kind in NODE_KINDS:
        # attributes of one set of elements are in one order; elements without a name are a set of their own
        named = node(kind, F.arrays_zip(found(kind, "[@name]/@id").alias("0"), found(kind, "[@name]/@name").alias("1")))
        bare = found(kind, "[not(@name)]/@id")
        rows = named.unionByName(node(kind, F.arrays_zip(bare.alias("0"), F.transform(bare, lambda _: F.lit("")).alias("1"))))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    ends = F.arrays_zip(*[found("sequenceFlow", f"/@{a}").alias(str(k)) for k, a in enumerate(("id", "sourceRef", "targetRef"))])
    flows = text.select(F.explode(ends).alias("n")).select(*[F.col(f"n.{k}").alias(name) for k, name in enumerate(("id", "source", "target"))])
    return nodes, flows


def activity_ids(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin("task", "userTask")).select("name", "id")


def with_ids(rows: DataFrame, nodes: DataFrame, column: str = "activity") -> DataFrame:
    """rows with the id of each activity name; names the model lacks raise."""
    ids = activity_ids(nodes).select(F.col("name").alias(column), "id")
    missing = rows.select(column).distinct().join(ids, column, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"the model has no activity {', '.join(str(m[0]) for m in missing)}")
    return rows.join(ids, column)


def add_timers(nodes: DataFrame, flows: DataFrame, delays: DataFrame, before: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, flows) with a timer in front of (or behind) each task named in delays (activity); all flows are led over it."""
    tasks = activity_ids(nodes).join(delays.select(F.col("activity").alias("name")).distinct(), "name").select(F.col("id").alias("task"), F.concat(F.lit("timer_"), F.substring(F.sha2("id", 256), 1, 16)).alias("timer"), "name")
    timers = tasks.select(F.col("timer").alias("id"), F.lit("intermediateCatchEvent").alias("kind"), F.concat(F.lit("Delay of "), "name").alias("name"))
    end, other = ("target", "source") if before else ("source", "target")
    led = flows.join(tasks.select(F.col("task").alias(end), "timer"), end, "left")
    led = led.select("id", other, F.coalesce("timer", end).alias(end)).select("id", "source", "target")
    name = F.concat(F.lit("flow_"), F.substring(F.sha2("timer", 256), 1, 16)).alias("id")
    new = tasks.select(name, F.col("timer").alias("source"), F.col("task").alias("target")) if before else tasks.select(name, F.col("task").alias("source"), F.col("timer").alias("target"))
    return nodes.unionByName(timers), led.unionByName(new)


def to_bpmn(nodes: DataFrame, flows: DataFrame, process: str = "process") -> str:
    """BPMN text of a graph; a model has some hundred nodes."""
    root = ET.Element("definitions", xmlns=NS, targetNamespace="http://caseflow")
    body = ET.SubElement(root, "process", id=process, isExecutable="false")
    for n in nodes.orderBy("id").collect():
        x = ET.SubElement(body, n.kind, id=n.id, **({"name": n.name} if n.name else {}))
        if n.kind == "intermediateCatchEvent":
            ET.SubElement(x, "timerEventDefinition")
    for f in flows.orderBy("id").collect():
        ET.SubElement(body, "sequenceFlow", id=f.id, sourceRef=f.source, targetRef=f.target)
    return ET.tostring(root, encoding="unicode")
