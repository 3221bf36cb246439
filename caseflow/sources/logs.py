"""Event logs: files by role map, the driver's tables as logs, partitions, exports."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_millis, micros


@dataclass(frozen=True)
class Roles:
    """Physical column names by role; None where a log lacks the role."""

    case_id: str = "case_id"
    activity: str = "activity"
    resource: str | None = "resource"
    start_time: str | None = "start_time"
    end_time: str = "end_time"
    enabled_time: str | None = None


XES_ROLES = Roles("case:concept:name", "concept:name", "org:resource", "start_timestamp", "time:timestamp")


def read_csv_log(spark: SparkSession, path: str, roles: Roles = Roles()) -> DataFrame:
    """A .csv or .csv.gz log with canonical columns, times in microseconds UTC, other columns as they are, and eid."""
    if not path.endswith((".csv", ".csv.gz")):
        raise ValueError(f"{path}: logs are read from .csv and .csv.gz files")
    raw = spark.read.option("header", True).csv(path)
    named = {getattr(roles, f.name): f.name for f in fields(roles) if getattr(roles, f.name)}
    missing = [x for x in named if x not in raw.columns and named[x] in ("case_id", "activity", "end_time")]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    log = raw.withColumnsRenamed({k: v for k, v in named.items() if k in raw.columns})
    at = lambda c: micros(F.to_timestamp_ntz(F.regexp_replace(F.col(c), r"(Z|[+-]00:?00)$", ""))).alias(c)
    times = [c for c in ("start_time", "end_time", "enabled_time") if c in log.columns]
    return log.select(*[at(c) if c in times else F.col(c) for c in log.columns], F.monotonically_increasing_id().alias("eid"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: c(ase), a(ctivity), r(esource), s(tart) and e(nd) in microseconds, eid."""
    ts = micros(F.col("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("eid"),
        F.col("user_id").alias("c"),
        F.col("event_type").alias("a"),
        (F.get_json_object("props", "$.k").cast("long") % 10).alias("r"),
        (ts - F.floor(F.col("value") * 60).cast("long") * 1_000_000).alias("s"),
        ts.alias("e"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a log with case attributes: c, a, r, s, e, priority, status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("c"),
        F.concat("l_returnflag", "l_linestatus").alias("a"),
        F.col("l_suppkey").alias("r"),
        micros(F.least("o_orderdate", "l_shipdate")).alias("s"),
        micros(F.greatest("o_orderdate", "l_shipdate")).alias("e"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("l_linenumber").alias("line"),
    )


def purchases_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as customers (r) that take kinds of parts (a)."""
    i, o, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).join(p, i["l_partkey"] == p["p_partkey"]).select(F.col("o_custkey").alias("r"), F.col("p_name").alias("a"))


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select([F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def fill_missing(df: DataFrame, value: str = "UNDEFINED") -> DataFrame:
    """Nulls of string columns only; times stay null."""
    return df.fillna(value)


def xes_rows(log: DataFrame) -> DataFrame:
    """The five exported columns of a log (c, a, r, s, e), strings filled, times as ISO text."""
    roles = {"case:concept:name": "c", "concept:name": "a", "org:resource": "r"}
    rows = log.select(*[F.col(v).cast("string").alias(k) for k, v in roles.items()], iso_millis(F.col("s")).alias("start_timestamp"), iso_millis(F.col("e")).alias("time:timestamp"), "eid")
    return fill_missing(rows)


def write_xes(log: DataFrame, path: str) -> None:
    """One <trace> element a line, in files below path; traces are built where their case is."""
    rows = xes_rows(log).withColumnsRenamed({"case:concept:name": "case", "concept:name": "name", "org:resource": "res", "start_timestamp": "st", "time:timestamp": "en"})
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    tag = lambda kind, key, c: F.concat(F.lit(f'<{kind} key="{key}" value="'), safe(c), F.lit('"/>'))
    event = lambda x: F.concat(F.lit("<event>"), tag("string", "concept:name", x["name"]), tag("string", "org:resource", x["res"]), tag("date", "start_timestamp", x["st"]), tag("date", "time:timestamp", x["en"]), F.lit("</event>"))
    traces = rows.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("st", "en", "eid", "name", "res"))).alias("events"))
    traces.select(F.concat(F.lit("<trace>"), tag("string", "concept:name", F.col("case")), F.array_join(F.transform("events", event), ""), F.lit("</trace>")).alias("value")).write.text(path)


def write_partitions(log: DataFrame, parts: DataFrame, path: str) -> None:
    """write_xes of each partition of (c, part), in a folder of its name below path."""
    for x in ("train", "validation", "test"):
        write_xes(log.join(parts.filter(F.col("part") == x).select("c"), "c", "left_semi"), f"{path}/{x}")


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """All simulated logs (CSV) of a folder in one scan, with source and the run number from the file name."""
    run = F.regexp_extract(F.input_file_name(), r"(\d+)[^/0-9]*$", 1).cast("int")
    return spark.read.option("header", True).csv(pattern).withColumn("role", F.lit("resource")).withColumn("source", F.lit("simulation")).withColumn("run_num", run)


def harvest(spark: SparkSession, pattern: str) -> DataFrame:
    """Measurement files of many runs, with the file each row came from."""
    return spark.read.option("header", True).option("inferSchema", True).csv(pattern).withColumn("file", F.input_file_name())


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a streaming aggregate after all that is there now; for results of bounded size (histograms)."""
    import uuid

    name = f"drained_{uuid.uuid4().hex}"
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def drained_to_files(stream: DataFrame) -> DataFrame:
    """The rows that an appending stream gives for all that is there now, as files in the shared folder, read back."""
    from ..runtime import shared_dir

    spark = stream.sparkSession
    base = shared_dir(spark)
    run = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
