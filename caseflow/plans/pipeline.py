"""The whole run: a log, prepared and partitioned, tuned for control flow and work, discovered anew, evaluated, exported."""

from __future__ import annotations

import argparse
import json
import time
import warnings
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DIVISORS_OF_DAY
from ..operators import calendars, distances, preprocess, rule_learning, rules, traces
from ..runtime import scratch, stored
from ..sources import bpmn
from ..sources.logs import Roles, read_csv_log
from . import discovery, replay, rules_json, simulate
from .model import ProcessModel
from .settings import Settings, schema, without_effect
from .tuner import Tuner

NAMES = {"case_id": "c", "activity": "a", "resource": "r", "start_time": "s", "end_time": "e"}


class Meter:
    """Seconds by stage."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.time()
        yield
        self.seconds[name] = self.seconds.get(name, 0.0) + time.time() - began


ROLES = ("eid", "c", "a", "r", "s", "e")


def canonical(raw: DataFrame) -> DataFrame:
    """A CSV log in the columns c, a, r, s, e, eid; cases and resources are numbered by hash, missing starts estimated later;
    other columns, the attributes, stay as they are."""
    have = raw.withColumnsRenamed({k: v for k, v in NAMES.items() if k in raw.columns})
    number = lambda k: F.xxhash64(F.col(k).cast("string")) if k in have.columns else F.lit(0).cast("long")
    start = F.col("s") if "s" in have.columns else F.lit(None).cast("long")
    more = [k for k in have.columns if k not in ROLES]
    return have.select("eid", number("c").alias("c"), F.col("a").cast("string").alias("a"), number("r").alias("r"), start.alias("s"), F.col("e").cast("long").alias("e"), *more)


def attributes_of(log: DataFrame) -> list[str]:
    return [k for k in log.columns if k not in ROLES]


def prepared(log: DataFrame, settings: Settings) -> DataFrame:
    """Starts are estimated for all events if any lacks one; durations of simultaneous work are shared out if asked for."""
    more = attributes_of(log)
    if log.filter("s IS NULL").limit(1).count():
        p = settings.preprocessing
        beside = preprocess.heuristic_concurrency(log, p.df, p.l2l, p.l1l).filter("concurrent").select("a", "b")
        log = log.drop("s").join(preprocess.estimated_starts(log, beside).withColumnRenamed("start_us", "s"), "eid").select(*ROLES, *more)
    if settings.preprocessing.multitasking:
        worked = preprocess.multitask_adjust(log)
        log = log.join(worked, "eid").withColumn("s", F.col("e") - F.round("worked_us").cast("long")).select(*ROLES, *more)
    return log


def _range(v) -> tuple:
    return v if isinstance(v, tuple) else (v, v)


def _numeric(log: DataFrame, more: list[str]) -> list[str]:
    """The attributes that are numbers with many values."""
    return [r.attribute for r in rules.attribute_types(log, more).filter("kind = 'continuous'").collect()] if more else []


def _choices(log: DataFrame, replayed: DataFrame, nodes: DataFrame, flows: DataFrame, more: list[str]) -> DataFrame:
    """(g, y, hold, r, hour, attributes): each flow taken out of a gateway, with what was known at the event before it."""
    hour = F.pmod(F.floor(F.col("e") / F.lit(3.6e9)), F.lit(24))
    known = log.select("eid", F.col("r").cast("string").alias("r"), hour.alias("hour"), *more)
    taken = replay.choices(replayed, nodes, flows).select(F.col("gateway_id").alias("g"), F.col("flow_id").alias("y"), F.col("source.eid").alias("eid"))
    return taken.join(known, "eid").withColumn("hold", rule_learning.held(F.col("eid"))).drop("eid")


def _calendars(log: DataFrame, settings: Settings, work: dict) -> DataFrame:
    kind = settings.resource_model.discovery_type
    key = F.lit(0).cast("long") if kind == "undifferentiated" else F.col("r")
    if kind == "resource_fuzzy":
        g = work["granule"]
        fuzzy = calendars.fuzzy_calendar(log, key, g, work["fuzzy_angle"])
        return fuzzy.select("k", "w", (F.col("g") * g).alias("begin_min"), ((F.col("g") + 1) * g).alias("end_min"), "probability")
    if kind == "pool":
        log = log.join(calendars.pools(log), "r").withColumn("r", F.col("pool")).drop("pool")
    return calendars.intervals(calendars.relaxed(log, key, work["granule"], work["confidence"], work["support"], work["participation"]), work["granule"])


def calendar_loss(train: DataFrame, valid: DataFrame, settings: Settings, work: dict) -> float | None:
    """How far the hours that calendars of one log keep open lie from the hours at work in another: the earth mover's
    distance within weekdays of open minutes and of active dates; none if no hour is open."""
    found = _calendars(train, settings, work)
    weight = F.col("probability") if "probability" in found.columns else F.lit(1.0)
    hours = F.sequence(F.floor(F.col("begin_min") / 60), F.floor((F.col("end_min") - 1) / 60))
    minutes = F.least("end_min", (F.col("b") + 1) * 60) - F.greatest("begin_min", F.col("b") * 60)
    mine = found.withColumn("b", F.explode(hours)).select(F.lit(0).alias("side"), "w", F.col("b").cast("int").alias("b"), (minutes * weight).alias("x"))
    seen = calendars.granule_activity(valid, F.lit(0)).select(F.lit(1).alias("side"), "w", F.col("g").alias("b"), F.col("days").cast("double").alias("x"))
    hist = mine.unionByName(seen).groupBy("side", "w", "b").agg(F.sum("x").alias("n"))
    return distances.over_weekdays(hist).collect()[0][0]


def discover(log: DataFrame, settings: Settings, miner: discovery.Miner, work: dict, given: tuple | None = None) -> ProcessModel:
    """The model of a log; work: granule, confidence, support, participation and fuzzy_angle, as found by the search."""
    # a graph has some hundred rows, and much is made of it: it is kept as tables
    nodes, flows = (stored(x) for x in given or discovery.process_graph(log, miner))
    log = stored(log)
    common, flow, resources, delays = settings.common, settings.control_flow, settings.resource_model, settings.extraneous_activity_delays
    more = attributes_of(log)
    beside = preprocess.overlap_concurrency(log, settings.preprocessing.enable_time_concurrency_threshold).filter("concurrent AND overlapping > 0")
    enabled = preprocess.enabled_times(log, beside)
    best = stored(calendars.best_distribution(log))
    replayed = replay.steps(log, nodes, flows)
    ways = replay.gateway_flows(replayed, nodes, flows).filter("kind <> 'parallelGateway'")
    share = F.round(1 / F.count(F.lit(1)).over(Window.partitionBy("gateway_id")), 6) if flow.gateway_probabilities == "equiprobable" else F.col("probability")
    paths = ways.select(F.col("gateway_id").alias("gateway"), F.col("flow_id").alias("path"), "taken", share.alias("observed"))
    numbers = _numeric(log, more)
    names = [k for k in more if k not in numbers]
    branches = None
    if flow.discover_branch_rules:
        found = rule_learning.learn(_choices(log, replayed, nodes, flows, more), ["hour", *numbers], ["r", *names], flow.f_score)
        branches = rules_json.learned_branch_json(found)
        paths = paths.join(branches.select(F.col("id").alias("path"), F.col("id").alias("condition_id")), "path", "left")
    case_attributes = event_attributes = global_attributes = None
    if more and (common.discover_data_attributes or resources.discover_prioritization_rules):
        case_attributes = rules.case_attribute_scores(log, more)
    if more and common.discover_data_attributes:
        event_attributes, global_attributes = rules.event_attribute_scores(log, more), rules.global_attribute_scores(log, more)
    priorities = None
    if case_attributes is not None and resources.discover_prioritization_rules:
        own = [r.attribute for r in case_attributes.filter("is_case").collect()]
        if own:
            values = rules.interval_labels(log.select("eid", *own), [k for k in own if k in numbers])
            priorities = rules_json.priority_levels_json(rules.priority_levels(rules.overtakes(log, enabled), values, own))
    extra = None
    if delays:
        if delays.discovery_method.lower().replace("_", "-") == "naive":
            extra = rules.extraneous(log, enabled).filter("delayed > 0").select("a", "mean_s")
        else:
            hours = rules.extraneous_on_calendar(log, enabled, calendars.granule_activity(log, F.col("r")))
            extra = hours.groupBy("a").agg((F.avg("extraneous_h") * 3600).alias("mean_s"))
        extra = stored(extra)
        nodes, flows = (stored(x) for x in bpmn.add_timers(nodes, flows, extra.select(F.col("a").alias("activity"))))
    hands = log.select("r", "a").distinct()
    if given:
        known = hands.select("a").distinct()
        tasks = bpmn.activity_ids(nodes).select(F.col("name").alias("a"))
        missing = stored(calendars.repair_missing(tasks, log, log.select("r"), known))
        hands = hands.unionByName(missing.select("r", "a"))
        best = best.unionByName(missing.select("a", "family", "mean").distinct().withColumn("std", F.lit(0.0)).withColumn("error", F.lit(0.0)))
    batches = None
    if resources.discover_batching_rules:
        runs = rules.batch_sessions(log)
        ids = bpmn.activity_ids(nodes).select(F.col("name").alias("a"), "id")
        fired = rules.learned_firing(rules.batch_firing(runs, enabled))
        batches = rules_json.learned_batch_json(fired, rules.batch_characteristics(runs), rules.batch_sizes(runs), ids)
    gaps = calendars.interarrivals(log)
    if common.use_observed_arrival_distribution:
        arrivals = calendars.arrival_histogram(log)
    else:
        fitted = gaps.filter("gap_us IS NOT NULL").select(F.lit("arrival").alias("a"), F.lit(0).alias("s"), F.col("gap_us").alias("e"))
        arrivals = stored(calendars.best_distribution(fitted).select("family", "mean", "std"))
    instants = gaps.select(F.col("arrival_us").alias("s"), F.col("arrival_us").alias("e"))
    arrival_calendar = calendars.intervals(calendars.crisp_scores(instants, F.lit(0), 60), 60).select("w", "begin_min", "end_min")
    return ProcessModel(
        nodes, flows, paths, arrivals, _calendars(log, settings, work), best.select("a", "family", "mean", "std"), hands, arrival_calendar=arrival_calendar, batches=batches, priorities=priorities,
        branches=branches, attributes=case_attributes if common.discover_data_attributes or priorities is not None else None, event_attributes=event_attributes, global_attributes=global_attributes,
        delays=extra, pools=calendars.pools(log) if resources.discovery_type == "pool" else None, granule=work["granule"], fuzzy=resources.discovery_type == "resource_fuzzy",
    )


def search_work(train: DataFrame, valid: DataFrame, settings: Settings, seed: int) -> tuple[dict, Tuner]:
    """The calendar parameters whose open hours lie nearest to the validation cases', among num_iterations trials."""
    w = settings.resource_model
    low, high = _range(w.granularity)
    space = {"granule": [g for g in DIVISORS_OF_DAY if low <= g <= high] or [max(g for g in DIVISORS_OF_DAY if g <= max(1, high))]}
    space |= {k: _range(getattr(w, k)) for k in ("confidence", "support", "participation", "fuzzy_angle")}
    search = Tuner(space, seed=seed)
    for _ in range(w.num_iterations):
        p = search.ask()
        with scratch(train.sparkSession):
            loss = calendar_loss(train, valid, settings, p)
        search.tell(p, loss)
    ok = [t for t in search.trials if t["status"] == "ok"]
    first = {k: v[-1] if isinstance(v, list) else v[0] for k, v in space.items()}
    return (search.best()["params"] if ok else first), search


def run(spark: SparkSession, settings: Settings, log: DataFrame, output: str | None = None, test: DataFrame | None = None, seed: int = 1) -> tuple[ProcessModel, DataFrame, DataFrame | None]:
    """(model, trials, measurements or None) of a canonical log; a test log is taken as it is, without preparation."""
    meter = Meter()
    flow = settings.control_flow
    idle = without_effect(settings)
    if idle:
        warnings.warn(f"without effect: {', '.join(idle)}", stacklevel=2)
    with meter.stage("preprocessing"):
        log = prepared(log, settings).cache()
        kept = [log]
        if test is None:
            parts = preprocess.partitions(log)
            log = log.join(parts, "c").cache()
            kept.append(log)
            test = log.filter("part = 'test'").drop("part")
            learn = log.filter("part <> 'test'").drop("part")
            train, valid = (log.filter(F.col("part") == x).drop("part") for x in ("train", "validation"))
        else:
            learn, cut = log, preprocess.split(log)
            train, valid = (log.join(cut.filter(F.col("train") == x).select("c"), "c", "left_semi") for x in (True, False))
    given = bpmn.read_bpmn(spark, settings.common.process_model_path) if settings.common.process_model_path else None
    cases = valid.select("c").distinct().count()
    miner = lambda p: discovery.Miner(flow.mining_algorithm or "sm1", p["eta"], p["epsilon"], bool(flow.prioritize_parallelism), bool(flow.replace_or_joins))

    with meter.stage("control-flow"):
        search = Tuner({"eta": _range(flow.eta or 0.4), "epsilon": _range(flow.epsilon or 0.3)}, seed=seed)

        def flow_loss(p: dict) -> float | None:
            """The distance of logs generated from the cases that fit the graph; a graph that no case fits fails."""
            allowed = discovery.pruned_graph(train, miner(p)).filter("kept OR concurrent").select("a", "b")
            steps = traces.directly_follows(train).join(allowed, ["a", "b"], "left_anti").select("c").distinct()
            fits = train.join(steps, "c", "left_anti")
            if fits.limit(1).count() == 0:
                return None
            sim = simulate.simulate(spark, simulate.simulation_model(fits), cases, flow.num_evaluations_per_iteration, seed)
            return simulate.measure(sim, valid, [flow.optimization_metric], flow.num_evaluations_per_iteration).agg(F.avg("distance")).collect()[0][0]

        for _ in range(flow.num_iterations if given is None else 1):
            p = search.ask()
            with scratch(spark):
                loss = flow_loss(p)
            search.tell(p, loss)
        ok = [t for t in search.trials if t["status"] == "ok"]
        best = search.best()["params"] if ok else {"eta": 0.4, "epsilon": 0.3}
    with meter.stage("resources"):
        work, work_search = search_work(train, valid, settings, seed)
        model = discover(learn, settings, miner(best), work, given)
    measured = None
    if settings.common.perform_final_evaluation:
        with meter.stage("evaluation"):
            n = settings.common.num_final_evaluations
            sim = simulate.simulate(spark, simulate.simulation_model(learn), test.select("c").distinct().count(), n, seed)
            measured = simulate.measure(sim, test, settings.common.evaluation_metrics, n).orderBy("metric", "distance", "run_num")
    trials = search.table(spark)
    if output:
        with meter.stage("export"):
            model.write(output)
            settings.to_yaml(f"{output}/configuration.yaml")
            flow_part = best | {"mining_algorithm": flow.mining_algorithm, "gateway_probabilities": flow.gateway_probabilities, "replace_or_joins": flow.replace_or_joins, "prioritize_parallelism": flow.prioritize_parallelism, "f_score": flow.f_score, "output_path": output, "process_model": settings.common.process_model_path}
            chosen = {"control_flow": flow_part, "calendars": work | {"discovery_type": settings.resource_model.discovery_type}}
            (Path(output) / "canonical_model.json").write_text(json.dumps(chosen, indent=1, default=str))
            for name, rows in (("trials", trials), ("resource_trials", work_search.table(spark))):
                rows.orderBy("loss", "trial").select("trial", "status", "loss", F.to_json("params").alias("params")).write.mode("overwrite").option("header", True).csv(f"{output}/{name}")
            if measured is not None:
                measured.write.mode("overwrite").option("header", True).csv(f"{output}/evaluation_metrics")
        (Path(output) / "runtimes.json").write_text(json.dumps(meter.seconds, indent=1))
        if settings.common.clean_intermediate_files:
            for x in kept:
                x.unpersist()
    return model, trials, measured


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="caseflow")
    p.add_argument("--configuration")
    p.add_argument("--output", default="outputs")
    p.add_argument("--one-shot", action="store_true")
    p.add_argument("--event-log")
    p.add_argument("--schema", action="store_true", help="print the settings' names, types and defaults")
    p.add_argument("--version", action="store_true")
    a = p.parse_args(args)
    if a.version:
        print("caseflow 1")
        return 0
    if a.schema:
        print(json.dumps(schema(), indent=1, default=str))
        return 0
    if not a.one_shot and not a.configuration:
        p.error("either --configuration or --one-shot with --event-log")
    if a.one_shot and not a.event_log:
        p.error("--one-shot needs --event-log")
    settings = Settings.one_shot(a.event_log) if a.one_shot else Settings.from_yaml(a.configuration)
    spark = SparkSession.builder.getOrCreate()
    roles = Roles(**settings.common.log_ids)
    read = lambda path: canonical(read_csv_log(spark, path, roles))
    test = read(settings.common.test_log_path) if settings.common.test_log_path else None
    run(spark, settings, read(settings.common.train_log_path), a.output, test)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
