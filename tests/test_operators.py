import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseflow.functions import scalars
from caseflow.operators import attribute_updates, calendars, distances, nested, preprocess, quantiles, rule_learning, rules, run_measures, traces
from caseflow.operators.variants_distance import coded_traces, control_flow_distance, damerau_levenshtein, distances_of
from caseflow.plans import discovery, nesting, replay, simulate, tuner
from caseflow.sources import bpmn, logs
from caseflow.streaming import silence

HOUR = 3_600_000_000
SCHEMA = "eid long, c long, a string, r long, s long, e long"


def log(spark, rows):
    return spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], SCHEMA)


def some(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randrange(0, 400 * HOUR, 60_000_000)
        rows.append((rng.randrange(12), rng.choice("abcd"), rng.randrange(4), s, s + rng.randrange(0, 5 * HOUR, 60_000_000)))
    return log(spark, rows)


@pytest.mark.parametrize("metric", [*distances.METRICS, "2_gram", "3_gram"])
def test_distance_of_a_log_to_itself_is_zero(spark, metric):
    one = some(spark)
    both = one.withColumn("side", F.lit(0)).unionByName(one.withColumn("c", F.col("c") + 1000).withColumn("side", F.lit(1)))
    assert distances.distance(both, metric).collect()[0]["distance"] == 0


def test_distances_are_symmetric(spark):
    x = some(spark).withColumn("side", (F.col("c") % 2).cast("int"))
    y = x.withColumn("side", 1 - F.col("side"))
    for m in distances.METRICS:
        a, b = (distances.distance(z, m).collect()[0]["distance"] for z in (x, y))
        assert a == pytest.approx(b) and a > 0


def test_unknown_metric_raises(spark):
    with pytest.raises(ValueError):
        distances.distance(some(spark), "nothing")


def test_split_keeps_cases_whole_and_in_order(spark):
    got = preprocess.split(some(spark), 0.8).orderBy("first_us", "c").collect()
    flags = [r.train for r in got]
    assert flags == sorted(flags, reverse=True) and sum(r.events for r in got if r.train) <= 0.8 * 300
    parts = {r.c: r.part for r in preprocess.partitions(some(spark)).collect()}
    assert set(parts.values()) == {"train", "validation", "test"} and len(parts) == 12


def test_multitasking_shares_sum_to_the_union_of_work(spark):
    df = some(spark)
    worked = {r.eid: r.worked_us for r in preprocess.multitask_adjust(df).collect()}
    rows = df.collect()
    assert all(worked[r.eid] <= r.e - r.s + 1e-3 for r in rows)
    for res in range(4):
        own = sorted((r.s, r.e) for r in rows if r.r == res)
        union, end = 0, None
        for s, e in own:
            if end is None or s > end:
                union, end = union + e - s, e
            elif e > end:
                union, end = union + e - end, e
        assert sum(worked[r.eid] for r in rows if r.r == res) == pytest.approx(union, rel=1e-9)


def test_overtakes_agree_with_a_plain_loop(spark):
    df = some(spark, 150)
    enabled = df.select("eid", (F.col("s") - 3 * HOUR * (F.col("eid") % 4)).alias("enabled_us"))
    got = sorted((r.eid, r.over) for r in rules.overtakes(df, enabled).collect())
    rows = [(r.eid, r.a, r.r, r.s, r.s - 3 * HOUR * (r.eid % 4)) for r in df.collect()]
    want = sorted((y[0], x[0]) for x in rows for y in rows if x[1:3] == y[1:3] and x[4] < y[4] <= x[3] and y[3] < x[3])
    assert got == want


def test_batches_of_the_known_shapes(spark):
    m = 60_000_000
    rows = [(1, "A", 1, 0, m), (2, "A", 1, m, 2 * m), (3, "A", 1, 2 * m, 3 * m), (4, "A", 1, 60 * m, 61 * m)]
    rows += [(k, "B", 1, 0, m) for k in range(3)] + [(1, "C", 1, 0, 3 * m), (2, "C", 1, m, 4 * m), (3, "C", 1, 2 * m, 3 * m)]
    got = {(r.a, r.size, r.kind, r.batched) for r in rules.batch_sessions(log(spark, rows)).collect()}
    assert got == {("A", 3, "sequential", True), ("A", 1, "single", False), ("B", 3, "parallel", True), ("C", 3, "concurrent", True)}


def test_calendar_intervals_merge_touching_granules(spark):
    rows = [(1, "A", 1, 9 * HOUR, 11 * HOUR - 1), (2, "A", 1, 14 * HOUR, 15 * HOUR - 1)]
    scores = calendars.crisp_scores(log(spark, rows), F.col("r"))
    assert sorted((r.begin_min, r.end_min) for r in calendars.intervals(scores).collect()) == [(540, 660), (840, 900)]
    with pytest.raises(ValueError):
        calendars.granules(log(spark, rows), F.col("r"), 50)


def test_relaxed_calendar_reaches_its_support(spark):
    scores = calendars.relaxed(some(spark), F.col("r"), 60, 0.9, 0.5)
    assert all(r.support >= 0.5 for r in calendars.crisp_support(scores).collect())


def test_missing_activity_gets_every_resource_and_a_second(spark):
    df = some(spark)
    model = spark.createDataFrame([("a",), ("z",)], "a string")
    got = calendars.repair_missing(model, df, df.select("r"), df.select("a")).collect()
    assert sorted((r.a, r.r, r.family, r["mean"]) for r in got) == [("z", k, "fix", 1.0) for k in range(4)]


def test_fixed_durations_are_recognised(spark):
    got = calendars.best_distribution(log(spark, [(k, "A", 1, k * HOUR, k * HOUR + 60_000_000) for k in range(20)])).collect()
    assert [(r.a, r.family, r["mean"]) for r in got] == [("A", "fix", 60.0)]


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=60, deadline=None)
def test_damerau_levenshtein_is_a_metric(x, y):
    d = damerau_levenshtein(x, y)
    assert d == damerau_levenshtein(y, x) and (d == 0) == (x == y) and d <= max(len(x), len(y))


def test_damerau_levenshtein_is_the_unrestricted_one():
    assert damerau_levenshtein("ca", "abc") == 2


def test_nearest_divisor_and_names(spark):
    row = spark.range(1).select(
        *[scalars.nearest_divisor(F.lit(g)).alias(f"g{g}") for g in (1, 7, 50, 100, 2000)], scalars.safe_granularity(F.lit(60)).alias("s"),
        scalars.weekday_name(scalars.weekday_number(F.lit("friday"))).alias("d"), scalars.firing_name(F.lit("batch_max_wt")).alias("f"), scalars.firing_name(F.lit("size"), True).alias("b"),
    ).collect()[0]
    assert tuple(row) == (1, 6, 48, 96, 1440, 60, "Friday", "large_wt", "batch_size")


def test_rules_as_data(spark):
    df = spark.createDataFrame([(1, "x"), (5, "y"), (9, "x")], "n int, t string")
    keep = lambda rule: [r.n for r in df.filter(scalars.any_of_all(rule)).orderBy("n").collect()]
    assert keep([[("t", "=", "x"), ("n", ">", 3)]]) == [9]
    assert keep([[("t", "in", ["y"])], [("n", "<", 2)]]) == [1, 5]
    assert keep([[("n", "in", (1, 9))]]) == [5]
    assert keep([]) == []
    with pytest.raises(ValueError):
        scalars.comparison(F.col("n"), "~", 1)


def test_csv_logs_and_guards(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("case,act,begin,finish,res,extra\n1,A,2021-01-01 08:00:00+00:00,2021-01-01 09:00:00.5+00:00,x,7\n")
    df = logs.read_csv_log(spark, str(path), logs.Roles("case", "act", "res", "begin", "finish"))
    r = df.collect()[0]
    assert (r.case_id, r.activity, r.resource, r.extra) == ("1", "A", "x", "7") and r.end_time - r.start_time == 3_600_500_000
    for bad in ("log.xes", "log.txt", "log.csv.zip"):
        with pytest.raises(ValueError):
            logs.read_csv_log(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        logs.read_csv_log(spark, str(path))


def test_xes_export_fills_strings_only(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 'A"<', None, 0, 1_500)], "eid long, c long, a string, r string, s long, e long")
    r = logs.xes_rows(df).collect()[0].asDict()
    assert r["org:resource"] == "UNDEFINED" and r["start_timestamp"] == "1970-01-01T00:00:00.000+00:00" and r["time:timestamp"].endswith("00.001+00:00")
    logs.write_xes(df, str(tmp_path / "x"))
    assert 'value="A&quot;&lt;"' in spark.read.text(str(tmp_path / "x")).collect()[0][0]


def test_graph_goes_out_and_comes_back_with_timers(spark, tmp_path):
    nodes, flows = discovery.process_graph(some(spark))
    path = tmp_path / "m.bpmn"
    path.write_text(bpmn.to_bpmn(nodes, flows))
    n2, f2 = bpmn.read_bpmn(spark, str(path))
    assert sorted(map(tuple, f2.collect())) == sorted(map(tuple, flows.collect())) and n2.count() == nodes.count()
    delays = spark.createDataFrame([("a",), ("nobody",)], "activity string")
    for before in (True, False):
        n3, f3 = bpmn.add_timers(nodes, flows, delays, before)
        assert n3.count() == nodes.count() + 1 and f3.count() == flows.count() + 1
        timer = n3.filter("kind = 'intermediateCatchEvent'").collect()[0].id
        far = f3.filter(F.col("source" if before else "target") == timer).collect()
        assert [x.target if before else x.source for x in far] == ["a"]
    with pytest.raises(KeyError):
        bpmn.with_ids(delays, nodes)


def test_unknown_miner_raises():
    with pytest.raises(ValueError):
        discovery.Miner("heuristics")


def test_simulation_is_seeded_and_like_its_log(spark):
    df = some(spark)
    model = simulate.simulation_model(df)
    a, b = (sorted(map(tuple, simulate.simulate(spark, model, 12, 2, seed=5).collect())) for _ in range(2))
    assert a == b and {x[0] for x in a} == {0, 1} and {x[2] for x in a} <= set("abcd")
    assert all(x[4] <= x[5] for x in a)


def test_tuner_finds_a_minimum_and_survives_failures(spark):
    t = tuner.Tuner({"x": (0.0, 1.0), "k": ["a", "b"]}, warm_up=10)
    best = t.run(lambda p: 1 / 0 if p["x"] > 0.95 else abs(p["x"] - 0.3) + (p["k"] == "b"), 60)
    assert abs(best["params"]["x"] - 0.3) < 0.1 and best["params"]["k"] == "a"
    assert t.table(spark).filter("status = 'fail' AND loss <> 1").count() == 0
    m = spark.createDataFrame([(0, 0.5), (1, -1.0), (2, None), (3, 0.25)], "trial int, distance double")
    assert tuner.best_trial(tuner.response(m)).collect()[0].trial == 3


def test_ngrams_of_one_trace(spark):
    got = {(r.g1, r.g2): r.cnt for r in traces.ngrams(log(spark, [(1, "x", 1, 0, 1), (1, "y", 1, 1, 2)]), 2).collect()}
    assert got == {("<", "x"): 1, ("x", "y"): 1, ("y", ">"): 1}


def test_empty_logs(spark):
    none = log(spark, [])
    assert traces.dfg(none).count() == 0 and preprocess.split(none).count() == 0 and rules.batch_sessions(none).count() == 0
    assert calendars.interarrivals(none).count() == 0 and preprocess.multitask_adjust(none).count() == 0


def test_variant_pairs_compare_whole_traces_once(spark):
    from caseflow.operators.variants_distance import variant_pairs

    traces_ = {0: "a" * 60 + "b", 2: "a" * 60 + "b", 1: "a" * 60 + "c" * 9, 3: "a" * 60 + "b"}
    log = spark.createDataFrame([(c, a, e, e) for c, t in traces_.items() for e, a in enumerate(t)], "c long, a string, e long, eid long")
    got = {(r.x_cases, r.y[60:], r.y_cases, r.steps) for r in variant_pairs(log.filter("c % 2 = 0"), log.filter("c % 2 = 1"), log).collect()}
    assert got == {(2, "C" * 9, 1, 9), (2, "B", 1, 0)}


def test_distances_of_many_pairs_at_once():
    xs, ys = ["", "abc", "ca", "abcd" * 5, "x"], ["ab", "", "abc", "acbd" * 5, "x"]
    assert distances_of(xs, ys) == [damerau_levenshtein(a, b) for a, b in zip(xs, ys, strict=True)] == [2, 3, 2, 5, 0]


def test_traces_of_very_many_activities(spark):
    names = [f"a{k:03d}" for k in range(400)]
    log = spark.createDataFrame([(1, a, k, k) for k, a in enumerate(names)], "c long, a string, e long, eid long")
    trace = coded_traces(log).collect()[0].trace
    assert len(trace) == len(set(trace)) == 400 and trace[:3] == "ABC"


def test_control_flow_distance_of_matched_cases(spark):
    def of(one, other):
        rows_ = [(10 * k + side, side, a, e, e) for side, traces_ in ((0, one), (1, other)) for k, t in enumerate(traces_) for e, a in enumerate(t)]
        return tuple(control_flow_distance(spark.createDataFrame(rows_, "c long, side int, a string, e long, eid long")).collect()[0])[:3]

    assert of(["abc", "abd", "abc"], ["abd", "abc", "abc"]) == (0.0, 3, 0)
    assert of(["abcd"], ["abdc"]) == (0.25, 1, 0)
    assert of(["ab", "ab", "xyzw"], ["ab"]) == (pytest.approx(2 / 3, abs=1e-6), 3, 2)
    assert of(["aaaa"] * 2, ["aaab", "bbbb"]) == (pytest.approx(1.25 / 2), 2, 0)


def test_pools_of_long_chains(spark):
    # resource k does activities k and k + 1: neighbours are alike, the ends of the chain are not
    log = spark.createDataFrame([(k, f"a{a:03d}") for k in range(70) for a in (k, k + 1)], "r long, a string")
    assert {r.pool for r in calendars.pools(log, 0.4).collect()} == {0}


def test_windows_in_two_levels_keep_null_resources(spark):
    rows_ = [(k, 1 + k % 2, "ab"[k % 2], None if k % 3 == 0 else k % 3, k * 1_000_000_000, (k + 2) * 1_000_000_000) for k in range(40)]
    df = spark.createDataFrame(rows_, "eid long, c long, a string, r long, s long, e long")
    assert preprocess.estimated_starts(df).count() == rules.batch_sessions(df).count() == preprocess.multitask_adjust(df).count() == 40
    none = preprocess.estimated_starts(df.filter("r IS NULL").withColumn("c", F.col("eid"))).orderBy("eid").collect()
    assert [r.start_us for r in none] == [2_000_000_000] + [(k + 2) * 1_000_000_000 for k in range(0, 39, 3)]


def test_no_window_runs_over_a_resource_alone(spark, capsys):
    df = some(spark)
    enabled = df.select("eid", F.col("s").alias("enabled_us"))
    for out in (preprocess.estimated_starts(df), rules.waiting(df, enabled), rules.batch_sessions(df)):
        out.explain("formatted")
        text = capsys.readouterr().out
        windows = re.findall(r"Window\n.*?\n(?=\n)", text, re.S)
        over_events = [w for w in windows if "eid#" in w and "c#" not in w.split("Arguments")[-1]]
        assert windows and all("_hour#" in w for w in over_events)


def test_the_second_miner_follows_intervals(spark):
    # b and c run side by side after a; d follows both
    cases = [(4 * k + n, k, x, 1, 1000 * k + s, 1000 * k + e) for k in range(5) for n, (x, s, e) in enumerate((("a", 0, 10), ("b", 20, 50), ("c", 30, 60), ("d", 70, 80)))]
    df = spark.createDataFrame(cases, "eid long, c long, a string, r long, s long, e long")
    got = {(r.a, r.b, r.n, r.concurrent) for r in discovery.pruned_graph(df, discovery.Miner("sm2", epsilon=0.5)).collect()}
    assert got == {("a", "b", 5, False), ("a", "c", 5, False), ("b", "d", 5, False), ("c", "d", 5, False)}
    kinds = lambda **o: {r.id: r.kind for r in discovery.process_graph(df, discovery.Miner("sm2", epsilon=0.5, **o))[0].collect()}
    assert kinds()["split_a"] == "exclusiveGateway"


def test_partitions_are_exported_apart(spark, tmp_path):
    df = some(spark)
    parts = spark.createDataFrame([(c.c, ("train", "test")[k % 2]) for k, c in enumerate(df.select("c").distinct().orderBy("c").collect())], "c long, part string")
    logs.write_partitions(df, parts, str(tmp_path / "x"))
    n = {p: spark.read.text(str(tmp_path / "x" / p)).filter("value LIKE '<trace>%'").count() for p in ("train", "validation", "test")}
    assert n["validation"] == 0 and n["train"] + n["test"] == parts.count()


def test_models_with_comments_quotes_and_prefixes(spark, tmp_path):
    path = tmp_path / "m.bpmn"
    path.write_text("""<?xml version="1.0"?><b:definitions xmlns:b="http://x"><b:process id="p"><!-- <b:task id="no" name="no"/> --><b:task id='t1' name='A &amp; "B"'/>
<b:task id="t2"/><b:startEvent name="" id="s"/><b:sequenceFlow targetRef="t1" id="f1" sourceRef='s'/><b:sequenceFlow id="f2" sourceRef="t1" targetRef="t2"/></b:process></b:definitions>""")
    nodes, flows = bpmn.read_bpmn(spark, str(path))
    assert sorted(map(tuple, nodes.collect()), key=str) == [("s", "startEvent", None), ("t1", "task", 'A & "B"'), ("t2", "task", None)]
    assert sorted(map(tuple, flows.collect())) == [("f1", "s", "t1"), ("f2", "t1", "t2")]


def rule_examples(n=900, seed=3):
    """Paths by two intervals that hold together, by a value, or otherwise; a few are wrong."""
    rng, out = random.Random(seed), []
    for k in range(n):
        x, z, v = rng.random() * 100, rng.random() * 100, rng.choice("abc")
        y = "both" if x > 60 and z <= 40 else "value" if v == "c" else "rest"
        out.append(("gate", "rest" if k % 90 == 0 else y, k % 3 == 0, x, z if k % 50 else None, v))
    return out + [("one", "only", False, 1.0, 1.0, "a")] * 5 + [("gate", None, False, 1.0, 1.0, "a")]


def test_rules_of_two_intervals_are_found_again(spark):
    df = spark.createDataFrame(rule_examples(), "g string, y string, hold boolean, x double, z double, v string")
    got = rule_learning.learn(df, ["x", "z"], ["v"]).collect()
    first = {(r.attribute, r.comparison): r.bound for r in got if r.y == "both" and r.rule == 0}
    assert set(first) == {("x", ">"), ("z", "<=")} and 50 <= first["x", ">"] <= 70 and 30 <= first["z", "<="] <= 50
    assert any(r.attribute == "v" and r.value == "c" for r in got if r.y == "value") and all(r.kept for r in got if r.y in ("both", "value"))
    assert {r.g for r in got} == {"gate"} and max(r.rule for r in got) < rule_learning.RULES


def test_rules_of_one_outcome_and_of_no_examples(spark):
    df = spark.createDataFrame(rule_examples(), "g string, y string, hold boolean, x double, z double, v string")
    assert {r.y for r in rule_learning.learn(df, ["x", "z"], ["v"], outcome="both").collect()} == {"both"}
    assert rule_learning.learn(df.filter("false"), ["x"], ["v"]).count() == 0


def test_starts_ignore_ends_of_concurrent_activities(spark):
    log = spark.createDataFrame([(1, 0, "A", 0, 10), (2, 0, "B", 1, 20), (3, 0, "C", 2, 30), (4, 0, "D", 3, 35)], "eid long, c long, a string, r long, e long")
    pairs = spark.createDataFrame([("B", "C")], "a string, b string")
    of = lambda p: [r.start_us for r in preprocess.estimated_starts(log, p).orderBy("eid").collect()]
    assert of(None) == [10, 10, 20, 30] and of(pairs) == [10, 10, 10, 30]


def test_kinds_of_batches(spark):
    rows = [(k, "A", "r1", k // 3, 3, "parallel") for k in range(9)] + [(10, "A", "r2", 9, 1, "single"), (11, "B", "r1", 0, 1, "single")]
    got = rules.batch_characteristics(spark.createDataFrame(rows, "eid long, a string, r string, session long, size long, kind string")).collect()
    assert [tuple(x) for x in got] == [("A", "parallel", 0.9, ["r1"])]


def traced(spark, traces, step=HOUR):
    rows = [(c, a, 0, c * 100 * step + k * step, c * 100 * step + k * step + step // 2) for c, t in enumerate(traces) for k, a in enumerate(t)]
    return log(spark, rows)


def test_a_block_of_choice_beside_an_activity_is_found_again(spark):
    rng, traces = random.Random(1), []
    for k in range(60):
        block = [["A", "B"][k % 2], "C"]
        rng.shuffle(block)
        traces.append(["S", *block, "T"] if k % 3 else ["S", *block[::-1], "T"])
    events = traced(spark, traces)
    nodes, flows = nesting.nested_graph(events, discovery.Miner(eta=0.0, epsilon=0.9))
    kind = {r.id: r.kind for r in nodes.collect()}
    out = {}
    for r in flows.collect():
        out.setdefault(r.source, set()).add(r.target)
    (top,) = out["S"]
    assert kind[top] == "parallelGateway" and len(out[top]) == 2 and "C" in out[top]
    (choice,) = out[top] - {"C"}
    assert kind[choice] == "exclusiveGateway" and out[choice] == {"A", "B"}
    (join,) = out["A"]
    assert out["B"] == {join} and kind[join] == "exclusiveGateway" and {kind[x] for x in out[join]} == {"parallelGateway"} == {kind[x] for x in out["C"]}
    # and its log can be replayed on it
    assert all(r.steps == r.fitting for r in replay.fitness(replay.steps(events, nodes, flows)).collect())


def test_short_loops(spark):
    events = traced(spark, [["S", *"A" * (1 + k % 4), *("XYX" if k % 2 else "XYXYX"), "T"] for k in range(20)])
    nodes, flows = nesting.nested_graph(events, discovery.Miner(eta=0.0, epsilon=0.9))
    pairs = {(r.source, r.target) for r in flows.collect()}
    assert {("loop_A", "A"), ("A", "again_A"), ("again_A", "loop_A")} <= pairs
    assert not {r.kind for r in nodes.collect()} & {"parallelGateway"}
    assert all(r.steps == r.fitting for r in replay.fitness(replay.steps(events, nodes, flows)).collect())


def test_updates_of_attributes_are_found_again(spark):
    rng, rows = random.Random(6), []
    for c in range(60):
        v = {"line": 1.0, "tree": 1.0, "flat": 0.0, "few": 0.0, "wide": 0.0}
        for k in range(6):
            v = {"line": 2 * v["line"] + 3 if k % 3 else rng.random() * 9, "tree": (50.0 if v["line"] > 5 else 1.0), "flat": 7.0, "few": float(rng.randrange(3)), "wide": rng.random()}
            rows.append((c * 10 + k, c, "U" if k % 3 else "R", c * 100 + k, *v.values()))
    df = spark.createDataFrame(rows, "eid long, c long, a string, e long, line double, tree double, flat double, few double, wide double")
    got = {(r.attribute, r.a): r for r in attribute_updates.updates(df, ["line", "flat", "few", "wide"]).withColumn("text", attribute_updates.expression()).collect()}
    assert got["line", "U"].kind == "linear" and round(got["line", "U"].slope, 6) == 2 and round(got["line", "U"].intercept, 6) == 3 and got["line", "U"].text == "2.00000 * line + 3.00000"
    assert got["flat", "U"].kind == "constant" and got["few", "U"].kind == "table" and got["wide", "U"].kind == "spread"
    step = [(k, k // 2, "AB"[k % 2], k, float(k // 2 % 10) if k % 2 == 0 else (0.0, 50.0, 20.0, 90.0)[(k // 2 % 10) // 3 if k // 2 % 10 < 9 else 3]) for k in range(800)]
    tree = {r.a: r for r in attribute_updates.updates(spark.createDataFrame(step, "eid long, c long, a string, e long, x double"), ["x"]).collect()}["B"]
    assert tree.kind == "tree" and tree.tree_r2 > 0.95 > tree.line_r2


def test_largest_free_stretch_against_intervals(spark):
    rng = random.Random(12)
    rows = [(k % 9, "AB"[k % 2], k % 3, s := rng.randrange(0, 96 * 60) * 60_000_000, s + rng.randrange(0, 300) * 60_000_000) for k in range(120)]
    events = log(spark, rows)
    enabled = spark.createDataFrame([(k, x[3] - rng.randrange(0, 40 * 60) * 60_000_000) for k, x in enumerate(rows)], "eid long, enabled_us long")
    duty = [(r, w, g) for r in range(3) for w in range(7) for g in range(24) if (g + r) % 5 and (r != 2 or w != 4)]
    got = {r.eid: r.delay_us for r in rules.extraneous_largest(events, enabled, spark.createDataFrame(duty, "k long, w int, g int")).collect()}
    on, minute = set(duty), 60_000_000
    busy = {r: {m for _, _, q, s, e in rows if q == r for m in range(s // minute, e // minute)} for r in range(3)}
    for x in enabled.collect():
        _, _, r, s, _ = rows[x.eid]
        best = run = 0
        for m in range(x.enabled_us // minute, s // minute):
            free = m not in busy[r] and (r, (m // 1440 + 3) % 7, m // 60 % 24) in on
            run = run + 1 if free else 0
            best = max(best, run)
        if x.enabled_us < s:
            assert got[x.eid] == best * minute


def test_the_auction_is_the_cheapest_matching(spark):
    rng = random.Random(4)
    for n, m in ((4, 6),):
        sides = [["".join(rng.choices("abc", k=rng.randint(4, 6))) for _ in range(k)] for k in (n, m)]
        sides[1][0] = sides[0][0]
        rows_ = [(10 * k + side, side, a, e, e) for side, traces_ in enumerate(sides) for k, t in enumerate(traces_) for e, a in enumerate(t)]
        got = control_flow_distance(spark.createDataFrame(rows_, "c long, side int, a string, e long, eid long"), epsilon=0.004, rounds=200).collect()[0]
        few, many = sorted(sides, key=len)
        cost = lambda x, y: damerau_levenshtein(x, y) / max(len(x), len(y))
        best = min(sum(map(cost, few, way)) for way in itertools.permutations(many, len(few)))
        want = (best + len(many) - len(few)) / len(many)
        assert got.distance == pytest.approx(want, abs=1e-5) and 0 <= got.gap and got.unmatched == len(many) - len(few)


def test_few_candidates_widen_the_gap_and_keep_the_bound(spark):
    rng = random.Random(8)
    rows_ = [(10 * k + side, side, rng.choice("abcd"), e, e) for side in (0, 1) for k in range(9) for e in range(rng.randint(2, 9))]
    df = spark.createDataFrame(rows_, "c long, side int, a string, e long, eid long")
    whole, part = (control_flow_distance(df, most=m).collect()[0] for m in (32, 2))
    assert part.distance >= whole.distance - whole.gap - 1e-6 and part.distance - part.gap <= whole.distance + 1e-6


def test_all_metrics_of_all_runs_are_those_of_each(spark):
    events = some(spark, 200)
    runs = events.withColumn("run_num", (F.col("c") % 3).cast("int"))
    got = {(r.run_num, r.metric): r.distance for r in run_measures.measured(runs, events, list(run_measures.METRICS)).collect()}
    for k in range(3):
        one = runs.filter(F.col("run_num") == k).select(F.lit(0).alias("side"), *events.columns).unionByName(events.withColumn("c", -1 - F.col("c")).withColumn("side", F.lit(1)))
        for m in ("absolute_event_distribution", "cycle_time_distribution", "circadian_workforce_distribution", "3_gram"):
            assert got[k, m] == pytest.approx(distances.distance(one, m).collect()[0].distance, abs=1e-6)
    plan = run_measures.histograms(runs, ["3_gram"])._jdf.queryExecution().toString()
    assert plan.count("Scan parquet") <= 2  # what is left is the stored table
    with pytest.raises(ValueError):
        run_measures.measured(runs, events, ["control_flow_log_distance"])


def test_a_coarse_calendar_from_fine_granules(spark):
    events = some(spark, 200)
    cube = calendars.calendar_cube(events, F.col("r"), [30, 60, 240])
    for m in (30, 60, 240):
        want = sorted(map(tuple, calendars.granule_activity(events, F.col("r"), m).select("k", "w", "g", "days").collect()))
        assert sorted(map(tuple, cube.filter(F.col("minutes") == m).select("k", "w", "g", "days").collect())) == want
    with pytest.raises(ValueError):
        calendars.calendar_cube(events, F.col("r"), [7])


@given(st.lists(st.tuples(st.integers(0, 200), st.sampled_from("ab")), max_size=20), st.integers(0, 30))
@settings(max_examples=50, deadline=None)
def test_runs_are_cut_where_nothing_happened_for_long(events, gap):
    got = silence.runs(events, gap)
    assert [x for run in got for x in run] == sorted(events)
    assert all(y[0] - x[0] <= gap for run in got for x, y in zip(run, run[1:])) and all(q[0][0] - p[-1][0] > gap for p, q in zip(got, got[1:]))


def test_a_stream_in_several_batches_emits_silent_cases_once(spark, tmp_path):
    minute = 60_000_000
    batches = [[(0, 1, "a"), (5, 2, "a")], [(3, 1, "b"), (40, 3, "a")], [(20, 2, "b"), (100, 3, "b")], [(300, 9, "z")]]
    for n, rows_ in enumerate(batches):
        df = spark.createDataFrame([((1000 + t) * minute, c, a) for t, c, a in rows_], "us long, c long, a string")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, silence.PROVIDER)
    try:
        read = spark.readStream.schema("us long, c long, a string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = logs.drained_to_files(silence.silent_runs(read.withColumn("ts", F.timestamp_micros("us")), 10 * minute, "30 minutes"))
    finally:
        spark.conf.set(key, before)
    got = sorted((r.c, r.begin_us // minute - 1000, r.end_us // minute - 1000, r.trace) for r in out.collect())
    assert got == [(1, 0, 3, "a>b"), (2, 5, 5, "a"), (2, 20, 20, "b"), (3, 40, 40, "a"), (3, 100, 100, "b")]


def test_gamma_durations_are_told_by_sketches(spark):
    rng, shape = random.Random(3), 2.5
    rows = [(c, "g", 0, 0, int(rng.gammavariate(shape, 400.0) * 1_000_000)) for c in range(4000)] + [(c, "f", 0, 0, 60_000_000) for c in range(20)]
    events = log(spark, rows)
    got = {r.a: r for r in calendars.best_distribution(events).collect()}
    assert got["g"].family == "gamma" and got["f"].family == "fix"
    v = events.filter("a = 'g'").select(F.greatest(F.floor((F.col("e") - F.col("s")) / 1e6).cast("double"), F.lit(1.0)).alias("v"))
    fit = calendars.gamma_shape(v.agg((F.log(F.avg("v")) - F.avg(F.log("v"))).alias("spread")), "spread", "k").collect()[0].k
    assert fit == pytest.approx(shape, rel=0.06)
    plan = calendars.best_distribution(events)._jdf.queryExecution().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan


def test_digamma_and_trigamma_are_derivatives_of_log_gamma(spark):
    for x in (0.2, 1.0, 3.7, 40.0):
        r = spark.range(1).select(calendars._digamma(F.lit(x)).alias("d"), calendars._trigamma(F.lit(x)).alias("t")).collect()[0]
        h = 1e-4 * x
        assert r.d == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5, abs=1e-5)
        assert r.t == pytest.approx((math.lgamma(x + h) - 2 * math.lgamma(x) + math.lgamma(x - h)) / h**2, rel=1e-3)


def test_quantiles_of_many_values_are_exact(spark):
    n, shares = 400_003, [0.025, 0.125, 0.5, 0.975]
    rows = spark.range(n).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % n).alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("y"))
    got = {r.k: r.q for r in quantiles.exact(rows, ["k"], ["x", "y"], shares).collect()}
    place = lambda v: [v[max(1, len(v) - math.floor(len(v) - len(v) * p)) - 1] for p in shares]
    for k in (0, 1):
        assert got[k][0] == place(sorted((i * 7919) % n for i in range(k, n, 2)))
    assert got[0][1] == place(sorted(i % 5 for i in range(0, n, 2))) and got[1][1] == []
    assert {r.k: len(r.q[0]) for r in quantiles.exact(rows.filter("id < 4").withColumn("k", F.lit(None).cast("long")), ["k"], ["x"], shares).collect()} == {None: 4}


def test_durations_beyond_a_sketch_are_fitted_exactly(spark):
    n = 300_000
    events = spark.range(n).select(F.col("id").alias("c"), F.lit("a").alias("a"), F.lit(0).alias("r"), F.lit(0).cast("long").alias("s"), (F.floor(F.pow(F.col("id") / n, F.lit(3.0)) * 1e8) * 1_000_000).cast("long").alias("e"), F.col("id").alias("eid"))
    v = sorted(math.floor((i / n) ** 3 * 1e8) for i in range(n))
    q = [v[max(1, n - math.floor(n - n * p)) - 1] for p in calendars.QUANTILES]
    got, mean, lo = calendars.best_distribution(events).collect()[0], math.fsum(v) / n, v[0]
    want = {"expon": [lo - (mean - lo) * math.log(1 - p) for p in calendars.QUANTILES], "uniform": [lo + (v[-1] - lo) * p for p in calendars.QUANTILES]}
    assert got.family in want and got.error == pytest.approx(sum(abs(a - b) for a, b in zip(q, want[got.family], strict=True)) / len(q), abs=1e-3)


def test_cut_points_of_many_examples_are_exact(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") % 2).cast("string").alias("y"), (F.col("id") % 3 == 0).alias("hold"), ((F.col("id") * 7919) % n).alias("x"))
    cuts = rule_learning.cells(rows, ["x"], [])[1].collect()[0].cuts
    assert cuts == [[math.ceil(n * k / 16) - 1 for k in range(1, 16)]]


def test_bounds_of_rules_on_many_examples_are_exact(spark):
    n = 300_000
    point = lambda k: math.ceil(n * k / 16) - 1
    x = (F.col("id") * 7919) % n
    rows = spark.range(n).select(F.lit("g").alias("g"), F.when((x > point(3)) & (x <= point(10)), "in").otherwise("out").alias("y"), (F.col("id") % 3 == 0).alias("hold"), x.alias("x"), (F.col("id") % 7).alias("z"))
    got = {(r.comparison, r.bound, r.fp, r.f1) for r in rule_learning.learn(rows, ["x", "z"], [], outcome="in").collect()}
    assert got == {(">", point(3), 0, 1.0), ("<=", point(10), 0, 1.0)}


def test_updates_of_many_values_are_cut_exactly(spark):
    n = 300_000
    points = [math.ceil(n * k / 16) - 1 for k in (3, 7, 12)]
    x = (F.col("id") * 7919) % n
    stairs = sum((F.when(x > p, 100).otherwise(0) for p in points), F.lit(0))
    one = lambda a, e, v: F.struct(F.lit(a).alias("a"), F.lit(e).cast("long").alias("e"), v.cast("double").alias("v"))
    events = spark.range(n).select(F.col("id").alias("c"), F.explode(F.array(one("b", 0, x), one("a", 1, stairs))).alias("x")).select("c", "x.*", F.monotonically_increasing_id().alias("eid"))
    got = attribute_updates.updates(events, ["v"]).collect()
    assert [(r.a, r.n, r["values"], r.tree_r2, list(r.cuts)) for r in got] == [("a", n, 4, 1.0, points)]


@pytest.mark.parametrize("whole", [1 << 15, 4])
def test_overtakes_are_counted_as_they_are_listed(spark, monkeypatch, whole):
    monkeypatch.setattr(nested, "WAYS", 4)
    monkeypatch.setattr(nested, "WHOLE", whole)
    rng = random.Random(5)
    rows = []
    for k in range(400):
        s = rng.randrange(60) * HOUR // 7
        rows.append((rng.randrange(9), rng.choice("ab"), rng.choice([1, 2, None]), s, s))
    events = log(spark, rows)
    enabled = events.select("eid", (F.col("s") - (F.col("eid") * 7919) % 40 * (HOUR // 7)).alias("enabled_us"))
    values = events.select("eid", F.when(F.col("c") > 0, F.col("c") % 4).alias("v"))
    want = rules.priority_scores(rules.overtakes(events, enabled), values).collect()
    assert len(want) == 4 and {tuple(r) for r in rules.priority_counts(events, enabled, values).collect()} == {tuple(r) for r in want}


def test_counting_overtakes_makes_no_pairs(spark):
    n = 3000  # each wait holds all later ones
    events = spark.range(n).select(F.col("id").alias("eid"), (F.col("id") % 3).alias("c"), F.lit("a").alias("a"), F.lit(1).alias("r"), (F.lit(2 * n) - F.col("id")).alias("s"), (F.lit(2 * n) - F.col("id")).alias("e"))
    got = rules.priority_counts(events, events.select("eid", F.col("eid").alias("enabled_us")), events.select("eid", (F.col("c") % 3).alias("v"))).collect()
    assert sum(r.won for r in got) == n * (n - 1) // 2 - 3 * (n // 3 * (n // 3 - 1) // 2) == sum(r.contested for r in got) // 2
