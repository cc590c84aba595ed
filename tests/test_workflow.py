"""Graphs, workflows, validation and their odd cases."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import validate
from weftline.operators.paths import execution_paths, execution_states
from weftline.operators.workflow import actions, gateways, with_states, workflows
from weftline.sources import export
from weftline.sources.records import RECORD, event_records


def of(spark, *rows):
    """Rows: (record_no, file_index, nodes (rid, text, type, agent), edges (src, tgt, condition))."""
    return spark.createDataFrame([(n, f, "text", nodes, edges) for n, f, nodes, edges in rows], RECORD)


ODD = (
    1,
    10,
    [
        ("s", "", "StartNode", ""),
        ("x", "", "XOR", " Boss "),
        ("1", " Do it ", "Activity", " Clerk"),
        ("1", "Do  'that'", "Activity", "Clerk"),
        ("2", "!!!", "Activity", ""),
        ("e", "Done", "EndNode", "Clerk"),
        ("u", "", "EndNode", None),
        ("q", "note", "Timer", None),
    ],
    [("s", "x", ""), ("x", "1", " yes "), ("x", "u", ""), ("x", "e", "no"), ("x", "q", ""), ("x", "zz", ""), ("1", "2", None), ("1", "2", ""), ("2", "x", ""), ("1", "s", "")],
)


def test_duplicate_ids_degrees_and_ids(spark):
    g = G.nodes(G.graphs(of(spark, ODD))).orderBy("idx").collect()
    assert [n.rid for n in g] == ["s", "x", "1", "2", "e", "u", "q"]
    by = {n.rid: n for n in g}
    assert by["1"].text == "Do  'that'" and by["1"].action_id == "do__that" and by["2"].action_id == "" and by["x"].gateway_id == "gateway_xor_1"
    assert (by["x"].in_degree, by["x"].out_degree) == (2, 5) and by["s"].schema_id == "start" and by["u"].schema_id is None
    dangling = G.dangling_edges(G.graphs(of(spark, ODD))).collect()
    assert [(d.src, d.tgt, d.has_src, d.has_tgt) for d in dangling] == [("x", "zz", True, False)]


def test_actions_and_gateways(spark):
    flows = workflows(G.graphs(of(spark, ODD)))
    assert flows.select("workflow.actors").first()[0] == [" Boss ", " Clerk", "Clerk"]
    a = {r.id: r for r in actions(flows).collect()}
    assert a["do__that"].predecessors == ["gateway_xor_1"] and a["do__that"].successors == [""] and a["do__that"].actor == "Clerk" and a["do__that"].postconditions == ["do__that_done"]
    assert a[""].actor is None and a[""].successors == ["gateway_xor_1"]
    (x,) = gateways(flows).collect()
    assert x.role == "join_split" and x.type == "exclusive" and x.actor == "Boss"
    assert [(b.next, b.condition) for b in x.branches] == [("do__that", "yes"), (None, None), ("done", "no"), ("q", None)]
    assert x.incoming_from == [""]


def test_empty_and_null_records(spark):
    rows = spark.createDataFrame([(1, 1, None, None, None), (2, None, "", [], [])], RECORD)
    flows = workflows(G.graphs(rows)).orderBy("record_no").collect()
    assert [(f.workflow.actors, f.workflow.actions, f.workflow.gateways) for f in flows] == [([], [], [])] * 2
    assert execution_paths(G.graphs(rows)).count() == 0
    assert workflows(G.graphs(rows.limit(0))).count() == 0


def test_validation_disagreements(spark):
    """Graph and extraction differ by rule on unnamed starts, named ends, unknown nodes and empty ids."""
    rows = of(spark, ODD)
    m = validate.metrics(validate.joined(G.graphs(rows), workflows(G.graphs(rows)))).first().m
    # the unnamed start leads to a gateway: in the graph only; the empty id: in the extraction only
    assert (m.gateway_incoming.gt_count, m.gateway_incoming.ext_count, m.gateway_incoming.recall) == (1, 1, 0.0)
    assert [(p.a, p.b) for p in m.gateway_incoming.missing] == [("start", "gateway_xor_1")]
    # a named end is no next in triples; a node of unknown type is null there and raw in branches
    assert [(p.a, p.b, p.c) for p in m.branch_tuples.extra] == [("gateway_xor_1", "done", "no"), ("gateway_xor_1", "q", None)]
    assert [(p.a, p.b, p.c) for p in m.branch_tuples.missing] == [("gateway_xor_1", None, "no")]
    assert m.action_successors.extra == [] and [(p.a, p.b) for p in m.action_successors.missing] == [("do__that", "start")]
    assert m.branch_counts.accuracy == 0.0 and m.gateways.type_accuracy == 1.0
    assert m.actions.f1 == 1.0


def test_last_graph_of_a_file_index_and_unmatched(spark):
    node = lambda t: [("1", t, "Activity", "")]
    raw = of(spark, (1, 5, node("old"), []), (2, 5, node("new"), []))
    found = of(spark, (3, 5, node("new"), []), (4, 6, node("x"), []))
    m = validate.metrics(validate.joined(G.graphs(raw), workflows(G.graphs(found)))).collect()
    assert len(m) == 1 and m[0].m.actions.f1 == 1.0
    assert [r.file_index for r in validate.unmatched(raw, found).collect()] == [6]


def test_runs_of_a_user_with_very_many_events_keep_their_own_numbers(spark):
    """Run 1,000 of a user is not run 0 of the next one."""
    hot = spark.range(10_020).selectExpr("id as event_id", "1L as user_id", "'view' as event_type")
    rows = hot.unionByName(spark.range(20).selectExpr("id + 20000 as event_id", "2L as user_id", "'click' as event_type")).selectExpr("*", "timestamp_seconds(event_id) as ts", "1.0D as value")
    found = event_records(rows)
    numbers = [r.record_no for r in found.select("record_no").collect()]
    assert len(numbers) == len(set(numbers)) == 1004
    assert {*range(1000, 2000), 2000, 2001} <= set(numbers)
    pairs = validate.joined(G.graphs(found), workflows(G.graphs(found)))
    assert pairs.count() == 1004 and pairs.where("g[1].text <> workflow.actions[if(g[0].text = '', 0, 1)].name").count() == 0


def test_events_of_hot_users_are_dealt_out(spark):
    """A user with a third of all events: the records are the same, and no task orders or groups all of the user's events."""
    from weftline.sources import records

    rows = spark.range(0, 6000, 1, 3).selectExpr("id as event_id", "case when id % 3 = 0 then 5 when id % 97 = 0 then null else id % 50 end as user_id", "timestamp_seconds(id * 7919 % 1000) as ts", "concat('t', id % 4) as event_type", "cast(id as double) as value")
    key = lambda df: sorted(map(str, df.collect()))
    spread = records.event_records(rows, 300)
    assert key(spread) == key(records.event_records(rows)) and spread.where("file_index between 5000 and 5999").count() > 190
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test's partitions are small
        ranked = records._ranked(rows, 300).where("user_id = 5").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranked) > 1 and max(r["count"] for r in ranked) < 1900


def test_averages_of_nothing(spark):
    rows = of(spark, ODD)
    measured = validate.metrics(validate.joined(G.graphs(rows.limit(0)), workflows(G.graphs(rows))))
    row = validate.averages(measured).first()
    assert row.records == 0 and row.action_f1 is None
    assert validate.report(measured).count() == len(validate.HEADING) + 4 + len(validate.AVERAGES)


@pytest.mark.parametrize("x", ["plain", "it's", 'say "x"', "it's \"x\"", "a\\b", "line\nfeed", None])
def test_literals_sort_as_python_writes_them(spark, x):
    assert spark.createDataFrame([(x,)], "x string").select(F.expr(validate.literal("x"))).first()[0] == repr(x)


def test_json_shape(spark):
    g = G.graphs(of(spark, ODD))
    paths = execution_paths(g)
    out = json.loads(export.workflow_json(with_states(workflows(g), execution_states(paths))).first().json)
    assert list(out) == ["file_index", "procedure_text", "workflow"]
    w = out["workflow"]
    assert w["actions"][1]["actor"] is None and w["gateways"][0]["branches"][1] == {"next": None} and w["gateways"][0]["actor"] == "Boss"
    assert any(s.get("can_terminate") for s in w["execution_states"]) and all(s.get("can_terminate", True) is True for s in w["execution_states"])
    assert json.dumps(out) == export.workflow_json(with_states(workflows(g), execution_states(paths)), ascii_only=True).first().json


def test_report_is_pythons_text(spark):
    """Numbers in the middle of two, quotes in texts, and lines that come only where something is missing."""
    from weftline.operators import validate

    halves = spark.createDataFrame([(k / 8,) for k in range(9)] + [(k / 7,) for k in range(8)], "x double")
    got = {r.x: r.t for r in halves.selectExpr("x", f"{validate.two_places('x')} as t").collect()}
    assert got == {x: f"{x:.2f}" for x in got}
    texts = ["a", "it's", 'say "x"', "it's \"x\"", "b\\c\nd", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {r.x: r.t for r in rows.selectExpr("x", f"{validate.literal('x')} as t").collect()} == {t: repr(t) for t in texts}


def test_fractions_are_rounded_as_python_rounds(spark):
    """All k/n with n up to 500, and numbers right beside the middle of two."""
    import math

    xs = sorted({k / n for n in range(1, 501) for k in range(n + 1)} | {f(m / 200, d) for m in range(1, 400, 2) for d in (0, 9) for f in (math.nextafter,)})
    rows = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{validate.two_places('x')} as t").collect()
    assert [(r.x, r.t) for r in rows if r.t != f"{r.x:.2f}"] == []


def test_report_scans_events_once(spark):
    """The records are made of the events in one scan; lines and averages of the report come from one table of measures."""
    from weftline.plans import registry

    plan = registry.QUERIES["validation_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and plan.count("Scan parquet") <= 2 and "Window" not in plan


def test_large_records_are_measured_in_linear_time(spark):
    """8,000 steps and as many gateways: sets of pairs and triples are found by hash."""
    import time

    n = 8000
    nodes = [("s", "", "StartNode", "")] + [(f"n{i}", f"Step {i}", "Activity", "a") for i in range(n)] + [(f"g{i}", "", "XOR", "") for i in range(n)]
    edges = [("s", "n0", "")] + [(f"n{i}", f"g{i}", "") for i in range(n)] + [(f"g{i}", f"n{i + 1}", "c") for i in range(n - 1)]
    g = G.graphs(spark.createDataFrame([(0, 0, "", nodes, edges)], "record_no long, file_index long, paragraph string, step_nodes array<struct<resourceId: string, NodeText: string, type: string, agent: string>>, SequenceFlow array<struct<src: string, tgt: string, condition: string>>"))
    measured = validate.metrics(validate.joined(g, workflows(g)))
    measured.limit(0).count()
    began = time.time()
    m = measured.first().m
    assert time.time() - began < 40 and m.branch_tuples.f1 == m.action_successors.f1 == 1.0 and m.branch_tuples.gt_count == n - 1


def test_last_of_a_number_is_kept_before_the_shuffle(spark):
    """Of records that share a number the last counts, and each task sends one of them."""
    rows = spark.range(0, 4000, 1, 4).selectExpr("id as record_no", "if(id % 3 = 0, 7, id) as file_index", "cast(id as string) as paragraph").selectExpr("*", "array(named_struct('resourceId', 's', 'NodeText', paragraph, 'type', 'Activity', 'agent', '')) as step_nodes", "cast(array() as array<struct<src: string, tgt: string, condition: string>>) as SequenceFlow")
    pairs = validate.joined(G.graphs(rows), workflows(G.graphs(rows.where("file_index in (7, 8)").limit(2))))
    assert {(r.file_index, r.g[0].text) for r in pairs.collect()} <= {(7, "3999"), (8, "8")}
    plan = validate.joined(G.graphs(rows), workflows(G.graphs(rows)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") == 1


def test_states_in_the_row_are_those_of_path_tables(spark):
    from weftline.operators import graph, paths
    from weftline.sources import records

    raw = records.event_records(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    graphs = graph.graphs(raw)
    one = paths.with_states(graphs).selectExpr("record_no", "posexplode(states) as (state_no, s)").selectExpr("record_no", "cast(state_no as bigint) as state_no", "s.completed", "s.available", "s.can_terminate")
    two = paths.execution_states(paths.execution_paths(graphs)).select("record_no", F.col("state_no").cast("bigint").alias("state_no"), "completed", "available", "can_terminate")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(two)


@pytest.mark.parametrize("paths_", [[()], [("a", "")], [("", "a"), ("a",)], [("a", "b"), ("a", "c"), ("a",)], [tuple("abc")] * 2 + [("x", str(k)) for k in range(80)]])
def test_states_of_odd_paths(spark, paths_):
    from weftline.operators import paths

    paths_ = list(dict.fromkeys(paths_))
    rows = spark.createDataFrame([(1, i, list(p), None) for i, p in enumerate(paths_)], "record_no long, path_no long, path array<string>, error string")
    want = [(r.completed, r.available, r.can_terminate) for r in paths.execution_states(rows).orderBy("state_no").collect()]
    assert [tuple(s.values()) for s in paths.Trie(paths_[: paths.CAP]).states()] == want
