"""Python takes batches in pieces, however many rows they have."""

import json
import pickle
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.util import PythonEvalType

import __spark_entry__
from weftline.operators import graph, paths, workflow
from weftline.sources import arrays, batches, export, files, records


def test_pieces_are_small_and_whole():
    texts = ["x" * (100_000 if i % 50 == 7 else 10) for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": texts})
    parts = list(batches.pieces(batch, 1 << 14))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.nbytes <= 2 << 14 or p.num_rows == 1 for p in parts) and len(parts) > 20
    assert not list(batches.pieces(batch.slice(0, 0)))


def test_workflow_json_takes_pieces_of_arrow_batches(spark):
    """Pandas made Python objects of a whole batch, 10,000 nested workflows, at once."""
    rows = spark.createDataFrame([(i, i, f"p{i}", [("s", "Go", "Activity", "x")], []) for i in range(50)], records.RECORD)
    made = export.workflow_json(workflow.workflows(graph.graphs(rows)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" in plan
    assert made.count() == 50


def test_graphs_of_a_batch_are_built_in_pieces(monkeypatch):
    sizes = []
    build = graph.build
    monkeypatch.setattr(graph, "build", lambda n, x, e: sizes.append(len(n)) or build(n, x, e))
    monkeypatch.setattr(graph, "pieces", lambda b: batches.pieces(b, 1 << 12))
    kinds = [pa.list_(pa.struct([(f, pa.string()) for f in fs])) for fs in (("resourceId", "NodeText", "type", "agent"), ("src", "tgt", "condition"))]
    nodes = pa.array([[{"resourceId": f"{i}-{k}", "NodeText": f"t{k}", "type": "Activity", "agent": ""} for k in range(3)] for i in range(500)], kinds[0])
    flows = pa.array([[{"src": f"{i}-0", "tgt": f"{i}-1", "condition": ""}] if i % 2 else None for i in range(500)], kinds[1])
    got = graph.make_graphs(nodes, flows, True)
    assert sum(sizes) == 500 and len(sizes) > 10
    assert got.to_pylist() == build(nodes, flows, True).to_pylist()
    assert graph.make_graphs(nodes.slice(0, 0), flows.slice(0, 0), True).to_pylist() == []


def test_tasks_get_their_own_range_alone(tmp_path):
    """The plan of all ranges went to every task, so that time grew by the square of the file."""
    reader = arrays.ArrayReader("x", [(i, i + 1, 0, 1, i) for i in range(10_000)])
    assert len(pickle.dumps(reader)) < 1000 and len(reader.partitions()) == 10_000


def test_ranges_read_little_more_than_themselves(tmp_path, monkeypatch):
    path = str(tmp_path / "a.json")
    files.write(path, json.dumps([{"i": i, "t": "x" * 50} for i in range(100_000)]).encode())
    read = []
    monkeypatch.setattr(arrays, "Marks", lambda data, slashes, made=arrays.Marks: read.append(len(data)) or made(data, slashes))
    size, step = files.size(path), 1 << 18
    bounds = [(b, min(b + step, size)) for b in range(0, size, step)]
    plan = arrays.compose([arrays.scan_range(path, *b) for b in bounds])
    read.clear()
    found = [x for b, (inside, depth, _) in zip(bounds, plan, strict=True) for x in arrays.elements(path, *b, inside, depth)]
    assert len(found) == 100_000 and sum(read) < 1.5 * size


def test_ranges_are_no_more_than_a_limit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.json")
    files.write(path, json.dumps(list(range(1000))).encode())
    monkeypatch.setattr(arrays, "RANGES", 8)
    rows = arrays.read_array(spark, path, 10)
    assert rows.rdd.getNumPartitions() <= 8
    assert [(r.record_no, r.json) for r in rows.orderBy("record_no").collect()] == [(i, str(i)) for i in range(1000)]


def test_parts_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """All texts of a batch were laid out at once, several times over."""
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_pydict({"json": ['"' + "y" * 10_000 + '"'] * 2000})
    tracemalloc.start()
    part = arrays.ArrayWriter(str(tmp_path / "p"), None).write(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert part.rows == 2000 and peak < 24 << 20
    assert "[" + (tmp_path / "p" / part.name).read_text() + "]" == "[" + ", ".join(batch.column("json").to_pylist()) + "]"


def _peak(made):
    """Rows of what a generator hands on, and the most bytes that Arrow held meanwhile."""
    rows, before, most = 0, pa.total_allocated_bytes(), 0
    for array in made:
        rows += len(array)
        most = max(most, pa.total_allocated_bytes() - before)
        del array
    return rows, most


def _batch(n):
    kinds = [pa.list_(pa.struct([(f, pa.string()) for f in fs])) for fs in (("resourceId", "NodeText", "type", "agent"), ("src", "tgt", "condition"))]
    kind = ["StartNode", *["Activity"] * 8, "EndNode"]
    nodes = [[{"resourceId": f"sid-{i}-{k}", "NodeText": f"step {k}", "type": kind[k], "agent": "Team"} for k in range(10)] for i in range(n)]
    flows = [[{"src": f"sid-{i}-{k}", "tgt": f"sid-{i}-{k + 1}", "condition": ""} for k in range(9)] for i in range(n)]
    return pa.array(nodes, kinds[0]), pa.array(flows, kinds[1])


def _frame(spark):
    return spark.createDataFrame([(i, i, f"p{i}", [("s", "Go", "StartNode", "x")], []) for i in range(50)], records.RECORD)


def test_graphs_are_handed_on_in_pieces(spark):
    """Those of a whole batch were put together before the first was handed on."""
    batch = _batch(10_000)
    whole = sum(a.nbytes for a in graph.graph_pieces([batch], True))
    rows, most = _peak(graph.graph_pieces([batch], True))
    assert rows == 10_000 and most < whole / 4
    made = graph.graphs(_frame(spark))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\n" in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.record_no, r.g[0].rid) for r in made.collect()) == [(i, "s") for i in range(50)]


def test_states_are_handed_on_in_pieces(spark):
    nodes, flows = (a.to_pylist() for a in _batch(10_000))
    n = pa.array([[{"rid": x["resourceId"], "type": x["type"], "action_id": x["NodeText"]} for x in r] for r in nodes])
    x = pa.array([[{"src": e["src"], "tgt": e["tgt"]} for e in r] for r in flows])
    batch = (pa.array(range(10_000), pa.int64()), n, x)
    whole = sum(a.nbytes for a in paths.state_pieces([batch], 60, "raise"))
    rows, most = _peak(paths.state_pieces([batch], 60, "raise"))
    assert rows == 10_000 and most < whole / 4
    made = paths.with_states(graph.graphs(_frame(spark)))
    assert made._jdf.queryExecution().optimizedPlan().toString().count(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\n") == 2
    assert sorted((r.record_no, len(r.states)) for r in made.collect()) == [(i, 2) for i in range(50)]


@pytest.mark.parametrize("name", ["action_prf", "edge_prf", "gateway_edge_prf", "branch_tuple_prf"])
def test_measures_have_one_worker_for_each_task(spark, name):
    """Graphs are all that Python makes, once on each side of the join and by pieces, so a task has one worker, which holds a batch."""
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    steps = [x for x in plan.toString().splitlines() if "Python" in x or "InArrow" in x or "InPandas" in x]
    assert len(steps) == 2 and all("ArrowEvalPython [make(" in x and x.endswith(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}") for x in steps)


def test_more_batches_take_no_more_memory():
    batch = _batch(5_000)
    once, often = (_peak(graph.graph_pieces((batch for _ in range(n)), True)) for n in (1, 6))
    assert often[0] == 6 * once[0] and often[1] < 1.2 * once[1]
