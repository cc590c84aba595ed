"""Records of one shape share their paths; states as rows; small tables are dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import paths, validate, workflow
from weftline.sources import records

DIAMOND = [("s", "x", ""), ("x", "1", ""), ("x", "2", ""), ("1", "j", ""), ("2", "j", ""), ("j", "e", "")]


def diamond(number, one, two, kind="OR", end=""):
    ids = {k: f"{k}{number}" for k in "sx12je"}
    nodes = [("s", "", "StartNode"), ("x", "", kind), ("1", one, "Activity"), ("2", two, "Activity"), ("j", "", kind), ("e", end, "EndNode")]
    return number, number, "", [(ids[k], t, kind, "") for k, t, kind in nodes], [(ids[a], ids[b], c) for a, b, c in DIAMOND]


@pytest.fixture(scope="module")
def rows(spark):
    data = [diamond(i, one, two, kind, end) for i, (one, two, kind, end) in enumerate([("b", "a", "OR", ""), ("a", "b", "OR", ""), ("c", "d", "AND", "Z"), ("a", "!", "OR", ""), ("!", "a", "OR", "q"), ("é", "z", "XOR", "")] * 3)]
    return G.graphs(spark.createDataFrame(data, records.RECORD).repartition(1))


def test_paths_of_a_shape_are_found_once(monkeypatch):
    """A thousand records of one shape, with names of their own: one walk, and each record's own names."""
    walks = []
    walk = paths.Graph.paths
    monkeypatch.setattr(paths.Graph, "paths", lambda self, starts: walks.append(1) or walk(self, starts))
    monkeypatch.setattr(paths, "_shapes", paths.Shapes())
    for i in range(1000):
        r = paths.Record(i, [f"{i}s", f"{i}a", f"{i}e"], ["StartNode", "Activity", "EndNode"], [None, f"go {i}", None], [f"{i}s", f"{i}a"], [f"{i}a", f"{i}e"])
        [(sizes, flat, error)] = paths._found(r)
        assert [r.names[k] for k in flat] == [f"go {i}"] and sizes.tolist() == [1] and error is None
    assert len(walks) == 1


def test_shapes_are_forgotten_when_they_are_many(monkeypatch):
    monkeypatch.setattr(paths, "SHAPES", 1000)
    kept = paths.Shapes()
    for i in range(100):
        kept.keep(("p", (i,), (), (), (), -1), i, 100)
        assert kept.size <= 1000
    kept.keep(("p", (), (), (), (), -1), 0, paths.SHAPE + 1)
    assert ("p", (), (), (), (), -1) not in kept.known


def test_states_as_rows_are_those_of_paths(rows):
    order = ("record_no", "completed")
    want = paths.execution_states(paths.execution_paths(rows)).select("record_no", F.col("state_no").cast("int").alias("state_no"), "completed", "available", "can_terminate").orderBy(*order).collect()
    got = paths.record_states(rows)
    assert got.orderBy(*order).collect() == want and len(want) > 50
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # the fixture's repartition
    inside = {r.record_no: r.states for r in paths.with_states(rows).collect()}
    for number, states in inside.items():
        assert [tuple(s) for s in states] == [tuple(r)[2:] for r in sorted((w for w in want if w.record_no == number), key=lambda r: r.state_no)]


def test_errors_name_their_own_node(spark):
    data = [(i, i, "", [(f"s{i}", "", "StartNode", ""), (f"a{i}", "", "Activity", "")], [(f"s{i}", f"a{i}", "")]) for i in range(4)]
    graphs = G.graphs(spark.createDataFrame(data, records.RECORD).repartition(1))
    assert sorted(r.error for r in paths.execution_paths(graphs, "null").collect()) == [f"activity 'a{i}' has no text" for i in range(4)]
    with pytest.raises(Exception, match="record [0-3]: activity 'a[0-3]' has no text"):
        paths.record_states(graphs).collect()


def test_small_tables_are_dealt_to_tasks(spark, tmp_path):
    """A million rows of a few bytes are one row group of one small file, and were one task."""
    spark.range(50_000).selectExpr("id as p_partkey", "concat('part ', id % 7) as p_name", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part"))
    made = records.wide_records(spark.read.parquet(str(tmp_path / "part")))
    counts = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(counts) >= 4 and max(counts) < 2 * min(counts) and sum(counts) == 50_000


def test_validation_shuffles_records_not_graphs(rows):
    plan = validate.joined(rows, workflow.workflows(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" in plan and all("step_nodes" in line and ", g," not in line for line in plan.splitlines() if "max_by" in line)
    got = validate.joined(rows, workflow.workflows(rows))
    assert got.columns == ["file_index", "workflow", "record_no", "g", "e"] and got.count() == 18
