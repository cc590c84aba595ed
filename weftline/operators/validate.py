"""Validation of extracted workflows against the graphs that they come from.

A workflow meets its graph in one join by file_index; everything after that compares arrays inside
the row. Pairs and triples are sets of structs in which null is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.columns import fixed
from weftline.operators.graph import GATEWAYS, gateway_type, graphs, role
from weftline.operators.graph import graphs as built
from weftline.sources.records import read_records, read_workflows
from weftline.sources.shared import kept

SETS = ("actions", "action_successors", "action_predecessors", "gateway_branches_next", "gateway_incoming", "branch_tuples")
AVERAGES = {
    "action_f1": "m.actions.f1",
    "gateway_type_accuracy": "m.gateways.type_accuracy",
    "gateway_role_accuracy": "m.gateways.role_accuracy",
    "action_successor_f1": "m.action_successors.f1",
    "action_predecessor_f1": "m.action_predecessors.f1",
    "gateway_next_f1": "m.gateway_branches_next.f1",
    "gateway_incoming_f1": "m.gateway_incoming.f1",
    "branch_tuple_f1": "m.branch_tuples.f1",
    "branch_count_accuracy": "m.branch_counts.accuracy",
}
#: Differences that a report shows of each kind but names, which it shows all.
SHOWN = 5


def joined(graphs: DataFrame, workflows: DataFrame) -> DataFrame:
    """Workflows with their graph; of graphs with one file_index the last counts. Workflows without a graph are left out.

    Tasks keep the last of each number before anything is shuffled, so that a number that very many records share is
    one row from each. Where graphs have the record that they are built of, this is shuffled, as it takes a fraction of the
    graph's bytes, and the graph is built after the join.
    """
    if {"step_nodes", "SequenceFlow"} <= set(graphs.columns):
        last = graphs.groupBy("file_index").agg(F.max_by(F.struct("record_no", "step_nodes", "SequenceFlow"), "record_no").alias("last"))
        both = workflows.select("file_index", "workflow").join(last.select("file_index", "last.*"), "file_index")
        return built(both).drop("step_nodes", "SequenceFlow").select("file_index", "workflow", "record_no", "g", "e")
    last = graphs.groupBy("file_index").agg(F.max_by(F.struct("record_no", "g", "e"), "record_no").alias("last"))
    return workflows.select("file_index", "workflow").join(last.select("file_index", "last.*"), "file_index")


def validate_files(spark: SparkSession, raw_path: str, workflow_path: str) -> DataFrame:
    """Measures of the workflows of one file against the raw records of another; see metrics()."""
    return metrics(joined(graphs(read_records(spark, raw_path)), read_workflows(spark, workflow_path)))


def unmatched(graphs: DataFrame, workflows: DataFrame) -> DataFrame:
    return workflows.select("file_index").join(graphs.select("file_index"), "file_index", "left_anti")


def _set(x: str, keep: str | None = None) -> str:
    """Distinct pairs or triples, as JSON text: sets of texts are found by hash, sets of structs by comparing all with all."""
    return f"array_distinct(transform({f'filter({x}, p -> {keep})' if keep else x}, p -> to_json(p)))"


def _members(x: str, kind: str) -> str:
    """The structs of a set of _set()."""
    return f"transform({x}, s -> from_json(s, '{', '.join(f'{f} string' for f in _fields(kind))}'))"


def _pairs(a: str, b: str) -> str:
    return f"named_struct('a', {a}, 'b', {b})"


def _nonempty(x: str) -> str:
    return f"nullif({x}, '')"


def metrics(pairs: DataFrame) -> DataFrame:
    """(record_no, file_index, m): all measures of each joined row."""
    normal = T.normalize
    some = lambda x: f"coalesce({x}, '') <> ''"
    nested = lambda outer, inner, item: f"flatten(transform({outer}, o -> transform({inner}, i -> {item})))"
    triple = lambda a, b, c: f"named_struct('a', {a}, 'b', {b}, 'c', {c})"
    acts, gates = "workflow.actions", "workflow.gateways"
    sets = {
        "actions": (f"array_distinct(transform(filter(g, n -> n.action_id is not null), n -> {normal('n.text')}))", f"array_distinct(transform({acts}, a -> {normal('a.name')}))"),
        "action_successors": (_set(f"transform(filter(e, x -> x.s.action_id is not null), x -> {_pairs('x.s.action_id', 'x.t.schema_id')})", some("p.b")), _set(nested(acts, "o.successors", _pairs("o.id", "i")))),
        "action_predecessors": (_set(f"transform(filter(e, x -> x.t.action_id is not null), x -> {_pairs('x.s.schema_id', 'x.t.action_id')})", some("p.a")), _set(nested(acts, "o.predecessors", _pairs("i", "o.id")))),
        "gateway_branches_next": (
            _set(f"transform(filter(e, x -> x.s.gateway_id is not null and x.t.idx is not null and ({some('x.t.schema_id')} or x.t.type = 'EndNode')), x -> {_pairs('x.s.gateway_id', _nonempty('x.t.schema_id'))})"),
            _set(nested(gates, "o.branches", _pairs("o.id", "i.next"))),
        ),
        "gateway_incoming": (_set(f"transform(filter(e, x -> x.t.gateway_id is not null), x -> {_pairs('x.s.schema_id', 'x.t.gateway_id')})", some("p.a")), _set(nested(gates, "o.incoming_from", _pairs("i", "o.id")))),
        "branch_tuples": (
            _set(f"transform(filter(e, x -> x.s.gateway_id is not null and x.t.idx is not null), x -> {triple('x.s.gateway_id', 'if(x.t.type = {0}, null, x.t.schema_id)'.format(repr('EndNode')), T.or_null('x.condition'))})"),
            _set(nested(gates, "o.branches", triple("o.id", "i.next", "i.condition"))),
        ),
    }
    rows = fixed(pairs, **{f"t_{k}": t for k, (t, _) in sets.items()}, **{f"x_{k}": x for k, (_, x) in sets.items()})
    scores = {}
    for k in sets:
        p, r = T.precision_recall(f"t_{k}", f"x_{k}")
        scores[f"p_{k}"], scores[f"r_{k}"] = p, r
    gateways = "filter(g, n -> n.gateway_id is not null)"
    rows = fixed(rows, **scores, gt=gateways, lesser=f"least(size({gateways}), size({gates}))")
    kinds = " + ".join(f"least(size(filter(gt, n -> {gateway_type('n.type')} = '{v}')), size(filter({gates}, w -> w.type = '{v}')))" for v in GATEWAYS.values())
    numbers = "sequence(0, greatest(lesser, 1) - 1)"
    same = lambda test: f"case when lesser > 0 then size(filter({numbers}, i -> {test})) / cast(lesser as double) else 1.0D end"
    parts = []
    for k in sets:
        parts.append(
            f"'{k}', named_struct('precision', p_{k}, 'recall', r_{k}, 'f1', {T.f1(f'p_{k}', f'r_{k}')}, 'gt_count', cast(size(t_{k}) as bigint), 'ext_count', cast(size(x_{k}) as bigint), "
            f"'missing', {_shown(f'array_except(t_{k}, x_{k})', k)}, 'extra', {_shown('slice(x_action_successors, 1, 0)' if k == 'action_successors' else f'array_except(x_{k}, t_{k})', k)})"
        )
    parts.append(
        f"'gateways', named_struct('count_match', size(gt) = size({gates}), 'gt_count', cast(size(gt) as bigint), 'ext_count', cast(size({gates}) as bigint), "
        f"'type_accuracy', {T.ratio(f'({kinds})', f'greatest(size(gt), size({gates}))')}, 'role_accuracy', {same(f'{role('gt[i].in_degree', 'gt[i].out_degree')} <=> {gates}[i].role')})"
    )
    parts.append(f"'branch_counts', named_struct('accuracy', {same(f'gt[i].out_degree = size({gates}[i].branches)')}, 'total_compared', cast(lesser as bigint))")
    return rows.select("record_no", "file_index", F.expr(f"named_struct({', '.join(parts)})").alias("m"))


def literal(x: str) -> str:
    """A string as Python writes it, or None."""
    escaped = f"replace(replace({x}, '\\\\', '\\\\\\\\'), '\\n', '\\\\n')"
    return f"case when {x} is null then 'None' when contains({x}, '\\'') and not contains({x}, '\"') then concat('\"', {escaped}, '\"') else concat('\\'', replace({escaped}, '\\'', '\\\\\\''), '\\'') end"


def _shown(x: str, kind: str) -> str:
    if kind == "actions":
        return f"array_sort({x})"
    x = _members(x, kind)
    if kind in ("gateway_branches_next", "branch_tuples"):
        fields = ("a", "b", "c") if kind == "branch_tuples" else ("a", "b")
        key = lambda p: "concat('(', " + ", ', ', ".join(literal(f"{p}.{f}") for f in fields) + ", ')')"
        return f"slice(transform(array_sort(transform({x}, p -> named_struct('k', {key('p')}, 'v', p))), q -> q.v), 1, {SHOWN})"
    return f"slice(array_sort({x}), 1, {SHOWN})"


def averages(measured: DataFrame) -> DataFrame:
    """One row of means over records, and how many there are; nulls if there are none."""
    return measured.agg(F.count("*").alias("records"), *(F.avg(v).alias(k) for k, v in AVERAGES.items()))


def _fields(kind: str) -> tuple[str, ...]:
    return ("a", "b", "c") if kind == "branch_tuples" else ("a", "b")


def _written(x: str, kind: str) -> str:
    """Differences as Python writes the elements of a list of strings or tuples."""
    item = literal("p") if kind == "actions" else "concat('(', " + ", ', ', ".join(literal(f"p.{f}") for f in _fields(kind)) + ", ')')"
    return f"array_join(transform({x}, p -> {item}), ', ')"


def diagnostics(measured: DataFrame) -> DataFrame:
    """(record_no, measure, missing, extra) with the shown differences as text."""
    parts = ", ".join(f"named_struct('measure', '{k}', 'missing', {_written(f'm.{k}.missing', k)}, 'extra', {_written(f'm.{k}.extra', k)})" for k in SETS)
    return measured.select("record_no", F.expr(f"inline(array({parts}))"))


# The report's texts.
RULE = "=" * 80
HEADING = (RULE, "EXTRACTION VALIDATION REPORT", RULE)
SCORES = {
    "actions": "  Actions:           ",
    "action_successors": "  Action successors: ",
    "action_predecessors": "  Action predecess:  ",
    "gateway_branches_next": "  Gateway next:      ",
    "gateway_incoming": "  Gateway incoming:  ",
    "branch_tuples": "  Branch tuples:     ",
}
GATEWAY_LINE = "  Gateways:          "
COUNT_LINE = "  Branch counts:     "
MISSING, EXTRA = " " * 21 + "Missing: ", " " * 21 + "Extra:   "
MEANS = {
    "action_f1": "  Action F1:              ",
    "gateway_type_accuracy": "  Gateway type accuracy:  ",
    "gateway_role_accuracy": "  Gateway role accuracy:  ",
    "action_successor_f1": "  Action successor F1:    ",
    "action_predecessor_f1": "  Action predecessor F1:  ",
    "gateway_next_f1": "  Gateway next F1:        ",
    "gateway_incoming_f1": "  Gateway incoming F1:    ",
    "branch_tuple_f1": "  Branch tuple F1:        ",
    "branch_count_accuracy": "  Branch count accuracy:  ",
}


def two_places(x: str) -> str:
    """A number from 0 on, with two places as Python writes it: the nearest of the number as it is in binary, of two the even one.

    The number is cut into two parts that can be multiplied by 200 without loss, so that its side of the middle
    between two hundredths is exact.
    """
    parts = f"transform(array({x}), v -> named_struct('h', v * 134217729D - (v * 134217729D - v), 'v', v, 'c', cast(floor(v * 100) as bigint)))"
    side = f"transform({parts}, p -> named_struct('c', p.c, 'd', (p.h * 200 - (2 * p.c + 1)) + (p.v - p.h) * 200))"
    return f"transform(transform({side}, s -> s.c + if(s.d > 0 or s.d = 0 and s.c % 2 = 1, 1, 0)), n -> concat(cast(n div 100 as string), '.', lpad(cast(n % 100 as string), 2, '0')))[0]"


def _whole(x: str) -> str:
    return f"cast({x} as string)"


def _line_numbers() -> dict[str, int]:
    """The place of each kind of line in a record's part of the report; lines that are not there leave a gap."""
    lines = ["", "record", "actions", "actions missing", "actions extra", "gateways"]
    for k in list(SCORES)[1:]:
        lines += [k, f"{k} missing"]
    return {x: n for n, x in enumerate([*lines, "counts"])}


def report(measured: DataFrame) -> DataFrame:
    """(section, record_no, line_no, line): heading (0), lines of each record (1), averages (2); records are named by number.

    Lines of no record have -1 as record_no. The measures are computed once and kept in the shared folder, from which
    lines and averages are read.
    """
    measured = kept(measured)
    at = _line_numbers()
    lines = {"": "''", "record": f"concat('--- Record ', {_whole('record_no')}, ' (file_index: ', {_whole('file_index')}, ') ---')"}
    for k, label in SCORES.items():
        m = f"m.{k}"
        lines[k] = f"concat('{label}P=', {two_places(m + '.precision')}, '  R=', {two_places(m + '.recall')}, '  F1=', {two_places(m + '.f1')}, '  (GT=', {_whole(m + '.gt_count')}, ', Ext=', {_whole(m + '.ext_count')}, ')')"
        for side, title in (("missing", MISSING), ("extra", EXTRA)):
            if f"{k} {side}" in at:
                lines[f"{k} {side}"] = f"if(size({m}.{side}) > 0, concat('{title}[', {_written(f'{m}.{side}', k)}, ']'), null)"
    g = "m.gateways"
    lines["gateways"] = f"concat('{GATEWAY_LINE}count_match=', initcap({_whole(g + '.count_match')}), '  type_acc=', {two_places(g + '.type_accuracy')}, '  role_acc=', {two_places(g + '.role_accuracy')}, '  (GT=', {_whole(g + '.gt_count')}, ', Ext=', {_whole(g + '.ext_count')}, ')')"
    lines["counts"] = f"concat('{COUNT_LINE}accuracy=', {two_places('m.branch_counts.accuracy')}, '  (compared=', {_whole('m.branch_counts.total_compared')}, ')')"
    parts = ", ".join(f"named_struct('line_no', {at[k]}, 'line', {x})" for k, x in lines.items())
    each = measured.select(F.lit(1).alias("section"), "record_no", F.expr(f"inline(filter(array({parts}), s -> s.line is not null))"))
    mean = averages(measured)
    texts = ["''", f"'{RULE}'", f"concat('AVERAGES (over ', {_whole('records')}, ' records):')", *(f"concat('{label}', {two_places(k)})" for k, label in MEANS.items()), f"'{RULE}'"]
    none = F.lit(-1).cast(measured.schema["record_no"].dataType).alias("record_no")
    total = mean.select(F.lit(2).alias("section"), none, F.posexplode(F.array(*map(F.expr, texts))).alias("line_no", "line"))
    head = measured.sparkSession.createDataFrame([(0, n, x) for n, x in enumerate(HEADING)], "section int, line_no int, line string").select("section", none, "line_no", "line")
    return each.unionByName(total).unionByName(head)
