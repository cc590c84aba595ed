"""Graphs of records, kept inside their record.

No edge crosses records, so a record's graph is built in its row: nodes with ids, degrees and neighbours
need no join and no shuffle however large the corpus is, and hash maps make the cost linear in the nodes
and edges of a record. graphs() adds two arrays:

    g: nodes by first appearance of their id, with the value of its last: rid, idx, text, type,
       agent, action_id, gateway_id, schema_id, in_degree, out_degree, and the places in e of the
       edges that enter and leave it, ins and outs
    e: edges in order: idx, src, tgt, condition, and the nodes s and t at their ends, null if absent

Null texts, agents and conditions count as blank; null arrays as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.batches import pieces

#: Node types, as the data writes them: fixed values.
ACTIONABLE = ("Activity", "StartNode", "EndNode")
GATEWAYS = {"XOR": "exclusive", "AND": "parallel", "OR": "inclusive"}

END = "struct<rid: string, idx: int, type: string, action_id: string, gateway_id: string, schema_id: string>"
NODE = "struct<rid: string, idx: int, text: string, type: string, agent: string, action_id: string, gateway_id: string, schema_id: string, in_degree: int, out_degree: int, ins: array<int>, outs: array<int>>"
EDGE = f"struct<idx: int, src: string, tgt: string, condition: string, s: {END}, t: {END}>"


def role(into: str, out: str) -> str:
    return f"case when {into} > 1 and {out} > 1 then 'join_split' when {out} > 1 then 'split' when {into} > 1 then 'merge' else 'pass_through' end"


def gateway_type(x: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in GATEWAYS.items()) + " end"


def slug(text: str) -> str:
    """Base of an action id: stripped, lower case, spaces to underscores, then letters, digits and underscores alone."""
    return "".join(c for c in text.strip().lower().replace(" ", "_") if c == "_" or c.isalnum())


class Ids:
    """Ids of a record: a base that is taken gets _2, _3 ... until it is free."""

    def __init__(self):
        self.taken: set[str] = set()
        self.next: dict[str, int] = {}

    def give(self, base: str) -> str:
        found = base
        if base in self.taken:
            # suffixes below the next were taken when they were tried, and stay so
            k = self.next.get(base, 2)
            while (found := f"{base}_{k}") in self.taken:
                k += 1
            self.next[base] = k + 1
        self.taken.add(found)
        return found


def _columns(lists: pa.Array, fields: tuple[str, ...]) -> tuple[list[int], list[list]]:
    """Where each row's elements begin and end, and the fields of all elements one after another."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    flat = lists.flatten()
    names = {flat.type.field(i).name: i for i in range(flat.type.num_fields)}
    parts = flat.flatten()
    return list(accumulate(sizes, initial=0)), [parts[names[f]].to_pylist() for f in fields]


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int32))


def build(step_nodes: pa.Array, flows: pa.Array, with_edges: bool) -> pa.StructArray:
    """g and e of each record of a batch."""
    at, (rids, texts, kinds, agents) = _columns(step_nodes, ("resourceId", "NodeText", "type", "agent"))
    edge_at, (srcs, tgts, conditions) = _columns(flows, ("src", "tgt", "condition"))
    # of all records: what nodes are, and the edges' ends as places among all nodes
    chosen, places, actions, gates, schemas, sizes = [], [], [], [], [], []
    sources, targets, ins, outs = [], [], [], []
    for record in range(len(step_nodes)):
        last: dict = {}
        for i in range(at[record], at[record + 1]):
            last[rids[i]] = i
        base, ids, number = len(chosen), Ids(), {}
        for place, (rid, i) in enumerate(last.items()):
            number[rid] = base + place
            kind, text = kinds[i], texts[i] or ""
            named = bool(text.strip())
            action = ids.give(slug(text)) if named and kind in ACTIONABLE else None
            gate = f"gateway_{kind.lower()}_{place}" if kind in GATEWAYS else None
            chosen.append(i)
            places.append(place)
            actions.append(action)
            gates.append(gate)
            schemas.append(action if action is not None else gate if gate is not None else "start" if kind == "StartNode" and not named else None)
        sizes.append(len(last))
        into: list[list] = [[] for _ in last]
        out: list[list] = [[] for _ in last]
        for i in range(edge_at[record], edge_at[record + 1]):
            s, t = number.get(srcs[i]), number.get(tgts[i])
            sources.append(s)
            targets.append(t)
            if s is not None:
                out[s - base].append(i - edge_at[record])
            if t is not None:
                into[t - base].append(i - edge_at[record])
        ins += into
        outs += out
    take = lambda values, kind=pa.string(): pa.array([values[i] for i in chosen], kind)
    rid, kind, idx = take(rids), take(kinds), pa.array(places, pa.int32())
    ids = [pa.array(x, pa.string()) for x in (actions, gates, schemas)]
    nested = lambda x: pa.array(x, pa.list_(pa.int32()))
    degree = lambda x: pa.array(list(map(len, x)), pa.int32())
    nodes = pa.StructArray.from_arrays(
        [rid, idx, take(texts), kind, take(agents), *ids, degree(ins), degree(outs), nested(ins), nested(outs)],
        ["rid", "idx", "text", "type", "agent", "action_id", "gateway_id", "schema_id", "in_degree", "out_degree", "ins", "outs"],
    )
    g = pa.ListArray.from_arrays(_offsets(sizes), nodes)
    if not with_edges:
        return pa.StructArray.from_arrays([g], ["g"])
    ends = pa.StructArray.from_arrays([rid, idx, kind, *ids], ["rid", "idx", "type", "action_id", "gateway_id", "schema_id"])
    per_record = [edge_at[i + 1] - edge_at[i] for i in range(len(step_nodes))]
    numbers = np.arange(len(srcs)) - np.repeat(np.array(edge_at[:-1], np.int64), per_record)
    edges = pa.StructArray.from_arrays(
        [pa.array(numbers.astype(np.int32)), pa.array(srcs, pa.string()), pa.array(tgts, pa.string()), pa.array(conditions, pa.string()), ends.take(pa.array(sources, pa.int64())), ends.take(pa.array(targets, pa.int64()))],
        ["idx", "src", "tgt", "condition", "s", "t"],
    )
    return pa.StructArray.from_arrays([g, pa.ListArray.from_arrays(_offsets(per_record), edges)], ["g", "e"])


def graph_pieces(batches: Iterable[tuple[pa.Array, pa.Array]], with_edges: bool) -> Iterator[pa.StructArray]:
    """build() of step_nodes and flows, a piece of a batch at a time; none is kept once it is handed on."""
    for step_nodes, flows in batches:
        for part in pieces(pa.RecordBatch.from_arrays([step_nodes, flows], ["n", "x"])):
            yield build(*part.columns, with_edges)


def make_graphs(step_nodes: pa.Array, flows: pa.Array, with_edges: bool) -> pa.StructArray:
    """graph_pieces() of one batch, put together."""
    built = list(graph_pieces([(step_nodes, flows)], with_edges))
    return pa.concat_arrays(built) if built else build(step_nodes, flows, with_edges)


def graphs(records: DataFrame, with_edges: bool = True) -> DataFrame:
    """records with g and e (see above); without e if only nodes, or paths, are wanted."""

    @F.arrow_udf(f"struct<g: array<{NODE}>, e: array<{EDGE}>>" if with_edges else f"struct<g: array<{NODE}>>")
    def make(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return graph_pieces(batches, with_edges)

    columns = [c for c in records.columns if c not in ("g", "e")]
    rows = records.select(*(f"`{c}`" for c in columns), make("step_nodes", "SequenceFlow").alias("weft_graph"))
    return rows.select(*(f"`{c}`" for c in columns), "weft_graph.g", *(["weft_graph.e"] if with_edges else []))


def entering(n: str) -> str:
    """The edges that enter a node, in order."""
    return f"transform({n}.ins, i -> e[i])"


def leaving(n: str) -> str:
    """The edges that leave a node, in order."""
    return f"transform({n}.outs, i -> e[i])"


# An inner generator would have its array filtered beforehand, where the optimizer computes the graph a second time;
# so outer ones are used, and the rows that they add for empty arrays are left out afterwards.


def nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("record_no", "file_index", F.inline_outer("g")).where("idx is not null")


def edges(graphs: DataFrame) -> DataFrame:
    found = graphs.select("record_no", "file_index", F.explode_outer("e").alias("e")).where("e.idx is not null")
    return found.select("record_no", "file_index", "e.idx", "e.src", "e.tgt", "e.condition", F.col("e.s.rid").isNotNull().alias("has_src"), F.col("e.t.rid").isNotNull().alias("has_tgt"))


def adjacency(graphs: DataFrame) -> DataFrame:
    """(record_no, rid, outgoing, incoming): neighbours of each node in edge order, absent ones too."""
    found = graphs.select("record_no", "file_index", "e", F.explode_outer("g").alias("n")).where("n.idx is not null")
    return found.select("record_no", "file_index", "n.rid", F.expr(f"transform({leaving('n')}, x -> x.tgt)").alias("outgoing"), F.expr(f"transform({entering('n')}, x -> x.src)").alias("incoming"))


def dangling_edges(graphs: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    return edges(graphs).where("not has_src or not has_tgt")
