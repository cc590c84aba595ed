"""Workflows of graphs: actors, actions and gateways, inside the record and without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.columns import fixed
from weftline.operators.graph import entering, gateway_type, leaving, role

ACTORS = f"array_distinct(filter(transform(step_nodes, n -> n.agent), a -> not {T.blank('a')}))"


def _known(x: str) -> str:
    return f"array_distinct(filter({x}, y -> y is not null))"


def predecessors(n: str) -> str:
    """Ids of what leads to a node; an unnamed start counts as "start", other unnamed nodes are passed over."""
    return _known(f"transform({entering(n)}, x -> x.s.schema_id)")


def successors(n: str) -> str:
    """Ids of the actions and gateways that a node leads to."""
    return _known(f"transform({leaving(n)}, x -> coalesce(x.t.action_id, x.t.gateway_id))")


def branches(n: str) -> str:
    """A branch for each edge to a node that is there: its id, null for an unnamed end, else the raw id."""
    after = "coalesce(x.t.action_id, x.t.gateway_id, if(x.t.type = 'EndNode', null, x.tgt))"
    return f"transform(filter({leaving(n)}, x -> x.t.idx is not null), x -> named_struct('next', {after}, 'condition', {T.or_null('x.condition')}))"


def incoming(n: str) -> str:
    """Ids of the actions and gateways that lead to a gateway; unnamed starts are passed over."""
    return _known(f"transform({entering(n)}, x -> coalesce(x.s.action_id, x.s.gateway_id))")


def workflows(graphs: DataFrame) -> DataFrame:
    """(record_no, file_index, procedure_text, workflow), with execution states if graphs have them (paths.with_states)."""
    actions = (
        f"transform(filter(g, n -> n.action_id is not null), n -> named_struct('id', n.action_id, 'name', {T.strip('n.text')}, 'actor', {T.or_null('n.agent')}, "
        f"'predecessors', {predecessors('n')}, 'successors', {successors('n')}, 'postconditions', array(concat(n.action_id, '_done'))))"
    )
    gateways = (
        f"transform(filter(g, n -> n.gateway_id is not null), n -> named_struct('id', n.gateway_id, 'type', {gateway_type('n.type')}, 'role', {role('n.in_degree', 'n.out_degree')}, "
        f"'incoming_from', {incoming('n')}, 'branches', {branches('n')}, 'actor', {T.or_null('n.agent')}))"
    )
    states = ", 'execution_states', transform(states, x -> named_struct('completed_actions', x.completed, 'available_next', x.available, 'can_terminate', if(x.can_terminate, true, null)))" if "states" in graphs.columns else ""
    whole = f"named_struct('actors', coalesce({ACTORS}, cast(array() as array<string>)), 'actions', {actions}, 'gateways', {gateways}{states})"
    return fixed(graphs, workflow=whole).select("record_no", "file_index", F.col("paragraph").alias("procedure_text"), "workflow")


def actions(workflows: DataFrame) -> DataFrame:
    return workflows.select("record_no", "file_index", F.posexplode("workflow.actions").alias("ordinal", "a")).select("record_no", "file_index", "ordinal", "a.*")


def gateways(workflows: DataFrame) -> DataFrame:
    return workflows.select("record_no", "file_index", F.posexplode("workflow.gateways").alias("ordinal", "w")).select("record_no", "file_index", "ordinal", "w.*")


def with_states(workflows: DataFrame, states: DataFrame) -> DataFrame:
    """Workflows with their execution states in order; records without paths have none."""
    lists = states.groupBy("record_no").agg(F.array_sort(F.collect_list(F.struct("state_no", "completed", "available", "can_terminate"))).alias("s"))
    lists = lists.select("record_no", F.expr("transform(s, x -> named_struct('completed_actions', x.completed, 'available_next', x.available, 'can_terminate', if(x.can_terminate, true, null)))").alias("states"))
    empty = "cast(array() as array<struct<completed_actions: array<string>, available_next: array<string>, can_terminate: boolean>>)"
    joined = workflows.join(lists, "record_no", "left")
    return joined.select("record_no", "file_index", "procedure_text", F.expr(f"named_struct('actors', workflow.actors, 'actions', workflow.actions, 'gateways', workflow.gateways, 'execution_states', coalesce(states, {empty}))").alias("workflow"))
