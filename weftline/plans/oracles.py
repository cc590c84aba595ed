"""The engine's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from weftline.operators.validate import COUNT_LINE, EXTRA, GATEWAY_LINE, HEADING, MEANS, MISSING, RULE, SCORES, _line_numbers
from weftline.plans.queries import QUERIES
from weftline.sources.records import NESTED_EDGES, TEMPLATE, WIDE_TEXTS

_ND = """
 r0 as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events),
 k0 as (select *, user_id * 1000 + cast(floor(rn / 10) as bigint) as file_index, cast(rn % 10 as int) as pos from r0),
 w0 as (select *, count(*) over (partition by file_index) as n, max(case when pos = 2 then event_type end) over (partition by file_index) as kt from k0),
 nd as (select file_index, pos, concat('sid-', file_index, '-', pos) as rid,
  case when pos = 0 then 'StartNode' when pos = 9 then 'EndNode' when pos = 7 then 'XOR'
   when pos in (2, 5) then case when kt = 'purchase' then 'AND' when kt = 'signup' then 'OR' else 'XOR' end else 'Activity' end as type,
  case when pos in (2, 5, 7) or (pos = 0 and file_index % 2 = 0) or (pos = 9 and file_index % 3 = 0) then '' else event_type end as text,
  case when value > 10 then concat('Team ', event_type) else '' end as agent, event_type
  from w0 where n = 10),
 ed as (select f.file_index, t.a * 10 + t.b as epos, concat('sid-', f.file_index, '-', t.a) as src, concat('sid-', f.file_index, '-', t.b) as tgt, t.cond
  from (select distinct file_index from nd) f cross join (values """ + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in TEMPLATE) + """) as t(a, b, cond)
  where not (t.a = 7 and t.b = 1) or f.file_index % 7 = 0),
 fnd as (select file_index, pos, rid, case when pos = 7 and file_index % 5 = 0 then 'AND' else type end as type,
  case when pos = 4 and file_index % 6 = 0 then 'Other step' else text end as text, agent from nd where not (pos = 3 and file_index % 13 = 0)),
 fed as (select * from ed where (file_index + epos) % 11 <> 0)"""


def _graph(p: str, nd: str, ed: str) -> str:
    """CTEs of nodes {p}n and edges {p}e; ids by row_number, which suffices where texts cannot collide with suffixed ones."""
    return f"""
 {p}d as (select *, row_number() over (partition by file_index order by pos) - 1 as idx,
  case when type in ('Activity', 'StartNode', 'EndNode') and trim(text) <> '' then regexp_replace(replace(replace(lower(trim(text)), ' ', '_'), '''', ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g') end as base from {nd}),
 {p}k as (select *, row_number() over (partition by file_index, base order by idx) as nth from {p}d),
 {p}n as (select k.*, case when base is not null then base || case when nth = 1 then '' else '_' || nth end end as action_id,
  case when type in ('XOR', 'AND', 'OR') then 'gateway_' || lower(type) || '_' || idx end as gateway_id,
  coalesce(case when base is not null then base || case when nth = 1 then '' else '_' || nth end end, case when type in ('XOR', 'AND', 'OR') then 'gateway_' || lower(type) || '_' || idx end, case when type = 'StartNode' and trim(text) = '' then 'start' end) as schema_id,
  case type when 'XOR' then 'exclusive' when 'AND' then 'parallel' when 'OR' then 'inclusive' end as gtype,
  (select count(*) from {ed} e where e.tgt = k.rid) as in_degree, (select count(*) from {ed} e where e.src = k.rid) as out_degree from {p}k k),
 {p}e as (select e.*, row_number() over (partition by e.file_index order by epos) - 1 as idx, s.rid is not null as has_src, t.rid is not null as has_tgt,
  s.action_id as s_action, s.gateway_id as s_gateway, s.schema_id as s_schema, t.action_id as t_action, t.gateway_id as t_gateway, t.schema_id as t_schema, t.type as t_type,
  coalesce(t.action_id, t.gateway_id, case when t.type = 'EndNode' then null else e.tgt end) as t_next
  from {ed} e left join {p}n s on s.rid = e.src left join {p}n t on t.rid = e.tgt)"""


def _role(i: str = "in_degree", o: str = "out_degree") -> str:
    return f"case when {i} > 1 and {o} > 1 then 'join_split' when {o} > 1 then 'split' when {i} > 1 then 'merge' else 'pass_through' end"


def _list(label: str, own: str, where: str) -> str:
    """Distinct labels per own id, in order of their first edge."""
    return f"(select file_index, {own} as own, string_agg(label, ',' order by first_at) as labels, count(*) as n from (select file_index, {own}, {label} as label, min(idx) as first_at from re where {where} and {label} is not null group by all) group by file_index, {own})"


PRED = _list("s_schema", "t_action", "t_action is not null")
SUCC = _list("coalesce(t_action, t_gateway)", "s_action", "s_action is not null")
INC = _list("coalesce(s_action, s_gateway)", "t_gateway", "t_gateway is not null")
RAW = f"with {_ND}, {_graph('r', 'nd', 'ed')}"
BOTH = f"{RAW}, {_graph('x', 'fnd', 'fed')}"
_ACTORS = "(select file_index, string_agg(agent, ',' order by first_at) as actors, count(*) as n from (select file_index, agent, min(pos) as first_at from nd where trim(agent) <> '' group by all) group by file_index)"

# Blocks of the template have one level, so a split is an edge to its join that carries the branch steps.
_PATHS = """
 sp as (select file_index, rid, type from nd where pos = 2 and type in ('AND', 'OR')),
 mac as (
  select e.file_index, e.src, e.tgt, cast([] as varchar[]) as emit from ed e where not exists (select 1 from sp where sp.rid = e.src)
  union all select file_index, rid, concat('sid-', file_index, '-5'), [concat('sid-', file_index, '-3'), concat('sid-', file_index, '-4')] from sp
  union all select file_index, rid, concat('sid-', file_index, '-5'), [concat('sid-', file_index, '-4'), concat('sid-', file_index, '-3')] from sp where type = 'AND'
  union all select file_index, rid, concat('sid-', file_index, '-5'), [concat('sid-', file_index, '-3')] from sp where type = 'OR'
  union all select file_index, rid, concat('sid-', file_index, '-5'), [concat('sid-', file_index, '-4')] from sp where type = 'OR'),
 me as (select m.*, case when n.text <> '' then [m.tgt] else cast([] as varchar[]) end as self from mac m join nd n on m.tgt = n.rid),
 p0 as (
  select file_index, rid, [rid] as vis, case when text <> '' then [rid] else cast([] as varchar[]) end as path, false as cut from nd where type = 'StartNode'
  union all
  select p.file_index, e.tgt, list_concat(p.vis, [e.tgt]),
   case when len(list_filter(p.vis, lambda v: v = e.tgt)) >= 2 then list_concat(p.path, e.emit) else list_concat(list_concat(p.path, e.emit), e.self) end,
   len(list_filter(p.vis, lambda v: v = e.tgt)) >= 2
  from p0 p join me e on p.rid = e.src where not p.cut),
 pr as (select distinct p.file_index, p.path as rids from p0 p join nd on p.rid = nd.rid where nd.type = 'EndNode' or p.cut),
 pi as (select file_index, rids, unnest(range(1, len(rids) + 1)) as i from pr),
 pp as (select pi.file_index, pi.rids, list(n.action_id order by pi.i) as path from pi join rn n on n.rid = pi.rids[pi.i] group by all
  union all select file_index, rids, cast([] as varchar[]) from pr where len(rids) = 0),
 st as (select file_index, completed, coalesce(string_agg(distinct nxt, ',' order by nxt), '') as available, bool_or(nxt is null) as can_terminate
  from (select file_index, array_to_string(path[1:i], '>') as completed, path[i + 1] as nxt from (select file_index, path, unnest(range(0, len(path) + 1)) as i from pp)) group by file_index, completed)"""
_RECURSIVE = RAW.replace("with", "with recursive", 1) + "," + _PATHS

# Wide records: ids by a fold over the nodes, joins by reachability, ways by permutations and subsets in order.
_WIDE = f"""with recursive
 wr as (select *, case when kind = 'XOR' then 60 + p_size % 10 else 1 + p_size % 8 end as n from (select p_partkey as record_no, p_size, case when p_partkey % 30 = 0 then 'XOR' when p_partkey % 2 = 0 then 'AND' else 'OR' end as kind from part)),
 wl as (select record_no, 0 as pos, 's' as rid, 'StartNode' as type, '' as text from wr union all select record_no, 1, 'x', kind, '' from wr
  union all select record_no, 2 + i, 'b' || i, 'Activity', ([{", ".join(f"'{t}'" for t in WIDE_TEXTS)}])[i % 4 + 1] from (select record_no, unnest(range(0, n)) as i from wr)
  union all select record_no, 2 + n, 'j', kind, '' from wr union all select record_no, 3 + n, 'e', 'EndNode', case when record_no % 2 = 0 then 'Done' else '' end from wr
  union all select record_no, 4 + n, 'b0', 'Activity', 'Again' from wr where record_no % 5 = 0),
 wn as (select record_no, rid, row_number() over (partition by record_no order by min(pos)) - 1 as idx, arg_max(type, pos) as type, arg_max(text, pos) as text from wl group by record_no, rid),
 wb as (select *, case when type in ('Activity', 'StartNode', 'EndNode') and text <> '' then replace(lower(text), ' ', '_') end as base from wn),
 wf as (select record_no, -1::bigint as idx, cast([] as varchar[]) as seen, null::varchar as id from wr
  union all select b.record_no, b.idx, case when b.base is null then f.seen else list_append(f.seen, case when list_contains(f.seen, b.base) then list_filter(list_transform(range(2, len(f.seen) + 3), lambda k: b.base || '_' || k), lambda c: not list_contains(f.seen, c))[1] else b.base end) end,
   case when b.base is null then null when list_contains(f.seen, b.base) then list_filter(list_transform(range(2, len(f.seen) + 3), lambda k: b.base || '_' || k), lambda c: not list_contains(f.seen, c))[1] else b.base end
  from wf f join wb b on b.record_no = f.record_no and b.idx = f.idx + 1),
 wi as (select f.record_no, f.idx, b.rid, f.id from wf f join wb b on b.record_no = f.record_no and b.idx = f.idx),
 we as (select record_no, 's' as src, 'x' as tgt, 0 as epos from wr union all select record_no, 'x', 'b' || i, 1 + 2 * i from (select record_no, unnest(range(0, n)) as i from wr)
  union all select record_no, 'b' || i, 'j', 2 + 2 * i from (select record_no, unnest(range(0, n)) as i from wr) union all select record_no, 'j', 'e', 1 + 2 * n from wr)"""


def _closing(nodes: str, edges: str, record: str) -> str:
    """CTEs and select of each split with the gateway that closes it: the first, by the ways to it, that all branches reach."""
    return f"""
 gates as (select n.{record} as rec, n.rid as split, count(*) as outs from {nodes} n join {edges} e on e.{record} = n.{record} and e.src = n.rid where n.type in ('XOR', 'AND', 'OR') group by all having count(*) > 1),
 reach as (select g.rec, g.split, e.epos as branch, e.tgt as rid, [e.epos] as way, [e.tgt] as met from gates g join {edges} e on e.{record} = g.rec and e.src = g.split
  union all select r.rec, r.split, r.branch, e.tgt, list_append(r.way, e.epos), list_append(r.met, e.tgt) from reach r join {edges} e on e.{record} = r.rec and e.src = r.rid where e.tgt <> r.split and not list_contains(r.met, e.tgt)),
 common as (select r.rec, r.split, r.rid, min([[len(way)], way]) as first from reach r join gates g on g.rec = r.rec and g.split = r.split group by r.rec, r.split, r.rid, g.outs having count(distinct branch) = g.outs),
 closing as (select c.rec, c.split, arg_min(c.rid, c.first) as rid from common c join {nodes} n on n.{record} = c.rec and n.rid = c.rid where n.type in ('XOR', 'AND', 'OR') and (select count(*) from {edges} e where e.{record} = c.rec and e.tgt = c.rid) > 1 group by all)
 select g.rec as record_no, g.split, c.rid as "join" from gates g left join closing c on c.rec = g.rec and c.split = g.split"""


_NESTED = f"""with recursive
 nr as (select s_suppkey as record_no, case when s_suppkey % 2 = 0 then 'AND' else 'OR' end as outr, s_suppkey // 4 % 4 as shape, case when s_suppkey // 4 % 4 = 2 then 'XOR' when s_suppkey // 2 % 2 = 0 then 'AND' else 'OR' end as innr from supplier),
 ne as (select record_no, src, tgt, epos from nr join (values {", ".join(f"({shape}, {k}, '{a}', '{b}')" for shape, pairs in enumerate(NESTED_EDGES) for k, (a, b) in enumerate(p.split(">") for p in pairs.split()))}) as t(shape, epos, src, tgt) on t.shape = nr.shape),
 nn as (select record_no, rid, case rid when 'x' then outr when 'j' then outr when 'y' then innr when 'k' then innr else 'other' end as type from nr, (values ('x'), ('y'), ('j'), ('k')) as t(rid) where rid <> 'k' or shape in (0, 2))"""
_NESTED_PATHS = f"""{_NESTED},
 ends as (select *, case when record_no % 5 = 0 then ['done'] else cast([] as varchar[]) end as done from nr),
 inside as (select record_no, nth, list_concat(way, case shape when 0 then ['delta'] when 3 then list_concat(['delta'], done) else cast([] as varchar[]) end) as way
  from ends join (values ('AND', 0, ['alpha', 'beta']), ('AND', 1, ['beta', 'alpha']), ('OR', 0, ['alpha']), ('OR', 1, ['beta']), ('OR', 2, ['alpha', 'beta']), ('XOR', 0, ['alpha']), ('XOR', 1, ['beta']), ('one', 0, ['alpha'])) as t(kind, nth, way)
  on kind = case when shape = 3 then 'one' else innr end),
 chosen as (
  select e.record_no, 2 * nth as path_no, list_concat(way, ['gamma']) as way from ends e join inside i on i.record_no = e.record_no where outr = 'AND'
  union all select e.record_no, 2 * nth + 1, list_concat(['gamma'], way) from ends e join inside i on i.record_no = e.record_no where outr = 'AND'
  union all select e.record_no, nth, way from ends e join inside i on i.record_no = e.record_no where outr = 'OR'
  union all select record_no, (select count(*) from inside i where i.record_no = e.record_no), ['gamma'] from ends e where outr = 'OR'
  union all select e.record_no, nth + 1 + (select count(*) from inside i where i.record_no = e.record_no), list_concat(way, ['gamma']) from ends e join inside i on i.record_no = e.record_no where outr = 'OR'),
 np as (select b.record_no, path_no, list_concat(list_concat(way, case when shape in (1, 3) then ['delta'] else cast([] as varchar[]) end), done) as path from chosen b join ends e on e.record_no = b.record_no)"""


def _states(paths: str) -> str:
    return f"""select record_no, completed, coalesce(string_agg(distinct nxt, ',' order by nxt), '') as available, bool_or(nxt is null) as can_terminate
 from (select record_no, array_to_string(path[1:i], '>') as completed, path[i + 1] as nxt from (select record_no, path, unnest(range(0, len(path) + 1)) as i from {paths} where path_no < 60)) group by record_no, completed"""


_WIDE_WAYS = f"""{_WIDE},
 orders as (select cast([] as integer[]) as o union all select list_append(o, i::integer) from orders, range(0, 8) as r(i) where len(o) < 8 and not list_contains(o, i::integer)),
 subsets as (select cast([] as integer[]) as o union all select list_append(o, i::integer) from subsets, range(0, 8) as r(i) where i > coalesce(o[len(o)], -1)),
 ways as (
  select 'AND' as kind, n, o, row_number() over (partition by n order by o) as nth from orders, range(1, 9) as r(n) where len(o) = n and coalesce(list_max(o), 0) < n
  union all select 'OR', n, o, row_number() over (partition by n order by len(o), o) from subsets, range(1, 9) as r(n) where len(o) between 1 and n and list_max(o) < n
  union all select 'XOR', n, [i::integer], i + 1 from (select n, unnest(range(0, n)) as i from range(60, 70) as r(n))),
 wp as (select r.record_no, w.nth - 1 as path_no, list_concat(list_transform(w.o, lambda i: ids[i + 1]), case when r.record_no % 2 = 0 then [done] else cast([] as varchar[]) end) as path
  from wr r join (select record_no, list(id order by try_cast(substr(rid, 2) as int)) filter (rid like 'b%') as ids, any_value(id) filter (rid = 'e') as done from wi group by 1) i on i.record_no = r.record_no
  join ways w on w.kind = r.kind and w.n = r.n"""
_WIDE_ALL = f"{_WIDE_WAYS})"
#: With the caps of blocks, for states.
_WIDE_PATHS = f"{_WIDE_WAYS} where r.kind = 'XOR' or w.nth <= 60)"

_KEY = lambda *xs: " || '|' || ".join(f"coalesce({x}, '<none>')" for x in xs)
_NAME = "regexp_replace(lower(trim(text)), ';+$', '')"
_TUPLES = {
    "actions": (f"select file_index, {_NAME} as k from rn where action_id is not null", f"select file_index, {_NAME} from xn where action_id is not null"),
    "action_successors": (f"select file_index, {_KEY('s_action', 't_schema')} as k from re where s_action is not null and coalesce(t_schema, '') <> ''", f"select file_index, {_KEY('s_action', 'coalesce(t_action, t_gateway)')} from xe where s_action is not null and coalesce(t_action, t_gateway) is not null"),
    "action_predecessors": (f"select file_index, {_KEY('s_schema', 't_action')} as k from re where t_action is not null and coalesce(s_schema, '') <> ''", f"select file_index, {_KEY('s_schema', 't_action')} from xe where t_action is not null and s_schema is not null"),
    "gateway_branches_next": (f"select file_index, {_KEY('s_gateway', 't_schema')} as k from re where s_gateway is not null and has_tgt and (coalesce(t_schema, '') <> '' or t_type = 'EndNode')", f"select file_index, {_KEY('s_gateway', 't_next')} from xe where s_gateway is not null and has_tgt"),
    "gateway_incoming": (f"select file_index, {_KEY('s_schema', 't_gateway')} as k from re where t_gateway is not null and coalesce(s_schema, '') <> ''", f"select file_index, {_KEY('coalesce(s_action, s_gateway)', 't_gateway')} from xe where t_gateway is not null and coalesce(s_action, s_gateway) is not null"),
    "branch_tuples": (f"select file_index, {_KEY('s_gateway', '''case when t_type = 'EndNode' then null else t_schema end''', '''nullif(trim(cond), '')''')} as k from re where s_gateway is not null and has_tgt", f"select file_index, {_KEY('s_gateway', 't_next', '''nullif(trim(cond), '')''')} from xe where s_gateway is not null and has_tgt"),
}
_SETS = (
    BOTH
    + ", gs as ("
    + " union ".join(f"select '{m}' as measure, * from ({g})" for m, (g, _) in _TUPLES.items())
    + "), xs as ("
    + " union ".join(f"select '{m}' as measure, * from ({x}) as q(file_index, k)" for m, (_, x) in _TUPLES.items())
    + "), ms as (select m.measure, f.file_index, (select count(*) from gs where gs.file_index = f.file_index and gs.measure = m.measure) as gt, (select count(*) from xs where xs.file_index = f.file_index and xs.measure = m.measure) as ext,"
    + " (select count(*) from gs join xs using (measure, file_index, k) where gs.file_index = f.file_index and gs.measure = m.measure) as hit from (select distinct file_index from nd) f cross join (values "
    + ", ".join(f"('{m}')" for m in _TUPLES)
    + ") as m(measure)),"
    + " pq as (select *, case when gt = 0 and ext = 0 then 1.0::double when ext = 0 then 0.0 else hit / ext end as p, case when gt = 0 and ext = 0 then 1.0::double when gt = 0 then 0.0 else hit / gt end as r from ms),"
    + " sc as (select *, case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end as f from pq),"
    + f" gg as (select file_index, row_number() over (partition by file_index order by idx) as ord, gtype, {_role()} as role, out_degree from rn where gateway_id is not null),"
    + f" gx as (select file_index, row_number() over (partition by file_index order by idx) as ord, gtype, {_role()} as role, (select count(*) from xe where xe.src = xn.rid and has_tgt) as nb from xn where gateway_id is not null),"
    + " ac as (select f.file_index, (select count(*) from gg where gg.file_index = f.file_index) as gt, (select count(*) from gx where gx.file_index = f.file_index) as ext,"
    + " (select sum(least(a, b)) from (select (select count(*) from gg where gg.file_index = f.file_index and gtype = t) as a, (select count(*) from gx where gx.file_index = f.file_index and gtype = t) as b from (values ('exclusive'), ('parallel'), ('inclusive')) as v(t))) as types,"
    + " (select count(*) from gg join gx using (file_index, ord) where gg.file_index = f.file_index and gg.role = gx.role) as roles,"
    + " (select count(*) from gg join gx using (file_index, ord) where gg.file_index = f.file_index and gg.out_degree = gx.nb) as counts from (select distinct file_index from nd) f),"
    + " aa as (select *, case when greatest(gt, ext) > 0 then types / greatest(gt, ext) else 1.0 end as type_accuracy, case when least(gt, ext) > 0 then roles / least(gt, ext) else 1.0 end as role_accuracy, case when least(gt, ext) > 0 then counts / least(gt, ext) else 1.0 end as count_accuracy from ac)"
)


def _prf(*measures: str) -> str:
    return f"{_SETS} select file_index as record_no, measure, round(p, 6) as \"precision\", round(r, 6) as recall, round(f, 6) as f1, gt as gt_count, ext as ext_count from sc where measure in ({', '.join(repr(m) for m in measures)})"


_ITEM = "case when measure = 'actions' then chr(39) || k || chr(39) else '(' || array_to_string(list_transform(string_split(k, '|'), lambda x: case when x = '<none>' then 'None' else chr(39) || x || chr(39) end), ', ') || ')' end"
_ORDER = "case when measure in ('gateway_branches_next', 'branch_tuples') then [item] else string_split(k, '|') end"


def _shown(name: str, left: str, right: str, where: str) -> str:
    return (
        f"{name} as (select measure, file_index, string_agg(item, ', ' order by nth) as items from (select *, row_number() over (partition by measure, file_index order by {_ORDER}) as nth"
        f" from (select *, {_ITEM} as item from (select measure, file_index, k from {left} except select measure, file_index, k from {right}))) where {where} group by measure, file_index)"
    )


_DIFFERENCES = f"{_SETS}, {_shown('dm', 'gs', 'xs', "nth <= 5 or measure = 'actions'")}, {_shown('dx', 'xs', 'gs', "measure = 'actions' or nth <= 5 and measure <> 'action_successors'")}"

_F = {"action_f1": "actions", "action_successor_f1": "action_successors", "action_predecessor_f1": "action_predecessors", "gateway_next_f1": "gateway_branches_next", "gateway_incoming_f1": "gateway_incoming", "branch_tuple_f1": "branch_tuples"}
_VM = "vm as (select aa.file_index, type_accuracy as gateway_type_accuracy, role_accuracy as gateway_role_accuracy, count_accuracy as branch_count_accuracy, " + ", ".join(f"(select f from sc where sc.file_index = aa.file_index and measure = '{m}') as {k}" for k, m in _F.items()) + " from aa)"
_EACH = f"{_SETS}, {_VM}"
_AT = _line_numbers()


def _two(x: str) -> str:
    return f"printf('%.2f', {x}::double)"


def _report() -> str:
    lines = ["select 1 as section, file_index as record_no, 0 as line_no, '' as line from aa", "select 1, file_index, 1, '--- Record ' || file_index || ' (file_index: ' || file_index || ') ---' from aa"]
    for k, label in SCORES.items():
        lines.append(f"select 1, file_index, {_AT[k]}, '{label}P=' || {_two('p')} || '  R=' || {_two('r')} || '  F1=' || {_two('f')} || '  (GT=' || gt || ', Ext=' || ext || ')' from sc where measure = '{k}'")
        for side, found, title in (("missing", "dm", MISSING), ("extra", "dx", EXTRA)):
            if f"{k} {side}" in _AT:
                lines.append(f"select 1, file_index, {_AT[f'{k} {side}']}, '{title}[' || items || ']' from {found} where measure = '{k}'")
    lines.append(f"select 1, file_index, {_AT['gateways']}, '{GATEWAY_LINE}count_match=' || case when gt = ext then 'True' else 'False' end || '  type_acc=' || {_two('type_accuracy')} || '  role_acc=' || {_two('role_accuracy')} || '  (GT=' || gt || ', Ext=' || ext || ')' from aa")
    lines.append(f"select 1, file_index, {_AT['counts']}, '{COUNT_LINE}accuracy=' || {_two('count_accuracy')} || '  (compared=' || least(gt, ext) || ')' from aa")
    lines += [f"select 0, -1, {n}, '{x}'" for n, x in enumerate(HEADING)]
    last = [(1, f"max('{RULE}')"), (2, "'AVERAGES (over ' || count(*) || ' records):'"), (3 + len(MEANS), f"max('{RULE}')"), *((3 + n, f"'{label}' || {_two(f'avg({k})')}") for n, (k, label) in enumerate(MEANS.items()))]
    lines += ["select 2, -1, 0, ''", *(f"select 2, -1, {n}, {x} from vm" for n, x in last)]
    return " union all ".join(lines)


_MEASURES = ("gateway_type_accuracy", "gateway_role_accuracy", "branch_count_accuracy", *_F)
_TEXT = "(select doc_id as record_no, replace(text, '. ', '. <SEP> ') as paragraph from documents)"
_CLEAN = "regexp_replace(replace(replace(replace(paragraph, ' <SEP> ', ' '), '<SEP>', ' '), chr(10), ' '), ' {2,}', ' ', 'g')"
_COUNT = "len(regexp_extract_all({}, '\\S+'))"

ORACLES = {
    "scan_records": f"with {_ND}, e as (select file_index, count(*) as n from ed group by 1) select n.file_index, count(*) as n_nodes, any_value(e.n) as n_flows, length(string_agg(event_type, ' ')) as n_chars from nd n join e on e.file_index = n.file_index group by 1",
    "merge_splits": f"""select record_no, file_index, n_words, paragraph from (select row_number() over (order by record_no % 3, record_no) - 1 as record_no, record_no as file_index, {_CLEAN} as paragraph, {_COUNT.format(_CLEAN)} as n_words from {_TEXT}) where n_words <= 500""",
    "merge_files": f"""select row_number() over (order by record_no % 3, record_no) - 1 as record_no, record_no as file_index, {_CLEAN} as paragraph, paragraph as title, {_CLEAN} as noted, n_chars as n, source, n_chars as size,
   array_to_string(list_sort(json_keys(record)), ',') as keys, array_to_string(list_sort(json_keys(record, '$.meta')), ',') as meta_keys
  from (select doc_id as record_no, replace(text, '. ', '. <SEP> ') as paragraph, n_chars, source,
    json_object('file_index', doc_id, 'paragraph', text, 'meta', json_object('lang', lang, 'source', source, 'title', text, 'history', [text]), 'size', n_chars) as record from documents) where {_COUNT.format(_CLEAN)} <= 500""",
    "merge_file_counts": f"select count(*) as before, count(*) filter ({_COUNT.format(_CLEAN)} <= 500) as after, count(*) filter ({_COUNT.format(_CLEAN)} > 500) as removed from {_TEXT}",
    "array_scan": "select row_number() over (order by doc_id) - 1 as record_no, doc_id as file_index, length(replace(text, '. ', '. <SEP> ')) as n_chars from documents",
    "checked_records": """select doc_id as at, case when doc_id % 7 = 0 then 'no JSON' when doc_id % 11 = 0 then 'does not fit the schema' when doc_id % 13 = 0 then 'activity without text' else '' end as error,
   case when error = '' then doc_id else -1 end as file_index, case when error = '' then length(replace(text, '. ', '. <SEP> ')) else -1 end as n_chars from documents""",
    "clean_nested": f"select record_no, paragraph as title, {_CLEAN} as paragraph, {_CLEAN} as listed, {_CLEAN} as mapped, paragraph as other, record_no as number from {_TEXT}",
    "clean_paragraph": f"select record_no, {_CLEAN} as paragraph from {_TEXT}",
    "filter_max_words": f"select record_no, {_COUNT.format(_CLEAN)} as n_words from {_TEXT} where {_COUNT.format(_CLEAN)} <= 500",
    "token_stats": f"select count(*) as records, round(avg(n), 6) as mean, round(median(n), 6) as median, round(stddev_pop(n), 6) as std, min(n) as min, max(n) as max from (select {_COUNT.format('paragraph')} as n from {_TEXT})",
    "token_histogram": f"""with c as (select {_COUNT.format('paragraph')}::double as n from {_TEXT}), e as (select min(n) - case when min(n) = max(n) then 0.5 else 0 end as lo, max(n) + case when min(n) = max(n) then 0.5 else 0 end as hi from c),
 b as (select least(50, floor((n - lo) * 50 / (hi - lo))::int + 1) as bin, count(*) as records from c, e group by 1)
 select i::int as bin, round(lo + (hi - lo) * (i - 1) / 50, 6) as low, round(lo + (hi - lo) * i / 50, 6) as high, coalesce(b.records, 0) as records from range(1, 51) as r(i) cross join e left join b on b.bin = r.i""",
    "token_chart": f"""with c as (select {_COUNT.format('paragraph')}::double as n from {_TEXT}), e as (select min(n) - case when min(n) = max(n) then 0.5 else 0 end as lo, max(n) + case when min(n) = max(n) then 0.5 else 0 end as hi, 'Mean: ' || cast(round(avg(n)) as bigint) as mean, 'Median: ' || cast(round(median(n)) as bigint) as median from c),
 b as (select least(50, floor((n - lo) * 50 / (hi - lo))::int + 1) as bin, count(*) as records from c, e group by 1)
 select cast(60 + 14 * (bin - 1) as bigint) as x, cast(floor(400.0 * records / (select max(records) from b)) as bigint) as height, mean, median from b, e""",
    "merge_counts": f"select count(*) as before, count(*) filter (n <= 500) as after, count(*) filter (n > 500) as removed from (select {_COUNT.format(_CLEAN)} as n from {_TEXT})",
    "train_test_split": "select doc_id as record_no, case when row_number() over (order by md5('42-' || doc_id), doc_id) <= floor((select count(*) from documents) * 0.8) then 'train' else 'test' end as split from documents",
    "train_test_files": """select split, row_number() over (partition by split order by doc_id) - 1 as record_no, doc_id as file_index, lang from (
   select *, case when row_number() over (order by md5('42-' || doc_id), doc_id) <= floor((select count(*) from documents) * 0.8) then 'train' else 'test' end as split from documents)""",
    "nodes": f"{RAW} select file_index as record_no, idx, rid, text, type, agent from rn",
    "edges": f"{RAW} select file_index as record_no, idx, src, tgt, cond as condition from re",
    "adjacency": f"{RAW} select file_index as record_no, rid, coalesce((select string_agg(tgt, ',' order by idx) from re where re.src = rn.rid), '') as outgoing, coalesce((select string_agg(src, ',' order by idx) from re where re.tgt = rn.rid), '') as incoming from rn",
    "start_nodes": f"{RAW} select file_index as record_no, rid from rn where type = 'StartNode'",
    "dangling_edges": f"{BOTH} select file_index as record_no, src, tgt, has_src, has_tgt from xe where not has_src or not has_tgt",
    "gateway_degrees": f"{RAW} select file_index as record_no, rid, in_degree, out_degree, {_role()} as role from rn where gateway_id is not null",
    "gateway_ids": f"{RAW} select file_index as record_no, rid, gateway_id from rn where gateway_id is not null",
    "action_ids": f"{RAW} select file_index as record_no, rid, action_id from rn where action_id is not null",
    "schema_ids": f"{RAW} select file_index as record_no, rid, schema_id from rn",
    "actors": f"{RAW} select f.file_index as record_no, coalesce(a.actors, '') as actors from (select distinct file_index from nd) f left join {_ACTORS} a on a.file_index = f.file_index",
    "actions": f"{RAW} select n.file_index as record_no, row_number() over (partition by n.file_index order by n.idx) - 1 as ordinal, action_id as id, trim(text) as name, nullif(trim(agent), '') as actor, coalesce(p.n, 0) as n_predecessors, coalesce(s.n, 0) as n_successors, action_id || '_done' as postconditions from rn n left join {PRED} p on p.file_index = n.file_index and p.own = n.action_id left join {SUCC} s on s.file_index = n.file_index and s.own = n.action_id where action_id is not null",
    "action_predecessors": f"{RAW} select n.file_index as record_no, action_id as id, coalesce(p.labels, '') as predecessors from rn n left join {PRED} p on p.file_index = n.file_index and p.own = n.action_id where action_id is not null",
    "action_successors": f"{RAW} select n.file_index as record_no, action_id as id, coalesce(s.labels, '') as successors from rn n left join {SUCC} s on s.file_index = n.file_index and s.own = n.action_id where action_id is not null",
    "gateways": f"{RAW} select n.file_index as record_no, row_number() over (partition by n.file_index order by n.idx) - 1 as ordinal, gateway_id as id, gtype as type, {_role()} as role, coalesce(i.n, 0) as n_incoming, (select count(*) from re where re.src = n.rid and has_tgt) as n_branches, nullif(trim(agent), '') as actor from rn n left join {INC} i on i.file_index = n.file_index and i.own = n.gateway_id where gateway_id is not null",
    "gateway_branches": f"{RAW} select file_index as record_no, s_gateway as id, row_number() over (partition by file_index, s_gateway order by idx) - 1 as branch_no, t_next as next, nullif(trim(cond), '') as condition from re where s_gateway is not null and has_tgt",
    "gateway_incoming": f"{RAW} select n.file_index as record_no, gateway_id as id, coalesce(i.labels, '') as incoming_from from rn n left join {INC} i on i.file_index = n.file_index and i.own = n.gateway_id where gateway_id is not null",
    "gateway_type_counts": f"{RAW} select file_index as record_no, gtype as type, count(*) as n from rn where gateway_id is not null group by all",
    "matching_joins": f"with recursive {_ND}, {_closing('nd', 'ed', 'file_index')}",
    "execution_paths": f"{_RECURSIVE} select file_index as record_no, array_to_string(path, '>') as path from pp",
    "execution_states": f"{_RECURSIVE} select file_index as record_no, completed, available, can_terminate from st",
    "wide_action_ids": f"{_WIDE} select record_no, idx, rid, id as action_id from wi where id is not null",
    "wide_matching_joins": f"{_WIDE}, {_closing('wn', 'we', 'record_no')}",
    "nested_matching_joins": f"{_NESTED}, {_closing('nn', 'ne', 'record_no')}",
    "nested_paths": f"{_NESTED_PATHS} select record_no, path_no, array_to_string(path, '>') as path from np",
    "nested_states": f"{_NESTED_PATHS} {_states('np')}",
    "wide_paths": f"{_WIDE_ALL} select record_no, path_no, array_to_string(path, '>') as path from wp",
    "wide_states": f"{_WIDE_PATHS} {_states('wp')}",
    "workflow_summary": f"{_RECURSIVE} select n.file_index as record_no, coalesce(any_value(a.n), 0) as n_actors, count(action_id) as n_actions, count(gateway_id) as n_gateways, any_value(s.n) as n_execution_states from rn n left join {_ACTORS} a on a.file_index = n.file_index join (select file_index, count(*) as n from st group by 1) s on s.file_index = n.file_index group by n.file_index",
    "extract_summary": f"{RAW} select n.file_index as record_no, coalesce(any_value(a.n), 0) as n_actors, count(action_id) as n_actions, count(gateway_id) as n_gateways from rn n left join {_ACTORS} a on a.file_index = n.file_index group by n.file_index order by 1 limit 20",
    "workflow_values": f"""{_RECURSIVE} select file_index, 'text' as part, 0 as ordinal, string_agg(event_type, ' ' order by pos) as value from nd group by file_index
 union all select f.file_index, 'actors', 0, coalesce(a.actors, '') from (select distinct file_index from nd) f left join {_ACTORS} a on a.file_index = f.file_index
 union all select n.file_index, 'action', row_number() over (partition by n.file_index order by n.idx) - 1, concat_ws('|', action_id, trim(text), coalesce(nullif(trim(agent), ''), '-'), coalesce(p.labels, ''), coalesce(s.labels, ''), action_id || '_done')
  from rn n left join {PRED} p on p.file_index = n.file_index and p.own = n.action_id left join {SUCC} s on s.file_index = n.file_index and s.own = n.action_id where action_id is not null
 union all select n.file_index, 'gateway', row_number() over (partition by n.file_index order by n.idx) - 1, concat_ws('|', gateway_id, gtype, {_role()}, coalesce(i.labels, ''), coalesce(w.ways, ''), coalesce(nullif(trim(agent), ''), '-'))
  from rn n left join {INC} i on i.file_index = n.file_index and i.own = n.gateway_id
  left join (select file_index, s_gateway, string_agg(coalesce(t_next, '-') || ':' || coalesce(nullif(trim(cond), ''), '-'), ',' order by idx) as ways from re where s_gateway is not null and has_tgt group by all) w on w.file_index = n.file_index and w.s_gateway = n.gateway_id where gateway_id is not null
 union all select file_index, 'state', -1, concat_ws('|', completed, available, cast(can_terminate as varchar)) from st""",
    "read_workflows": f"""{_RECURSIVE} select n.file_index, coalesce(any_value(a.n), 0) as n_actors, count(action_id) as n_actions, count(gateway_id) as n_gateways, any_value(s.n) as n_execution_states,
 (select count(*) from re where re.file_index = n.file_index and s_gateway is not null and has_tgt and trim(cond) <> '') as n_conditions, (select count(*) from re where re.file_index = n.file_index and s_gateway is not null and has_tgt and t_next is null) as n_ends,
 count(*) filter (action_id is not null and trim(agent) <> '') as n_acted, any_value(s.terminal) as n_terminal
 from rn n left join {_ACTORS} a on a.file_index = n.file_index join (select file_index, count(*) as n, count(*) filter (can_terminate) as terminal from st group by 1) s on s.file_index = n.file_index group by n.file_index""",
    "validation_join": f"{BOTH} select file_index, (select count(*) from rn where rn.file_index = f.file_index) as n_nodes, (select count(action_id) from xn where xn.file_index = f.file_index) as n_actions from (select distinct file_index from fnd) f",
    "validation_unmatched": f"with {_ND} select distinct -1 - file_index as file_index from fnd where file_index % 10 = 3",
    "action_prf": _prf("actions"),
    "edge_prf": _prf("action_successors", "action_predecessors"),
    "gateway_edge_prf": _prf("gateway_branches_next", "gateway_incoming"),
    "branch_tuple_prf": _prf("branch_tuples"),
    "gateway_type_accuracy": f"{_SETS} select file_index as record_no, gt = ext as count_match, gt as gt_count, ext as ext_count, round(type_accuracy, 6) as type_accuracy from aa",
    "gateway_role_accuracy": f"{_SETS} select file_index as record_no, round(role_accuracy, 6) as role_accuracy from aa",
    "branch_count_accuracy": f"{_SETS} select file_index as record_no, round(count_accuracy, 6) as accuracy, least(gt, ext) as total_compared from aa",
    "validation_metrics": f"{_EACH} select file_index as record_no, " + ", ".join(f"round({m}, 6) as {m}" for m in _MEASURES) + " from vm",
    "validation_diagnostics": f"{_DIFFERENCES} select ms.file_index as record_no, ms.measure, coalesce(dm.items, '') as missing, coalesce(dx.items, '') as extra from ms left join dm on dm.measure = ms.measure and dm.file_index = ms.file_index left join dx on dx.measure = ms.measure and dx.file_index = ms.file_index",
    "validation_report": f"{_DIFFERENCES}, {_VM} {_report()}",
    "validation_averages": f"{_EACH} select count(*) as records, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in _MEASURES) + " from vm",
}
ORACLES["validation_from_files"] = ORACLES["validation_averages"]
assert not set(ORACLES) - set(QUERIES)
