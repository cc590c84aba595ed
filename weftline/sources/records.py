"""Procedure records: schemas, JSON sources and sinks, and the adapter that makes records of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.sources.arrays import read_array
from weftline.sources.numbers import numbered
from weftline.sources.shared import shared_folder

NODE = "struct<resourceId: string, NodeText: string, type: string, agent: string>"
FLOW = "struct<src: string, tgt: string, condition: string>"
RAW = f"file_index bigint, paragraph string, step_nodes array<{NODE}>, SequenceFlow array<{FLOW}>"
RECORD = f"record_no bigint, {RAW}"

ACTION = "struct<id: string, name: string, actor: string, predecessors: array<string>, successors: array<string>, postconditions: array<string>>"
BRANCH = "struct<next: string, condition: string>"
GATEWAY = f"struct<id: string, type: string, role: string, incoming_from: array<string>, branches: array<{BRANCH}>, actor: string>"
STATE = "struct<completed_actions: array<string>, available_next: array<string>, can_terminate: boolean>"
WORKFLOW = f"file_index bigint, procedure_text string, workflow struct<actors: array<string>, actions: array<{ACTION}>, gateways: array<{GATEWAY}>, execution_states: array<{STATE}>>"

#: The splits of a corpus in the order in which they are joined.
SPLITS = ("dev", "test", "train")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, json): each record's text, of a JSON array file or of JSON Lines (a path ending in .jsonl or /).

    An array is read by many tasks and numbered by position; numbers of JSON Lines are unique and
    ordered within a file.
    """
    if path.endswith((".jsonl", "/")):
        return spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("record_no"), F.col("value").alias("json"))
    return read_array(spark, path)


def _parsed(rows: DataFrame, schema: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.from_json("json", schema, {"mode": "FAILFAST"}).alias("weft")).select(*keep, "weft.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as texts() finds them, with the declared columns. A record that does not fit the schema fails the read."""
    return _parsed(texts(spark, path), RAW, "record_no")


def read_workflows(spark: SparkSession, path: str) -> DataFrame:
    """Extracted workflows of a JSON array file or of JSON Lines (a path ending in .jsonl or /); keys that are absent are null."""
    return _parsed(texts(spark, path), WORKFLOW)


def read_open(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, record): records with all their keys, whatever they are, as VARIANT values. Text that is no JSON fails the read."""
    return texts(spark, path).select("record_no", F.parse_json("json").alias("record"))


def with_columns(records: DataFrame, schema: str = RAW) -> DataFrame:
    """Open records with the declared columns beside them; keys that are absent, or of another kind, are null."""
    return records.select("*", F.from_json(F.to_json("record"), schema).alias("weft")).select("*", "weft.*").drop("weft")


#: Why a record is rejected.
NO_JSON, NO_FIT, NO_TEXT = "no JSON", "does not fit the schema", "activity without text"


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """All records of one pass, good and bad: record_no, the declared columns, json, and error, null where the record is good.

    Bad records have null columns: those that are no JSON, that do not fit the schema, or whose
    paths could not be enumerated.
    """
    rows = texts(spark, path).select("record_no", "json", F.from_json("json", f"{RAW}, weft_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "weft_bad"}).alias("r"))
    mute = "exists(r.step_nodes, n -> n.type = 'Activity' and " + T.blank("n.NodeText") + ")"
    error = f"case when try_parse_json(json) is null then '{NO_JSON}' when r.weft_bad is not null or r is null then '{NO_FIT}' when {mute} then '{NO_TEXT}' end"
    kept = rows.select("record_no", "json", "r", F.expr(error).alias("error"))
    return kept.select("record_no", *(F.when(F.col("error").isNull(), F.col(f"r.{c}")).alias(c) for c in ("file_index", "paragraph", "step_nodes", "SequenceFlow")), "json", "error")


def merge_splits(splits: list[DataFrame]) -> DataFrame:
    """Splits one after another, with dense record numbers; each split keeps its own order.

    Offsets come from the splits' counts, so nothing is sorted or sent to one task; each split's
    record_no must be dense from 0, as read_records() gives for an array file.
    """
    merged, offset = None, 0
    for split in splits:
        part = split.withColumn("record_no", F.col("record_no") + F.lit(offset).cast("bigint"))
        merged = part if merged is None else merged.unionByName(part)
        offset += split.count()
    return merged


def write_records(records: DataFrame, path: str) -> None:
    """JSON Lines in UTF-8, absent fields left out."""
    records.drop("record_no").write.mode("error").json(path)


#: Edges of the adapter's template: from, to, condition.
TEMPLATE = ((0, 1, ""), (1, 2, ""), (2, 3, "high"), (2, 4, "low"), (3, 5, ""), (4, 5, ""), (5, 6, ""), (6, 7, ""), (7, 1, "again"), (7, 8, "retry"), (7, 9, "done"), (8, 9, ""))


#: Runs of a user that are numbered user_id * 1000 + run; further ones get numbers from FURTHER on, in RUNS places
#: for each user from -USERS to USERS - 1.
PLAIN, FURTHER, RUNS, USERS = 1000, 1 << 62, 1 << 26, 1 << 34
NUMBER = f"""case when user_id is null then null
          when run < {PLAIN} and user_id < {FURTHER // PLAIN} then user_id * {PLAIN} + run
          when run between {PLAIN} and {PLAIN + RUNS - 1} and user_id between {-USERS} and {USERS - 1} then {FURTHER} + (user_id + {USERS}) * {RUNS} + (run - {PLAIN})
          else cast(raise_error(concat('no record number for user ', user_id, ', run ', run)) as bigint) end"""


#: Events of a user that one task may put in order; those of users with more are dealt out by ranges.
HOT_EVENTS = 1 << 22
#: Bytes that an event takes in a file at the least.
EVENT_BYTES = 4


def _ranked(events: DataFrame, most: int) -> DataFrame:
    """(user_id, event_type, value, rn): events with their number among their user's, by time."""
    own = events.select("user_id", "ts", "event_id", "event_type", "value")
    in_tasks = "row_number() over (partition by user_id order by ts, event_id) - 1"
    rank = lambda rows: rows.select("user_id", "event_type", "value", F.expr(in_tasks).cast("bigint").alias("rn"))
    size = int(own._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < most * EVENT_BYTES:
        return rank(own)
    users = own.groupBy("user_id").count().where(F.col("count") > most).select(F.col("user_id").alias("hot"))
    users = users.checkpoint() if shared_folder(events.sparkSession) else users
    if users.isEmpty():
        return rank(own)
    # hot users are few: each holds more than `most` events
    same = F.col("user_id").eqNullSafe(F.col("hot"))
    rest, hot = own.join(F.broadcast(users), same, "left_anti"), numbered(own.join(F.broadcast(users), same, "left_semi"), "user_id", "ts", "event_id", name="at")
    first = F.broadcast(hot.groupBy(F.col("user_id").alias("hot")).agg(F.min("at").alias("first")))
    return rank(rest).unionByName(hot.join(first, same).select("user_id", "event_type", "value", (F.col("at") - F.col("first")).alias("rn")))


def event_records(events: DataFrame, hot_events: int = HOT_EVENTS) -> DataFrame:
    """Records of complete runs of ten events of a user, over a fixed ten-node template.

    One shuffle, by user: the runs are grouped in the partitions that the window made. Events of users with more than
    hot_events are put in order by ranges and grouped by run, so that no task has all of a user's. Numbers are
    unique, however many runs a user has; a user or run beyond NUMBER's ranges is an error.
    """
    edges = ", ".join(f"named_struct('a', {a}, 'b', {b}, 'cond', '{c}')" for a, b, c in TEMPLATE)
    return events.sparkSession.sql(f"""
        with runs as (
          select user_id, cast(floor(rn / 10) as bigint) as run, array_sort(collect_list(named_struct('pos', cast(rn % 10 as int), 'kind', event_type, 'value', value))) as steps
          from {{ranked}} group by user_id, cast(floor(rn / 10) as bigint) having count(*) = 10),
        keyed as (select {NUMBER} as file_index, steps, steps[2].kind as split from runs)
        select file_index as record_no, file_index, array_join(transform(steps, s -> s.kind), ' ') as paragraph,
          transform(steps, s -> named_struct(
            'resourceId', concat('sid-', file_index, '-', s.pos),
            'NodeText', case when s.pos in (2, 5, 7) or (s.pos = 0 and file_index % 2 = 0) or (s.pos = 9 and file_index % 3 = 0) then '' else s.kind end,
            'type', case when s.pos = 0 then 'StartNode' when s.pos = 9 then 'EndNode' when s.pos = 7 then 'XOR'
                    when s.pos in (2, 5) then case split when 'purchase' then 'AND' when 'signup' then 'OR' else 'XOR' end else 'Activity' end,
            'agent', case when s.value > 10 then concat('Team ', s.kind) else '' end)) as step_nodes,
          transform(filter(array({edges}), t -> not (t.a = 7 and t.b = 1) or file_index % 7 = 0), t -> named_struct(
            'src', concat('sid-', file_index, '-', t.a), 'tgt', concat('sid-', file_index, '-', t.b), 'condition', t.cond)) as SequenceFlow
        from keyed""", ranked=_ranked(events, hot_events))


#: Bytes of a table for a task that makes records of its rows, at the least, and the tasks for each core, at the most
#: unless they would have more than the further number of bytes.
SPREAD_BYTES, SPREAD_TASKS, SPREAD_MOST = 16 << 10, 4, 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to tasks: a file of a few bytes a row is read by few tasks, however much work follows from each row."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-size // SPREAD_BYTES), max(SPREAD_TASKS * cores, min(-(-size // SPREAD_MOST), 1 << 16)))
    return rows.repartition(tasks) if tasks > 1 else rows


#: Texts of the branches of wide records, over and over: their ids collide with each other's suffixes.
WIDE_TEXTS = ("Step", "step", "Step 2", "step_2")


def wide_records(parts: DataFrame) -> DataFrame:
    """Records of one block with many branches, of each part: more ways than the caps allow.

    start > split > branch i > join > end. Parallel and inclusive blocks have up to eight branches; every 30th
    record has an exclusive one of 60 to 69. Texts collide, every other end has a name, and every fifth record
    holds its first branch's id again, with another text.
    """
    texts = ", ".join(f"'{t}'" for t in WIDE_TEXTS)
    node = lambda rid, text, kind: f"named_struct('resourceId', {rid}, 'NodeText', {text}, 'type', {kind}, 'agent', '')"
    flow = lambda a, b: f"named_struct('src', {a}, 'tgt', {b}, 'condition', '')"
    return (
        spread(parts.select("p_partkey", "p_name", "p_size")).selectExpr("p_partkey as record_no", "p_partkey as file_index", "p_name as paragraph", "case when p_partkey % 30 = 0 then 'XOR' when p_partkey % 2 = 0 then 'AND' else 'OR' end as kind", "p_size")
        .withColumn("n", F.expr("cast(if(kind = 'XOR', 60 + p_size % 10, 1 + p_size % 8) as int)"))
        .selectExpr(
            "record_no",
            "file_index",
            "paragraph",
            f"""concat(array({node("'s'", "''", "'StartNode'")}, {node("'x'", "''", "kind")}), transform(sequence(0, n - 1), i -> {node("concat('b', i)", f"array({texts})[i % 4]", "'Activity'")}),
                array({node("'j'", "''", "kind")}, {node("'e'", "if(record_no % 2 = 0, 'Done', '')", "'EndNode'")}), if(record_no % 5 = 0, array({node("'b0'", "'Again'", "'Activity'")}), array())) as step_nodes""",
            f"""concat(array({flow("'s'", "'x'")}), flatten(transform(sequence(0, n - 1), i -> array({flow("'x'", "concat('b', i)")}, {flow("concat('b', i)", "'j'")}))), array({flow("'j'", "'e'")})) as SequenceFlow""",
        )
    )


def nested_records(suppliers: DataFrame) -> DataFrame:
    """Records of a block within a block, of each supplier, in four shapes.

    start > x > (y > (a, b), c) > j > end. The inner block ends in a gateway of its own, before a step d (shape 0), or where
    the outer one ends, with d after both (1); it is a choice (2), or has one branch, so that nothing stops it at the outer
    block's end (3). Both blocks are parallel or inclusive by turns; every fifth end has a name.
    """
    node = lambda rid, text, kind: f"named_struct('resourceId', '{rid}', 'NodeText', {text}, 'type', {kind}, 'agent', '')"
    flow = lambda pairs: "array(" + ", ".join(f"named_struct('src', '{a}', 'tgt', '{b}', 'condition', '')" for a, b in (p.split(">") for p in pairs.split())) + ")"
    steps = ", ".join(node(r, f"'{t}'", "'Activity'") for r, t in NESTED_STEPS.items())
    edges = " ".join(f"when {shape} then {flow(pairs)}" for shape, pairs in enumerate(NESTED_EDGES))
    return spread(suppliers.select("s_suppkey", "s_name")).selectExpr("s_suppkey as record_no", "s_suppkey as file_index", "s_name as paragraph", "if(s_suppkey % 2 = 0, 'AND', 'OR') as outer", "s_suppkey div 4 % 4 as shape", "if(s_suppkey div 4 % 4 = 2, 'XOR', if(s_suppkey div 2 % 2 = 0, 'AND', 'OR')) as inner").selectExpr(
        "record_no",
        "file_index",
        "paragraph",
        f"""concat(array({node("s", "''", "'StartNode'")}, {node("x", "''", "outer")}, {node("y", "''", "inner")}, {steps}, {node("j", "''", "outer")}, {node("e", "if(record_no % 5 = 0, 'Done', '')", "'EndNode'")}),
            if(shape in (0, 2), array({node("k", "''", "inner")}), array())) as step_nodes""",
        f"case shape {edges} end as SequenceFlow",
    )


#: Steps and edges of nested records; edges by shape.
NESTED_STEPS = {"a": "alpha", "b": "beta", "c": "gamma", "d": "delta"}
NESTED_EDGES = (
    "s>x x>y x>c y>a y>b a>k b>k k>d d>j c>j j>e",
    "s>x x>y x>c y>a y>b a>j b>j c>j j>d d>e",
    "s>x x>y x>c y>a y>b a>k b>k k>j c>j j>e",
    "s>x x>y x>c y>a a>j c>j j>d d>e",
)


def with_strays(records: DataFrame) -> DataFrame:
    """records, and beside every tenth a copy under a number that no other record has."""
    return records.unionByName(records.where("file_index % 10 = 3").withColumns({"file_index": F.expr("-1 - file_index"), "record_no": F.expr("-1 - record_no")}))


def with_faults(records: DataFrame) -> DataFrame:
    """Records of the adapter with some nodes, texts, types and edges changed, by rule of their number.

    Gives validation something to find: a step is missing from every 13th record, a text is changed
    in every 6th, a gateway's type in every 5th, and about one edge in eleven is missing.
    """
    return records.withColumns(
        {
            "step_nodes": F.expr("""transform(filter(step_nodes, (n, i) -> not (i = 3 and file_index % 13 = 0)), (n, i) -> named_struct(
                'resourceId', n.resourceId,
                'NodeText', if(n.resourceId = concat('sid-', file_index, '-4') and file_index % 6 = 0, 'Other step', n.NodeText),
                'type', if(n.resourceId = concat('sid-', file_index, '-7') and file_index % 5 = 0, 'AND', n.type), 'agent', n.agent))"""),
            "SequenceFlow": F.expr("filter(SequenceFlow, e -> (file_index + 10 * cast(element_at(split(e.src, '-'), -1) as bigint) + cast(element_at(split(e.tgt, '-'), -1) as bigint)) % 11 <> 0)"),
        }
    )
