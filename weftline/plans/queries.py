"""The engine's queries over the driver's tables: records come from events by the adapter, paragraphs from documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import corpus, paths, validate, workflow
from weftline.operators import graph as G
from weftline.sources import export, records
from weftline.sources.arrays import read_array
from weftline.sources.shared import kept, run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records.event_records(_table(spark, d, "events"))


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    return G.graphs(_records(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.graphs(_records(spark, d), with_edges=False)


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return workflow.workflows(_graphs(spark, d))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as paragraphs; they have no separators, so sentences get some."""
    return _table(spark, d, "documents").select(F.col("doc_id").alias("record_no"), F.expr("replace(text, '. ', '. <SEP> ')").alias("paragraph"))


def _whole(raw: DataFrame) -> DataFrame:
    """Workflows with execution states, each record's in one pass."""
    return workflow.workflows(paths.with_states(G.graphs(raw)))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """The measures of workflows with faults against their raw records, which are made of the events once."""
    raw = kept(_records(spark, d))
    return validate.metrics(validate.joined(G.graphs(raw), workflow.workflows(G.graphs(records.with_faults(raw)))))


def _joined(column: str, by: str = ",") -> F.Column:
    return F.array_join(column, by).alias(column)


# corpus


@query
def scan_records(spark, d):
    """Records written as JSON Lines, read back with the declared schema, and counted."""
    folder = run_folder(spark, "records") + "/"
    records.write_records(_records(spark, d), folder)
    return records.read_records(spark, folder).select("file_index", F.size("step_nodes").cast("bigint").alias("n_nodes"), F.size("SequenceFlow").cast("bigint").alias("n_flows"), F.length("paragraph").cast("bigint").alias("n_chars"))


@query
def merge_splits(spark, d):
    """Three splits as files of one JSON array each, read, cleaned, joined with dense numbers and filtered."""
    folder, splits = run_folder(spark, "splits"), []
    for n, name in enumerate(records.SPLITS):
        part = _table(spark, d, "documents").where(F.col("doc_id") % 3 == n).select(
            F.col("doc_id").alias("file_index"), F.expr("replace(text, '. ', '. <SEP> ')").alias("paragraph"), F.array().cast(f"array<{records.NODE}>").alias("step_nodes"), F.array().cast(f"array<{records.FLOW}>").alias("SequenceFlow"), F.col("doc_id").alias("at")
        )
        export.write_array(export.row_json(part, "at", ascii_only=n == 0, indent=2 if n else None), f"{folder}/{name}.json", "at", 2 if n else None)
        splits.append(corpus.clean(records.read_records(spark, f"{folder}/{name}.json")))
    merged = corpus.filter_max_words(records.merge_splits(splits), count="n_words")
    return merged.select("record_no", "file_index", F.col("n_words").cast("bigint").alias("n_words"), "paragraph")


def _open(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records with keys that no schema of the engine names, some of them nested; json in order of at."""
    text = F.expr("replace(text, '. ', '. <SEP> ')")
    history = F.array(F.struct(text.alias("paragraph"), F.col("n_chars").alias("n")), F.struct(F.col("lang").alias("paragraph"), F.lit(0).cast("bigint").alias("n")))
    record = F.struct(F.col("doc_id").alias("file_index"), text.alias("paragraph"), F.struct(F.col("lang"), F.col("source"), text.alias("title"), history.alias("history")).alias("meta"), F.col("n_chars").alias("size"))
    return _table(spark, d, "documents").select(F.col("doc_id").alias("at"), F.to_json(record).alias("json"))


def _merged(spark: SparkSession, d: str) -> tuple[str, dict[str, int]]:
    folder = run_folder(spark, "open")
    for n, name in enumerate(records.SPLITS):
        export.write_array(_open(spark, d).where(F.col("at") % 3 == n), f"{folder}/{name}.json", "at", None)
    counts = corpus.merge_files(spark, [f"{folder}/{name}.json" for name in records.SPLITS], f"{folder}/merged.json")
    return f"{folder}/merged.json", counts


@query
def merge_files(spark, d):
    """Three array files of records with unknown keys, cleaned at any depth, joined, filtered, written as one and read back."""
    rows = records.read_open(spark, _merged(spark, d)[0])
    value = lambda path, kind="string": F.expr(f"variant_get(record, '$.{path}', '{kind}')")
    keys = lambda x: F.array_join(F.array_sort(F.json_object_keys(F.to_json(x))), ",")
    return rows.select(
        "record_no", value("file_index", "bigint").alias("file_index"), value("paragraph").alias("paragraph"), value("meta.title").alias("title"), value("meta.history[0].paragraph").alias("noted"), value("meta.history[0].n", "bigint").alias("n"),
        value("meta.source").alias("source"), value("size", "bigint").alias("size"), keys(F.col("record")).alias("keys"), keys(F.expr("variant_get(record, '$.meta')")).alias("meta_keys"),
    )


@query
def merge_file_counts(spark, d):
    """Records before and after the length filter, and removed, as the write of the merged file counts them."""
    return spark.createDataFrame([tuple(_merged(spark, d)[1].values())], "before bigint, after bigint, removed bigint")


@query
def array_scan(spark, d):
    """One array file of all documents, read in ranges of 256 KB by as many tasks, numbered by position."""
    path = run_folder(spark, "array") + "/all.json"
    export.write_array(_open(spark, d), path, "at")
    rows = read_array(spark, path, 1 << 18)
    return rows.select("record_no", F.get_json_object("json", "$.file_index").cast("bigint").alias("file_index"), F.length(F.get_json_object("json", "$.paragraph")).cast("bigint").alias("n_chars"))


@query
def train_test_files(spark, d):
    """The pair of files of a split, written in order, read back with each record's place in its file."""
    folder = run_folder(spark, "split")
    rows = _open(spark, d).withColumn("record_no", F.col("at"))
    export.write_split(corpus.hash_split(rows), folder, order="at")
    part = lambda name: read_array(spark, f"{folder}/{name}.json").select(F.lit(name).alias("split"), "record_no", F.get_json_object("json", "$.file_index").cast("bigint").alias("file_index"), F.get_json_object("json", "$.meta.lang").alias("lang"))
    return part("train").unionByName(part("test"))


@query
def checked_records(spark, d):
    """Good records, and bad ones with their reasons, of one pass over JSON Lines, some of which are broken."""
    folder = run_folder(spark, "checked") + "/"
    bad = "case when at % 7 = 0 then left(json, length(json) - 1) when at % 11 = 0 then replace(json, '\"file_index\":', '\"file_index\":[1],\"was\":') when at % 13 = 0 then concat('{\"step_nodes\":[{\"type\":\"Activity\"}],', substring(json, 2)) else json end"
    _open(spark, d).select(F.expr(bad).alias("value")).write.text(folder)
    rows = records.read_checked(spark, folder)
    return rows.select(F.regexp_extract("json", r'"(?:file_index|was)":(\d+)', 1).cast("bigint").alias("at"), F.coalesce("error", F.lit("")).alias("error"), F.expr("coalesce(file_index, -1)").alias("file_index"), F.expr("coalesce(cast(length(paragraph) as bigint), -1)").alias("n_chars"))


@query
def clean_nested(spark, d):
    """Texts under the key in structs, lists and maps; those under other names stay."""
    rows = _paragraphs(spark, d).selectExpr(
        "record_no", "named_struct('title', paragraph, 'paragraph', paragraph) as one", "array(named_struct('paragraph', paragraph, 'n', record_no)) as many", "map('paragraph', paragraph, 'title', paragraph) as keyed", "named_struct('paragraph', record_no) as number"
    )
    return corpus.clean_nested(rows).selectExpr("record_no", "one.title", "one.paragraph", "many[0].paragraph as listed", "keyed['paragraph'] as mapped", "keyed['title'] as other", "number.paragraph as number")


@query
def exact_split(spark, d):
    """The seeded shuffle and cut of the corpus, with positions."""
    numbered = corpus.numbered(_table(spark, d, "documents").select("doc_id"), "doc_id")
    return corpus.exact_split(numbered).select("record_no", "position", "split")


@query
def clean_paragraph(spark, d):
    return corpus.clean(_paragraphs(spark, d))


@query
def filter_max_words(spark, d):
    return corpus.filter_max_words(corpus.clean(_paragraphs(spark, d)), count="n_words").select("record_no", F.col("n_words").cast("bigint").alias("n_words"))


@query
def token_stats(spark, d):
    return corpus.token_stats(_paragraphs(spark, d)).select("records", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std")), "min", "max")


@query
def token_histogram(spark, d):
    return corpus.token_histogram(_paragraphs(spark, d)).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "records")


@query
def token_chart(spark, d):
    """The histogram as a drawing, and its bars read off it again."""
    drawn = corpus.token_chart(_paragraphs(spark, d))
    bars = F.expr("regexp_extract_all(svg, r'<rect x=\"(\\d+)\" y=\"(\\d+)\" width=\"\\d+\" height=\"(\\d+)\"', 0)")
    number = lambda k: F.regexp_extract("bar", rf'{k}="(\d+)"', 1).cast("bigint")
    return drawn.select(F.explode(bars).alias("bar"), F.regexp_extract("svg", r">(Mean: \d+)<", 1).alias("mean"), F.regexp_extract("svg", r">(Median: \d+)<", 1).alias("median")).select(number(" x").alias("x"), number(" height").alias("height"), "mean", "median")


@query
def merge_counts(spark, d):
    """Records before and after the length filter, over three splits cut from the documents."""
    cleaned = corpus.clean(_paragraphs(spark, d)).withColumn("split", F.pmod("record_no", F.lit(3)))
    merged = None
    for n in range(3):
        part = cleaned.where(F.col("split") == n)
        merged = part if merged is None else merged.unionByName(part)
    kept = F.expr(f"{T.word_count('paragraph')} <= {corpus.MAX_WORDS}")
    return merged.agg(F.count("*").alias("before"), F.count_if(kept).alias("after"), F.count_if(~kept).alias("removed"))


@query
def train_test_split(spark, d):
    return corpus.hash_split(_paragraphs(spark, d).select("record_no")).select("record_no", "split")


# graphs


@query
def nodes(spark, d):
    return G.nodes(_nodes(spark, d)).select("record_no", "idx", "rid", "text", "type", "agent")


@query
def edges(spark, d):
    return G.edges(_graphs(spark, d)).select("record_no", "idx", "src", "tgt", "condition")


@query
def adjacency(spark, d):
    return G.adjacency(_graphs(spark, d)).select("record_no", "rid", _joined("outgoing"), _joined("incoming"))


@query
def start_nodes(spark, d):
    return G.nodes(_nodes(spark, d)).where("type = 'StartNode'").select("record_no", "rid")


@query
def dangling_edges(spark, d):
    return G.dangling_edges(G.graphs(records.with_faults(_records(spark, d)))).select("record_no", "src", "tgt", "has_src", "has_tgt")


@query
def gateway_degrees(spark, d):
    return G.nodes(_nodes(spark, d)).where("gateway_id is not null").select("record_no", "rid", F.col("in_degree").cast("bigint").alias("in_degree"), F.col("out_degree").cast("bigint").alias("out_degree"), F.expr(G.role("in_degree", "out_degree")).alias("role"))


@query
def gateway_ids(spark, d):
    return G.nodes(_nodes(spark, d)).where("gateway_id is not null").select("record_no", "rid", "gateway_id")


@query
def action_ids(spark, d):
    return G.nodes(_nodes(spark, d)).where("action_id is not null").select("record_no", "rid", "action_id")


@query
def schema_ids(spark, d):
    return G.nodes(_nodes(spark, d)).select("record_no", "rid", "schema_id")


# workflows


@query
def actors(spark, d):
    return _flows(spark, d).select("record_no", F.array_join("workflow.actors", ",").alias("actors"))


@query
def actions(spark, d):
    return workflow.actions(_flows(spark, d)).select("record_no", "ordinal", "id", "name", "actor", F.size("predecessors").cast("bigint").alias("n_predecessors"), F.size("successors").cast("bigint").alias("n_successors"), _joined("postconditions"))


@query
def action_predecessors(spark, d):
    return workflow.actions(_flows(spark, d)).select("record_no", "id", _joined("predecessors"))


@query
def action_successors(spark, d):
    return workflow.actions(_flows(spark, d)).select("record_no", "id", _joined("successors"))


@query
def gateways(spark, d):
    return workflow.gateways(_flows(spark, d)).select("record_no", "ordinal", "id", "type", "role", F.size("incoming_from").cast("bigint").alias("n_incoming"), F.size("branches").cast("bigint").alias("n_branches"), "actor")


@query
def gateway_branches(spark, d):
    return workflow.gateways(_flows(spark, d)).select("record_no", "id", F.posexplode("branches").alias("branch_no", "b")).select("record_no", "id", "branch_no", "b.next", "b.condition")


@query
def gateway_incoming(spark, d):
    return workflow.gateways(_flows(spark, d)).select("record_no", "id", _joined("incoming_from"))


@query
def gateway_type_counts(spark, d):
    return workflow.gateways(_flows(spark, d)).groupBy("record_no", "type").agg(F.count("*").alias("n"))


# paths


@query
def matching_joins(spark, d):
    return paths.matching_joins(_nodes(spark, d))


@query
def execution_paths(spark, d):
    return paths.execution_paths(_nodes(spark, d)).select("record_no", _joined("path", ">"))


@query
def execution_states(spark, d):
    return paths.record_states(_nodes(spark, d)).select("record_no", _joined("completed", ">"), _joined("available"), "can_terminate")


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return G.graphs(records.wide_records(_table(spark, d, "part")), with_edges=False)


@query
def wide_action_ids(spark, d):
    """Ids where texts collide and an id of a node comes twice."""
    return G.nodes(_wide(spark, d)).where("action_id is not null").select("record_no", "idx", "rid", "action_id")


@query
def wide_matching_joins(spark, d):
    return paths.matching_joins(_wide(spark, d))


@query
def wide_paths(spark, d):
    """All paths in order, where blocks have more ways than the cap of other queries allows."""
    return paths.execution_paths(_wide(spark, d), cap=None).select("record_no", "path_no", _joined("path", ">"))


@query
def wide_states(spark, d):
    """States where there are more paths than the cap allows."""
    return paths.record_states(_wide(spark, d)).select("record_no", _joined("completed", ">"), _joined("available"), "can_terminate")


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return G.graphs(records.nested_records(_table(spark, d, "supplier")), with_edges=False)


@query
def nested_matching_joins(spark, d):
    return paths.matching_joins(_nested(spark, d))


@query
def nested_paths(spark, d):
    """Paths in order, where blocks stand in blocks, and inner ones end before, with or beyond the outer one."""
    return paths.execution_paths(_nested(spark, d)).select("record_no", "path_no", _joined("path", ">"))


@query
def nested_states(spark, d):
    return paths.record_states(_nested(spark, d)).select("record_no", _joined("completed", ">"), _joined("available"), "can_terminate")


@query
def workflow_summary(spark, d):
    return _whole(_records(spark, d)).select("record_no", *(F.size(f"workflow.{c}").cast("bigint").alias(f"n_{c}") for c in ("actors", "actions", "gateways", "execution_states")))


@query
def extract_summary(spark, d):
    """Counts of the first 20 records."""
    first = _records(spark, d).orderBy("record_no").limit(20)
    return workflow.workflows(G.graphs(first)).select("record_no", *(F.size(f"workflow.{c}").cast("bigint").alias(f"n_{c}") for c in ("actors", "actions", "gateways")))


@query
def workflow_json(spark, d):
    return export.workflow_json(_whole(_records(spark, d)))


@query
def read_workflows(spark, d):
    """Workflows written as JSON, one to a line, read back with the declared schema, and counted."""
    folder = run_folder(spark, "workflows") + "/"
    export.workflow_json(_whole(_records(spark, d))).select("json").write.text(folder)
    flows = records.read_workflows(spark, folder)
    count = lambda x: F.expr(f"cast(size({x}) as bigint)")
    ways = "flatten(transform(workflow.gateways, g -> g.branches))"
    return flows.select(
        "file_index",
        *(count(f"workflow.{c}").alias(f"n_{c}") for c in ("actors", "actions", "gateways", "execution_states")),
        count(f"filter({ways}, b -> b.condition is not null)").alias("n_conditions"),
        count(f"filter({ways}, b -> b.next is null)").alias("n_ends"),
        count("filter(workflow.actions, a -> a.actor is not null)").alias("n_acted"),
        count("filter(workflow.execution_states, s -> s.can_terminate)").alias("n_terminal"),
    )


@query
def workflow_values(spark, d):
    """All values of workflows written as JSON and read back, a row for each text, list of actors, action, gateway and state."""
    folder = run_folder(spark, "workflows") + "/"
    export.workflow_json(_whole(_records(spark, d))).select("json").write.text(folder)
    flows = records.read_workflows(spark, folder)
    # read once: each workflow becomes an array of its rows
    text = lambda *xs: "concat_ws('|', " + ", ".join(xs) + ")"
    row = lambda part, at, value: f"named_struct('part', '{part}', 'ordinal', cast({at} as bigint), 'value', {value})"
    parts = (
        f"array({row('text', 0, 'procedure_text')}, {row('actors', 0, 'array_join(workflow.actors, {0})'.format(repr(',')))})",
        "transform(workflow.actions, (a, i) -> " + row("action", "i", text("a.id", "a.name", "coalesce(a.actor, '-')", "array_join(a.predecessors, ',')", "array_join(a.successors, ',')", "array_join(a.postconditions, ',')")) + ")",
        "transform(workflow.gateways, (g, i) -> " + row("gateway", "i", text("g.id", "g.type", "g.role", "array_join(g.incoming_from, ',')", "array_join(transform(g.branches, b -> concat(coalesce(b.next, '-'), ':', coalesce(b.condition, '-'))), ',')", "coalesce(g.actor, '-')")) + ")",
        "transform(workflow.execution_states, s -> " + row("state", -1, text("array_join(s.completed_actions, '>')", "array_join(s.available_next, ',')", "cast(coalesce(s.can_terminate, false) as string)")) + ")",
    )
    return flows.select("file_index", F.expr(f"inline(concat({', '.join(parts)}))"))


# validation


@query
def validation_from_files(spark, d):
    """The measures' averages, of raw records and of extracted workflows that are read from files."""
    raw = _records(spark, d)
    one, two = run_folder(spark, "raw") + "/", run_folder(spark, "extracted") + "/"
    records.write_records(raw, one)
    export.workflow_json(workflow.workflows(G.graphs(records.with_faults(raw)))).select("json").write.text(two)
    return validate.averages(validate.validate_files(spark, one, two)).select("records", *(F.round(k, 6).alias(k) for k in validate.AVERAGES))


@query
def validation_join(spark, d):
    raw = _records(spark, d)
    return validate.joined(G.graphs(raw), workflow.workflows(G.graphs(records.with_strays(records.with_faults(raw))))).select("file_index", F.size("g").cast("bigint").alias("n_nodes"), F.size("workflow.actions").cast("bigint").alias("n_actions"))


@query
def validation_unmatched(spark, d):
    raw = _records(spark, d)
    return validate.unmatched(raw, records.with_strays(records.with_faults(raw)))


def _prf(*measures: str):
    def run(spark, d):
        parts = ", ".join(f"named_struct('measure', '{k}', 'precision', round(m.{k}.precision, 6), 'recall', round(m.{k}.recall, 6), 'f1', round(m.{k}.f1, 6), 'gt_count', m.{k}.gt_count, 'ext_count', m.{k}.ext_count)" for k in measures)
        return _measured(spark, d).select("record_no", F.expr(f"inline(array({parts}))"))

    return run


QUERIES["action_prf"] = _prf("actions")
QUERIES["edge_prf"] = _prf("action_successors", "action_predecessors")
QUERIES["gateway_edge_prf"] = _prf("gateway_branches_next", "gateway_incoming")
QUERIES["branch_tuple_prf"] = _prf("branch_tuples")


@query
def gateway_type_accuracy(spark, d):
    return _measured(spark, d).select("record_no", "m.gateways.count_match", "m.gateways.gt_count", "m.gateways.ext_count", F.round("m.gateways.type_accuracy", 6).alias("type_accuracy"))


@query
def gateway_role_accuracy(spark, d):
    return _measured(spark, d).select("record_no", F.round("m.gateways.role_accuracy", 6).alias("role_accuracy"))


@query
def branch_count_accuracy(spark, d):
    return _measured(spark, d).select("record_no", F.round("m.branch_counts.accuracy", 6).alias("accuracy"), "m.branch_counts.total_compared")


@query
def validation_metrics(spark, d):
    return _measured(spark, d).select("record_no", *(F.round(F.expr(v), 6).alias(k) for k, v in validate.AVERAGES.items()))


@query
def validation_averages(spark, d):
    return validate.averages(_measured(spark, d)).select("records", *(F.round(k, 6).alias(k) for k in validate.AVERAGES))


@query
def validation_diagnostics(spark, d):
    return validate.diagnostics(_measured(spark, d))


@query
def validation_report(spark, d):
    return validate.report(_measured(spark, d))
