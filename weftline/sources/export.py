"""Records and workflows as JSON text with exactly the keys that the formats have, and files of one JSON array."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.arrays import write_array
from weftline.sources.batches import in_pieces

__all__ = ["document", "open_json", "row_json", "workflow_json", "write_array", "write_split"]


def _list(x) -> list:
    return [] if x is None else [str(y) for y in x]


def document(file_index, procedure_text, workflow) -> dict:
    """actor and next are always there and may be null; a gateway's actor, a condition and can_terminate only if set."""
    out = {"file_index": None if pd.isna(file_index) else int(file_index), "procedure_text": procedure_text, "workflow": {"actors": _list(workflow["actors"]), "actions": [], "gateways": []}}
    for a in workflow["actions"]:
        out["workflow"]["actions"].append({"id": a["id"], "name": a["name"], "actor": a["actor"], "predecessors": _list(a["predecessors"]), "successors": _list(a["successors"]), "postconditions": _list(a["postconditions"])})
    for g in workflow["gateways"]:
        ways = [{"next": b["next"]} | ({"condition": b["condition"]} if b["condition"] is not None else {}) for b in g["branches"]]
        out["workflow"]["gateways"].append({"id": g["id"], "type": g["type"], "role": g["role"], "incoming_from": _list(g["incoming_from"]), "branches": ways} | ({"actor": g["actor"]} if g["actor"] is not None else {}))
    if "execution_states" in workflow:
        out["workflow"]["execution_states"] = [
            {"completed_actions": _list(s["completed_actions"]), "available_next": _list(s["available_next"])} | ({"can_terminate": True} if s["can_terminate"] else {}) for s in workflow["execution_states"]
        ]
    return out


def _plain(x):
    """Rows, arrays and numbers of a column as JSON knows them."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def row_json(rows: DataFrame, order: str = "record_no", ascii_only: bool = False, indent: int | None = None) -> DataFrame:
    """(order, json): all other columns of each row as one JSON object, nulls written as null."""
    columns = [c for c in rows.columns if c != order]

    def run(batches):
        for batch in in_pieces(batches):
            texts = [json.dumps(_plain(x), ensure_ascii=ascii_only, indent=indent) for x in batch.select(columns).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(order), pa.array(texts, pa.string())], [order, "json"])

    kind = rows.schema[order].dataType.simpleString()
    return rows.mapInArrow(run, f"`{order}` {kind}, json string")


def open_json(records: DataFrame, ascii_only: bool = False, indent: int | None = None) -> DataFrame:
    """(record_no, json): open records as text, their keys in alphabetical order."""
    rows = records.select("record_no", F.to_json("record").alias("json"))
    if not (ascii_only or indent):
        return rows

    def run(batches):
        for batch in in_pieces(batches):
            laid_out = [json.dumps(json.loads(x), ensure_ascii=ascii_only, indent=indent) for x in batch.column("json").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("record_no"), pa.array(laid_out, pa.string())], ["record_no", "json"])

    return rows.mapInArrow(run, rows.schema)


def write_split(texts: DataFrame, folder: str, order: str = "position", indent: int | None = 2) -> dict[str, int]:
    """train.json and test.json of the rows' texts, by their column split and in order; returns how many each has."""
    rows = texts.select(order, "split", "json")
    return {name: write_array(rows.where(F.col("split") == name), f"{folder}/{name}.json", order, indent) for name in ("train", "test")}


def workflow_json(workflows: DataFrame, ascii_only: bool = False, indent: int | None = None) -> DataFrame:
    """(record_no, json): one JSON text per workflow."""
    kind = workflows.schema["record_no"].dataType.simpleString()

    def run(batches):
        for b in in_pieces(batches):
            rows = zip(*(b.column(c).to_pylist() for c in ("file_index", "procedure_text", "workflow")), strict=True)
            texts = [json.dumps(document(*row), ensure_ascii=ascii_only, indent=indent) for row in rows]
            yield pa.RecordBatch.from_arrays([b.column("record_no"), pa.array(texts, pa.string())], ["record_no", "json"])

    return workflows.select("record_no", "file_index", "procedure_text", "workflow").mapInArrow(run, f"record_no {kind}, json string")
