"""Sources, sinks, splits, statistics and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus
from weftline.sources import records
from weftline.streaming.records import stream_workflows, write_stream


def paragraphs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "record_no long, paragraph string")


def test_exact_split_is_pythons_shuffle(spark):
    rows = corpus.exact_split(paragraphs(spark, ["x"] * 12)).orderBy("position").collect()
    order = list(range(12))
    random.Random(42).shuffle(order)
    assert [r.record_no for r in rows] == order and [r.split for r in rows] == ["train"] * 9 + ["test"] * 3
    ten = corpus.exact_split(paragraphs(spark, ["x"] * 10)).orderBy("position").collect()
    assert [r.record_no for r in ten] == [7, 3, 2, 8, 5, 6, 9, 4, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 12, 500])
def test_hash_split_sizes(spark, n):
    rows = corpus.hash_split(paragraphs(spark, ["x"] * n)).groupBy("split").count().collect()
    found = {r.split: r["count"] for r in rows}
    assert found.get("train", 0) == int(n * 0.8) and sum(found.values()) == n


def test_statistics(spark):
    rows = paragraphs(spark, ["a b", "a", "a b c", "a b c d"])
    s = corpus.token_stats(rows).first()
    assert (s.records, s["mean"], s["median"], s.min, s.max) == (4, 2.5, 2.5, 1, 4) and s.std == pytest.approx(1.118033988749895)
    h = corpus.token_histogram(rows).orderBy("bin").collect()
    assert len(h) == 50 and [x.bin for x in h if x.records] == [1, 17, 34, 50]
    one = corpus.token_histogram(paragraphs(spark, ["a b", "c d"])).orderBy("bin").collect()
    assert [(x.bin, x.records) for x in one if x.records] == [(26, 2)] and (one[0].low, one[-1].high) == (1.5, 2.5)
    assert corpus.token_histogram(paragraphs(spark, [])).count() == 0


def test_chart(spark):
    from xml.etree import ElementTree

    rows = paragraphs(spark, ["a b", "a", "a b c", "a b c d"] * 3 + ["a"])
    (drawn,) = corpus.token_chart(rows).collect()
    parts = list(ElementTree.fromstring(drawn.svg))
    bars = [p for p in parts if p.tag.endswith("rect")]
    assert [(int(b.get("x")), int(b.get("height"))) for b in bars] == [(60, 400), (284, 300), (522, 300), (746, 300)] and all(int(b.get("y")) + int(b.get("height")) == 440 for b in bars)
    texts = [p.text for p in parts if p.tag.endswith("text")]
    assert {"Token distribution per procedure", "Token count (words)", "Frequency", "Mean: 2", "Median: 2", "1", "4"} <= set(texts)
    one = corpus.token_chart(paragraphs(spark, ["a b"])).first().svg
    assert one.count("<rect") == 1 and not corpus.token_chart(paragraphs(spark, [])).count()


def test_one_pass_for_statistics(spark, tmp_path):
    """Texts are scanned and split once, whatever is asked of them."""
    paragraphs(spark, ["a b", "c"]).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for made in (corpus.token_stats(rows), corpus.token_histogram(rows)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_length_filter_is_inclusive(spark):
    rows = paragraphs(spark, ["w " * 500, "w " * 501, "", None])
    assert [r.record_no for r in corpus.filter_max_words(rows).orderBy("record_no").collect()] in ([0, 2], [0, 2, 3])


RAW = [{"file_index": i, "paragraph": f"text {i} é", "step_nodes": [{"resourceId": "s", "NodeText": "", "type": "StartNode", "agent": ""}, {"resourceId": "1", "NodeText": "Go", "type": "Activity", "agent": "A"}], "SequenceFlow": [{"src": "s", "tgt": "1", "condition": ""}]} for i in range(5)]


def test_json_sources_and_merge(spark, tmp_path):
    paths = []
    for k, name in enumerate(records.SPLITS):
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps([r | {"file_index": r["file_index"] + 10 * k} for r in RAW], indent=2))
        paths.append(str(p))
    merged = records.merge_splits([records.read_records(spark, p) for p in paths])
    rows = merged.orderBy("record_no").collect()
    assert [r.record_no for r in rows] == list(range(15)) and [r.file_index for r in rows] == [i + 10 * k for k in range(3) for i in range(5)]
    out = str(tmp_path / "out") + "/"
    records.write_records(merged, out)
    back = records.read_records(spark, out)
    assert back.count() == 15 and sorted(r.paragraph for r in back.select("paragraph").collect()) == sorted(r.paragraph for r in rows)


def test_bad_records_fail(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('[{"file_index": "x", "step_nodes": 3}]')
    with pytest.raises(Exception):
        records.read_records(spark, str(p)).collect()


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(map(json.dumps, RAW)))
    rows = stream_workflows(spark, str(folder))
    write_stream(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(F.size("workflow.actions")).collect() == [(1,)] * 5
    (folder / "b.json").write_text(json.dumps(RAW[0] | {"file_index": 77}))
    write_stream(stream_workflows(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_files_of_one_array_are_pythons(spark, tmp_path):
    """As json.dump() writes them, with and without indentation and escapes; and they read back."""
    import json

    from weftline.sources import export, records

    node = {"resourceId": "r", "NodeText": "é\n\"x\"", "type": "XOR", "agent": None}
    flow = {"src": "r", "tgt": "s", "condition": ""}
    rows = [{"file_index": i, "paragraph": f"p\t{i} 日\n[", "step_nodes": [node] * (i % 3), "SequenceFlow": [flow] if i else None} for i in range(2500)]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], records.RECORD).repartition(3)
    for ascii_only, indent in ((True, 2), (False, 2), (False, None)):
        path = f"{tmp_path}/{ascii_only}{indent}.json"
        export.write_array(export.row_json(df, ascii_only=ascii_only, indent=indent), path, indent=indent)
        assert open(path, encoding="utf-8").read() == json.dumps(rows, ensure_ascii=ascii_only, indent=indent)
        back = records.read_records(spark, path).orderBy("record_no").collect()
        assert [r.asDict(True) | {"record_no": None} for r in back[:5]] == [r | {"record_no": None} for r in rows[:5]] and len(back) == len(rows)
    path = f"{tmp_path}/none.json"
    export.write_array(export.row_json(df.limit(0)), path)
    assert json.load(open(path)) == []


def test_cleaning_at_any_depth(spark):
    kind = "id int, paragraph string, a struct<paragraph: string, b: array<struct<paragraph: string, c: map<string, array<struct<paragraph: string, d: string>>>>>>, m map<string, string>, n struct<paragraph: array<string>>"
    text = "x <SEP> y\n  z"
    rows = spark.createDataFrame([(1, text, (text, [(text, {"paragraph": [(text, text)], "k": [(text, text)]})]), {"paragraph": text, "q": text}, ([text],)), (2, None, None, None, None)], kind)
    from weftline.operators import corpus

    got = {r.id: r.asDict(True) for r in corpus.clean_nested(rows).collect()}
    clean = "x y z"
    assert got[1] == {"id": 1, "paragraph": clean, "a": {"paragraph": clean, "b": [{"paragraph": clean, "c": {"paragraph": [{"paragraph": text, "d": text}], "k": [{"paragraph": clean, "d": text}]}}]}, "m": {"paragraph": clean, "q": text}, "n": {"paragraph": [text]}}
    assert got[2] == {"id": 2, "paragraph": None, "a": None, "m": None, "n": None}
    assert corpus.clean_nested(rows).schema.simpleString() == rows.schema.simpleString()
