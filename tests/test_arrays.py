"""Array files in ranges, their writer, and records of unknown keys."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import corpus
from weftline.sources import arrays, export, files, records


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.45:
        return "".join(rng.choices(["a", '"', "\\", "[", "]", "{", "}", ",", ":", " ", "  ", "\n", "\t", "é", "<SEP>", " <SEP> ", "\\n", "paragraph", '"paragraph":"', "\x01"], k=rng.randrange(9)))
    if kind < 0.55:
        return rng.choice([1, 2.5, None, True])
    if kind < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["paragraph", "x", 'y"paragraph', "p\\", "z"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(40))
def test_ranges_of_any_size(tmp_path, monkeypatch, seed):
    """Strings full of brackets, quotes and backslashes: each element is found once, whole and with its number."""
    rng = random.Random(seed)
    for k in range(12):
        data = [value(rng) for _ in range(rng.randrange(7))]
        text = rng.choice(["", " \n"]) + json.dumps(data, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n "])
        path = str(tmp_path / f"{k}.json")
        files.write(path, text.encode())
        size, step = len(text.encode()), rng.choice([1, 2, 3, 7, 20, 1000])
        monkeypatch.setattr(arrays, "PIECE", rng.choice([1, 2, 5, 1 << 20]))
        bounds = [(b, min(b + step, size)) for b in range(0, size, step)]
        found = []
        for (begin, end), (inside, depth, first) in zip(bounds, arrays.compose([arrays.scan_range(path, *b) for b in bounds]), strict=True):
            found += [(first + i, json.loads(x)) for i, x in enumerate(filter(None, arrays.elements(path, begin, end, inside, depth)))]
        assert found == list(enumerate(data))


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(5)
    data = [{"file_index": i, "paragraph": value(rng, 9) * 5, "more": value(rng)} for i in range(3000)]
    path = str(tmp_path / "a.json")
    files.write(path, json.dumps(data, indent=2, ensure_ascii=False).encode())
    rows = arrays.read_array(spark, path, 10_000)
    got = rows.withColumn("task", F.spark_partition_id()).orderBy("record_no").collect()
    assert [r.record_no for r in got] == list(range(3000)) and [json.loads(r.json) for r in got] == data
    assert len({r.task for r in got}) > 20
    one = arrays.read_array(spark, path, 1 << 30)
    assert one.rdd.getNumPartitions() == 1 and one.orderBy("record_no").collect() == rows.orderBy("record_no").collect()


@pytest.mark.parametrize("text", ['{"a": 1}', "", '[{"a": 1}', '[1, "x', '[1, 2]]'])
def test_no_array(spark, tmp_path, text):
    path = str(tmp_path / "a.json")
    files.write(path, text.encode())
    with pytest.raises(ValueError):
        arrays.read_array(spark, path, 3)


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select("id", F.expr("if(id = 99, raise_error('lost'), 'x')").alias("json"))
    with pytest.raises(Exception, match="lost"):
        export.write_array(rows, str(tmp_path / "a.json"), None)
    assert not list(tmp_path.iterdir())
    assert export.write_array(rows.where("id < 5"), str(tmp_path / "a.json"), "id", None) == 5 and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    with pytest.raises(FileExistsError):
        export.write_array(rows.where("id < 5"), str(tmp_path / "a.json"), "id")


def cleaned(x):
    if isinstance(x, list):
        return [cleaned(y) for y in x]
    own = lambda v: re.sub(" {2,}", " ", v.replace(" <SEP> ", " ").replace("<SEP>", " ").replace("\n", " ")) if isinstance(v, str) else v
    return {k: own(v) if k == "paragraph" else cleaned(v) for k, v in x.items()} if isinstance(x, dict) else x


def test_open_records_are_cleaned_at_any_depth(spark):
    """Strings under the key, not under others; lists and objects under the key stay whole. No key is lost."""
    rng = random.Random(1)
    data = [{"paragraph": value(rng), "k": value(rng)} if i % 2 else value(rng) for i in range(1500)]
    rows = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=i % 3 == 0)) for i, x in enumerate(data)], "record_no long, j string").select("record_no", F.parse_json("j").alias("record"))
    clean = corpus.clean_open(rows)
    got = {r.record_no: json.loads(r.json) for r in export.open_json(clean).collect()}
    assert all(got[i] == cleaned(x) for i, x in enumerate(data))
    assert "Python" not in clean._jdf.queryExecution().executedPlan().toString()
    for key in ("x", 'y"paragraph', "p\\"):
        one = spark.createDataFrame([(json.dumps({key: "a <SEP> b", "z": {key: "c\n"}}),)], "j string").select(F.expr(T.clean_json("to_json(parse_json(j))", key)).alias("j"))
        assert json.loads(one.first().j) == {key: "a b", "z": {key: "c "}}


def test_merged_files_keep_all_keys(spark, tmp_path):
    rng = random.Random(2)
    data = [{"file_index": i, "paragraph": ("w " * rng.choice([3, 500, 501])).strip() + " <SEP> x\n", "note": value(rng), "step_nodes": [{"resourceId": "s", "position": [1, 2]}]} for i in range(60)]
    paths = []
    for k in range(3):
        paths.append(str(tmp_path / f"{k}.json"))
        files.write(paths[-1], json.dumps(data[20 * k : 20 * k + 20], indent=2).encode())
    counts = corpus.merge_files(spark, paths, str(tmp_path / "out.json"))
    want = [x for x in cleaned(data) if len(x["paragraph"].split()) <= 500]
    assert counts == {"before": 60, "after": len(want), "removed": 60 - len(want)}
    text = (tmp_path / "out.json").read_text()
    assert json.loads(text) == want and text == json.dumps([json.loads(json.dumps(x, sort_keys=True)) for x in want], indent=2)
    typed = records.with_columns(records.read_open(spark, str(tmp_path / "out.json"))).orderBy("record_no").collect()
    assert [r.paragraph for r in typed] == [x["paragraph"] for x in want] and typed[0].step_nodes[0].resourceId == "s"


def test_split_files_are_pythons(spark, tmp_path):
    """The seeded shuffle and cut, written as json.dump() writes both parts."""
    data = [{"file_index": i, "paragraph": f"é {i}"} for i in range(57)]
    rows = spark.createDataFrame([(i, json.dumps(x, indent=2, ensure_ascii=False)) for i, x in enumerate(data)], "record_no long, json string")
    assert export.write_split(corpus.exact_split(rows), str(tmp_path)) == {"train": 45, "test": 12}
    shuffled = list(data)
    random.Random(42).shuffle(shuffled)
    for name, part in (("train", shuffled[:45]), ("test", shuffled[45:])):
        assert (tmp_path / f"{name}.json").read_text(encoding="utf-8") == json.dumps(part, indent=2, ensure_ascii=False)


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = corpus.numbered(rows, "k").collect()
    assert sorted((r.k, r.record_no) for r in got) == [(i, i) for i in range(5000)]
    assert corpus.numbered(rows.limit(0), "k").count() == 0


def test_bad_records_stand_aside(spark, tmp_path):
    good = {"file_index": 1, "paragraph": "p", "step_nodes": [{"resourceId": "s", "NodeText": "Go", "type": "Activity", "agent": ""}], "SequenceFlow": []}
    lines = [json.dumps(good), "{", json.dumps(good | {"file_index": "x"}), json.dumps(good | {"step_nodes": [{"type": "Activity", "NodeText": " "}]}), "[1, 2]", "", json.dumps({"other": 1})]
    files.write(str(tmp_path / "a.jsonl"), "\n".join(lines).encode())
    rows = records.read_checked(spark, str(tmp_path / "a.jsonl")).orderBy("record_no").collect()
    assert [r.error for r in rows] == [None, records.NO_JSON, records.NO_FIT, records.NO_TEXT, records.NO_FIT, None]
    assert [r.file_index for r in rows] == [1, None, None, None, None, None] and [r.json for r in rows] == [x for x in lines if x]
