"""Records from JSON lines: each line in exactly one output."""

import gzip

from folioscope.sources.json_records import read_records

LINES = {
    '{"_id":"doc|1","type":"document","title":"One","metaTags":{"a":"b"},"fetchedAt":"2024-05-01T10:00:00Z","colour":{"x":[1]}}': None,
    '{"type":"document","_id":"doc|2","categories":[{"name":"News","confidence":0.5,"classifier":"c","more":1}],"notes":["n"],"sizeBytes":9}': None,
    '{"_id":"category|a","type":"category","name":"A","documentCount":3}': None,
    '{"_id":"category|b","type":"category","name":"B","colour":"red"}': "unknown field",
    '{"_id":"doc|3","type":"document","title":': "broken",
    '{"_id":"doc|4","type":"document","sizeBytes":"many"}': "broken",
    '{"_id":"doc|5","type":"document","fetchedAt":"yesterday"}': "broken",
    '[{"_id":"doc|6","type":"document"}]': "broken",
    "not json": "broken",
    "42": "broken",
    "": "empty",
    " \t": "empty",
    '{"_id":"x","type":"attachment"}': "type",
    '{"_id":"x","type":null}': "type",
    "{}": "type",
    '{"type":"document","title":"no id"}': "id",
    '{"_id":null,"type":"category","colour":1}': "id",
    '{"_id":"doc|l","type":"document","title":"' + "ü" * 100_000 + '"}': None,
}


def write(path, lines):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("".join(line + "\n" for line in lines))
    return str(path)


def test_each_line_once(spark, tmp_path):
    records = read_records(spark, write(tmp_path / "in.json.gz", [*LINES, *LINES]))
    rejects = sorted((r["line"], r["reason"]) for r in records.rejects.collect())
    assert rejects == sorted(2 * [(line, reason) for line, reason in LINES.items() if reason])
    docs = {r["_id"]: r for r in records.documents.collect()}
    assert sorted(docs) == ["doc|1", "doc|2", "doc|l"] and records.documents.count() == 6
    assert docs["doc|1"]["meta_tags"] == {"a": "b"} and docs["doc|1"]["fetched_at"] is not None
    assert docs["doc|2"]["categories"][0].asDict() == {"name": "News", "confidence": 0.5, "classifier": "c"}
    assert (docs["doc|2"]["notes"], docs["doc|2"]["size_bytes"], docs["doc|2"]["title"]) == (["n"], 9, None)
    assert len(docs["doc|l"]["title"]) == 100_000
    assert [(r["name"], r["document_count"]) for r in records.categories.collect()] == [("A", 3)] * 2


def test_empty_file_and_pruning(spark, tmp_path):
    records = read_records(spark, write(tmp_path / "none.json.gz", []))
    assert records.documents.count() == records.categories.count() == records.rejects.count() == 0
    plan = read_records(spark, write(tmp_path / "in.json.gz", LINES)).documents.select("title")._jdf.queryExecution().executedPlan().toString()
    assert " = document)]" in plan and "PushedFilters: []" in plan and "ReadSchema: struct<document:struct<title:string>>" in plan
