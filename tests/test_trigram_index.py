"""The index against the scan, and what its plans read."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search as S
from folioscope.operators import trigram_index as TI
from folioscope.operators.trigram_index import TrigramIndex
from folioscope.session import shared_path

QUERIES = ["abc", "ABC", "a%c", "a_c", "%", "_", "é", "Éab", "é😀b", "zzzz", "ab", "", "b c", "abcabcab", "http://x.org/1", "İ", "ß"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcABCé😀%_ ßİ") for _ in range(rnd.randint(0, n)))
    data = [(f"d{i:04}", word(60), rnd.choice([None, "", word(30)]), rnd.choice([None, f"http://x.org/{i}"])) for i in range(400)]
    return spark.createDataFrame(data + [("long", "x" * 5000 + "abcabcab", None, None)], "_id string, title string, description string, url string")


@pytest.fixture(scope="module")
def index(spark, docs):
    return TrigramIndex.build(docs.repartition(4), shared_path(spark, "test-trigram-" + uuid.uuid4().hex[:8]))


@pytest.mark.parametrize("q", QUERIES)
def test_equal_to_the_scan(docs, index, q):
    want = sorted(r["_id"] for r in S.search(docs, q).collect())
    assert sorted(r["_id"] for r in index.search(q).collect()) == want


def test_a_table_of_queries(spark, docs, index):
    table = spark.createDataFrame([(q,) for q in QUERIES + ["abc", None]], "q string")
    want = sorted((q, r["_id"]) for q in QUERIES for r in S.search(docs, q).collect())
    assert sorted(tuple(r) for r in index.search_all(table).collect()) == want


def test_plans_push_the_filters_down(index):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "In(_id" in plan(index.search("http://x.org/1")) or "EqualTo(_id" in plan(index.search("http://x.org/1"))
    found = index.candidates("http://x.org/1")
    assert "In(gram" in plan(found)
    assert found.count() < 200  # rare grams only


def test_empty_table(spark, docs):
    index = TrigramIndex.build(docs.where("1 = 0"), shared_path(spark, "test-trigram-" + uuid.uuid4().hex[:8]))
    assert index.search("abc").collect() == [] and index.search("a").collect() == []
    assert index.search_all(spark.createDataFrame([("abc",), ("a",)], "q string")).collect() == []


def test_documents_and_queries_have_the_same_grams(spark):
    texts = ["", "ab", "abc", "aaaaa", "é😀b é😀b", "\u0000\u0000\u0000x", "abcabcab" * 40]
    of_query = {r["t"]: sorted(r["g"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", TI.grams(F.col("t")).alias("g")).collect()}
    assert of_query == {t: TI.gram_codes(t.encode()).tolist() for t in texts}


def test_bytes_that_are_no_utf8_hide_no_match(spark):
    docs = spark.sql("SELECT 'd' AS _id, concat(CAST(X'61C3' AS STRING), 'bcd', CAST(X'FF' AS STRING)) AS title, "
                     "CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS url")
    index = TrigramIndex.build(docs, shared_path(spark, "test-trigram-" + uuid.uuid4().hex[:8]))
    assert [r["_id"] for r in index.search("bcd").collect()] == ["d"]


def test_postings_are_sorted_segments_and_not_shuffled(spark, docs, tmp_path, monkeypatch):
    docs.repartition(2).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(TI, "SEGMENT_BYTES", 1000)
    monkeypatch.setattr(TI, "OUT_ROWS", 50)
    index = TrigramIndex.build(spark.read.parquet(f"{tmp_path}/docs"), shared_path(spark, "test-trigram-" + uuid.uuid4().hex[:8]))
    rows = index._read("postings").select(F.input_file_name().alias("f"), "gram", "_id", "field").collect()
    by_file: dict = {}
    for r in rows:
        by_file.setdefault(r["f"], []).append(r["gram"])
    assert len(by_file) > spark.sparkContext.defaultParallelism and all(g == sorted(g) for g in by_file.values())
    assert len(rows) == len({(r["gram"], r["_id"], r["field"]) for r in rows})
    found = index.search_all(spark.createDataFrame([("abc",), ("é😀b",)], "q string"))
    want = sorted((q, r["_id"]) for q in ("abc", "é😀b") for r in S.search(docs, q).collect())
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [gram" in plan and "SortMergeJoin [gram" not in plan
