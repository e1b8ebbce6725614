"""Behaviour of the scale-related helpers."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import assign, notes, store, tfidf
from folioscope.session import shared_path
from folioscope.sources.tables import read_table

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_active_session_keeps_its_settings(spark):
    from folioscope.session import build_session
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        assert build_session(shuffle_partitions=8) is spark
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_cluster_without_shared_folder_is_an_error(spark):
    from folioscope.session import shared_folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_scans_are_dealt_only_on_request(spark):
    key = "folioscope.scanPartitions"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        assert "Repartition" not in _plan(read_table(spark, SF_SMALL, "documents", ["doc_id"]))
    finally:
        spark.conf.set(key, before)
    assert read_table(spark, SF_SMALL, "documents", ["doc_id"]).rdd.getNumPartitions() == int(before)


def test_fit_transform_equals_train_then_vectorise(spark):
    docs = spark.createDataFrame([
        ("d1", "a", True, "spark spark data cluster"), ("d2", "a", True, "spark data stream"),
        ("d3", "b", True, "data garden garden soil"), ("d4", "b", True, "garden soil stream"),
        ("q1", None, False, "spark stream garden")], "doc_id string, category string, trainable boolean, text string")
    m1, v1 = tfidf.fit_transform(docs)
    m2 = tfidf.train(docs.where("trainable").select("doc_id", "category", "text"))
    v2 = tfidf.document_vectors(docs.select("doc_id", "text"), m2.vocab)
    r = lambda df, cols: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.select(*cols).collect())
    assert r(m1.vocab, ["term", "df", "idx", "idf"]) == r(m2.vocab, ["term", "df", "idx", "idf"])
    assert r(m1.class_vectors, ["category", "term", "weight"]) == r(m2.class_vectors, ["category", "term", "weight"])
    assert r(v1, ["doc_id", "term", "weight"]) == r(v2, ["doc_id", "term", "weight"])
    assert m1.n_docs.first()["n_docs"] == 4


def test_document_count_includes_token_less_documents(spark):
    docs = spark.createDataFrame([("d1", "a", "spark data"), ("d2", "a", "?!"), ("d3", "b", "spark data")],
                                 "doc_id string, category string, text string")
    m = tfidf.train(docs)
    assert m.n_docs.first()["n_docs"] == 3
    idf = {r["term"]: r["idf"] for r in m.vocab.collect()}
    assert abs(idf["spark"] - __import__("math").log(3 / 2)) < 1e-12


def test_upsert_loses_no_change(spark):
    schema = "_id string, _rev int, title string, seq int"
    base = spark.createDataFrame([("a", 5, "a5"), ("b", 1, "b1")], "_id string, _rev int, title string")
    changes = spark.range(5000).select(F.lit("a").alias("_id"), F.lit(5).alias("_rev"),
                                       F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.col("id").cast("int").alias("seq"))
    changes = changes.unionByName(spark.createDataFrame(
        [("a", 4, "old", 0), ("n", None, "n1", 1), ("n", None, "n2", 0), ("m", 3, "m3", 0), ("b", None, "b?", 0),
         ("c", None, "same", 0), ("c", None, "same", 0)], schema))
    out, conflicts = store.upsert(base, changes, order=("seq",))
    got = {r["_id"]: (r["_rev"], r["title"]) for r in out.collect()}
    assert got == {"a": (6, "t0"), "b": (1, "b1"), "n": (1, "n2"), "c": (1, "same")}
    lost = conflicts.groupBy("_id").count().collect()
    assert {r["_id"]: r["count"] for r in lost} == {"a": 5000, "n": 1, "m": 1, "b": 1, "c": 1}
    applied = 3
    assert applied + conflicts.count() == changes.count()


def test_merge_is_one_row_per_document_and_name(spark):
    a = spark.range(2000).select((F.col("id") % 10).cast("string").alias("doc_id"), F.lit("X").alias("name"),
                                 (F.col("id") / 2000.0).alias("confidence"), F.lit("c").alias("classifier"))
    m = assign.merge([a])
    assert m.count() == 10
    assert m.where(F.col("rank") != 1).count() == 0


def test_equal_titles_stay_two_notes(spark):
    row = ("Same", "2024-01-01 00:00:00", "u", "u", None, None, 5, {"k": "v"}, [])
    docs = spark.createDataFrame([("d1", "x.pdf", *row), ("d2", None, *row)],
                                 "_id string, pdf_name string, title string, at string, url string, canonical_url string, description string, "
                                 "status string, size_bytes long, meta_tags map<string,string>, "
                                 "categories array<struct<name:string,confidence:double,classifier:string>>")
    table = notes.notes_table(docs.withColumn("fetched_at", F.to_timestamp_ntz("at"))).cache()
    assert {r["doc_id"]: r["pdf_path"] for r in table.collect()} == {"d1": "pdfs/d1.pdf", "d2": None}
    assert len({r["file_name"] for r in table.collect()}) == 1 and notes.listing(table).count() == 2
    assert notes.content(table, table.select("file_name").limit(1)).count() == 2
    ids = spark.createDataFrame([("d1",), ("zz",), ("d1",)], "doc_id string")
    assert {r["doc_id"]: r["exists"] for r in notes.exists(table, ids).collect()} == {"d1": True, "zz": False}
    assert [r["doc_id"] for r in notes.delete(table, ids).collect()] == ["d2"]
    table.unpersist()


def test_store_scans_push_down(spark):
    from folioscope.plans import queries
    for name in ("scan_documents", "scan_categories"):
        plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters: [") + 16:]
        assert not pushed.startswith("]"), plan


def test_documents_with_failed_steps_only_have_pending_steps(spark):
    from folioscope.plans import ingest
    log = spark.createDataFrame([("a", "view", True, "m", 1), ("a", "click", True, "m", 2), ("b", "error", False, "bad", 1)],
                                "doc_id string, step string, success boolean, message string, at int")
    got = {(r["doc_id"], r["step"]): r["state"] for r in ingest.step_progress(log).collect()}
    assert len(got) == 8 and got["a", "click"] == "active" and {v for (d, _), v in got.items() if d == "b"} == {"pending"}
    status = {r["doc_id"]: r for r in ingest.latest_status(log).collect()}
    assert not status["a"]["completed"] and status["b"]["last_error"] == "bad"


def test_checks_have_rows(spark):
    from folioscope.plans import queries
    for name in ("rule_classify", "reclassify_unknown", "capped_training_set", "page_after"):
        assert queries.QUERIES[name](spark, SF_SMALL).count() > 0, name


def test_a_bounded_fit_reads_the_first_rows(spark):
    docs = spark.createDataFrame([("d1", "a", "spark data"), ("d2", "a", "spark data"), ("d3", "b", "garden soil"), ("d4", "b", "garden soil")],
                                 "doc_id string, category string, text string")
    m = tfidf.train(docs, max_rows=2)
    assert m.n_docs.first()["n_docs"] == 2 and {r["term"] for r in m.vocab.collect()} == {"spark", "data"}


def test_fits_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    docs = spark.createDataFrame([("d1", "a", True, "spark data"), ("d2", "a", True, "spark data")],
                                 "doc_id string, category string, trainable boolean, text string")
    _, vectors = tfidf.fit_transform(docs)
    vectors.collect()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


def test_tasks_that_count_terms_by_document_follow_the_size_of_the_input(spark, tmp_path, monkeypatch):
    from folioscope.operators import tfidf
    spark.range(400).selectExpr("CAST(id AS STRING) AS doc_id", "concat('alpha beta ', sha2(CAST(id AS STRING), 512)) AS text").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    vocab = spark.createDataFrame([("alpha", 1.0), ("beta", 2.0)], "term string, idf double")
    few = tfidf.document_terms(docs, vocab, "text", "doc_id")
    monkeypatch.setattr(tfidf, "TASK_BYTES", 500)
    many = tfidf.document_terms(docs, vocab, "text", "doc_id")
    assert many.rdd.getNumPartitions() > 2 * few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and many.count() == 800
