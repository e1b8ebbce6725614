"""Structured Streaming ingest: equal to the batch plan and restart-safe."""

import uuid

from folioscope.plans import ingest as I
from folioscope.session import shared_path
from folioscope.sources import bindings as B
from folioscope.streaming.ingest_stream import compact, one_per_page, read_ingested, run_ingest_stream

from .conftest import SF_SMALL


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_stream_equals_batch_and_restart_is_a_no_op(spark):
    run = shared_path(spark, "test-stream-" + uuid.uuid4().hex[:8])
    run_ingest_stream(spark, SF_SMALL, f"{run}/out", f"{run}/ckpt", B.request_columns, file_glob="pages.parquet")
    first = _rows(read_ingested(spark, f"{run}/out"))
    batch = _rows(I.ingest(B.ingest_requests(spark, SF_SMALL), B.http_reasons(spark)))
    assert first == batch
    # same checkpoint: the file was already committed, nothing is reprocessed
    run_ingest_stream(spark, SF_SMALL, f"{run}/out", f"{run}/ckpt", B.request_columns, file_glob="pages.parquet")
    assert _rows(read_ingested(spark, f"{run}/out")) == first
    epochs = {r["epoch"] for r in spark.read.parquet(f"{run}/out").select("epoch").distinct().collect()}
    assert epochs == {0}
    assert _rows(compact(spark, f"{run}/out", f"{run}/compacted")) == first


def test_pages_that_come_twice_or_are_replayed_come_out_once(spark):
    run = shared_path(spark, "test-stream-" + uuid.uuid4().hex[:8])
    rows = [(1, "http://a/1", "<title>old</title>"), (1, "http://a/1", "<title>full page</title>"), (1, "http://a/1", None),
            (2, "http://a/2", None), (3, "http://a/3", "<title>three</title>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r["page_id"], r["html"]) for r in one_per_page(pages.repartition(5)).collect()} == {
        (1, rows[1][2]), (2, None), (3, rows[4][2])}
    pages.repartition(5).write.parquet(f"{run}/in")

    def requests(df):
        from pyspark.sql import functions as F
        return df.select("page_id", "url", "html", F.lit(True).alias("create_note"), F.lit("k").alias("note_meta_tag"), F.lit(200).alias("http_status"))

    for checkpoint in ("c1", "c2"):  # a second checkpoint replays epoch 0
        run_ingest_stream(spark, f"{run}/in", f"{run}/out", f"{run}/{checkpoint}", requests)
    got = {r["page_id"]: (r["outcome"], r["title"]) for r in read_ingested(spark, f"{run}/out").collect()}
    assert got == {1: ("STORED", "full page"), 2: ("FAILED", None), 3: ("STORED", "three")}
    assert spark.read.parquet(f"{run}/out").count() == 3


def test_streams_read_tables_that_are_folders_of_part_files(spark, tmp_path):
    from folioscope.plans.queries import QUERIES
    pages = spark.createDataFrame([(i, f"https://a.example.com/{i}", f"<title>page {i}</title>") for i in range(8)],
                                  "page_id long, url string, html string")
    events = spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, id % 5 AS user_id,
        element_at(array('view', 'click', 'error', 'purchase'), CAST(id % 4 + 1 AS INT)) AS event_type, CAST(id AS DOUBLE) AS value, '{}' AS props FROM range(40)""")
    for kind in ("folder", "file"):
        for name, table in (("pages", pages), ("events", events)):
            table.repartition(3 if kind == "folder" else 1).write.parquet(f"{tmp_path}/{kind}/{name}.parquet" if kind == "folder" else f"{tmp_path}/{name}")
            if kind == "file":
                (tmp_path / kind).mkdir(exist_ok=True)
                next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / kind / f"{name}.parquet")
        for stream, batch in (("ingest_stream", "ingest_pages"), ("latest_status_stream", "latest_status"), ("status_stream_bounded", "latest_status")):
            got = _rows(QUERIES[stream](spark, f"{tmp_path}/{kind}"))
            assert got == _rows(QUERIES[batch](spark, f"{tmp_path}/{kind}")) != []
