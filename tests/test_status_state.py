"""The stateful status stream: rows of the batch plan, and what its state store holds."""

import datetime as dt
import uuid

from folioscope.plans import ingest as I
from folioscope.session import shared_path
from folioscope.sources import bindings as B
from folioscope.streaming import ingest_stream as S
from folioscope.streaming import status_state as T

T0 = dt.datetime(2024, 5, 1)


def land(spark, path, rows):
    data = [(i, T0 + dt.timedelta(hours=h), doc, step, 0.0, None) for i, h, doc, step in rows]
    spark.createDataFrame(data, S.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def in_state(spark, checkpoint):
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "status").load()
    return sorted(r["key"][0] for r in rows.collect())


def batch(spark, path):
    from pyspark.sql import functions as F
    e = spark.read.schema(S.EVENTS_SCHEMA).parquet(path)
    log = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("step"), (F.col("event_type") != B.EVENT_FAILURE).alias("success"),
                   F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("message"), F.col("ts").alias("at"))
    return I.latest_status(log)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "current_step", "started", "ended", "n_steps", "failed", "completed", "completed_at", "last_error").collect())


def test_finished_and_silent_documents_leave_the_state(spark):
    run = shared_path(spark, "test-status-" + uuid.uuid4().hex[:8])
    go = lambda: T.run_status(spark, f"{run}/in", f"{run}/out", f"{run}/ckpt", silence=dt.timedelta(hours=5), delay="2 hours")
    land(spark, f"{run}/in", [(1, 0, 10, "view"), (2, 0.5, 10, "purchase"), (3, 0, 20, "view"), (4, 1, 20, "error"), (5, 0, 30, "click")])
    go()
    assert in_state(spark, f"{run}/ckpt") == [20, 30]  # 10 is finished
    assert rows(T.read_status(spark, f"{run}/out")) == rows(batch(spark, f"{run}/in"))
    # a step before the newest one, a document that begins again
    land(spark, f"{run}/in", [(6, 4, 20, "click"), (7, 3.5, 20, "view"), (8, 4, 10, "view")])
    go()
    assert in_state(spark, f"{run}/ckpt") == [10, 20, 30]
    assert rows(T.read_status(spark, f"{run}/out")) == rows(batch(spark, f"{run}/in"))
    # 30 is silent for more than five hours of event time, then 20 ends
    land(spark, f"{run}/in", [(9, 8, 20, "purchase"), (10, 8, 40, "signup")])
    go()
    land(spark, f"{run}/in", [(11, 8.5, 40, "error")])
    go()
    assert in_state(spark, f"{run}/ckpt") == [10, 40]
    assert rows(T.read_status(spark, f"{run}/out")) == rows(batch(spark, f"{run}/in"))
    go()  # nothing new
    assert rows(T.read_status(spark, f"{run}/out")) == rows(batch(spark, f"{run}/in"))


def test_steps_in_any_order_give_the_same_state():
    import itertools

    from pyspark.sql import Row
    steps = [Row(step=s, success=s != "error", message=f"{s} {i}", us=i) for i, s in enumerate(["view", "error", "purchase", "error"])]
    found = set()
    for order in itertools.permutations(steps):
        state = None
        for s in order:
            state = T.folded(state, s, "purchase")
        found.add(tuple(v for k, v in state.items() if k != "run"))
    assert len(found) == 1
