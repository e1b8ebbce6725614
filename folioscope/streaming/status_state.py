"""The status of documents in processing, with a state that stays small.

The step log arrives as a stream. A document has state only while it is in
processing: when its last pipeline step succeeds, or nothing comes for
``silence`` of event time, a final row goes out and its state is removed (by a
timer). Steps that come later begin a new run of the document.

Every micro-batch gives the rows of the runs it changed; ``read_status`` takes
the newest row of each run and puts the runs of a document together, which
gives the rows of ``ingest.latest_status``: every column is a minimum, maximum,
sum or the value at a maximum.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import bindings as B
from .ingest_stream import EVENTS_SCHEMA

#: Times are microseconds, so that they mean the same on either side of the worker.
STATE = ("run string, current_step string, started long, ended long, n_steps long, failed boolean, completed boolean, "
         "completed_at long, last_error string, error_at long")
NAMES = [f.split()[0] for f in STATE.split(", ")]
OUTPUT = f"doc_id long, {STATE}, final boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(state: dict | None, step: Row, last_step: str) -> dict:
    """The state after one more step, in whatever order steps come."""
    if state is None:
        state = dict.fromkeys(NAMES) | {"run": f"{step.us} {step.message}", "n_steps": 0, "failed": False, "completed": False}
    state["n_steps"] += 1
    if state["started"] is None or step.us < state["started"]:
        state["started"] = step.us
    if state["ended"] is None or step.us >= state["ended"]:
        state["ended"], state["current_step"] = step.us, step.step
    if not step.success:
        state["failed"] = True
        if state["error_at"] is None or step.us >= state["error_at"]:
            state["error_at"], state["last_error"] = step.us, step.message
    elif step.step == last_step:
        state["completed"] = True
        if state["completed_at"] is None or step.us > state["completed_at"]:
            state["completed_at"] = step.us
    return state


class StatusProcessor(StatefulProcessor):
    def __init__(self, last_step: str, silence_ms: int):
        self.last_step, self.silence_ms = last_step, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.status.get() if self.status.exists() else None
        state = dict(zip(NAMES, stored)) if stored is not None else None
        for step in rows:
            state = folded(state, step, self.last_step)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state["completed"]:
            self.status.clear()
        else:
            self.status.update(tuple(state[n] for n in NAMES))
            self.handle.registerTimer(state["ended"] // 1000 + self.silence_ms)
        yield Row(doc_id=key[0], **state, final=state["completed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.status.exists():
            state = dict(zip(NAMES, self.status.get()))
            self.status.clear()
            yield Row(doc_id=key[0], **state, final=True)

    def close(self) -> None:
        pass


def run_status(spark: SparkSession, landing: str, out_dir: str, checkpoint: str, silence: dt.timedelta = dt.timedelta(days=1),
               delay: str = "1 day", file_glob: str = "*.parquet", max_files_per_trigger: int = 64) -> None:
    """Works on all files of the landing folder that are not worked on yet, then
    stops; one folder per epoch, overwritten when the epoch is replayed.

    A step more than ``delay`` older than the newest one would be dropped; the run
    then ends with an error."""
    events = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("pathGlobFilter", file_glob).parquet(landing))
    log = events.select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("step"), (F.col("event_type") != B.EVENT_FAILURE).alias("success"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withWatermark("at", delay)
    status = log.groupBy("doc_id").transformWithState(
        StatusProcessor(B.EVENT_STEPS[-1], int(silence.total_seconds() * 1000)), OUTPUT, "Update", "EventTime")

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)  # timers need this store; a query keeps what it starts with
    try:
        query = (status.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    query.awaitTermination()
    dropped = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} steps came after the watermark")


def read_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """The status of every document, over all its runs."""
    rows = spark.read.parquet(out_dir)
    time = lambda us, c: F.timestamp_micros(us).cast("timestamp_ntz").alias(c)
    newest = rows.groupBy("doc_id", "run").agg(F.max_by(F.struct(*NAMES[1:]), F.struct("epoch", "final", "n_steps")).alias("_s")).select("doc_id", "_s.*")
    return newest.groupBy("doc_id").agg(
        F.max_by("current_step", "ended").alias("current_step"), time(F.min("started"), "started"), time(F.max("ended"), "ended"),
        F.sum("n_steps").cast("long").alias("n_steps"), F.max("failed").alias("failed"), F.max("completed").alias("completed"),
        time(F.max("completed_at"), "completed_at"), F.max_by("last_error", "error_at").alias("last_error"))
