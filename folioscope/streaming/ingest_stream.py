"""Structured Streaming form of the ingest job.

Pages arriving in a landing folder are read with ``readStream``; each
micro-batch goes through the same plan as the batch job and is written to an
epoch folder of its own (``foreachBatch``). A replayed epoch overwrites its
folder with the same rows: of a page that comes several times in a batch one
row is kept, by a rule that does not depend on the order of the files. The
newest epoch counts per id; ``compact`` folds the epochs into one table.
``trigger(availableNow=True)`` processes everything that is there and stops;
with a processing-time trigger the same query runs continuously.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..sources import bindings as B
from ..plans import ingest as I

PAGES_SCHEMA = TT.StructType([
    TT.StructField("page_id", TT.LongType()),
    TT.StructField("url", TT.StringType()),
    TT.StructField("html", TT.StringType()),
])


def one_per_page(batch: DataFrame) -> DataFrame:
    """One row per page: the one with the most html, ties by content."""
    newest = Window.partitionBy("page_id").orderBy(F.desc_nulls_last(F.length("html")), F.xxhash64("url", "html"), "url", "html")
    return batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def run_ingest_stream(spark: SparkSession, landing: str, out_dir: str, checkpoint: str,
                      to_requests: Callable[[DataFrame], DataFrame],
                      file_glob: str = "*.parquet", max_files_per_trigger: int = 64) -> None:
    """Process every file in the ``landing`` folder that matches
    ``file_glob`` (availableNow) into ``out_dir``. ``to_requests`` turns pages
    (page_id, url, html) into requests: options and the probe's answers, for
    example by a join with a table of them."""
    reasons = B.http_reasons(spark)
    stream = (spark.readStream.schema(PAGES_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .option("pathGlobFilter", file_glob)
              .parquet(landing))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        out = I.ingest(to_requests(one_per_page(batch)), reasons)
        # one output folder per epoch: a replay of the same epoch overwrites it
        out.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """The row of the newest epoch per ``_id``."""
    df = spark.read.parquet(out_dir)
    newest = df.groupBy("_id").agg(F.max("epoch").alias("epoch"))
    return df.join(newest, ["_id", "epoch"], "left_semi").drop("epoch")


def compact(spark: SparkSession, out_dir: str, target: str) -> DataFrame:
    """The newest rows as one table in ``target``, sorted by id."""
    read_ingested(spark, out_dir).repartitionByRange("_id").sortWithinPartitions("_id").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


EVENTS_SCHEMA = TT.StructType([
    TT.StructField("event_id", TT.LongType()),
    TT.StructField("ts", TT.TimestampNTZType()),
    TT.StructField("user_id", TT.LongType()),
    TT.StructField("event_type", TT.StringType()),
    TT.StructField("value", TT.DoubleType()),
    TT.StructField("props", TT.StringType()),
])


def run_status_stream(spark: SparkSession, landing: str, out_dir: str, checkpoint: str,
                      file_glob: str = "*.parquet", max_files_per_trigger: int = 64) -> None:
    """Per-document processing status as a stateful streaming aggregation.

    The step log arrives as files; ``groupBy(doc).agg(max_by(...), ...)`` keeps
    one state row per document (bounded by the number of documents) and emits
    changed rows in update mode; each micro-batch of changes is written to its
    own epoch folder (a replayed epoch overwrites it)."""
    from ..plans import ingest as I
    events = (spark.readStream.schema(EVENTS_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .option("pathGlobFilter", file_glob)
              .parquet(landing))
    log = events.select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("step"),
        (F.col("event_type") != B.EVENT_FAILURE).alias("success"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        F.col("ts").alias("at"))
    status = I.latest_status(log)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    q = (status.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest emitted state per document (the last epoch that changed it)."""
    df = spark.read.parquet(out_dir)
    cols = [c for c in df.columns if c not in ("doc_id", "epoch")]
    return (df.groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.col("epoch")).alias("_r"))
            .select("doc_id", "_r.*"))
