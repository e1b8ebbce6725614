"""The whole ingest as a stream: pages and requests arrive apart, are joined,
classified and saved.

Every row carries the time of its event and the time at which it arrived.

* A row whose event lies more than ``delay`` before its arrival, or after it, is
  late; it goes to ``rejects/late`` (a file sink, each row once).
* The others are joined, pages with requests, by ``page_id`` and events at most
  ``within`` apart: a full outer stream-stream join. Its state is bounded by the
  watermark; a row that leaves it without a partner goes to ``rejects/unmatched``.
* A micro-batch of pairs goes through the plan of the batch ingest, with the
  hybrid categories of a stored model and external responses, is written as an
  epoch and saved into a ``KeyedStore`` as the batch of that epoch. A replayed
  epoch writes the same folder and finds its batch done.

So each row that arrives is saved, logged as rejected by the store, or in one of
the rejects. Files have to be listed in the order of arrival; should the
watermark drop a row nevertheless, the run ends with an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..operators.keyed_store import KeyedStore
from ..operators.tfidf import TfidfModel
from ..plans import ingest as I
from ..sources import bindings as B

def _schema(**types: TT.DataType) -> TT.StructType:
    return TT.StructType([TT.StructField(name, kind) for name, kind in types.items()])


_LONG, _INT, _TEXT, _TIME = TT.LongType(), TT.IntegerType(), TT.StringType(), TT.TimestampType()
PAGES = _schema(page_id=_LONG, url=_TEXT, html=_TEXT, fetched_at=_TIME, arrived_at=_TIME)
REQUESTS = _schema(page_id=_LONG, create_note=TT.BooleanType(), note_meta_tag=_TEXT, http_status=_INT, requested_at=_TIME, arrived_at=_TIME)
#: Columns of a document that the stream saves.
STORED = _schema(_id=_TEXT, _rev=_INT, url=_TEXT, title=_TEXT, pdf_name=_TEXT, category=_TEXT, categories=TT.ArrayType(_TEXT),
                 note_file=_TEXT, note=_TEXT)


def is_late(event: str, delay: str):
    late = (F.col("page_id").isNull() | F.col(event).isNull() | F.col("arrived_at").isNull() | (F.col(event) > F.col("arrived_at"))
            | (F.col(event) < F.col("arrived_at") - F.expr(f"INTERVAL {delay}")))
    return F.coalesce(late, F.lit(True))


def landing(spark: SparkSession, path: str, schema: TT.StructType, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def joined(pages: DataFrame, requests: DataFrame, delay: str, within: str) -> DataFrame:
    """Pages and requests side by side; a side without a partner is null."""
    p = pages.withWatermark("fetched_at", delay).select(F.col("page_id").alias("_page"), "url", "html", "fetched_at")
    r = requests.withWatermark("requested_at", delay).select("page_id", "create_note", "note_meta_tag", "http_status", "requested_at")
    near = F.expr(f"_page = page_id AND requested_at BETWEEN fetched_at - INTERVAL {within} AND fetched_at + INTERVAL {within}")
    return p.join(r, near, "full_outer")


def one_pair(pairs: DataFrame) -> DataFrame:
    """One pair per page: the page with the most html, then the earliest request; ties by content."""
    content = ["url", "html", "create_note", "note_meta_tag", "http_status"]
    first = Window.partitionBy("page_id").orderBy(F.desc_nulls_last(F.length("html")), "requested_at", F.xxhash64(*content), *content)
    return pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def documents(ingested: DataFrame) -> DataFrame:
    """New documents for the store (no revision yet)."""
    return ingested.where("outcome = 'STORED'").select(
        "_id", F.lit(None).cast("int").alias("_rev"), "url", "title", "pdf_name", "category",
        F.transform("categories", lambda c: c["name"]).alias("categories"), "note_file", "note")


def run(spark: SparkSession, pages_dir: str, requests_dir: str, run_dir: str, store: KeyedStore, model: TfidfModel | None = None,
        responses: DataFrame | None = None, delay: str = "1 hour", within: str = "1 hour", max_files: int = 64) -> None:
    """Works on everything in the two landing folders that is not worked on yet, then stops.

    ``run_dir`` holds the checkpoints, the epochs (``ingested/epoch=N``) and the
    rejects. A file may be added and ``run`` called again at any time."""
    reasons = B.http_reasons(spark)
    pages, requests = landing(spark, pages_dir, PAGES, max_files), landing(spark, requests_dir, REQUESTS, max_files)

    for name, rows, event in (("pages", pages, "fetched_at"), ("requests", requests, "requested_at")):
        (rows.where(is_late(event, delay)).writeStream.format("parquet").option("path", f"{run_dir}/rejects/late/{name}")
         .option("checkpointLocation", f"{run_dir}/checkpoints/late-{name}").trigger(availableNow=True).start().awaitTermination())

    def save(batch: DataFrame, epoch: int) -> None:
        # the join's state is read once: both outputs come from what is written here
        batch.write.mode("overwrite").parquet(f"{run_dir}/pairs/epoch={epoch}")
        rows = spark.read.schema(batch.schema).parquet(f"{run_dir}/pairs/epoch={epoch}")
        alone = rows.where("page_id IS NULL OR _page IS NULL")
        reason = F.when(F.col("_page").isNull(), F.lit("no page")).otherwise(F.lit("no request"))
        alone.withColumn("reason", reason).write.mode("overwrite").parquet(f"{run_dir}/rejects/unmatched/epoch={epoch}")
        pairs = one_pair(rows.where("page_id IS NOT NULL AND _page IS NOT NULL"))
        done = I.ingest(pairs, reasons, model=model, responses=responses)
        done.write.mode("overwrite").parquet(f"{run_dir}/ingested/epoch={epoch}")
        store.save(documents(spark.read.schema(done.schema).parquet(f"{run_dir}/ingested/epoch={epoch}")), f"epoch-{epoch}")

    on_time = joined(pages.where(~is_late("fetched_at", delay)), requests.where(~is_late("requested_at", delay)), delay, within)
    query = (on_time.writeStream.foreachBatch(save).option("checkpointLocation", f"{run_dir}/checkpoints/join")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    dropped = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} rows came after the watermark: files were not listed in the order of arrival")
