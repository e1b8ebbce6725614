"""Set-at-a-time ingest: verify → convert → store → analyse → categorise → note.

The reference processes one URL per request with an in-memory status map.
Here a whole request table flows through one lazy plan; every row carries
its outcome, the step that failed and the error, so rejected rows can be
routed to a quarantine table instead of aborting the job. The first three
steps are fatal for a row, the last three are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import html as H
from ..functions import text as T
from ..operators import assign, notes, rules
from ..operators.tfidf import TfidfModel
from ..sources import bindings as B

INGEST_COLUMNS = ["page_id", "_id", "url", "outcome", "failed_step", "error", "title", "pdf_name",
                  "category", "confidence", "note_file"]


def ingest(requests: DataFrame, reasons: DataFrame, model: TfidfModel | None = None,
           responses: DataFrame | None = None) -> DataFrame:
    """One row per request, with its outcome, document, categories and note.

    ``requests``: page_id, url, html, create_note, note_meta_tag, http_status (the
    reachability probe's answer). A failed row carries the step and the error
    and nothing else; its page is not looked at. Everything is a column of the
    request's row: with density classes alone the plan has no shuffle. With a
    ``model`` or external ``responses`` (doc_id, response) the hybrid categories
    are joined by id."""
    r = requests.join(F.broadcast(reasons), "http_status", "left")
    fetched = (F.col("http_status") >= 200) & (F.col("http_status") < 400)
    checked = T.url_check("url")
    r = r.select("page_id", "url", "html", "create_note", "note_meta_tag",
                 F.when(checked.isNotNull(), checked).when(~fetched, T.fetch_outcome("http_status", "reason")).alias("_verify"),
                 F.when(H.is_blank(F.col("html")), F.lit("PDF generation failed: empty page")).alias("_convert"))
    failed = (F.when(F.col("_verify").isNotNull(), F.lit(K.INGEST_STEPS[0]))
              .when(F.col("_convert").isNotNull(), F.lit(K.INGEST_STEPS[1])))
    r = r.select("page_id", "url", "create_note", "note_meta_tag", failed.alias("failed_step"), F.coalesce("_verify", "_convert").alias("error"),
                 F.when(failed.isNull(), F.col("html")).alias("html"))
    docs = rules.density_columns(B.extract_pages(r, keep=("failed_step", "error", "create_note", "note_meta_tag")))
    density = F.array(F.struct(F.col("density_name").alias("name"), F.col("density_confidence").alias("confidence"),
                               F.lit(K.DENSITY_CLASSIFIER).alias("classifier")))
    if model is None and responses is None:
        docs = docs.withColumn("categories", density)
    else:
        stored = docs.where("failed_step IS NULL").withColumn("tfidf_text", T.tfidf_text("title", "description", "meta_tags", F.lit("")))
        ranked = assign.hybrid(stored, model=model, responses=responses)
        found = assign.categories_array(ranked).withColumnRenamed("doc_id", "_id")
        docs = docs.join(found, "_id", "left")
    ok = F.col("failed_step").isNull()
    noted = ok & F.col("create_note")
    only = lambda c, when=ok: F.when(when, c)
    return docs.select(
        "page_id", "_id", "url", F.when(ok, F.lit("STORED")).otherwise(F.lit("FAILED")).alias("outcome"), "failed_step", "error",
        only(F.col("title")).alias("title"), only(F.col("description")).alias("description"),
        only(F.col("canonical_url")).alias("canonical_url"), only(F.col("meta_tags")).alias("meta_tags"), "fetched_at", "size_bytes",
        only(T.stored_file_name("title")).alias("pdf_name"), only(F.col("categories")).alias("categories"),
        only(F.col("categories")[0]["name"]).alias("category"), only(F.col("categories")[0]["confidence"]).alias("confidence"),
        only(T.note_file_name("title", "fetched_at"), noted).alias("note_file"),
        only(notes.markdown(docs, meta_tag=F.col("note_meta_tag")), noted).alias("note"))


def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(B.ingest_requests(spark, sf_dir), B.http_reasons(spark))


def step_rows(ingested: DataFrame) -> DataFrame:
    """The step log of an ingest: every step up to the failed one, or all."""
    steps = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(s).alias("step")) for i, s in enumerate(K.INGEST_STEPS, 1)))
    last = F.coalesce(F.array_position(F.transform(steps, lambda s: s["step"]), F.col("failed_step")), F.lit(len(K.INGEST_STEPS)))
    rows = ingested.select("_id", "failed_step", "error", F.explode(F.slice(steps, F.lit(1), last.cast("int"))).alias("_s"))
    failed = F.coalesce(F.col("_s.step") == F.col("failed_step"), F.lit(False))
    return rows.select("_id", F.col("_s.position").alias("position"), F.col("_s.step").alias("step"), (~failed).alias("success"),
                       F.when(failed, F.col("error")).alias("message"))


def ingest_counts(ingested: DataFrame) -> DataFrame:
    """Documents added per category."""
    # explode_outer: the filter that explode implies would compute the categories once more
    names = ingested.select(F.explode_outer("categories").alias("c")).select(F.col("c.name").alias("name"))
    return names.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).cast("long").alias("delta"))


def stored_documents(ingested: DataFrame) -> DataFrame:
    """Changes for the document store: new documents have no revision yet."""
    return ingested.where("outcome = 'STORED'").select("_id", F.lit(None).cast("int").alias("_rev"), "title")


def latest_status(step_log: DataFrame) -> DataFrame:
    """Current state per document from an append-only step log: last step, times,
    failures, and whether and when the last pipeline step succeeded. Partial
    aggregation keeps the shuffle to one row per document per partition."""
    fail = ~F.col("success")
    finished = F.col("success") & (F.col("step") == B.EVENT_STEPS[-1])
    return step_log.groupBy("doc_id").agg(
        F.max_by("step", "at").alias("current_step"),
        F.min("at").alias("started"), F.max("at").alias("ended"),
        F.count(F.lit(1)).cast("long").alias("n_steps"),
        F.max(fail).alias("failed"),
        F.max(finished).alias("completed"), F.max(F.when(finished, F.col("at"))).alias("completed_at"),
        F.max_by(F.when(fail, F.col("message")), F.when(fail, F.col("at"))).alias("last_error"))


def step_progress(step_log: DataFrame, steps=B.EVENT_STEPS) -> DataFrame:
    """Per document and pipeline step: completed / active / pending, by
    comparing the step's position with the latest successful step; without one
    all steps are pending."""
    idx = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("step"))
    done = F.col("success")
    cur = step_log.groupBy("doc_id").agg(F.coalesce(F.max_by(F.when(done, idx), F.when(done, F.col("at"))), F.lit(0)).alias("current_index"))
    arr = F.array(*[F.struct(F.lit(i).alias("step_index"), F.lit(s).alias("step")) for i, s in enumerate(steps, 1)])
    x = cur.select("doc_id", "current_index", F.explode(arr).alias("s")).select("doc_id", "current_index", "s.*")
    state = (F.when(F.col("step_index") < F.col("current_index"), F.lit("completed"))
             .when(F.col("step_index") == F.col("current_index"), F.lit("active"))
             .otherwise(F.lit("pending")))
    return x.select("doc_id", "step", F.col("step_index").cast("int").alias("step_index"), state.alias("state"))
