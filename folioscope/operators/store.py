"""Keyed document store operations as set-at-a-time joins.

Lookups are semi joins, deletes anti joins, saves an upsert by revision,
attachments an equi-join on (doc_id, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_documents(store: DataFrame) -> DataFrame:
    return store.where(F.col("type") == "document")


def scan_categories(store: DataFrame) -> DataFrame:
    """Id-prefix range scan (``StringStartsWith`` pushes down to Parquet)."""
    return store.where(F.col("_id").startswith("category|"))


def lookup(docs: DataFrame, keys: DataFrame, key: str = "_id") -> DataFrame:
    """Every requested key with an ``exists`` flag and the found title."""
    found = docs.select(F.col(key), F.col("title"), F.lit(True).alias("_hit"))
    return (keys.select(key).distinct().join(found, key, "left")
            .select(key, F.coalesce(F.col("_hit"), F.lit(False)).alias("exists"), "title"))


def judge(current: DataFrame, changes: DataFrame, key: str = "_id", order: tuple[str, ...] = ()) -> DataFrame:
    """The changes with ``_won``, whether each is the one applied to its key,
    ``_current`` and ``_stored`` (the stored revision, whether there is one) and
    ``_late``, how many equal ones come too late. ``current``: key and ``_rev``.

    The winner per key is a ``min`` over (order, hash), reduced before the
    shuffle, so a key with a large share of all changes is one row per task.
    The store is joined once, on the key."""
    cols = [c for c in changes.columns if c != key]
    rank = F.struct(*order, F.xxhash64(*changes.columns).alias("_hash"))
    ranked = changes.withColumn("_rank", rank).withColumn("_new", F.col("_rev").isNull())
    # rows equal in every column count as one change made several times
    dealt = ranked.groupBy(key, *cols, "_rank", "_new").agg(F.count(F.lit(1)).alias("_times"))
    stored = current.select(F.col(key), F.col("_rev").alias("_current"), F.lit(True).alias("_stored"))
    joined = dealt.join(stored, key, "left")
    fits = F.when(F.col("_stored").isNull(), F.col("_new")).otherwise(F.coalesce(F.col("_rev") == F.col("_current"), F.lit(False)))
    joined = joined.withColumn("_fits", fits)
    # from the bare revisions: the other columns need not be dealt once more for it
    bare = ranked.select(key, "_rev", "_rank", "_new").join(stored, key, "left")
    first = bare.where(fits).groupBy(key).agg(F.min("_rank").alias("_first"))
    judged = joined.join(first.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col("_rank") == F.col("_first")) & F.col("_fits"), "left")
    won = F.col("_key").isNotNull()
    late = F.col("_times") - F.when(won, F.lit(1)).otherwise(F.lit(0))
    return judged.select(key, *cols, "_current", F.coalesce("_stored", F.lit(False)).alias("_stored"), won.alias("_won"), late.alias("_late"))


def next_revision() -> Column:
    return F.when(F.col("_current").isNull(), F.lit(1)).otherwise(F.col("_current") + 1)


def upsert(base: DataFrame, changes: DataFrame, key: str = "_id", order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Save a batch of changes, one after the other per key. Returns (store,
    conflicts); every change is in exactly one of them.

    A change whose ``_rev`` equals the stored revision is applied and moves the
    revision to ``_rev + 1``; a change without a revision creates a new key at
    revision 1. Any other change is a conflict: a used or unknown revision, a
    revision for a key that is not stored, none for a key that is. So of
    several changes for one key one is applied, the first by the ``order``
    columns, then by the hash of its values; the others come too late."""
    judged = judge(base.select(key, "_rev"), changes, key, order)
    applied = judged.where("_won").withColumn("_rev", next_revision())
    conflicts = judged.where("_late > 0").select(
        key, F.col("_rev").alias("rejected_rev"), F.when(F.col("_stored"), F.col("_current")).alias("current_rev"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_late"))).alias("_n")).drop("_n")
    kept = base.join(applied.select(key), key, "left_anti")
    return kept.unionByName(applied.select(*base.columns)), conflicts


def delete(docs: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    """Idempotent delete: missing ids are a no-op."""
    return docs.join(ids.select(key), key, "left_anti")


def attach(docs: DataFrame, attachments: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Attachments whose document exists (joined) and orphans (rejected)."""
    ids = docs.select(F.col(key).alias("doc_id"))
    ok = attachments.join(ids, "doc_id", "left_semi")
    orphans = attachments.join(ids, "doc_id", "left_anti")
    return ok, orphans


def fetch_attachment(docs: DataFrame, attachments: DataFrame, key: str = "_id") -> DataFrame:
    """Document ⋈ attachment on (id, stored attachment name); orphans have no
    document to join, so the payload passes one join only."""
    a = attachments.select(F.col("doc_id").alias(key), F.col("name").alias("pdf_name"), "content_type", "length", "data")
    return docs.join(a, [key, "pdf_name"], "inner")


def pdf_lookup(requests: DataFrame, docs: DataFrame, attachments: DataFrame, key: str = "_id") -> DataFrame:
    """Outcome per requested id: ok / not_found / no_attachment."""
    d = docs.select(key, "pdf_name", F.lit(True).alias("_doc"))
    a = attachments.select(F.col("doc_id").alias(key), F.col("name").alias("pdf_name"), "length", F.lit(True).alias("_att"))
    j = requests.select(key).join(d, key, "left").join(a, [key, "pdf_name"], "left")
    outcome = (F.when(F.col("_doc").isNull(), F.lit("not_found"))
               .when(F.col("pdf_name").isNull() | (F.col("pdf_name") == "") | F.col("_att").isNull(), F.lit("no_attachment"))
               .otherwise(F.lit("ok")))
    return j.select(key, outcome.alias("outcome"), F.when(outcome == "ok", F.col("length")).alias("length"))
