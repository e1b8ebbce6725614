"""Documents and categories from JSON lines, by schema on read.

A line holds one record; its ``type`` tells documents from categories. Fields
that the schema does not name are ignored in a document and reject a category.
Each line of the input is in exactly one output:

* ``documents`` and ``categories``: the fields below, in this library's names;
* ``rejects``: ``line`` and ``reason``: ``empty`` (nothing but white space),
  ``broken`` (no JSON object, cut off, or a field of another type), ``type``
  (neither kind), ``id`` (null or missing), ``unknown field`` (of a category).

The lines are parsed once and the result is written to the shared folder by
kind; each output then reads its own part.

Lines repeat as they do in the input. Missing fields are null. Text behind the
closing brace is not looked at. Instants are ISO texts; one that is none breaks the line.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..session import shared_path

# FIXED VALUES: field names of stored records, each with its column here and its type.
DOCUMENT_FIELDS = {
    "_id": ("_id", "string"), "_rev": ("_rev", "int"), "type": ("type", "string"), "url": ("url", "string"),
    "canonicalUrl": ("canonical_url", "string"), "title": ("title", "string"), "description": ("description", "string"),
    "metaTags": ("meta_tags", "map<string,string>"), "fetchedAt": ("fetched_at", "timestamp"),
    "pdfAttachmentName": ("pdf_name", "string"), "sizeBytes": ("size_bytes", "bigint"),
    "categories": ("categories", "array<struct<name:string,confidence:double,classifier:string>>"),
    "notes": ("notes", "array<string>"), "status": ("status", "string"),
}
CATEGORY_FIELDS = {
    "_id": ("_id", "string"), "_rev": ("_rev", "int"), "type": ("type", "string"), "name": ("name", "string"),
    "description": ("description", "string"), "createdAt": ("created_at", "timestamp"), "documentCount": ("document_count", "bigint"),
}
KINDS = {"document": DOCUMENT_FIELDS, "category": CATEGORY_FIELDS}
CORRUPT = "_corrupt"


@dataclass
class Records:
    documents: DataFrame
    categories: DataFrame
    rejects: DataFrame  # line, reason


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """``line``, ``kind`` (document, category or reject), ``reason`` and the record as
    ``document`` or ``category``."""
    line = F.col("line")
    rows = lines.select(F.col(column).alias("line"))
    rows = rows.select("line", F.json_object_keys("line").alias("_keys"), F.get_json_object("line", "$.type").alias("_type"))
    for kind, fields in KINDS.items():
        schema = ", ".join(f"`{name}` {sql}" for name, (_, sql) in fields.items()) + f", {CORRUPT} string"
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        rows = rows.withColumn(f"_{kind}", F.when(F.col("_type") == kind, F.from_json(line, schema, options)))
    is_broken = F.coalesce(*(F.when(F.col("_type") == kind, F.col(f"_{kind}.{CORRUPT}").isNotNull()) for kind in KINDS), F.lit(False))
    record_id = F.coalesce(F.col("_document._id"), F.col("_category._id"))
    foreign = F.size(F.array_except("_keys", F.array(*map(F.lit, CATEGORY_FIELDS)))) > 0
    reason = (F.when(line.isNull() | ~line.rlike(r"\S"), "empty")
              .when(F.col("_keys").isNull() | is_broken, "broken")
              .when(F.col("_type").isNull() | ~F.col("_type").isin(list(KINDS)), "type")
              .when(record_id.isNull(), "id")
              .when((F.col("_type") == "category") & foreign, "unknown field"))
    rows = rows.withColumn("reason", reason)
    as_struct = lambda kind, fields: F.struct(*(F.col(f"_{kind}.{name}").alias(column) for name, (column, _) in fields.items()))
    good = lambda kind: F.col("reason").isNull() & (F.col("_type") == kind)
    return rows.select(F.when(F.col("reason").isNotNull(), line).alias("line"),
                       F.when(F.col("reason").isNotNull(), F.lit("reject")).otherwise(F.col("_type")).alias("kind"), "reason",
                       *(F.when(good(kind), as_struct(kind, fields)).alias(kind) for kind, fields in KINDS.items()))


def read_records(spark: SparkSession, path: str | list[str]) -> Records:
    """The records of JSON-lines files (compressed ones too, by their ending)."""
    rows = parsed(spark.read.text(path))
    out = shared_path(spark, "stages", f"json-records-{uuid.uuid4().hex}")
    rows.write.partitionBy("kind").parquet(out)
    stored = spark.read.schema(TT.StructType([f for f in rows.schema])).parquet(out)
    part = lambda kind: stored.where(F.col("kind") == kind)
    return Records(part("document").select("document.*"), part("category").select("category.*"), part("reject").select("line", "reason"))
