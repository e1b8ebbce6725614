"""Category catalog: lookups, counts, incremental deltas, rebuild, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import reliable


def builtin_categories(spark: SparkSession) -> DataFrame:
    rows = [(key, name, desc, i) for i, (key, name, desc) in enumerate(K.BUILTIN_CATEGORIES, start=1)]
    return spark.createDataFrame(rows, "key string, display_name string, description string, decl_order int")


def record_descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.CATEGORY_RECORD_DESCRIPTIONS, "lname string, description string")


def normalize_category(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Map a free-text name to a built-in category: enum key or display name,
    case-insensitive; anything else (and NULL) → UNKNOWN. The lookup side is
    the fixed 10-entry table, broadcast."""
    spark = df.sparkSession
    b = builtin_categories(spark)
    lookup = (b.select(F.lower("key").alias("_l"), "key", "display_name", "decl_order")
              .unionByName(b.select(F.lower("display_name").alias("_l"), "key", "display_name", "decl_order"))
              .groupBy("_l").agg(F.min_by(F.struct("key", "display_name"), "decl_order").alias("_m")))
    out = df.join(F.broadcast(lookup), F.lower(F.col(name_col)) == F.col("_l"), "left")
    return (out.withColumn("category_key", F.coalesce(F.col("_m.key"), F.lit("UNKNOWN")))
            .withColumn("category_display", F.coalesce(F.col("_m.display_name"), F.lit(K.UNKNOWN_NAME)))
            .drop("_l", "_m"))


def classifiable_categories(spark: SparkSession) -> DataFrame:
    return builtin_categories(spark).where(F.col("key") != "UNKNOWN")


def with_description(df: DataFrame, name_col: str = "name") -> DataFrame:
    d = F.broadcast(record_descriptions(df.sparkSession))
    out = df.join(d, F.lower(F.col(name_col)) == F.col("lname"), "left")
    desc = F.coalesce(F.col("description"), F.concat(F.lit(K.DEFAULT_DESCRIPTION_PREFIX), F.col(name_col)))
    return out.drop("lname").withColumn("description", desc)


def category_counts(assignments: DataFrame, distinct: bool = False) -> DataFrame:
    """Documents per category name. Partial aggregation runs map-side, so a
    hot category only sends per-partition counts through the shuffle.

    Assignments from the classifiers here are unique per (doc, name) — the
    density classifier gives one row per document and ``assign.merge`` keeps
    one row per (doc, name) — so a plain count is exact and needs a single
    exchange. Pass ``distinct=True`` for input that may repeat a pair (a
    distinct count costs a second exchange)."""
    agg = F.countDistinct("doc_id") if distinct else F.count(F.lit(1))
    counts = assignments.groupBy("name").agg(agg.cast("long").alias("document_count"))
    return with_description(counts)


def apply_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Incremental counts: old + Σ delta, floored at 0; names present on
    either side survive (full outer join of two per-category frames)."""
    d = deltas.groupBy("name").agg(F.sum("delta").cast("long").alias("delta"))
    j = counts.select("name", "document_count").join(d, "name", "full_outer")
    new = F.greatest(F.lit(0), F.coalesce(F.col("document_count"), F.lit(0)) + F.coalesce(F.col("delta"), F.lit(0)))
    return j.select("name", F.coalesce(F.col("document_count"), F.lit(0)).cast("long").alias("old_count"),
                    F.coalesce(F.col("delta"), F.lit(0)).cast("long").alias("delta"),
                    new.cast("long").alias("document_count"))


def rebuild(doc_categories: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct category names carried by documents; those missing from
    ``existing`` are created with the number of documents that carry them.
    Returns (created categories, one-row report)."""
    names = doc_categories.select("doc_id", "name").where(F.col("name").isNotNull())
    counts = names.groupBy("name").agg(F.countDistinct("doc_id").cast("long").alias("document_count"))
    created = with_description(counts.join(existing.select("name"), "name", "left_anti"))
    report = counts.join(existing.select("name").withColumn("_e", F.lit(1)), "name", "left").agg(
        F.count(F.when(F.col("_e").isNull(), 1)).cast("long").alias("categories_created"),
        F.count(F.lit(1)).cast("long").alias("total_categories"))
    return created, report


def graph_nodes(counts: DataFrame) -> DataFrame:
    """Root node (count = Σ counts) plus one node per category; group is the
    list position + 1 with the list ordered by name. Names are free text, so
    the list is sorted in ranges: a name's position is its place within its
    range plus the sizes of the ranges before. The ranges are written once, so
    that both see the same ones."""
    root = counts.agg(F.coalesce(F.sum("document_count"), F.lit(0)).cast("long").alias("count")).select(
        F.lit(K.GRAPH_ROOT_ID).alias("id"), F.lit(K.GRAPH_ROOT_NAME).alias("name"),
        F.lit(0).alias("group"), "count")
    ranged = counts.select("name", F.col("document_count").cast("long").alias("count")).repartitionByRange("name")
    ranged = reliable(ranged.withColumn("_range", F.spark_partition_id()), "graph-ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("name"))
    cats = ranged.withColumn("_place", place).join(before, "_range").select(
        F.col("name").alias("id"), "name", (F.col("_place") + F.col("_before")).cast("int").alias("group"), "count")
    return root.unionByName(cats)


def graph_edges(counts: DataFrame) -> DataFrame:
    value = F.when(F.coalesce(F.col("document_count"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("document_count"))
    return counts.select(F.lit(K.GRAPH_ROOT_ID).alias("source"), F.col("name").alias("target"),
                         value.cast("long").alias("value"), F.round(F.sqrt(value), 6).alias("stroke_width"))
