"""Search, filters and paging.

Filters are plain column predicates, so they push down to the scan where the
source allows; paging is ``orderBy(...).offset(n).limit(m)``, which Spark
plans as a top-k (TakeOrderedAndProject) — each partition keeps only its
``offset + size`` best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTING_COLUMNS = ["_id", "url", "title", "description", "status"]


def _contains_ci(col: str, q: str):
    return F.coalesce(F.contains(F.lower(F.col(col)), F.lower(F.lit(q))), F.lit(False))


def search(docs: DataFrame, q: str, fields=("title", "description", "url")) -> DataFrame:
    """Case-insensitive literal substring match on any field ('%' and '_'
    are ordinary characters; NULL fields never match)."""
    cond = F.lit(False)
    for f in fields:
        cond = cond | _contains_ci(f, q)
    return docs.where(cond)


def by_category(docs: DataFrame, name: str) -> DataFrame:
    """Exact, case-sensitive category name over the nested category list."""
    return docs.where(F.coalesce(F.exists("categories", lambda c: c["name"] == F.lit(name)), F.lit(False)))


def by_category_long(docs: DataFrame, assignments: DataFrame, name: str, key: str = "_id") -> DataFrame:
    hits = assignments.where(F.col("name") == name).select(F.col("doc_id").alias(key))
    return docs.join(hits, key, "left_semi")


def trainable(docs: DataFrame) -> DataFrame:
    return docs.where((F.coalesce(F.size("categories"), F.lit(0)) > 0) & F.col("pdf_name").isNotNull())


def page(df: DataFrame, offset: int, size: int, order_by=("_id",)) -> DataFrame:
    return df.orderBy(*order_by).offset(offset).limit(size)


def page_after(df: DataFrame, last: tuple, size: int, order_by=("_id",)) -> DataFrame:
    """The ``size`` rows after the row whose sort columns are ``last`` (keyset
    paging; the last sort column is unique). Unlike an offset, the cost does not
    grow with the page number: the filter reaches the scan."""
    after, equal = F.lit(False), F.lit(True)
    for name, value in zip(order_by, last):
        after = after | (equal & (F.col(name) > F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    return df.where((F.col(order_by[0]) >= F.lit(last[0])) & after).orderBy(*order_by).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("long").alias("total_elements")).select(
        "total_elements", F.ceil(F.col("total_elements") / F.lit(float(size))).cast("long").alias("total_pages"),
        F.lit(size).alias("page_size"))


def first_n_then_filter(df: DataFrame, n: int, cond, order_by=("_id",)) -> DataFrame:
    """The cap comes before the filter: the first ``n`` rows in id order, then
    only those that satisfy ``cond``."""
    return df.orderBy(*order_by).limit(n).where(cond)
