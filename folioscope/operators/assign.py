"""Merging classifier outputs into ranked per-document assignments.

All assignment frames share the long form ``(doc_id, name, confidence,
classifier)``. Merging keeps one row per (doc, name): highest confidence,
and on a tie the classifier that comes first in the given order (then the
position inside its list). Merge and ranking both work per document, so the
union is hash-partitioned by ``doc_id`` once and both windows reuse that
partitioning — one shuffle for the whole step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rules, tfidf

ASSIGNMENT_COLUMNS = ["doc_id", "name", "confidence", "classifier"]


class Classifier(Protocol):
    """Plug-in classifier: a name, a version and a DataFrame → assignments
    function (documents in, ``doc_id, name, confidence, classifier`` out)."""
    name: str
    version: str

    def classify(self, docs: DataFrame) -> DataFrame: ...


class FunctionClassifier:
    def __init__(self, name: str, version: str, fn: Callable[[DataFrame], DataFrame]):
        self.name, self.version, self._fn = name, version, fn

    def classify(self, docs: DataFrame) -> DataFrame:
        return self._fn(docs)


def _tagged(frames: Sequence[DataFrame]) -> DataFrame:
    out = None
    for rank, f in enumerate(frames):
        pos = F.col("pos") if "pos" in f.columns else F.lit(0)
        t = f.select(*ASSIGNMENT_COLUMNS, F.lit(rank).alias("source_rank"), pos.cast("int").alias("pos"))
        out = t if out is None else out.unionByName(t)
    return out


def merge(frames: Sequence[DataFrame], with_rank: bool = True) -> DataFrame:
    """Union (bag) of assignment frames → best row per (doc, name), plus the
    per-document rank by confidence desc (ties by name)."""
    u = _tagged(frames).repartition("doc_id")
    keep = Window.partitionBy("doc_id", "name").orderBy(F.desc("confidence"), "source_rank", "pos")
    best = (u.withColumn("_k", F.row_number().over(keep)).where(F.col("_k") == 1)
            .select(*ASSIGNMENT_COLUMNS))
    if not with_rank:
        return best
    return rank(best)


def rank(assignments: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), F.asc("name"))
    return assignments.withColumn("rank", F.row_number().over(w))


def primary(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") == 1).select(*ASSIGNMENT_COLUMNS)


def hybrid(docs: DataFrame, model: tfidf.TfidfModel | None = None, responses: DataFrame | None = None,
           tfidf_text_col: str = "tfidf_text", extra: Sequence[DataFrame] = (), key: str = "_id",
           doc_vectors: DataFrame | None = None) -> DataFrame:
    """External predictions ∪ TF-IDF ∪ density rules (∪ plug-ins) → merge →
    rank. Each input is optional and independent of the others; pass
    ``doc_vectors`` when they were already computed (``tfidf.fit_transform``)."""
    from . import predictions as P
    frames = []
    if responses is not None:
        frames.append(P.predictions(responses))
    if model is not None:
        vecs = doc_vectors if doc_vectors is not None else tfidf.document_vectors(
            docs.select(F.col(key).alias("doc_id"), F.col(tfidf_text_col).alias("text")), model.vocab)
        frames.append(tfidf.classify(tfidf.score(vecs, model.class_vectors)))
    frames.append(rules.density_classify(docs, key=key))
    frames.extend(extra)
    return merge(frames)


def categories_array(ranked: DataFrame) -> DataFrame:
    """Long form → one row per document with the ordered category list (the
    list is bounded by the number of distinct categories)."""
    return (ranked.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "name", "confidence", "classifier"))).alias("_c"))
            .select("doc_id", F.transform("_c", lambda c: F.struct(c["name"].alias("name"),
                                                                   c["confidence"].alias("confidence"),
                                                                   c["classifier"].alias("classifier"))).alias("categories")))
