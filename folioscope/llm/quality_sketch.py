"""Quality rules with adaptive thresholds, DataFrame operations only.

Each text's counts are computed within its row. The rates derived from them go
into quantile sketches per language and source: logarithmic buckets of fixed
relative width with counts (bucket i holds values up to gamma^i), which merge
by adding counts, so partial sums leave every task and a hot source is a few
hundred rows. A rate's upper threshold, per language and source, is
q85 + ``reach`` * (q85 - q50); nothing in it is fixed. A text is held against it
by its own counts: it may exceed the threshold by ``reach`` standard errors of
a count of its length (Poisson, in units of the least event), so that a single
sign or repeated line does not condemn a short text where most have none. Up to
a seventh of a group may be bad before that moves its threshold.

The counts are written as a table after the one pass over the texts; sketches
and filter read that table only.

Repeated windows are found by sorting pairs of 64-bit hash and position and
comparing neighbours.

Defined results: null and empty texts have no words and fail the base rule.
Null language or source is a group like any other. A group of one row has its
own values as quartiles, so it passes. Rows repeat as they do in the input.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: rate: what is counted, among what, and the size of the least event (two
#: equal three-word windows cover six words)
RATES = {"word_length": ("word_chars", "n_words", 1), "symbols": ("n_symbols", "n_words", 1),
         "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 6)}
HIGH, MIDDLE = 0.85, 0.5


def counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
           source_column: str = "source") -> DataFrame:
    """``_id``, ``_lang``, ``_source``, the base counts and ``n_lines`` (lines with a
    word) of every text.

    Each step's arrays are columns of their own before the next step looks into
    them: an array named inside a lambda is otherwise computed once per element."""
    w, n, h, k, marks = (F.col(c) for c in ("_w", "n_words", "_h", "_k", "_marks"))
    text = F.coalesce(F.col(text_column), F.lit(""))

    def repeated(key: Column, j: Column) -> Column:
        same = lambda other: F.coalesce(other["hash"] == key["hash"], F.lit(False))
        return same(F.get(k, j - 1)) | same(F.get(k, j + 1))

    rows = docs.select(F.col(id_column).alias("_id"), F.col(lang_column).alias("_lang"), F.col(source_column).alias("_source"),
                       F.array_remove(F.split(text, SPACE), "").alias("_w"),
                       F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
                       F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    rows = rows.select("_id", "_lang", "_source", "n_symbols", "_w", F.size("_w").cast("long").alias("n_words"),
                       F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                       F.size("_lines").cast("long").alias("n_lines"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    carried = ["_id", "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = rows.select(*carried, F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias("_h"))
    keyed = F.transform(F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0)).cast("int")),
                        lambda x, i: F.struct(x.alias("hash"), i.cast("long").alias("at")))
    rows = rows.select(*carried, F.sort_array(keyed).alias("_k"))
    rows = rows.select(*carried, F.sort_array(F.transform(F.filter(k, repeated), lambda x: x["at"])).alias("_marks"))
    spans = F.transform(marks, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(marks, j + 1), x + 3) - x))
    return rows.select(*carried, F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def rates() -> dict[str, Column]:
    return {name: F.col(count) / F.greatest(F.col(among), F.lit(1).cast("long")) for name, (count, among, _) in RATES.items()}


def sketch(rows: DataFrame) -> DataFrame:
    """Bucket counts of every rate per language and source; null bucket: zero."""
    pairs = F.array(*(F.struct(F.lit(name).alias("rate"), value.alias("value")) for name, value in rates().items()))
    long = rows.select("_lang", "_source", F.inline(pairs))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log(F.col("value")) / F.lit(math.log(GAMMA))).cast("long"))
    return long.groupBy("_lang", "_source", "rate", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(buckets: DataFrame, reach: float) -> DataFrame:
    """One row per language and source with the upper threshold of each rate."""
    group = ["_lang", "_source", "rate"]
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * F.lit(2 / (GAMMA + 1)), F.lit(0.0))
    up = Window.partitionBy(*group).orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    cum = buckets.withColumn("_cum", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(Window.partitionBy(*group)))
    at = lambda q: F.min(F.when(F.col("_cum") >= F.col("_all") * q, value))
    limits = cum.groupBy(*group).agg(at(MIDDLE).alias("_mid"), at(HIGH).alias("_high")).select(
        *group, (F.col("_high") + reach * (F.col("_high") - F.col("_mid"))).alias("most"))
    return limits.groupBy("_lang", "_source").agg(
        *(F.max(F.when(F.col("rate") == name, F.col("most"))).alias(f"_most_{name}") for name in RATES))


def judge(docs: DataFrame, reach: float = 3.0, id_column: str = "doc_id", **columns: str) -> DataFrame:
    """``id_column``, the counts, ``base_failed`` and ``kept`` of every row."""
    rows = written(counts(docs, id_column, **columns), "quality-counts")
    limits = thresholds(sketch(rows), reach).withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = rows.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    within = F.lit(True)
    for name, (count, among, unit) in RATES.items():
        due = F.col(f"_most_{name}") * F.col(among)
        within = within & (F.col(count) <= due + reach * F.sqrt(unit * (due + unit)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"))
