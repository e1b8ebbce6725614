"""Rule-based classifiers as generated column expressions.

The rule sets are small parameters (dicts / pattern lists); each rule becomes
one JVM expression over the text column, so classification is a single
narrow projection — no join against a rule table, no shuffle — and runs
inside whole-stage codegen. Results come out in long form through an
``explode`` of a fixed-size array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


# ---------------------------------------------------------------- keyword / domain
def keyword_scores(docs: DataFrame,
                   keyword_rules: Mapping[str, Sequence[str]] = K.DEFAULT_KEYWORD_RULES,
                   domain_rules: Mapping[str, Sequence[str]] = K.DEFAULT_DOMAIN_RULES,
                   key: str = "_id") -> DataFrame:
    """Per (document, rule category): distinct keywords found as substrings of
    the lower-cased rules text / list size, and whether the URL's domain
    contains a listed domain. ``docs`` needs title, description, url, meta_tags."""
    text = F.lower(T.rules_text("title", "description", "url", "meta_tags"))
    domain = T.url_domain("url")
    base = docs.select(F.col(key), text.alias("_t"), domain.alias("_d"))
    rows = []
    for category, keywords in keyword_rules.items():
        kws = list(keywords)
        hits = sum((F.col("_t").contains(kw.lower()).cast("int") for kw in kws), F.lit(0))
        doms = list(domain_rules.get(category, []))
        if doms:
            any_dom = F.lit(False)
            for dname in doms:
                any_dom = any_dom | F.col("_d").contains(dname.lower())
            dom_score = F.when((F.col("_d") != "") & any_dom, F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            dom_score = F.lit(0.0)
        kw_score = hits / F.lit(len(kws)) if kws else F.lit(0.0)
        rows.append(F.struct(F.lit(category).alias("category"), hits.alias("keyword_hits"),
                             kw_score.alias("keyword_score"), dom_score.alias("domain_score")))
    out = base.select(F.col(key), F.explode(F.array(*rows)).alias("_r")).select(key, "_r.*")
    conf = F.col("keyword_score") * K.RULE_KEYWORD_WEIGHT + F.col("domain_score") * K.RULE_DOMAIN_WEIGHT
    return out.withColumn("confidence", conf)


def keyword_classify(docs: DataFrame, threshold: float = K.RULE_THRESHOLD, key: str = "_id", **rules) -> DataFrame:
    s = keyword_scores(docs, key=key, **rules)
    return (s.where(F.col("confidence") >= threshold)
            .select(F.col(key).alias("doc_id"), F.col("category").alias("name"), "confidence",
                    F.lit(K.RULE_CLASSIFIER).alias("classifier")))


# ---------------------------------------------------------------- density
def _pattern_hits(content: Column, patterns: Sequence[str]) -> Column:
    return sum((F.regexp_count(content, F.lit(r"(?i)\b(" + p + r")\b")) for p in patterns), F.lit(0))


def density_scores(docs: DataFrame, patterns=K.DENSITY_PATTERNS, key: str = "_id",
                   content_col: str | None = None) -> DataFrame:
    """Per (document, built-in category): regex hits over the lower-cased
    density text, word count and score = max(2·hits/words, min(0.1·hits, 1))."""
    content = F.col(content_col) if content_col else T.density_text("title", "description", "url", "meta_tags")
    base = docs.select(F.col(key), content.alias("_c"))
    folded = T.fold_non_ascii_word_chars(F.col("_c"))
    words = T.word_count(F.col("_c"))
    base = base.select(F.col(key), folded.alias("_f"), words.alias("words"))
    rows = []
    for rank, (name, pats) in enumerate(patterns, start=1):
        hits = _pattern_hits(F.col("_f"), pats)
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(rank).alias("decl_order"), hits.alias("hits")))
    out = base.select(F.col(key), "words", F.explode(F.array(*rows)).alias("_r")).select(key, "words", "_r.*")
    density = F.col("hits") / F.greatest(F.col("words"), F.lit(1))
    score = F.greatest(density * 2.0, F.least(F.col("hits") * 0.1, F.lit(1.0)))
    return out.withColumn("score", score)


def density_columns(docs: DataFrame, patterns=K.DENSITY_PATTERNS, content_col: str | None = None,
                    prefix: str = "density_") -> DataFrame:
    """``docs`` plus the arg-max density category and its confidence as
    columns (``density_name``, ``density_confidence``). Ties go to declaration
    order; below 0.1 the document is Unknown with confidence 1.0. The arg-max
    is taken inside the row over a fixed-size array: no window, no shuffle,
    and no join back to the documents."""
    content = F.col(content_col) if content_col else T.density_text("title", "description", "url", "meta_tags")
    folded = T.fold_non_ascii_word_chars(content)
    words = F.greatest(T.word_count(content), F.lit(1))
    tmp = docs.withColumn("_f", folded).withColumn("_w", words)
    cands = []
    for rank, (name, pats) in enumerate(patterns, start=1):
        hits = _pattern_hits(F.col("_f"), pats)
        score = F.greatest((hits / F.col("_w")) * 2.0, F.least(hits * 0.1, F.lit(1.0)))
        cands.append(F.struct((-score).alias("neg"), F.lit(rank).alias("decl_order"),
                              F.lit(name).alias("name"), score.alias("score")))
    tmp = tmp.withColumn("_best", F.sort_array(F.array(*cands))[0])
    low = F.col("_best.score") < K.DENSITY_MIN_SCORE
    # coalesce makes the name provably non-null, so a later ``name IS NOT NULL``
    # filter folds away instead of re-inlining this expression
    name = F.coalesce(F.when(low, F.lit(K.UNKNOWN_NAME)).otherwise(F.col("_best.name")), F.lit(K.UNKNOWN_NAME))
    return (tmp.withColumn(prefix + "name", name)
            .withColumn(prefix + "confidence", F.when(low, F.lit(1.0)).otherwise(F.least(F.col("_best.score"), F.lit(1.0))))
            .drop("_f", "_w", "_best"))


def density_classify(docs: DataFrame, patterns=K.DENSITY_PATTERNS, key: str = "_id",
                     content_col: str | None = None) -> DataFrame:
    """Density classification as assignments (doc_id, name, confidence,
    classifier)."""
    base = docs.select(F.col(key), *[c for c in ("title", "description", "url", "meta_tags", content_col)
                                      if c and c in docs.columns and c != key])
    d = density_columns(base, patterns, content_col)
    return d.select(F.col(key).alias("doc_id"), F.col("density_name").alias("name"),
                    F.col("density_confidence").alias("confidence"), F.lit(K.DENSITY_CLASSIFIER).alias("classifier"))
