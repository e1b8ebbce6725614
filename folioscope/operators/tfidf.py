"""TF-IDF cosine classifier (training, vectors, scoring) as DataFrame plans.

Model = small tables, written once to the shared folder:
``vocab(term, df, idx, idf)`` has at most ``max_features`` rows and
``class_vectors(category, term, weight)`` at most classes × ``max_features``.
As written tables they have a known size, so Spark broadcasts them below its
own threshold and shuffles above it. The corpus-sized frames are only ever
aggregated or streamed past them, and nothing stays cached.

Semantics: one class per training document (its first category); document
frequency counts documents; vocabulary = terms with df ≥ ``min_df``, the
``max_features`` most frequent (ties by term); idf = ln(N/df) without
smoothing; a class vector is tf·idf over all its texts, L2-normalised; a
document is scored by the dot product of its normalised vector with each
class vector. Spark ML's CountVectorizer/IDF rank and smooth differently, so
they are not used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import read_bytes, reliable
from .folder import Folder


#: Bytes of input files whose tokens one task counts by document.
TASK_BYTES = 8 << 20


@dataclass
class TfidfModel:
    vocab: DataFrame          # term, df, idx, idf
    class_vectors: DataFrame  # category, term, weight
    n_docs: DataFrame         # one row: n_docs


def explode_tokens(df: DataFrame, text_col: str, keep: list[str],
                   stop_words=K.STOP_WORDS, min_len: int = K.MIN_TOKEN_LENGTH) -> DataFrame:
    """One row per token. The split runs in the JVM; the length and stop-word
    filters run after ``explode`` so they stay inside whole-stage codegen."""
    parts = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\W_]+")
    return (df.select(*keep, F.explode(parts).alias("term"))
            .where((F.length("term") >= min_len) & ~F.col("term").isin(list(stop_words))))


# Added once to every document's distinct tokens: its document frequency is
# the number of documents (tokens are ASCII letters/digits, so it cannot
# collide with a real term).
DOC_SENTINEL = "\u0000documents"


def document_frequency(train: DataFrame, text_col: str = "text", key: str = "doc_id",
                       with_sentinel: bool = False) -> DataFrame:
    """term → number of training documents containing it. With
    ``with_sentinel`` the same pass also counts the documents (every one,
    including documents without tokens) under ``DOC_SENTINEL``."""
    parts = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\W_]+"))
    if with_sentinel:
        parts = F.concat(parts, F.array(F.lit(DOC_SENTINEL)))
    toks = (train.select(F.explode(parts).alias("term"))
            .where((F.length("term") >= K.MIN_TOKEN_LENGTH) & ~F.col("term").isin(list(K.STOP_WORDS))))
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(train: DataFrame, text_col: str = "text", key: str = "doc_id", min_df: int = K.TFIDF_MIN_DF,
               max_features: int = K.TFIDF_MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """(vocab(term, df, idx, idf), n_docs) from one pass over the training
    text. The vocabulary has at most ``max_features`` rows and is written once.

    The sentinel's frequency is N, the largest possible, and it sorts before
    every real term, so it is always the first row of the top-k; N is read
    from it by a window over those ≤ max_features + 1 rows (no join)."""
    return vocabulary_of(document_frequency(train, text_col, key, with_sentinel=True), min_df, max_features)


def vocabulary_of(dft: DataFrame, min_df: int = K.TFIDF_MIN_DF, max_features: int = K.TFIDF_MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """``vocabulary`` from document frequencies (term, df) with the sentinel's."""
    top = (dft.where((F.col("df") >= min_df) | (F.col("term") == DOC_SENTINEL))
           .orderBy(F.desc("df"), F.asc("term")).limit(max_features + 1))
    w = Window.orderBy(F.desc("df"), F.asc("term"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.max(F.when(F.col("term") == DOC_SENTINEL, F.col("df"))).over(whole).cast("long")
    ranked = top.select("term", "df", (F.row_number().over(w) - 2).alias("idx"), n.alias("n_docs"))
    vocab = reliable(ranked.where(F.col("term") != DOC_SENTINEL)
                     .select("term", "df", "idx", F.log(F.col("n_docs") / F.col("df")).alias("idf"), "n_docs"), "tfidf-vocab")
    return vocab.drop("n_docs"), vocab.select("n_docs").limit(1)


def top_terms(df_table: DataFrame, min_df: int = K.TFIDF_MIN_DF, max_features: int = K.TFIDF_MAX_FEATURES) -> DataFrame:
    """Vocabulary of a (term, df) table: df ≥ min_df, top ``max_features`` by df
    desc, term asc. The cut is a top-k (TakeOrderedAndProject); the index is
    assigned over the ≤ max_features survivors only."""
    top = (df_table.where(F.col("df") >= min_df)
           .orderBy(F.desc("df"), F.asc("term")).limit(max_features))
    w = Window.orderBy(F.desc("df"), F.asc("term"))
    return top.withColumn("idx", F.row_number().over(w) - 1)


def vocab_tokens(docs: DataFrame, vocab: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Tokens restricted to the vocabulary, with their idf — applied before any
    aggregation, so only vocabulary terms reach a shuffle."""
    return explode_tokens(docs, text_col, keep).join(vocab.select("term", "idf"), "term")


def _normalised(tf: DataFrame, group_col: str, out_group: str, keep: tuple[str, ...] = ()) -> DataFrame:
    # a group (class or document) has at most max_features terms: bounded window
    raw = tf.withColumn("w", F.col("tf") * F.col("idf"))
    raw = raw.withColumn("_norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group_col))))
    return raw.select(F.col(group_col).alias(out_group), *keep, "term",
                      F.when(F.col("_norm") > 0, F.col("w") / F.col("_norm")).otherwise(F.col("w")).alias("weight"))


def document_terms(docs: DataFrame, vocab: DataFrame, text_col: str, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, term, tf, idf) of every document. Vocabulary tokens are dealt
    by document once; counting, the norm and the scores then all work within
    that partitioning. The number of tasks follows from the size of the input, so
    that what one of them holds does not grow with it."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-read_bytes(docs) // TASK_BYTES))
    tokens = vocab_tokens(docs, vocab, text_col, [key, *keep]).repartition(tasks, key)
    return tokens.groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))


def train(train_docs: DataFrame, text_col: str = "text", class_col: str = "category",
          key: str = "doc_id", min_df: int = K.TFIDF_MIN_DF,
          max_features: int = K.TFIDF_MAX_FEATURES, max_rows: int | None = None) -> TfidfModel:
    """``train_docs``: one row per training document with its class and text.
    N counts every training document, also those without tokens.

    ``max_rows`` bounds the labelled rows the fit reads, in key order; None
    (the default) takes all.

    Two passes over the training text: document frequency and N (per-document
    distinct tokens into a per-term count — the map-side combine sends one
    partial count per term and partition through the shuffle, so frequent
    terms do not skew it), then class term counts over vocabulary tokens only
    (≤ classes × max_features groups)."""
    docs = train_docs.select(key, class_col, text_col)
    if max_rows is not None:
        docs = docs.orderBy(key).limit(max_rows)
    vocab, n_docs = vocabulary(docs, text_col, key, min_df, max_features)
    tf = (vocab_tokens(docs, vocab, text_col, [class_col])
          .groupBy(class_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf")))
    return TfidfModel(vocab, reliable(_normalised(tf, class_col, "category"), "tfidf-classes"), n_docs)


def fit_transform(docs: DataFrame, text_col: str = "text", class_col: str = "category",
                  train_col: str = "trainable", key: str = "doc_id", min_df: int = K.TFIDF_MIN_DF,
                  max_features: int = K.TFIDF_MAX_FEATURES) -> tuple[TfidfModel, DataFrame]:
    """Train on the rows flagged ``train_col`` and vectorise every row, with
    two passes over the text: (1) document frequency + N of the training rows,
    (2) vocabulary-filtered (doc, term, tf) of all rows — written to the shared
    folder, far smaller than the text — from which both the class vectors
    (Σ tf of the training rows per class) and the document vectors come."""
    d = docs.select(key, class_col, train_col, text_col)
    vocab, n_docs = vocabulary(d.where(F.col(train_col)), text_col, key, min_df, max_features)
    counted = document_terms(d, vocab, text_col, key, (class_col, train_col))
    doc_tf = reliable(counted.withColumn("w", F.col("tf") * F.col("idf")).withColumn(
        "_norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))), "tfidf-doc-terms")
    class_tf = (doc_tf.where(F.col(train_col)).groupBy(class_col, "term")
                .agg(F.sum("tf").alias("tf"), F.first("idf").alias("idf")))
    vectors = reliable(_normalised(class_tf, class_col, "category"), "tfidf-classes")
    doc_vectors = doc_tf.select(key, "term", F.when(F.col("_norm") > 0, F.col("w") / F.col("_norm")).otherwise(F.col("w")).alias("weight"))
    return TfidfModel(vocab, vectors, n_docs), doc_vectors


def document_vectors(docs: DataFrame, vocab: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, term, weight): tf·idf over vocabulary terms, L2-normalised per
    document (a zero norm leaves the weights as they are)."""
    return _normalised(document_terms(docs, vocab, text_col, key), key, key)


def score(doc_vectors: DataFrame, class_vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cosine similarity (vectors are unit length): sparse dot product as a join
    on term and a sum per (doc, category)."""
    cv = class_vectors.select("category", "term", F.col("weight").alias("cw"))
    return (doc_vectors.join(cv, "term")
            .groupBy(key, "category").agg(F.sum(F.col("weight") * F.col("cw")).alias("score")))


def classify(scores: DataFrame, threshold: float = K.TFIDF_THRESHOLD, key: str = "doc_id") -> DataFrame:
    return (scores.where(F.col("score") >= threshold)
            .select(F.col(key).alias("doc_id"), F.col("category").alias("name"),
                    F.col("score").alias("confidence"), F.lit(K.TFIDF_CLASSIFIER).alias("classifier")))


def save_model(model: TfidfModel, path: str) -> None:
    """Writes the model to a fresh folder below ``path``, then publishes it: readers
    see this model or the one before, whole, also when two jobs save at once."""
    spark = model.vocab.sparkSession
    folder, name = Folder(spark, path), uuid.uuid4().hex
    model.vocab.write.parquet(f"{path}/{name}/vocab")
    model.class_vectors.write.parquet(f"{path}/{name}/class_vectors")
    model.n_docs.write.parquet(f"{path}/{name}/n_docs")
    folder._mark(f"published/{len(folder._names('published')) + 1:08d}.{name}", overwrite=False)


def has_model(spark, path: str) -> bool:
    return bool(Folder(spark, path)._names("published"))


def load_model(spark, path: str) -> TfidfModel:
    """The model published last."""
    name = max(Folder(spark, path)._names("published")).split(".")[1]
    return TfidfModel(spark.read.parquet(f"{path}/{name}/vocab"),
                      spark.read.parquet(f"{path}/{name}/class_vectors"),
                      spark.read.parquet(f"{path}/{name}/n_docs"))
