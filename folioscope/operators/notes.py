"""Markdown notes: file names, bodies, quarantine, and the notes table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def quarantine(docs: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Split rows that can become notes from rows that cannot (id NULL or
    title blank); rejected rows carry a ``reason``."""
    reason = (F.when(F.col(key).isNull(), F.lit("Document ID is required"))
              .when(F.col("title").isNull() | (F.trim(F.col("title")) == ""), F.lit("Document title is required")))
    tagged = docs.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def meta_note_text(meta: Column, tag: str | Column) -> Column:
    t = F.lit(tag) if isinstance(tag, str) else tag
    return F.try_element_at(meta, t)


def tags_line(categories: Column) -> Column:
    names = F.transform(F.coalesce(categories, F.array().cast("array<struct<name:string,confidence:double,classifier:string>>")),
                        lambda c: c["name"])
    return F.array_join(F.concat(names, F.array(F.lit(K.NOTE_TAG))), ", ")


def _section(cond: Column, text: Column) -> Column:
    return F.when(cond, text).otherwise(F.lit(""))


def markdown(docs: DataFrame, note_text: Column | None = None, meta_tag: str | Column | None = K.DEFAULT_NOTE_META_TAG) -> Column:
    """The whole note body as one ``concat`` with conditional sections."""
    fetched = F.date_format(F.col("fetched_at"), ISO_SECONDS)
    cats = F.col("categories")
    has_cats = F.coalesce(F.size(cats) > 0, F.lit(False))
    desc = F.col("description")
    given = note_text if note_text is not None else F.lit(None).cast("string")
    meta_val = meta_note_text(F.col("meta_tags"), meta_tag) if meta_tag is not None else F.lit(None).cast("string")
    note = F.when(F.coalesce(F.trim(given) != "", F.lit(False)), given).when(
        F.coalesce(F.trim(meta_val) != "", F.lit(False)), meta_val)
    cat_lines = F.array_join(F.transform(F.coalesce(cats, F.array()), lambda c: F.concat(
        F.lit("- "), c["name"], F.lit(" (confidence: "), T.confidence_text(c["confidence"]), F.lit(")\n"))), "")
    return F.concat(
        F.lit("---\n"),
        F.lit("source_url: "), F.coalesce(F.col("url"), F.lit("null")), F.lit("\n"),
        F.lit("title: "), F.coalesce(F.col("title"), F.lit("null")), F.lit("\n"),
        F.lit("pdf_id: "), F.col("_id"), F.lit("\n"),
        F.lit("fetchedAt: "), fetched, F.lit("\n"),
        F.lit("tags: ["), tags_line(cats), F.lit("]\n"),
        F.lit("---\n\n"),
        F.lit("# "), F.coalesce(F.col("title"), F.lit("null")), F.lit("\n\n"),
        _section(F.coalesce(F.trim(desc) != "", F.lit(False)), F.concat(F.lit(K.NOTE_HEADINGS["description"]), desc, F.lit("\n\n"))),
        _section(note.isNotNull(), F.concat(F.lit(K.NOTE_HEADINGS["notes"]), F.coalesce(note, F.lit("")), F.lit("\n\n"))),
        F.lit(K.NOTE_HEADINGS["resources"]), T.path_safe_id(F.col("_id")), F.lit(".pdf)\n\n"),
        _section(has_cats, F.concat(F.lit(K.NOTE_HEADINGS["categories"]), cat_lines, F.lit("\n"))),
        F.lit(K.NOTE_HEADINGS["metadata"]), fetched, F.lit("\n"),
        _section(F.col("canonical_url").isNotNull(),
                 F.concat(F.lit(K.NOTE_HEADINGS["canonical"]), F.coalesce(F.col("canonical_url"), F.lit("")), F.lit("\n"))),
        _section(F.col("size_bytes").isNotNull(),
                 F.concat(F.lit(K.NOTE_HEADINGS["size"]), F.coalesce(T.size_text(F.col("size_bytes")), F.lit("")), F.lit("\n"))),
    )


def notes_table(docs: DataFrame, meta_tag: str | None = K.DEFAULT_NOTE_META_TAG,
                note_text: Column | None = None) -> DataFrame:
    """(doc_id, file_name, markdown, pdf_path) for documents that pass the
    note preconditions; a path only for documents with an attachment."""
    ok, _ = quarantine(docs)
    attached = F.col("pdf_name").isNotNull() if "pdf_name" in docs.columns else F.lit(False)
    return ok.select(
        F.col("_id").alias("doc_id"),
        T.note_file_name(F.col("title"), F.col("fetched_at")).alias("file_name"),
        markdown(ok, note_text, meta_tag).alias("markdown"),
        F.when(attached, F.concat(F.lit("pdfs/"), T.path_safe_id(F.col("_id")), F.lit(".pdf"))).alias("pdf_path"),
        F.col("fetched_at"),
    )


def note_title(content: Column, file_name: Column) -> Column:
    """First line after '# ' when the note starts that way, else the file
    name with '.md' removed."""
    first = F.substring_index(content, "\n", 1)
    first = F.regexp_replace(first, r"\r$", "")
    return F.when(first.startswith("# "), F.trim(F.substr(first, F.lit(3)))).otherwise(
        F.replace(file_name, F.lit(".md"), F.lit("")))


# ---------------------------------------------------------------- path guard
def path_is_safe(name: Column) -> Column:
    """File-name guard: no '..', '/' or '\\' in a requested note name."""
    return ~name.rlike(r"\.\.|/|\\")


def normalized_path(path: Column) -> Column:
    """Fold '.' and '..' segments of a relative path; a '..' that would climb
    above the start leaves a leading '..' (which the guard rejects)."""
    segs = F.split(path, "/")
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when((s == ".") | (s == ""), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(s))))
    return F.array_join(folded, "/")


def path_inside_vault(path: Column) -> Column:
    n = normalized_path(path)
    return ~((n == "..") | n.startswith("../"))


# ---------------------------------------------------------------- the notes table
# Notes are rows keyed by document id; the file name is a column, so two notes
# of one title and second stay two notes.
def listing(notes: DataFrame) -> DataFrame:
    """Id, file name, size in bytes, time, and title of every note."""
    return notes.select("doc_id", "file_name", F.octet_length("markdown").cast("long").alias("size"),
                        F.col("fetched_at").alias("modified"), note_title(F.col("markdown"), F.col("file_name")).alias("title"))


def content(notes: DataFrame, names: DataFrame) -> DataFrame:
    """Id, file name and text of the notes with a requested file name."""
    return notes.join(names.select("file_name"), "file_name", "left_semi").select("doc_id", "file_name", F.col("markdown").alias("content"))


def exists(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Every requested ``doc_id`` with a flag."""
    found = notes.select("doc_id", F.lit(True).alias("_hit"))
    return ids.select("doc_id").distinct().join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("_hit", F.lit(False)).alias("exists"))


def delete(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """The notes without those of the given ``doc_id``; missing ids are a no-op."""
    return notes.join(ids.select("doc_id"), "doc_id", "left_anti")
