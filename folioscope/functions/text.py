"""Text, string and number Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- tokens
def tokens(text, stop_words=K.STOP_WORDS, min_len: int = K.MIN_TOKEN_LENGTH) -> Column:
    """Lower-case, split on ASCII non-word characters and '_', keep tokens of
    at least ``min_len`` characters that are not stop words. Accented letters
    are separators, so ``café`` yields ``caf``."""
    parts = F.split(F.lower(F.coalesce(col_(text), F.lit(""))), r"[\W_]+")
    stop = list(stop_words)
    return F.filter(parts, lambda t: (F.length(t) >= min_len) & ~t.isin(stop))


def fold_non_ascii_word_chars(text) -> Column:
    """Replace non-ASCII letters and digits by '_' so that regex word
    boundaries behave the same on every engine and JVM version."""
    return F.regexp_replace(col_(text), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")


def word_count(text) -> Column:
    """Whitespace-separated word count where trailing blanks add nothing and a
    leading blank counts as one (empty) word."""
    return F.size(F.split(F.regexp_replace(col_(text), r"\s+$", ""), r"\s+"))


# ---------------------------------------------------------------- builders
def _part(c) -> Column:
    return F.coalesce(F.concat(col_(c), F.lit(" ")), F.lit(""))


def meta_values_text(meta) -> Column:
    """Each meta value followed by one space (maps are built key-sorted)."""
    m = col_(meta)
    vals = F.map_values(m)
    return F.when(m.isNull() | (F.size(vals) == 0), F.lit("")).otherwise(
        F.concat(F.array_join(vals, " "), F.lit(" ")))


def body_text(text) -> Column:
    return F.coalesce(col_(text), F.lit(""))


def rules_text(title, description, url, meta) -> Column:
    return F.concat(_part(title), _part(description), _part(url), meta_values_text(meta))


def density_text(title, description, url, meta) -> Column:
    return F.lower(F.concat(_part(title), _part(description), meta_values_text(meta), _part(url)))


def tfidf_text(title, description, meta, body) -> Column:
    return F.concat(_part(title), _part(description), meta_values_text(meta),
                    F.coalesce(col_(body), F.lit("")))


# ---------------------------------------------------------------- urls
def url_domain(url) -> Column:
    u = col_(url)
    d = F.regexp_replace(u, r"^https?://", "")
    d = F.regexp_replace(d, r"^www\.", "")
    d = F.regexp_replace(d, r"/.*$", "")
    return F.coalesce(F.lower(d), F.lit(""))


def url_check(url) -> Column:
    """Syntactic URL check → NULL when valid, else the rejection message.

    The whole text must be a URI reference; one without a scheme is well
    formed, but not accepted. The scheme must be exactly ``http`` or ``https``
    (case-sensitive)."""
    u = col_(url)
    return (
        F.when(u.isNull() | (F.trim(u) == ""), F.lit(K.MSG_URL_REQUIRED))
        .when(~u.rlike(K.URI_REFERENCE), F.lit(K.MSG_BAD_FORMAT))
        .when(~u.rlike(r"^https?:"), F.lit(K.MSG_BAD_SCHEME))
    )


def fetch_outcome(status, reason) -> Column:
    s = col_(status)
    return (
        F.when((s >= 200) & (s < 400), F.lit(K.MSG_ACCESSIBLE))
        .when((s >= 400) & (s < 500), F.concat(F.lit("Client error: "), s.cast("string"), F.lit(" "), F.coalesce(col_(reason), F.lit(""))))
        .otherwise(F.concat(F.lit("Server error: "), s.cast("string"), F.lit(" "), F.coalesce(col_(reason), F.lit(""))))
    )


# ---------------------------------------------------------------- file names
def stored_file_base(title) -> Column:
    """Stored PDF base name: bad characters and whitespace to '_', runs of '_'
    collapsed, cut to 100, one trailing '_' dropped, blank → 'document'.
    Written as one linear chain (no sub-expression repeated in branches)."""
    s = F.regexp_replace(col_(title), K.STORED_NAME_BAD, "_")
    s = F.regexp_replace(s, r"\s+", "_")
    s = F.regexp_replace(s, r"_+", "_")
    s = F.substring(F.trim(s), 1, K.STORED_NAME_MAX)
    s = F.regexp_replace(s, r"_$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(K.DEFAULT_FILE_BASE))


def stored_file_name(title) -> Column:
    return F.concat(stored_file_base(title), F.lit(".pdf"))


def download_file_name(pdf_name) -> Column:
    n = F.coalesce(F.nullif(col_(pdf_name), F.lit("")), F.lit("document.pdf"))
    s = F.regexp_replace(n, K.DOWNLOAD_NAME_BAD, "_")
    s = F.regexp_replace(s, r"_+", "_")
    # append '.pdf' unless present (case-insensitive), then cut to 96 + '.pdf'
    s = F.regexp_replace(s, r"^(.*?)(?<!(?i)\.pdf)$", "$1.pdf")
    return F.regexp_replace(s, r"^(.{%d}).{5,}$" % (K.DOWNLOAD_NAME_MAX - 4), "$1.pdf")


def link_file_name(pdf_name) -> Column:
    n = F.coalesce(col_(pdf_name), F.lit("document.pdf"))
    return F.substring(F.regexp_replace(n, K.LINK_NAME_BAD, "_"), 1, K.LINK_NAME_MAX)


def path_safe_id(doc_id) -> Column:
    return F.replace(col_(doc_id), F.lit("|"), F.lit("-"))


def note_file_name(title, fetched_at) -> Column:
    s = F.regexp_replace(col_(title), K.NOTE_NAME_BAD, "")
    s = F.lower(F.regexp_replace(s, r"\s+", "_"))
    s = F.substring(s, 1, K.NOTE_TITLE_MAX)
    return F.concat(s, F.lit("_"), F.date_format(col_(fetched_at), "yyyyMMdd_HHmmss"), F.lit(".md"))


# ---------------------------------------------------------------- numbers
def size_text(nbytes) -> Column:
    """``N B`` below 1 KiB, else one decimal with K/M/G/T/P/E; the unit is
    chosen by comparing with powers of 1024 (exact, no float log)."""
    b = col_(nbytes).cast("long")
    chain = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
    units = list(K.SIZE_UNITS)
    for k, u in enumerate(units, start=1):
        lo = 1024 ** k
        cond = (b >= lo) if k == len(units) else (b < lo * 1024)
        chain = chain.when(cond, F.format_string("%.1f %sB", b / F.lit(float(lo)), F.lit(u)))
    return chain


def size_label(nbytes) -> Column:
    """Listing label: ``0 Bytes``; else the value in Bytes/KB/MB rounded to
    two decimals without trailing zeros (``1.5 KB``, ``2 MB``). Sizes of a
    GiB and more stay in MB (the unit list ends there)."""
    b = col_(nbytes).cast("long")
    unit_exp = F.when(b < 1024, F.lit(0)).when(b < 1024 * 1024, F.lit(1)).otherwise(F.lit(2))
    value = F.round(b / F.pow(F.lit(1024.0), unit_exp), 2)
    text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    unit = F.element_at(F.array(F.lit("Bytes"), F.lit("KB"), F.lit("MB")), unit_exp + 1)
    return F.when(b == 0, F.lit("0 Bytes")).otherwise(F.concat(text, F.lit(" "), unit))


def confidence_text(conf) -> Column:
    """Two decimals, half-up on the decimal text."""
    return F.format_string("%.2f", col_(conf))


def elapsed_text(start, end) -> Column:
    """Whole seconds between two instants, rounded half up, plus 's'.
    ``timestamp_diff`` works on TIMESTAMP_NTZ without any time-zone shift."""
    us = F.timestamp_diff("MICROSECOND", col_(start), col_(end))
    return F.concat(F.round(us / F.lit(1_000_000.0)).cast("long").cast("string"), F.lit("s"))
