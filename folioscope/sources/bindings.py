"""Logical inputs of the catalog, derived by Spark from the driver tables.

Each binding is a lazy projection (no shuffle) of one table, so its work
grows with the table. The SQL oracle builds the same frames with the same
rules (see ``folioscope.plans.oracle``).

* ``corpus``        – stored documents, from ``documents``
* ``crawled``       – documents extracted from raw ``pages`` HTML
* ``meta_pages``    – HTML composed from ``documents`` that carries meta tags,
                      Open Graph tags, canonical links, duplicates, empty titles
                      and missing HTML, so every extraction branch is exercised
* ``ingest_requests`` – URL requests from ``pages`` with option columns and a
                      fetch status (the reachability probe's answer)
* ``step_log``      – per-document step events, from ``events``
* ``page_texts``    – numbered page texts, from ``conversations``
* ``predictions``   – external model responses (JSON), composed from ``documents``
* ``attachments``   – binary attachments, from ``documents`` and ``pages``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import html as H
from ..functions import text as T
from .tables import read_table

EPOCH_2024 = "2024-01-01 00:00:00"  # UTC wall clock, as TIMESTAMP_NTZ


def _at_seconds(seconds: Column) -> Column:
    """EPOCH_2024 + seconds as TIMESTAMP_NTZ: independent of the session time zone."""
    return F.timestamp_add("SECOND", seconds, F.to_timestamp_ntz(F.lit(EPOCH_2024)))

# Step names of the event log in pipeline order; 'error' marks a failed step.
EVENT_STEPS = ["view", "click", "signup", "purchase"]
EVENT_FAILURE = "error"


def _doc_url(source: Column, lang: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(".example.com/"), lang, F.lit("/"), doc_id.cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents: title = first line, description = second line,
    one imported category (the language), PDF only for texts of ≥ 200 chars."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    title = F.substring_index(F.col("text"), "\n", 1)
    return d.select(
        F.concat(F.lit("doc|"), F.col("doc_id").cast("string")).alias("_id"),
        F.col("doc_id"),
        F.lit(1).alias("_rev"),
        F.lit("document").alias("type"),
        _doc_url(F.col("source"), F.col("lang"), F.col("doc_id")).alias("url"),
        _doc_url(F.col("source"), F.col("lang"), F.col("doc_id")).alias("canonical_url"),
        title.alias("title"),
        F.nullif(F.regexp_extract(F.col("text"), r"^[^\n]*\n([^\n]*)", 1), F.lit("")).alias("description"),
        F.create_map(F.lit("language"), F.col("lang")).alias("meta_tags"),
        _at_seconds(F.col("doc_id")).alias("fetched_at"),
        F.when(F.col("n_chars") >= 200, T.stored_file_name(title)).alias("pdf_name"),
        F.col("n_chars").alias("size_bytes"),
        F.array(F.struct(F.col("lang").alias("name"), F.lit(1.0).alias("confidence"),
                         F.lit("import").alias("classifier"))).alias("categories"),
        F.lit("STORED").alias("status"),
        F.col("text").alias("body"),
        F.col("lang"),
        F.col("source"),
    )


def extract_pages(pages: DataFrame, id_prefix: str = "doc|p", keep: tuple = ()) -> DataFrame:
    """Raw pages (page_id, url, html) → document metadata columns (plus the
    ``keep`` columns carried through)."""
    found = H.with_metadata(pages.select("page_id", "url", "html", *(c for c in keep if c not in ("page_id", "url", "html"))))
    return found.select(
        *keep,
        F.concat(F.lit(id_prefix), F.col("page_id").cast("string")).alias("_id"),
        *(c for c in ("page_id", "url") if c not in keep),
        "title", "description", "canonical_url", "meta_tags",
        _at_seconds(F.col("page_id") * 60).alias("fetched_at"),
        F.length(F.col("html")).cast("long").alias("size_bytes"))


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def meta_pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML composed from documents; the variant is picked by doc_id mod 8."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    did = F.col("doc_id").cast("string")
    title = F.substring_index(F.col("text"), "\n", 1)
    v = F.col("doc_id") % 8
    html = (
        F.when(v == 0, F.concat(
            F.lit("<html><head><title>"), title, F.lit("</title><meta name=\"description\" content=\"About "),
            F.col("source"), F.lit("\"><meta name=\"language\" content=\""), F.col("lang"),
            F.lit("\"></head><body><p>"), title, F.lit("</p></body></html>")))
        .when(v == 1, F.concat(
            F.lit("<html><head><TITLE>"), title, F.lit("</TITLE><meta property=\"og:description\" content=\"OG "),
            F.col("lang"), F.lit("\"><meta property='og:url' content='https://canon.example.org/"), did,
            F.lit("'></head></html>")))
        .when(v == 2, F.concat(
            F.lit("<html><head><!-- <title>hidden</title> --><title>\n  "), title,
            F.lit("  </title><link href='https://canon.example.org/"), did,
            F.lit("' rel=\"canonical\"><meta content=1 name=k><meta name=\"k\" content=\""), F.col("source"),
            F.lit("\"><meta name=\"e\" content=\"\"><meta content='D &amp; "), F.col("lang"),
            F.lit("' name=description></head></html>")))
        .when(v == 3, F.lit("<html><head><title>   </title><script>var t='<title>x</title>';</script></head><body>no title</body></html>"))
        .when(v == 5, F.concat(
            F.lit("<html><head><title>Caf&eacute; &#8217;s &#x27;x &amp;lt; &bogus; &#0;</title><meta name=\"description\" content=\"Home > "),
            F.col("source"), F.lit("\"><meta content=\"set name=foo here\" property=\"og:x\"><meta name=\"a\"content=\""), F.col("lang"),
            F.lit("\"><link rel=\" Canonical \" href=\"https://canon.example.org/?a=1&amp;b="), did,
            F.lit("\"><meta name=bare content=it's><meta name=slash content=b/></head></html>")))
        .when(v == 6, F.concat(
            F.lit("<html><head><title>a&nbsp;b &euro;</title><meta name=description><meta NAME='Description' CONTENT='second &quot;"),
            F.col("lang"), F.lit("&quot;'><meta name=dup content=1 content=2><meta name=dup content=3><meta property=p name='' content=v>"
                                 "<script>document.write('<meta name=no content=no>')"), did))
        .when(v == 7, F.concat(
            F.lit("<html><head><title>Many</title>"),
            F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(
                F.lit("<meta name=k"), (i % 40).cast("string"), F.lit(" content='"), i.cast("string"), F.lit(" "), F.col("source"), F.lit("'>"))), ""),
            F.lit("</head></html>")))
    )
    return d.select(F.col("doc_id").alias("page_id"),
                    _doc_url(F.col("source"), F.col("lang"), F.col("doc_id")).alias("url"),
                    html.alias("html"))


def topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title names a share of the keywords of a built-in rule,
    on a domain of the rule: the category is picked by doc_id, the last
    ``doc_id mod 7`` keywords are left out."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    title, host = F.lit(None).cast("string"), F.col("source")
    for i, (name, words) in enumerate(K.DEFAULT_KEYWORD_RULES.items()):
        mine = F.col("doc_id") % len(K.DEFAULT_KEYWORD_RULES) == i
        kept = F.slice(F.array(*map(F.lit, words)), F.lit(1), F.lit(len(words)) - (F.col("doc_id") % 7).cast("int"))
        title = F.when(mine, F.array_join(kept, " ")).otherwise(title)
        if K.DEFAULT_DOMAIN_RULES.get(name):
            host = F.when(mine, F.lit(K.DEFAULT_DOMAIN_RULES[name][0])).otherwise(host)
    return d.select(F.concat(F.lit("doc|t"), F.col("doc_id").cast("string")).alias("_id"), title.alias("title"),
                    F.concat(F.lit("https://"), host, F.lit("/x")).alias("url"))


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(meta_pages_html(spark, sf_dir), id_prefix="doc|m")


def request_columns(pages: DataFrame) -> DataFrame:
    """Requests built from pages (page_id, url, html): mostly the crawl URL,
    with some malformed or non-HTTP variants; create_note off for every third
    page; fetch status as the reachability probe would report it."""
    v = F.col("page_id") % 10
    url = (F.when(v == 5, F.concat(F.lit("HTTP"), F.substr(F.col("url"), F.lit(5))))
           .when(v == 6, F.regexp_replace(F.col("url"), r"^https?", "ftp"))
           .when(v == 7, F.regexp_replace(F.col("url"), r"\.example\.", ".exa mple."))
           .when(v == 8, F.lit(""))
           .when(v == 9, F.regexp_replace(F.col("url"), r"^https?://", ""))
           .when(v == 4, F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, F.lit("/%zz")).when(
               F.col("page_id") % 3 == 1, F.lit("/[x]")).otherwise(F.lit("/%7Ex?[y]"))))
           .when((v == 3) & (F.col("page_id") % 4 == 1), F.lit("http://"))
           .otherwise(F.col("url")))
    status = (F.when(F.col("page_id") % 11 == 4, F.lit(404))
              .when(F.col("page_id") % 13 == 9, F.lit(503))
              .when(F.col("page_id") % 17 == 3, F.lit(301))
              .otherwise(F.lit(200)))
    return pages.select(
        F.col("page_id"), url.alias("url"), F.col("html"),
        (F.col("page_id") % 3 != 0).alias("create_note"),
        F.when(F.col("page_id") % 2 == 0, F.lit(K.DEFAULT_NOTE_META_TAG)).otherwise(F.lit("language")).alias("note_meta_tag"),
        status.alias("http_status"))


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_columns(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def http_reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.HTTP_REASONS, "http_status int, reason string")


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_type").alias("step"),
        (F.col("event_type") != EVENT_FAILURE).alias("success"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        F.col("ts").alias("at"),
        F.col("event_id"),
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.col("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External model responses (JSON-RPC text) per document: one in five
    carries an error, one in seven a null model, a few are malformed."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"])
    did = F.col("doc_id").cast("string")
    c1 = F.concat(F.lit("0."), F.lpad((F.col("n_chars") % 100).cast("string"), 2, "0"))
    c2 = F.concat(F.lit("0."), F.lpad((F.col("doc_id") % 97).cast("string"), 2, "0"))
    model = F.when(F.col("doc_id") % 7 == 0, F.lit("null")).otherwise(F.lit("\"m1\""))
    ok = F.concat(
        F.lit("{\"jsonrpc\":\"2.0\",\"id\":\"r"), did, F.lit("\",\"result\":{\"model\":"), model,
        F.lit(",\"confidence\":0.5,\"categories\":[{\"name\":\""), F.col("lang"), F.lit("\",\"confidence\":"), c1,
        F.lit(",\"reasoning\":\"language\"},{\"name\":\"Technology\",\"confidence\":"), c2,
        F.lit(",\"reasoning\":\"topic\"}]}}"))
    err = F.concat(F.lit("{\"jsonrpc\":\"2.0\",\"id\":\"r"), did,
                   F.lit("\",\"error\":{\"code\":-32000,\"message\":\"model busy "), did, F.lit("\"}}"))
    resp = (F.when(F.col("doc_id") % 5 == 0, err)
            .when(F.col("doc_id") % 23 == 11, F.concat(F.lit("{\"jsonrpc\":\"2.0\",\"result\":"), did))
            .otherwise(ok))
    return d.select(F.concat(F.lit("doc|"), did).alias("doc_id"), resp.alias("response"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF stand-ins: document text bytes for documents that have a PDF name,
    plus page HTML bytes keyed by page ids (which are not in the corpus)."""
    docs = corpus(spark, sf_dir).where(F.col("pdf_name").isNotNull())
    a = docs.select(F.col("_id").alias("doc_id"), F.col("pdf_name").alias("name"),
                    F.lit("application/pdf").alias("content_type"),
                    F.encode(F.col("body"), "UTF-8").alias("data"))
    p = read_table(spark, sf_dir, "pages", ["page_id", "html"]).select(
        F.concat(F.lit("doc|p"), F.col("page_id").cast("string")).alias("doc_id"),
        F.lit("page.pdf").alias("name"), F.lit("application/pdf").alias("content_type"),
        F.encode(F.col("html"), "UTF-8").alias("data"))
    return a.unionByName(p).withColumn("length", F.octet_length(F.col("data")).cast("long"))
