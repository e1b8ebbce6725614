"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (through ``sources.bindings``) and runs
over whole tables; limits appear only where paging or a top-k is the
feature itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import catalog, rules
from ..sources import bindings as B
from ..sources.tables import table_landing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- flagship
@query("category_counts")
def category_counts(spark, sf_dir):
    """pages → title/description/meta → density text → density classes →
    documents per category with descriptions."""
    docs = B.crawled(spark, sf_dir)
    assigned = rules.density_classify(docs)
    return catalog.category_counts(assigned).select("name", "document_count", "description")


# ---------------------------------------------------------------- page metadata
@query("page_title")
def page_title(spark, sf_dir):
    return B.crawled(spark, sf_dir).select("_id", "title")


@query("page_description")
def page_description(spark, sf_dir):
    return B.meta_pages(spark, sf_dir).select("_id", "description")


@query("page_canonical")
def page_canonical(spark, sf_dir):
    return B.meta_pages(spark, sf_dir).select("_id", "canonical_url")


@query("page_meta_tags")
def page_meta_tags(spark, sf_dir):
    # explode_outer: the filter that explode implies would build the map once more
    tags = B.meta_pages(spark, sf_dir).select("_id", F.explode_outer("meta_tags").alias("key", "value"))
    return tags.where("key IS NOT NULL")


@query("page_fallback")
def page_fallback(spark, sf_dir):
    from ..functions import html as H
    raw = B.meta_pages_html(spark, sf_dir).where(H.is_blank(F.col("html")))
    return B.extract_pages(raw, id_prefix="doc|m").select(
        "_id", "title", "description", "canonical_url", F.col("meta_tags").isNull().alias("meta_missing"))


@query("meta_note_text")
def meta_note_text(spark, sf_dir):
    from ..operators import notes as N
    d = B.meta_pages(spark, sf_dir)
    return d.select("_id", N.meta_note_text(F.col("meta_tags"), "language").alias("note_language"),
                    N.meta_note_text(F.col("meta_tags"), "k").alias("note_k"),
                    N.meta_note_text(F.col("meta_tags"), K.DEFAULT_NOTE_META_TAG).alias("note_default"))


# ---------------------------------------------------------------- text functions
@query("tokenize")
def tokenize(spark, sf_dir):
    from ..operators import tfidf
    d = B.read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return (tfidf.explode_tokens(d, "text", ["doc_id"])
            .groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("long").alias("tf")))


@query("text_builders")
def text_builders(spark, sf_dir):
    d = B.corpus(spark, sf_dir)
    return d.select("_id",
                    T.rules_text("title", "description", "url", "meta_tags").alias("rules_text"),
                    T.density_text("title", "description", "url", "meta_tags").alias("density_text"),
                    T.tfidf_text("title", "description", "meta_tags", "body").alias("tfidf_text"))


@query("body_text")
def body_text(spark, sf_dir):
    """T4: the whole body text, uncut; null is empty."""
    d = B.read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    c = T.body_text(F.col("text"))
    return d.select("doc_id", F.length(c).cast("long").alias("body_length"), F.md5(c.cast("binary")).alias("body_md5"))


PAGE_RANGE = (2, 4)


@query("page_range_text")
def page_range_text(spark, sf_dir):
    """Text of pages [start, min(end, n)] per document, in page order; the
    collected list is bounded by the range width, not the document size."""
    start, end = PAGE_RANGE
    p = B.page_texts(spark, sf_dir)
    in_range = F.col("page_no").between(start, end)
    agg = p.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("long").alias("page_count"),
        F.array_sort(F.collect_list(F.when(in_range, F.struct("page_no", "text")))).alias("_p"))
    return agg.select("doc_id", "page_count",
                      F.lit(start).alias("start_page"), F.least(F.lit(end), F.col("page_count")).cast("long").alias("end_page"),
                      F.array_join(F.transform("_p", lambda x: x["text"]), "\n").alias("text"))


@query("page_count")
def page_count(spark, sf_dir):
    d = B.read_table(spark, sf_dir, "documents", ["doc_id"])
    n = B.page_texts(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("page_count"))
    return d.join(n, "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"))


@query("url_domain")
def url_domain(spark, sf_dir):
    p = B.read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return p.select("page_id", T.url_domain("url").alias("domain"))


@query("safe_filenames")
def safe_filenames(spark, sf_dir):
    d = B.corpus(spark, sf_dir)
    return d.select("_id", T.stored_file_name("title").alias("stored_name"),
                    T.download_file_name("pdf_name").alias("download_name"),
                    T.link_file_name("pdf_name").alias("link_name"),
                    T.path_safe_id("_id").alias("safe_id"))


@query("note_file_name")
def note_file_name(spark, sf_dir):
    d = B.corpus(spark, sf_dir)
    return d.select("_id", T.note_file_name("title", "fetched_at").alias("file_name"))


@query("format_size")
def format_size(spark, sf_dir):
    d = B.read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    size = F.expr("shiftleft(n_chars, CAST((doc_id % 5) * 10 AS INT))") + F.col("doc_id")
    return d.select("doc_id", size.alias("size_bytes")).select(
        "doc_id", "size_bytes", T.size_text("size_bytes").alias("size_text"), T.size_label("size_bytes").alias("size_label"))


@query("note_tags")
def note_tags(spark, sf_dir):
    from ..operators import notes as N
    return B.corpus(spark, sf_dir).select("_id", N.tags_line(F.col("categories")).alias("tags"))


@query("note_title")
def note_title(spark, sf_dir):
    """Title from a note's first line ('# ' heading) or its file name; run over
    generated notes (front matter first) and heading-first notes."""
    from ..operators import notes as N
    d = B.corpus(spark, sf_dir)
    gen = N.notes_table(d, meta_tag=None).select(F.col("doc_id").alias("_id"), "file_name", "markdown")
    plain = d.select("_id", T.note_file_name("title", "fetched_at").alias("file_name"),
                     F.concat(F.lit("# "), F.col("title"), F.lit(" \n"), F.col("body")).alias("markdown"))
    both = (gen.withColumn("kind", F.lit("generated"))
            .unionByName(plain.withColumn("kind", F.lit("plain"))))
    return both.select("_id", "kind", N.note_title(F.col("markdown"), F.col("file_name")).alias("title"))


@query("step_duration")
def step_duration(spark, sf_dir):
    s = B.step_log(spark, sf_dir)
    g = s.groupBy("doc_id").agg(F.min("at").alias("started"), F.max("at").alias("ended"))
    return g.select("doc_id", T.elapsed_text("started", "ended").alias("elapsed"))


# ---------------------------------------------------------------- predicates
SEARCH_TERM = "Src1"


#: A table of queries for the index: literal wild cards, other letters, short ones.
INDEX_QUERIES = ["Src1", "src3.example", "%", "_", "the ", "tion", "\u00e9", "stra\u00dfe", "a%b", "doc", "and the", "/en/", "zzzz", "ThOn", "be"]


def _trigram_index(spark, sf_dir):
    import uuid

    from ..operators.trigram_index import TrigramIndex
    from ..session import shared_path
    return TrigramIndex.build(B.corpus(spark, sf_dir), shared_path(spark, "trigrams", uuid.uuid4().hex))


@query("search_index")
def search_index(spark, sf_dir):
    """P1 through the trigram index: every match of a table of queries."""
    queries = spark.createDataFrame([(q,) for q in INDEX_QUERIES], "q string")
    return _trigram_index(spark, sf_dir).search_all(queries)


@query("search_index_page")
def search_index_page(spark, sf_dir):
    """W3 through the trigram index: a page of the matches of one query."""
    from ..operators import search as S
    return S.page(_trigram_index(spark, sf_dir).search(SEARCH_TERM), offset=2 * PAGE_SIZE, size=PAGE_SIZE)


@query("search_documents")
def search_documents(spark, sf_dir):
    from ..operators import search as S
    return S.search(B.corpus(spark, sf_dir), SEARCH_TERM).select("_id", "url", "title")


CATEGORY_NAME = "fr"


@query("documents_by_category")
def documents_by_category(spark, sf_dir):
    from ..operators import search as S
    return S.by_category(B.corpus(spark, sf_dir), CATEGORY_NAME).select("_id", "title")


@query("documents_by_assignment")
def documents_by_assignment(spark, sf_dir):
    """P2 over long-form assignments: a semi join with the assignments that
    carry the name (here the external model's predictions)."""
    from ..operators import predictions as P
    from ..operators import search as S
    preds = P.predictions(B.predictions(spark, sf_dir))
    return S.by_category_long(B.corpus(spark, sf_dir), preds, "Technology").select("_id", "title")


@query("trainable_documents")
def trainable_documents(spark, sf_dir):
    from ..operators import search as S
    return S.trainable(B.corpus(spark, sf_dir)).select("_id", "pdf_name")


@query("url_validation")
def url_validation(spark, sf_dir):
    r = B.ingest_requests(spark, sf_dir)
    msg = T.url_check("url")
    return r.select("page_id", "url", msg.isNull().alias("valid"),
                    F.coalesce(msg, F.lit(K.MSG_ACCESSIBLE)).alias("message"))


@query("fetch_outcome")
def fetch_outcome(spark, sf_dir):
    r = B.ingest_requests(spark, sf_dir).join(F.broadcast(B.http_reasons(spark)), "http_status", "left")
    return r.select("page_id", "http_status",
                    ((F.col("http_status") >= 200) & (F.col("http_status") < 400)).alias("accessible"),
                    T.fetch_outcome("http_status", "reason").alias("message"))


@query("note_quarantine")
def note_quarantine(spark, sf_dir):
    from ..functions import html as H
    from ..operators import notes as N
    raw = B.meta_pages_html(spark, sf_dir)
    docs = raw.select(F.concat(F.lit("doc|m"), F.col("page_id").cast("string")).alias("_id"),
                      F.when(~H.is_blank(F.col("html")), H.raw_title(H.strip_blocks(F.col("html")))).alias("title"))
    ok, bad = N.quarantine(docs)
    return (ok.select("_id", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select("_id", F.lit("rejected").alias("status"), "reason")))


def _path_candidates(spark, sf_dir):
    d = B.corpus(spark, sf_dir).select("doc_id", T.note_file_name("title", "fetched_at").alias("name"))
    v = F.col("doc_id") % 6
    cand = (F.when(v == 1, F.concat(F.lit("../"), F.col("name")))
            .when(v == 2, F.concat(F.lit("a/./"), F.col("name")))
            .when(v == 3, F.concat(F.lit("a/../"), F.col("name")))
            .when(v == 4, F.concat(F.lit("a/../../etc/"), F.col("name")))
            .when(v == 5, F.concat(F.lit("x\\"), F.col("name")))
            .otherwise(F.col("name")))
    return d.select("doc_id", cand.alias("candidate"))


@query("path_guard")
def path_guard(spark, sf_dir):
    from ..operators import notes as N
    c = _path_candidates(spark, sf_dir)
    return c.select("doc_id", "candidate", N.path_is_safe(F.col("candidate")).alias("name_ok"),
                    N.normalized_path(F.col("candidate")).alias("normalized"),
                    N.path_inside_vault(F.col("candidate")).alias("inside_vault"))


def _category_name_inputs(spark, sf_dir):
    d = B.read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    v = F.col("doc_id") % 6
    name = (F.when(v == 0, F.lit("technology")).when(v == 1, F.lit("NEWSPAPER_ARTICLE"))
            .when(v == 2, F.lit("Technology Update")).when(v == 3, F.col("lang"))
            .when(v == 4, F.lit(None).cast("string")).otherwise(F.lit("simple article")))
    return d.select("doc_id", name.alias("name"))


@query("normalize_category")
def normalize_category(spark, sf_dir):
    n = catalog.normalize_category(_category_name_inputs(spark, sf_dir))
    return n.select("doc_id", "name", "category_key", "category_display")


@query("category_descriptions")
def category_descriptions(spark, sf_dir):
    n = catalog.normalize_category(_category_name_inputs(spark, sf_dir))
    names = (n.select(F.col("category_display").alias("name"))
             .unionByName(B.read_table(spark, sf_dir, "documents", ["lang"]).select(F.col("lang").alias("name")))
             .distinct())
    return catalog.with_description(names).select("name", "description")


@query("ingest_response")
def ingest_response(spark, sf_dir):
    d = B.crawled(spark, sf_dir)
    return d.select(F.col("_id").alias("id"), F.lit("STORED").alias("status"),
                    F.concat(F.lit(K.PDF_URL_PREFIX), F.col("_id"), F.lit(K.PDF_URL_SUFFIX)).alias("pdf_url"))


# ---------------------------------------------------------------- store
def store_records(spark, sf_dir) -> DataFrame:
    """One store mixing record kinds: documents and category records."""
    d = B.corpus(spark, sf_dir)
    docs = d.select("_id", "type", F.lit(None).cast("string").alias("name"), "title", "url", "status",
                    F.lit(None).cast("long").alias("document_count"))
    cats = (d.groupBy("lang").agg(F.count(F.lit(1)).cast("long").alias("document_count"))
            .select(F.concat(F.lit("category|"), F.col("lang")).alias("_id"), F.lit("category").alias("type"),
                    F.col("lang").alias("name"), F.lit(None).cast("string").alias("title"),
                    F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("status"),
                    "document_count"))
    return docs.unionByName(cats)


def stored_records(spark, sf_dir) -> DataFrame:
    """The store as a table sorted by id, so that filters on type and id prefix
    reach the files."""
    from ..session import reliable
    return reliable(store_records(spark, sf_dir).repartitionByRange("_id").sortWithinPartitions("_id"), "store")


@query("scan_documents")
def scan_documents(spark, sf_dir):
    from ..operators import store as S
    return S.scan_documents(stored_records(spark, sf_dir)).select("_id", "title", "url", "status")


@query("scan_categories")
def scan_categories(spark, sf_dir):
    from ..operators import store as S
    return S.scan_categories(stored_records(spark, sf_dir)).select("_id", "name", "document_count")


def _json_lines(spark, sf_dir) -> DataFrame:
    """The corpus as JSON lines (stand-in input): documents, some with a field that no
    schema names, some cut off, mistyped, of another type or without id; a
    category per language and one with a foreign field per source."""
    d = B.corpus(spark, sf_dir)
    k, extra = F.col("doc_id") % 10, F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    record = F.to_json(F.struct(F.when(k != 4, F.col("_id")).alias("_id"), "_rev", F.when(k == 3, "attachment").otherwise("document").alias("type"),
                                "url", "title", F.col("meta_tags").alias("metaTags"), F.col("size_bytes").alias("sizeBytes"), "categories",
                                F.col("pdf_name").alias("pdfAttachmentName"), "status", extra.alias("crawledBy")))
    cut = F.concat(F.lit('{"_id":"'), "_id", F.lit('","type":"document","title":'))
    typed = F.concat(F.lit('{"_id":"'), "_id", F.lit('","type":"document","sizeBytes":"many"}'))
    blank = F.when(F.col("doc_id") % 20 == 5, F.lit("  "))
    docs = d.select(F.when(k == 1, cut).when(k == 2, typed).otherwise(F.coalesce(blank, record)).alias("value"))
    def category(name, more):
        return F.concat(F.lit('{"_id":"category|'), name, F.lit('","type":"category","name":"'), name, F.lit('","documentCount":'),
                        F.count(F.lit(1)).cast("string"), F.lit(more))
    langs = d.groupBy("lang").agg(category("lang", "}").alias("value")).select("value")
    sources = d.groupBy("source").agg(category("source", ',"colour":"red"}').alias("value")).select("value")
    return docs.unionByName(langs).unionByName(sources)


def _json_records(spark, sf_dir):
    import uuid

    from ..session import shared_path
    from ..sources.json_records import read_records
    path = shared_path(spark, "landing", uuid.uuid4().hex)
    _json_lines(spark, sf_dir).write.option("compression", "gzip").text(path)
    return read_records(spark, path)


@query("json_documents")
def json_documents(spark, sf_dir):
    """S1 from JSON lines: the documents, unknown fields ignored."""
    return _json_records(spark, sf_dir).documents.select(
        "_id", F.col("_rev").cast("int").alias("_rev"), "title", "url", F.col("size_bytes").cast("long").alias("size_bytes"),
        F.col("meta_tags")["language"].alias("language"), F.col("categories")[0]["name"].alias("category"), "pdf_name")


@query("json_categories")
def json_categories(spark, sf_dir):
    """S2 from JSON lines: the categories without fields of their own."""
    return _json_records(spark, sf_dir).categories.select("_id", "name", "document_count")


@query("json_rejects")
def json_rejects(spark, sf_dir):
    """S1 from JSON lines: how many lines were rejected for which reason, and their id where one can be read."""
    found = F.nullif(F.regexp_extract("line", r'^\{"_id":"([^"]*)"', 1), F.lit(""))
    return _json_records(spark, sf_dir).rejects.groupBy("reason", found.alias("_id")).agg(F.count(F.lit(1)).alias("times"))


def _lookup_keys(spark, sf_dir):
    e = B.read_table(spark, sf_dir, "events", ["user_id"])
    return e.select(F.concat(F.lit("doc|"), F.col("user_id").cast("string")).alias("_id"))


@query("lookup_documents")
def lookup_documents(spark, sf_dir):
    from ..operators import store as S
    return S.lookup(B.corpus(spark, sf_dir), _lookup_keys(spark, sf_dir))


def _changes(spark, sf_dir):
    lab = B.read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    upd = lab.select(F.concat(F.lit("doc|"), F.col("doc_id").cast("string")).alias("_id"),
                     F.col("quality").alias("_rev"),
                     F.concat(F.lit("labelled "), F.col("doc_id").cast("string")).alias("title"))
    pg = B.read_table(spark, sf_dir, "pages", ["page_id", "url"])
    ins = pg.select(F.concat(F.lit("doc|p"), F.col("page_id").cast("string")).alias("_id"),
                    F.lit(None).cast("int").alias("_rev"), F.col("url").alias("title"))
    # every fifth label comes a second time with the same revision: too late
    again = upd.where(lab["doc_id"] % 5 == 0).withColumn("title", F.concat(F.lit("again "), F.col("title")))
    return upd.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2))).unionByName(ins.withColumn("seq", F.lit(1)))


@query("upsert_documents")
def upsert_documents(spark, sf_dir):
    from ..operators import store as S
    base = B.corpus(spark, sf_dir).select("_id", "_rev", "title")
    out, _ = S.upsert(base, _changes(spark, sf_dir), order=("seq",))
    return out.select("_id", F.col("_rev").cast("int").alias("_rev"), "title")


@query("upsert_conflicts")
def upsert_conflicts(spark, sf_dir):
    from ..operators import store as S
    base = B.corpus(spark, sf_dir).select("_id", "_rev", "title")
    _, conflicts = S.upsert(base, _changes(spark, sf_dir), order=("seq",))
    return conflicts.select("_id", F.col("rejected_rev").cast("int").alias("rejected_rev"),
                            F.col("current_rev").cast("int").alias("current_rev"))


STORE_SCHEMA = "_id string, _rev int, title string, categories array<string>"


def _store_changes(spark, sf_dir):
    """The changes with categories: labelled documents are classified anew."""
    pages = F.col("_id").startswith("doc|p")
    return _changes(spark, sf_dir).withColumn("categories", F.array(F.when(pages, F.lit("page")).otherwise(F.lit("labelled"))))


def _saved_store(spark, sf_dir):
    """A store on disk: the corpus saved as its first batch, then the changes,
    which are sent twice."""
    import uuid

    from ..operators.keyed_store import KeyedStore
    from ..session import shared_path
    store = KeyedStore.create(spark, shared_path(spark, "stores", uuid.uuid4().hex), spark.createDataFrame([], STORE_SCHEMA).schema)
    docs = B.corpus(spark, sf_dir).select("_id", F.lit(None).cast("int").alias("_rev"), "title", F.array("lang").alias("categories"))
    store.save(docs, "corpus")
    for _ in range(2):
        store.save(_store_changes(spark, sf_dir), "changes", order=("seq",))
    return store


@query("store_saved")
def store_saved(spark, sf_dir):
    """S4 on disk: what the store holds after two batches, one of them sent twice."""
    return _saved_store(spark, sf_dir).read().select("_id", "_rev", "title", F.array_join("categories", ",").alias("categories"))


@query("store_saved_log")
def store_saved_log(spark, sf_dir):
    """S4 on disk: what the second batch did to each key."""
    log = _saved_store(spark, sf_dir).feed().where("batch = 'changes'")
    return log.select("_id", "op", F.col("before._rev").alias("old_rev"), F.col("after._rev").alias("new_rev"),
                      F.col("rejected_rev").cast("int").alias("rejected_rev"), F.col("current_rev").cast("int").alias("current_rev"), "times")


@query("store_feed_counts")
def store_feed_counts(spark, sf_dir):
    """A1, A2 from the change feed: documents per category after saves,
    reclassification and deletes, without reading the store."""
    from ..operators.keyed_store import counts_of_feed
    store = _saved_store(spark, sf_dir)
    store.delete(_toxic_ids(spark, sf_dir).withColumnRenamed("doc_id", "_id"), "toxic")
    return counts_of_feed(store.feed())


TRAINED_SCHEMA = STORE_SCHEMA + ", pdf_name string, text string"


def _merged_counts(spark, sf_dir):
    """Training counts that follow a store: the corpus as one batch, then a batch
    that retitles and reclassifies documents and brings pages, sent twice, then
    deletes. Each batch is counted from its part of the change feed alone."""
    import uuid

    from ..operators.keyed_store import KeyedStore
    from ..operators.training_counts import TrainingCounts, changes_of_feed
    from ..session import shared_path
    run = shared_path(spark, "stores", uuid.uuid4().hex)
    store = KeyedStore.create(spark, f"{run}/store", spark.createDataFrame([], TRAINED_SCHEMA).schema)
    counts = TrainingCounts(spark, f"{run}/counts")

    def training(side):
        trained = (F.coalesce(F.size(f"{side}.categories"), F.lit(0)) > 0) & F.col(f"{side}.pdf_name").isNotNull()
        return F.when(trained, F.struct(F.col(f"{side}.categories")[0].alias("category"),
                                        F.concat_ws(" ", f"{side}.title", f"{side}.text").alias("text")))

    docs = scoring_docs(spark, sf_dir).select("_id", F.lit(None).cast("int").alias("_rev"), "title", F.array("lang").alias("categories"),
                                              "pdf_name", F.col("tfidf_text").alias("text"))
    changes = _store_changes(spark, sf_dir).withColumn("pdf_name", F.concat("_id", F.lit(".pdf")))
    store.save(docs, "corpus")
    store.save(changes, "changes", order=("seq",))
    store.delete(_toxic_ids(spark, sf_dir).withColumnRenamed("doc_id", "_id"), "toxic")
    for batch in ("corpus", "changes", "changes", "toxic"):
        counts.apply(changes_of_feed(store.feed().where(F.col("batch") == batch), training), batch)
    return counts


@query("training_counts_idf")
def training_counts_idf(spark, sf_dir):
    """C5, A4 by merged counts: the vocabulary after three batches, as a refit gives it."""
    vocab = _merged_counts(spark, sf_dir).model().vocab
    return vocab.select("term", F.col("df").cast("long").alias("df"), F.col("idx").cast("int").alias("idx"), r6("idf"))


@query("training_counts_vectors")
def training_counts_vectors(spark, sf_dir):
    """C5 by merged counts, read from their compacted form: the class vectors after three batches."""
    counts = _merged_counts(spark, sf_dir)
    counts.compact()
    return counts.model().class_vectors.select("category", "term", r6("weight"))


@query("store_lookup")
def store_lookup(spark, sf_dir):
    """S3 by key: the rows of the requested documents, from their buckets."""
    return _saved_store(spark, sf_dir).lookup(_lookup_keys(spark, sf_dir)).select("_id", "_rev", "title")


@query("delete_documents")
def delete_documents(spark, sf_dir):
    from ..operators import store as S
    lab = B.read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]).where(F.col("toxic") == 1)
    ids = lab.select(F.concat(F.lit("doc|"), F.col("doc_id").cast("string")).alias("_id"))
    return S.delete(B.corpus(spark, sf_dir), ids).select("_id")


@query("attachment_join")
def attachment_join(spark, sf_dir):
    from ..operators import store as S
    fetched = S.fetch_attachment(B.corpus(spark, sf_dir).select("_id", "pdf_name"), B.attachments(spark, sf_dir))
    return fetched.select("_id", "pdf_name", "content_type", "length", F.md5(F.col("data")).alias("data_md5"))


@query("attachment_orphans")
def attachment_orphans(spark, sf_dir):
    from ..operators import store as S
    _, orphans = S.attach(B.corpus(spark, sf_dir), B.attachments(spark, sf_dir))
    return orphans.select("doc_id", "name", "length")


@query("pdf_lookup_outcome")
def pdf_lookup_outcome(spark, sf_dir):
    from ..operators import store as S
    keys = _lookup_keys(spark, sf_dir).distinct()
    return S.pdf_lookup(keys, B.corpus(spark, sf_dir), B.attachments(spark, sf_dir))


# ---------------------------------------------------------------- classification
def r6(c: str):
    """Compared doubles are rounded to 6 places (sum order varies by plan)."""
    return F.round(F.col(c), 6).alias(c)


# Query parameters for a rule set that fires on the test corpus (the
# built-in rules barely match invented prose).
CORPUS_KEYWORD_RULES = {
    "english": ["the", "and", "ing", "tion", "with"],
    "french": ["les", "des", "une", "pour", "que"],
    "german": ["der", "und", "sch", "ein", "ich"],
    "spanish": ["los", "las", "que", "por", "una"],
}
CORPUS_DOMAIN_RULES = {
    "english": ["/en/", "src1.example.com"],
    "french": ["src2.example.com"],
}


@query("rule_scores")
def rule_scores(spark, sf_dir):
    s = rules.keyword_scores(B.corpus(spark, sf_dir))
    return s.select("_id", "category", F.col("keyword_hits").cast("int").alias("keyword_hits"),
                    r6("keyword_score"), r6("domain_score"), r6("confidence"))


@query("rule_classify")
def rule_classify(spark, sf_dir):
    docs = (B.corpus(spark, sf_dir).unionByName(B.crawled(spark, sf_dir), allowMissingColumns=True)
            .unionByName(B.topical(spark, sf_dir), allowMissingColumns=True))
    return rules.keyword_classify(docs).select("doc_id", "name", r6("confidence"), "classifier")


@query("rule_classify_custom")
def rule_classify_custom(spark, sf_dir):
    c = rules.keyword_classify(B.corpus(spark, sf_dir), keyword_rules=CORPUS_KEYWORD_RULES,
                               domain_rules=CORPUS_DOMAIN_RULES)
    return c.select("doc_id", "name", r6("confidence"), "classifier")


def _rule_tables(spark, sf_dir):
    """Rules in tables: every title word is a keyword of its language and first
    letter, every source a domain of its own category."""
    d = B.corpus(spark, sf_dir)
    words = d.select("lang", F.explode(F.split(F.lower("title"), "[^a-z]+")).alias("keyword")).where("keyword <> ''").distinct()
    keywords = words.select(F.concat_ws(" ", "lang", F.substring("keyword", 1, 1)).alias("category"), "keyword")
    return keywords, d.select(F.concat(F.lit("source "), F.col("source")).alias("category"), F.concat("source", F.lit(".")).alias("domain")).distinct()


@query("rule_table_scores")
def rule_table_scores(spark, sf_dir):
    """C1, C2 with rule tables of thousands of rows, by one automaton."""
    from ..operators import rule_tables
    s = rule_tables.table_scores(B.corpus(spark, sf_dir), *_rule_tables(spark, sf_dir))
    return s.select("_id", "category", F.col("keyword_hits").cast("int").alias("keyword_hits"), r6("keyword_score"), r6("domain_score"), r6("confidence"))


@query("rule_table_classify")
def rule_table_classify(spark, sf_dir):
    """The categories of those rules at a confidence of 0.3 or more."""
    from ..operators import rule_tables
    c = rule_tables.table_classify(B.corpus(spark, sf_dir), *_rule_tables(spark, sf_dir), threshold=0.3)
    return c.select("doc_id", "name", r6("confidence"), "classifier")


@query("density_scores")
def density_scores(spark, sf_dir):
    s = rules.density_scores(B.corpus(spark, sf_dir))
    return s.select(F.col("_id").alias("doc_id"), "name", F.col("hits").cast("int").alias("hits"),
                    F.col("words").cast("int").alias("words"), r6("score"))


@query("density_classify")
def density_classify(spark, sf_dir):
    return rules.density_classify(B.corpus(spark, sf_dir)).select("doc_id", "name", r6("confidence"), "classifier")


def scoring_docs(spark, sf_dir) -> DataFrame:
    """Corpus documents with the TF-IDF text (title, description, meta values,
    whole body)."""
    d = B.corpus(spark, sf_dir)
    return d.withColumn("tfidf_text", T.tfidf_text("title", "description", "meta_tags", "body"))


def tfidf_docs(spark, sf_dir) -> DataFrame:
    """(doc_id, category = first category, trainable, text) for every corpus
    document."""
    d = scoring_docs(spark, sf_dir)
    trainable = (F.coalesce(F.size("categories"), F.lit(0)) > 0) & F.col("pdf_name").isNotNull()
    return d.select(F.col("_id").alias("doc_id"), F.col("categories")[0]["name"].alias("category"),
                    trainable.alias("trainable"), F.col("tfidf_text").alias("text"))


def train_model(spark, sf_dir):
    from ..operators import tfidf
    return tfidf.train(tfidf_docs(spark, sf_dir).where("trainable").select("doc_id", "category", "text"))


def stored_model(spark, sf_dir):
    """The model of these documents from the shared folder. The first caller
    trains and publishes it; all others load it. Its name follows from the size,
    number of files and time of the documents' table, so a changed table gets
    a new one."""
    from ..operators import tfidf
    from ..operators.folder import Folder
    from ..operators.training_counts import TrainingCounts
    from ..session import shared_path
    fs, table = Folder(spark, sf_dir)._at("documents.parquet")
    content = fs.getContentSummary(table)
    state = (str(fs.makeQualified(table)), content.getLength(), content.getFileCount(), fs.getFileStatus(table).getModificationTime())
    path = shared_path(spark, "models", "stored-" + hashlib.sha1(repr(state).encode()).hexdigest()[:16])
    if not tfidf.has_model(spark, path):
        side = F.struct("category", "text")
        docs = tfidf_docs(spark, sf_dir).where("trainable").select(F.when(F.lit(False), side).alias("before"), side.alias("after"))
        counts = TrainingCounts(spark, f"{path}/counts")
        counts.apply(docs, "all")
        tfidf.save_model(counts.model(), path)
    return tfidf.load_model(spark, path)


def fitted(spark, sf_dir):
    """(model, document vectors of every corpus document), two text passes."""
    from ..operators import tfidf
    return tfidf.fit_transform(tfidf_docs(spark, sf_dir))


def doc_vectors(spark, sf_dir, model):
    from ..operators import tfidf
    d = scoring_docs(spark, sf_dir).select(F.col("_id").alias("doc_id"), F.col("tfidf_text").alias("text"))
    return tfidf.document_vectors(d, model.vocab)


@query("tfidf_train_idf")
def tfidf_train_idf(spark, sf_dir):
    m = train_model(spark, sf_dir)
    return m.vocab.select("term", F.col("df").cast("long").alias("df"), F.col("idx").cast("int").alias("idx"), r6("idf"))


@query("top_terms")
def top_terms(spark, sf_dir):
    from ..operators import tfidf
    frequency = tfidf.document_frequency(tfidf_docs(spark, sf_dir).where("trainable"))
    return tfidf.top_terms(frequency).select("term", F.col("df").cast("long").alias("df"), F.col("idx").cast("int").alias("idx"))


@query("tfidf_category_vectors")
def tfidf_category_vectors(spark, sf_dir):
    return train_model(spark, sf_dir).class_vectors.select("category", "term", r6("weight"))


@query("tfidf_vectors")
def tfidf_vectors(spark, sf_dir):
    _, vecs = fitted(spark, sf_dir)
    return vecs.select("doc_id", "term", r6("weight"))


@query("tfidf_scores")
def tfidf_scores(spark, sf_dir):
    from ..operators import tfidf
    m, vecs = fitted(spark, sf_dir)
    return tfidf.score(vecs, m.class_vectors).select("doc_id", "category", r6("score"))


@query("tfidf_classify")
def tfidf_classify(spark, sf_dir):
    from ..operators import tfidf
    m, vecs = fitted(spark, sf_dir)
    c = tfidf.classify(tfidf.score(vecs, m.class_vectors))
    return c.select("doc_id", "name", r6("confidence"), "classifier")


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Persist the model as Parquet under the shared checkpoint folder, load
    it back and score with the loaded tables."""
    from ..operators import tfidf
    from ..session import shared_path
    m = train_model(spark, sf_dir)
    path = shared_path(spark, "models", "tfidf-" + hashlib.sha1(sf_dir.encode()).hexdigest()[:12])
    tfidf.save_model(m, path)
    loaded = tfidf.load_model(spark, path)
    return tfidf.score(doc_vectors(spark, sf_dir, loaded), loaded.class_vectors).select("doc_id", "category", r6("score"))


@query("model_requests")
def model_requests(spark, sf_dir):
    from ..operators import predictions as P
    d = scoring_docs(spark, sf_dir)
    return P.requests(d, content_col="tfidf_text")


@query("model_predictions")
def model_predictions(spark, sf_dir):
    from ..operators import predictions as P
    p = P.predictions(B.predictions(spark, sf_dir))
    return p.select("doc_id", "name", r6("confidence"), "classifier", F.col("pos").cast("int").alias("pos"))


@query("model_failures")
def model_failures(spark, sf_dir):
    from ..operators import predictions as P
    return P.failures(B.predictions(spark, sf_dir))


@query("model_map_batches")
def model_map_batches(spark, sf_dir):
    """Requests sent in Arrow batches to a model function on the executors,
    responses parsed back into assignments."""
    from ..operators import predictions as P
    req = P.requests(scoring_docs(spark, sf_dir), content_col="tfidf_text")
    return P.predictions(P.call_model(req, P.length_model)).select("doc_id", "name", r6("confidence"), "classifier")


def classifier_outputs(spark, sf_dir) -> list[DataFrame]:
    """External predictions, TF-IDF, density rules — in merge order."""
    from ..operators import predictions as P
    from ..operators import tfidf
    m = stored_model(spark, sf_dir)
    tf = tfidf.classify(tfidf.score(doc_vectors(spark, sf_dir, m), m.class_vectors))
    return [P.predictions(B.predictions(spark, sf_dir)), tf, rules.density_classify(B.corpus(spark, sf_dir))]


@query("merge_assignments")
def merge_assignments(spark, sf_dir):
    from ..operators import assign
    return assign.merge(classifier_outputs(spark, sf_dir), with_rank=False).select(
        "doc_id", "name", r6("confidence"), "classifier")


@query("ranked_assignments")
def ranked_assignments(spark, sf_dir):
    from ..operators import assign
    return assign.merge(classifier_outputs(spark, sf_dir)).select(
        "doc_id", "name", r6("confidence"), "classifier", F.col("rank").cast("int").alias("rank"))


@query("primary_category")
def primary_category(spark, sf_dir):
    from ..operators import assign
    return assign.primary(assign.merge(classifier_outputs(spark, sf_dir))).select(
        "doc_id", "name", r6("confidence"), "classifier")


@query("hybrid_classify")
def hybrid_classify(spark, sf_dir):
    """Full hybrid classification: one row per document with its ordered
    category list."""
    from ..operators import assign
    ranked = assign.hybrid(scoring_docs(spark, sf_dir), model=stored_model(spark, sf_dir), responses=B.predictions(spark, sf_dir))
    cats = assign.categories_array(ranked)
    return cats.select("doc_id", F.size("categories").cast("int").alias("n_categories"),
                       F.col("categories")[0]["name"].alias("primary_name"),
                       F.array_join(F.transform("categories", lambda c: c["name"]), ", ").alias("names"))


def _reclassify_keys(spark, sf_dir) -> DataFrame:
    """Requested ids: documents named in the event log, and pages, which are not stored."""
    pages = B.read_table(spark, sf_dir, "pages", ["page_id"]).select(
        F.concat(F.lit("doc|p"), F.col("page_id").cast("string")).alias("_id"))
    return _lookup_keys(spark, sf_dir).unionByName(pages).distinct()


@query("reclassify")
def reclassify(spark, sf_dir):
    """New categories for the requested documents only: every input is cut to
    them first; the stored model was trained on all."""
    from ..operators import assign
    from ..operators import store as S
    keys = _reclassify_keys(spark, sf_dir)
    subset = scoring_docs(spark, sf_dir).join(keys, "_id", "left_semi")
    responses = B.predictions(spark, sf_dir).join(keys.withColumnRenamed("_id", "doc_id"), "doc_id", "left_semi")
    ranked = assign.hybrid(subset, model=stored_model(spark, sf_dir), responses=responses)
    cats = assign.categories_array(ranked).withColumnRenamed("doc_id", "_id")
    changes = subset.select("_id", "_rev", "title").join(cats, "_id")
    stored, _ = S.upsert(subset.select("_id", "_rev", "title", "categories"), changes)
    return stored.select("_id", F.col("_rev").cast("int").alias("_rev"),
                         F.col("categories")[0]["name"].alias("primary_name"),
                         F.size("categories").cast("int").alias("n_categories"))


@query("reclassify_unknown")
def reclassify_unknown(spark, sf_dir):
    """Requested ids that are not stored."""
    return _reclassify_keys(spark, sf_dir).join(B.corpus(spark, sf_dir).select("_id"), "_id", "left_anti")


def length_classifier():
    """Example plug-in: labels documents by word count."""
    from ..operators.assign import FunctionClassifier

    def run(docs: DataFrame) -> DataFrame:
        words = T.word_count(F.col("body"))
        return docs.select(F.col("_id").alias("doc_id"),
                           F.when(words > 500, F.lit("Long Read")).otherwise(F.lit("Short Read")).alias("name"),
                           F.lit(0.5).alias("confidence"), F.lit("length-v1.0").alias("classifier"))
    return FunctionClassifier("length", "v1.0", run)


@query("custom_classifier")
def custom_classifier(spark, sf_dir):
    from ..operators import assign
    docs = B.corpus(spark, sf_dir)
    plugins = [length_classifier()]
    ranked = assign.merge([rules.density_classify(docs)] + [p.classify(docs) for p in plugins])
    return ranked.select("doc_id", "name", r6("confidence"), "classifier", F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- catalog
def merged_assignments(spark, sf_dir) -> DataFrame:
    from ..operators import assign
    return assign.merge(classifier_outputs(spark, sf_dir), with_rank=False)


@query("category_counts_hybrid")
def category_counts_hybrid(spark, sf_dir):
    """Documents per category over the merged hybrid assignments."""
    from ..operators import assign
    best = assign.merge(classifier_outputs(spark, sf_dir), with_rank=False)
    return catalog.category_counts(best).select("name", "document_count", "description")


@query("category_count_deltas")
def category_count_deltas(spark, sf_dir):
    """Counts from the corpus, then −1 for every deleted (toxic) document and
    +1 for every crawled page, by their density category; floored at 0."""
    corpus_cls = rules.density_classify(B.corpus(spark, sf_dir))
    toxic = (B.read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]).where(F.col("toxic") == 1)
             .select(F.concat(F.lit("doc|"), F.col("doc_id").cast("string")).alias("doc_id")))
    minus = corpus_cls.join(toxic, "doc_id", "left_semi").select("name", F.lit(-1).alias("delta"))
    plus = rules.density_classify(B.crawled(spark, sf_dir)).select("name", F.lit(1).alias("delta"))
    return catalog.apply_deltas(catalog.category_counts(corpus_cls), minus.unionByName(plus))


def _rebuild(spark, sf_dir):
    existing = catalog.builtin_categories(spark).select(F.col("display_name").alias("name"))
    return catalog.rebuild(merged_assignments(spark, sf_dir), existing)


@query("rebuild_categories")
def rebuild_categories(spark, sf_dir):
    created, _ = _rebuild(spark, sf_dir)
    return created.select("name", "document_count", "description")


@query("rebuild_report")
def rebuild_report(spark, sf_dir):
    _, report = _rebuild(spark, sf_dir)
    return report


@query("training_metrics")
def training_metrics(spark, sf_dir):
    """What the fitted model learned: one row per class."""
    m = train_model(spark, sf_dir)
    classes = m.class_vectors.groupBy("category").agg(F.count(F.lit(1)).cast("long").alias("terms"))
    return classes.select(F.col("category").alias("category_name"), "terms",
                          m.n_docs.select(F.col("n_docs").cast("long")).scalar().alias("documents_processed"),
                          m.class_vectors.agg(F.countDistinct("category")).scalar().alias("categories_learned"))


@query("classifiable_categories")
def classifiable_categories(spark, sf_dir):
    """Built-in categories a classifier may give (all but unknown), each with
    the documents that the density rules put there."""
    found = rules.density_classify(B.corpus(spark, sf_dir)).groupBy("name").agg(F.count(F.lit(1)).cast("long").alias("n"))
    cats = catalog.classifiable_categories(spark)
    return cats.join(found, cats["display_name"] == found["name"], "left").select(
        "key", "display_name", F.coalesce("n", F.lit(0)).cast("long").alias("document_count"))


def note_docs(spark, sf_dir) -> DataFrame:
    """Corpus documents whose category list is the imported language and the
    density class, ordered by confidence, then name; of equal names the import
    counts. Both are in the row, so nothing is joined."""
    d = rules.density_columns(B.corpus(spark, sf_dir))
    imported = F.struct(F.col("lang").alias("name"), F.lit(1.0).alias("confidence"), F.lit("import").alias("classifier"))
    density = F.struct(F.col("density_name").alias("name"), F.col("density_confidence").alias("confidence"),
                       F.lit(K.DENSITY_CLASSIFIER).alias("classifier"))
    first = (F.col("density_confidence") < 1.0) | (F.col("lang") <= F.col("density_name"))
    cats = (F.when(F.col("lang") == F.col("density_name"), F.array(imported))
            .when(first, F.array(imported, density)).otherwise(F.array(density, imported)))
    return d.withColumn("categories", cats)


@query("notes_table")
def notes_table(spark, sf_dir):
    from ..operators import notes as N
    return N.notes_table(note_docs(spark, sf_dir), meta_tag="language").select("doc_id", "file_name", "markdown", "pdf_path")


@query("note_markdown")
def note_markdown(spark, sf_dir):
    """Notes for crawled pages: no categories, fetched description and
    canonical URL, page size; note text from a request option."""
    from ..operators import notes as N
    d = B.crawled(spark, sf_dir).withColumn("categories", F.lit(None).cast(
        "array<struct<name:string,confidence:double,classifier:string>>"))
    given = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Reviewed page "), F.col("page_id").cast("string")))
    return N.notes_table(d, note_text=given).select("doc_id", "file_name", "markdown")


def _toxic_ids(spark, sf_dir) -> DataFrame:
    toxic = B.read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]).where(F.col("toxic") == 1)
    return toxic.select(F.concat(F.lit("doc|"), F.col("doc_id").cast("string")).alias("doc_id"))


@query("note_anti_join")
def note_anti_join(spark, sf_dir):
    """Delete the notes of toxic documents: the remaining notes."""
    from ..operators import notes as N
    n = N.notes_table(B.corpus(spark, sf_dir), meta_tag=None)
    return N.delete(n, _toxic_ids(spark, sf_dir)).select("doc_id", "file_name")


@query("note_exists")
def note_exists(spark, sf_dir):
    """Whether each requested note is there once the toxic ones are deleted;
    pages are requested too, which have no notes."""
    from ..operators import notes as N
    n = N.delete(N.notes_table(B.corpus(spark, sf_dir), meta_tag=None), _toxic_ids(spark, sf_dir))
    return N.exists(n, _reclassify_keys(spark, sf_dir).withColumnRenamed("_id", "doc_id"))


@query("vault_stats")
def vault_stats(spark, sf_dir):
    from ..operators import notes as N
    n = N.notes_table(B.corpus(spark, sf_dir), meta_tag=None)
    return n.agg(F.count(F.lit(1)).cast("long").alias("total_notes"),
                 F.date_format(F.max("fetched_at"), "MMM dd, yyyy HH:mm").alias("last_modified"))


@query("vault_listing")
def vault_listing(spark, sf_dir):
    from ..operators import notes as N
    n = N.listing(N.notes_table(note_docs(spark, sf_dir), meta_tag="language"))
    return n.select("doc_id", "file_name", "size", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"), "title")


@query("note_content")
def note_content(spark, sf_dir):
    """Requested notes (by file name, after the name guard)."""
    from ..operators import notes as N
    wanted = (_path_candidates(spark, sf_dir).where(N.path_is_safe(F.col("candidate")))
              .select(F.col("candidate").alias("file_name")))
    return N.content(N.notes_table(note_docs(spark, sf_dir), meta_tag="language"), wanted)


@query("category_graph_nodes")
def category_graph_nodes(spark, sf_dir):
    return catalog.graph_nodes(catalog.category_counts(merged_assignments(spark, sf_dir)))


@query("category_graph_edges")
def category_graph_edges(spark, sf_dir):
    return catalog.graph_edges(catalog.category_counts(merged_assignments(spark, sf_dir)))


# ---------------------------------------------------------------- paging
PAGE_SIZE = 20


def _listing(df):
    from ..operators.search import LISTING_COLUMNS
    return df.select(*LISTING_COLUMNS)


@query("page_documents")
def page_documents(spark, sf_dir):
    from ..operators import search as S
    return S.page(_listing(B.corpus(spark, sf_dir)), offset=PAGE_SIZE, size=PAGE_SIZE)


@query("page_totals")
def page_totals(spark, sf_dir):
    from ..operators import search as S
    return S.page_totals(B.corpus(spark, sf_dir).select("_id"), PAGE_SIZE)


@query("search_page")
def search_page(spark, sf_dir):
    from ..operators import search as S
    return S.page(_listing(S.search(B.corpus(spark, sf_dir), SEARCH_TERM)), offset=2 * PAGE_SIZE, size=PAGE_SIZE)


@query("category_page")
def category_page(spark, sf_dir):
    from ..operators import search as S
    return S.page(_listing(S.by_category(B.corpus(spark, sf_dir), CATEGORY_NAME)), offset=PAGE_SIZE, size=PAGE_SIZE)


PAGE_AFTER = ("https://src5", "doc|5")  # url and id of the last row seen


@query("page_after")
def page_after(spark, sf_dir):
    """Keyset paging: the page after a known row, sorted by url, then id."""
    from ..operators import search as S
    return S.page_after(_listing(B.corpus(spark, sf_dir)), PAGE_AFTER, PAGE_SIZE, order_by=("url", "_id"))


TRAINING_CAP = 100  # documented bound on the labelled rows of a fit: first N, then filter


@query("tfidf_train_bounded")
def tfidf_train_bounded(spark, sf_dir):
    """A fit on the first ``TRAINING_CAP`` trainable documents in id order."""
    from ..operators import tfidf
    docs = tfidf_docs(spark, sf_dir).where("trainable").select("doc_id", "category", "text")
    m = tfidf.train(docs, max_rows=TRAINING_CAP)
    return m.vocab.select("term", F.col("df").cast("long").alias("df"), F.col("idx").cast("int").alias("idx"), r6("idf"))


@query("capped_training_set")
def capped_training_set(spark, sf_dir):
    from ..operators import search as S
    d = B.corpus(spark, sf_dir).select("_id", "categories", "pdf_name")
    cond = (F.coalesce(F.size("categories"), F.lit(0)) > 0) & F.col("pdf_name").isNotNull()
    return S.first_n_then_filter(d, TRAINING_CAP, cond).select("_id", "pdf_name")


# ---------------------------------------------------------------- ingest
def _ingest_out(df):
    return df.select("page_id", "_id", "url", "outcome", "failed_step", "error", "title", "pdf_name",
                     "category", r6("confidence"), "note_file", F.md5(F.col("note").cast("binary")).alias("note_md5"))


def meta_requests(spark, sf_dir) -> DataFrame:
    """Requests for the composed pages with meta tags: note text from the
    ``language`` or ``k0`` tag, some pages unreachable, one in eight empty."""
    p = B.meta_pages_html(spark, sf_dir)
    return p.select("page_id", "url", "html", (F.col("page_id") % 3 != 0).alias("create_note"),
                    F.when(F.col("page_id") % 2 == 0, F.lit("language")).otherwise(F.lit("k0")).alias("note_meta_tag"),
                    F.when(F.col("page_id") % 9 == 4, F.lit(404)).otherwise(F.lit(200)).alias("http_status"))


def _ingested_meta(spark, sf_dir) -> DataFrame:
    from . import ingest as I
    return I.ingest(meta_requests(spark, sf_dir), B.http_reasons(spark))


@query("ingest_meta_notes")
def ingest_meta_notes(spark, sf_dir):
    """I4: each note's text comes from the tag that its request names."""
    return _ingested_meta(spark, sf_dir).select("_id", "outcome", "note_file", F.md5(F.col("note").cast("binary")).alias("note_md5"))


@query("ingest_step_log")
def ingest_step_log(spark, sf_dir):
    from . import ingest as I
    return I.step_rows(I.ingest_pages(spark, sf_dir))


@query("ingest_counts")
def ingest_counts(spark, sf_dir):
    """Category counts after the ingest: the corpus's density classes plus the
    documents that the ingest stored."""
    from . import ingest as I
    counts = catalog.category_counts(rules.density_classify(B.corpus(spark, sf_dir)))
    return catalog.apply_deltas(counts, I.ingest_counts(_ingested_meta(spark, sf_dir)))


@query("ingest_upsert")
def ingest_upsert(spark, sf_dir):
    """The store after the ingest's documents are saved."""
    from . import ingest as I
    from ..operators import store as S
    base = B.corpus(spark, sf_dir).select("_id", "_rev", "title")
    out, _ = S.upsert(base, I.stored_documents(_ingested_meta(spark, sf_dir)))
    return out.select("_id", F.col("_rev").cast("int").alias("_rev"), "title")


@query("ingest_hybrid")
def ingest_hybrid(spark, sf_dir):
    """The ingest with a trained model and external responses: ranked categories
    of every stored document."""
    from . import ingest as I
    responses = B.predictions(spark, sf_dir).withColumn("doc_id", F.replace("doc_id", F.lit("doc|"), F.lit("doc|p")))
    out = I.ingest(meta_requests(spark, sf_dir), B.http_reasons(spark), model=stored_model(spark, sf_dir), responses=responses)
    return out.where("outcome = 'STORED'").select("_id", "category", F.size("categories").cast("int").alias("n_categories"),
                                                  F.array_join(F.transform("categories", lambda c: c["name"]), ", ").alias("names"))


@query("ingest_pages")
def ingest_pages(spark, sf_dir):
    from . import ingest as I
    return _ingest_out(I.ingest_pages(spark, sf_dir))


ISO_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("latest_status")
def latest_status(spark, sf_dir):
    from . import ingest as I
    s = I.latest_status(B.step_log(spark, sf_dir))
    return s.select("doc_id", "current_step", F.date_format("started", ISO_MICROS).alias("started"),
                    F.date_format("ended", ISO_MICROS).alias("ended"), "n_steps", "failed", "completed",
                    F.date_format("completed_at", ISO_MICROS).alias("completed_at"), T.elapsed_text("started", "ended").alias("elapsed"), "last_error")


@query("latest_status_stream")
def latest_status_stream(spark, sf_dir):
    """Stream form of ``latest_status``: the events table feeds a stateful
    streaming aggregation in update mode; the emitted states are read back."""
    import hashlib
    import uuid

    from ..session import shared_path
    from ..streaming.ingest_stream import read_status, run_status_stream
    run = shared_path(spark, "status-" + hashlib.sha1(sf_dir.encode()).hexdigest()[:12] + "-" + uuid.uuid4().hex[:8])
    landing, files = table_landing(spark, sf_dir, "events")
    run_status_stream(spark, landing, f"{run}/out", f"{run}/checkpoint", file_glob=files)
    s = read_status(spark, f"{run}/out")
    return s.select("doc_id", "current_step", F.date_format("started", ISO_MICROS).alias("started"),
                    F.date_format("ended", ISO_MICROS).alias("ended"), "n_steps", "failed", "completed",
                    F.date_format("completed_at", ISO_MICROS).alias("completed_at"), T.elapsed_text("started", "ended").alias("elapsed"), "last_error")


@query("step_progress")
def step_progress(spark, sf_dir):
    from . import ingest as I
    return I.step_progress(B.step_log(spark, sf_dir))


@query("ingest_stream")
def ingest_stream(spark, sf_dir):
    """Stream form of ``ingest_pages``: the pages table is the landing input of
    a file stream; each micro-batch is appended and the newest row per id read back."""
    import hashlib
    import uuid

    from ..session import shared_path
    from ..streaming.ingest_stream import read_ingested, run_ingest_stream
    run = shared_path(spark, "stream-" + hashlib.sha1(sf_dir.encode()).hexdigest()[:12] + "-" + uuid.uuid4().hex[:8])
    landing, files = table_landing(spark, sf_dir, "pages")
    run_ingest_stream(spark, landing, f"{run}/out", f"{run}/checkpoint", B.request_columns, file_glob=files)
    return _ingest_out(read_ingested(spark, f"{run}/out"))


@query("ingest_stream_hybrid")
def ingest_stream_hybrid(spark, sf_dir):
    """I3, the whole chain: the requests of ``ingest_hybrid`` arrive first, their
    pages later; joined, classified with model and responses, saved in a store."""
    import uuid

    from ..operators.keyed_store import KeyedStore
    from ..session import shared_path
    from ..streaming import joined_ingest as J
    run = shared_path(spark, "joined-" + uuid.uuid4().hex)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 600)
    rows = meta_requests(spark, sf_dir).withColumn("_at", at).withColumn("arrived_at", F.col("_at") + F.expr("INTERVAL 5 minutes"))
    landed = {"pages": rows.withColumn("fetched_at", F.col("_at")).select(*J.PAGES.names),
              "requests": rows.withColumn("requested_at", F.col("_at") + F.expr("INTERVAL 1 minute")).select(*J.REQUESTS.names)}
    responses = B.predictions(spark, sf_dir).withColumn("doc_id", F.replace("doc_id", F.lit("doc|"), F.lit("doc|p")))
    store, model = KeyedStore.create(spark, f"{run}/store", J.STORED), stored_model(spark, sf_dir)
    landed["pages"].where("1 = 0").write.parquet(f"{run}/pages")
    for name in ("requests", "pages"):
        landed[name].write.mode("append").parquet(f"{run}/{name}")
        J.run(spark, f"{run}/pages", f"{run}/requests", f"{run}/run", store, model, responses)
    return store.read().select("_id", "category", F.size("categories").cast("int").alias("n_categories"),
                               F.array_join("categories", ", ").alias("names"))


@query("status_stream_bounded")
def status_stream_bounded(spark, sf_dir):
    """I2 with a state that documents leave: the rows of ``latest_status``."""
    import uuid

    from ..session import shared_path
    from ..streaming.status_state import read_status, run_status
    run = shared_path(spark, "status-" + uuid.uuid4().hex)
    landing, files = table_landing(spark, sf_dir, "events")
    run_status(spark, landing, f"{run}/out", f"{run}/checkpoint", file_glob=files)
    s = read_status(spark, f"{run}/out")
    return s.select("doc_id", "current_step", F.date_format("started", ISO_MICROS).alias("started"),
                    F.date_format("ended", ISO_MICROS).alias("ended"), "n_steps", "failed", "completed",
                    F.date_format("completed_at", ISO_MICROS).alias("completed_at"), T.elapsed_text("started", "ended").alias("elapsed"), "last_error")
