"""Oracle SQL (DuckDB) for every registered query.

Built from the same fixed values and the SQL restatement of each rule in
``sqlexpr``; the views named after the driver tables are pre-registered by
the checker.
"""

from __future__ import annotations

from .. import constants as K
from . import sqlexpr as X
from .sqlexpr import q

ORACLE: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- bindings
def doc_url(source="source", lang="lang", did="doc_id") -> str:
    return f"('https://' || {source} || '.example.com/' || {lang} || '/' || CAST({did} AS VARCHAR))"


CORPUS = f"""corpus AS (
  SELECT 'doc|' || CAST(doc_id AS VARCHAR) AS _id, doc_id, 1 AS _rev, 'document' AS type,
         {doc_url()} AS url, {doc_url()} AS canonical_url,
         split_part(text, chr(10), 1) AS title,
         nullif(split_part(text, chr(10), 2), '') AS description,
         lang || ' ' AS meta_text,
         lang AS meta_language,
         {X.EPOCH} + to_seconds(doc_id) AS fetched_at,
         CASE WHEN n_chars >= 200 THEN {X.stored_file_name("split_part(text, chr(10), 1)")} END AS pdf_name,
         n_chars AS size_bytes, lang AS category, 'STORED' AS status, text AS body, lang, source
  FROM documents)"""


def pages_x(src: str = "pages", name: str = "pages_x", prefix: str = "doc|p") -> str:
    return f"""{name} AS (
  SELECT page_id, url, html, {X.strip_blocks("html")} AS clean, {q(prefix)} || CAST(page_id AS VARCHAR) AS _id
  FROM {src})"""


def extracted(src: str = "pages_x", name: str = "crawled") -> str:
    return f"""{name} AS (
  SELECT _id, page_id, url, html,
         {X.title("clean", "html")} AS title,
         {X.description("clean", "html", "url")} AS description,
         {X.canonical("clean", "html", "url")} AS canonical_url,
         {X.EPOCH} + to_seconds(page_id * 60) AS fetched_at,
         CAST(length(html) AS BIGINT) AS size_bytes
  FROM {src})"""


def meta_long(src: str = "pages_x", name: str = "meta_long") -> str:
    tag = "tag"
    key = f"CASE WHEN {X.attr(tag, 'name')} <> '' THEN {X.attr(tag, 'name')} ELSE {X.attr(tag, 'property')} END"
    return f"""{name} AS (
  SELECT _id, page_id, key, arg_max(value, pos) AS value FROM (
    SELECT _id, page_id, pos, {key} AS key, {X.attr(tag, 'content')} AS value FROM (
      SELECT _id, page_id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos
      FROM (SELECT _id, page_id, {X.meta_tags("clean")} AS tags FROM {src} WHERE NOT {X.is_blank("html")})))
  WHERE key <> '' AND value <> ''
  GROUP BY _id, page_id, key)"""


def meta_text(src: str = "meta_long", name: str = "meta_text") -> str:
    return f"""{name} AS (
  SELECT _id, string_agg(value || ' ', '' ORDER BY key) AS meta_text FROM {src} GROUP BY _id)"""


def crawled_docs(name: str = "cdocs") -> list[str]:
    return [pages_x(), extracted(), meta_long(), meta_text(),
            f"""{name} AS (SELECT c.*, coalesce(m.meta_text, '') AS meta_text FROM crawled c LEFT JOIN meta_text m USING (_id))"""]


META_PAGES_HTML = f"""meta_src AS (
  SELECT doc_id AS page_id, {doc_url()} AS url,
    CASE doc_id % 8
      WHEN 0 THEN '<html><head><title>' || split_part(text, chr(10), 1) || '</title><meta name="description" content="About ' || source || '"><meta name="language" content="' || lang || '"></head><body><p>' || split_part(text, chr(10), 1) || '</p></body></html>'
      WHEN 1 THEN '<html><head><TITLE>' || split_part(text, chr(10), 1) || '</TITLE><meta property="og:description" content="OG ' || lang || '"><meta property=''og:url'' content=''https://canon.example.org/' || CAST(doc_id AS VARCHAR) || '''></head></html>'
      WHEN 2 THEN '<html><head><!-- <title>hidden</title> --><title>' || chr(10) || '  ' || split_part(text, chr(10), 1) || '  </title><link href=''https://canon.example.org/' || CAST(doc_id AS VARCHAR) || ''' rel="canonical"><meta content=1 name=k><meta name="k" content="' || source || '"><meta name="e" content=""><meta content=''D &amp; ' || lang || ''' name=description></head></html>'
      WHEN 3 THEN '<html><head><title>   </title><script>var t=''<title>x</title>'';</script></head><body>no title</body></html>'
      WHEN 5 THEN '<html><head><title>Caf&eacute; &#8217;s &#x27;x &amp;lt; &bogus; &#0;</title><meta name="description" content="Home > ' || source || '"><meta content="set name=foo here" property="og:x"><meta name="a"content="' || lang || '"><link rel=" Canonical " href="https://canon.example.org/?a=1&amp;b=' || CAST(doc_id AS VARCHAR) || '"><meta name=bare content=it''s><meta name=slash content=b/></head></html>'
      WHEN 6 THEN '<html><head><title>a&nbsp;b &euro;</title><meta name=description><meta NAME=''Description'' CONTENT=''second &quot;' || lang || '&quot;''><meta name=dup content=1 content=2><meta name=dup content=3><meta property=p name='''' content=v><script>document.write(''<meta name=no content=no>'')' || CAST(doc_id AS VARCHAR)
      WHEN 7 THEN '<html><head><title>Many</title>' || array_to_string(list_transform(range(1, 61), lambda i: '<meta name=k' || CAST(i % 40 AS VARCHAR) || ' content=''' || CAST(i AS VARCHAR) || ' ' || source || '''>'), '') || '</head></html>'
    END AS html
  FROM documents)"""


def meta_pages_docs(name: str = "mdocs") -> list[str]:
    return [META_PAGES_HTML, pages_x("meta_src", "mpages_x", "doc|m"), extracted("mpages_x", "mcrawled"),
            meta_long("mpages_x", "mmeta_long"), meta_text("mmeta_long", "mmeta_text"),
            f"""{name} AS (SELECT c.*, coalesce(m.meta_text, '') AS meta_text FROM mcrawled c LEFT JOIN mmeta_text m USING (_id))"""]


def record_descriptions_values() -> str:
    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in K.CATEGORY_RECORD_DESCRIPTIONS)
    return f"(VALUES {rows}) AS rd(lname, rdesc)"


def with_description_sql(src: str, name_col: str = "name") -> str:
    return (f"SELECT s.*, coalesce(rd.rdesc, {q(K.DEFAULT_DESCRIPTION_PREFIX)} || s.{name_col}) AS description "
            f"FROM {src} s LEFT JOIN {record_descriptions_values()} ON lower(s.{name_col}) = rd.lname")


def density_best(src: str, text_expr: str, name: str = "dens", key: str = "_id") -> str:
    """Arg-max density category per row of ``src``."""
    hits_cols = ", ".join(f"{X.density_hits('f', pats)} AS h{i}" for i, (_, pats) in enumerate(K.DENSITY_PATTERNS, 1))
    unions = " UNION ALL ".join(
        f"SELECT {key}, {q(n)} AS name, {i} AS decl, h{i} AS hits, w FROM {name}_h" for i, (n, _) in enumerate(K.DENSITY_PATTERNS, 1))
    return f"""{name}_f AS (
  SELECT {key}, {X.fold('c')} AS f, greatest({X.word_count('c')}, 1) AS w FROM (SELECT {key}, {text_expr} AS c FROM {src})),
{name}_h AS (SELECT {key}, w, {hits_cols} FROM {name}_f),
{name}_s AS (
  SELECT {key}, name, decl, hits, w,
         greatest((hits / w) * CAST(2.0 AS DOUBLE), least(hits * CAST(0.1 AS DOUBLE), CAST(1.0 AS DOUBLE))) AS score
  FROM ({unions})),
{name} AS (
  SELECT {key} AS doc_id,
         CASE WHEN score < {K.DENSITY_MIN_SCORE} THEN {q(K.UNKNOWN_NAME)} ELSE name END AS name,
         CASE WHEN score < {K.DENSITY_MIN_SCORE} THEN CAST(1.0 AS DOUBLE) ELSE least(score, CAST(1.0 AS DOUBLE)) END AS confidence,
         {q(K.DENSITY_CLASSIFIER)} AS classifier
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, decl) AS rn FROM {name}_s) WHERE rn = 1)"""


def density_text_sql(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return X.density_text(f"{p}title", f"{p}description", f"{p}url", f"{p}meta_text")


# ---------------------------------------------------------------- flagship
@oracle("category_counts")
def _category_counts():
    return ctes(*crawled_docs(), density_best("cdocs", density_text_sql())) + f"""
SELECT name, document_count, description FROM (
  {with_description_sql("(SELECT name, CAST(count(DISTINCT doc_id) AS BIGINT) AS document_count FROM dens GROUP BY name)")})
"""


# ---------------------------------------------------------------- page metadata
@oracle("page_title")
def _page_title():
    return ctes(pages_x(), extracted()) + "SELECT _id, title FROM crawled"


@oracle("page_description")
def _page_description():
    return ctes(*meta_pages_docs()) + "SELECT _id, description FROM mdocs"


@oracle("page_canonical")
def _page_canonical():
    return ctes(*meta_pages_docs()) + "SELECT _id, canonical_url FROM mdocs"


@oracle("page_meta_tags")
def _page_meta_tags():
    return ctes(*meta_pages_docs()) + "SELECT _id, key, value FROM mmeta_long"


@oracle("page_fallback")
def _page_fallback():
    return ctes(*meta_pages_docs()) + f"""
SELECT _id, title, description, canonical_url, true AS meta_missing FROM mcrawled WHERE {X.is_blank('html')}"""


@oracle("meta_note_text")
def _meta_note_text():
    return ctes(*meta_pages_docs()) + f"""
SELECT d._id,
       (SELECT value FROM mmeta_long m WHERE m._id = d._id AND m.key = 'language') AS note_language,
       (SELECT value FROM mmeta_long m WHERE m._id = d._id AND m.key = 'k') AS note_k,
       CAST(NULL AS VARCHAR) AS note_default
FROM mdocs d"""


# ---------------------------------------------------------------- text functions
@oracle("tokenize")
def _tokenize():
    return f"""
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf
FROM (SELECT doc_id, unnest({X.tokens('text')}) AS term FROM documents)
GROUP BY doc_id, term"""


@oracle("text_builders")
def _text_builders():
    return ctes(CORPUS) + f"""
SELECT _id, {X.rules_text('title', 'description', 'url', 'meta_text')} AS rules_text,
       {X.density_text('title', 'description', 'url', 'meta_text')} AS density_text,
       {X.tfidf_text('title', 'description', 'meta_text', 'body')} AS tfidf_text
FROM corpus"""


@oracle("body_text")
def _body_text():
    return "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS body_length, md5(coalesce(text, '')) AS body_md5 FROM documents"


@oracle("page_range_text")
def _page_range_text():
    return """
SELECT conv_id AS doc_id, CAST(count(*) AS BIGINT) AS page_count, 2 AS start_page,
       CAST(least(4, count(*)) AS BIGINT) AS end_page,
       coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn + 1 BETWEEN 2 AND 4), '') AS text
FROM conversations GROUP BY conv_id"""


@oracle("page_count")
def _page_count():
    return """
SELECT d.doc_id, CAST(coalesce(n.page_count, 0) AS BIGINT) AS page_count
FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS page_count FROM conversations GROUP BY conv_id) n
  ON d.doc_id = n.conv_id"""


@oracle("url_domain")
def _url_domain():
    return f"SELECT page_id, {X.url_domain('url')} AS domain FROM pages"


@oracle("safe_filenames")
def _safe_filenames():
    return ctes(CORPUS) + f"""
SELECT _id, {X.stored_file_name('title')} AS stored_name, {X.download_file_name('pdf_name')} AS download_name,
       {X.link_file_name('pdf_name')} AS link_name, {X.path_safe_id('_id')} AS safe_id
FROM corpus"""


@oracle("note_file_name")
def _note_file_name():
    return ctes(CORPUS) + f"SELECT _id, {X.note_file_name('title', 'fetched_at')} AS file_name FROM corpus"


@oracle("format_size")
def _format_size():
    return f"""
SELECT doc_id, size_bytes, {X.size_text('size_bytes')} AS size_text, {X.size_label('size_bytes')} AS size_label
FROM (SELECT doc_id, (n_chars << CAST((doc_id % 5) * 10 AS INTEGER)) + doc_id AS size_bytes FROM documents)"""


@oracle("note_tags")
def _note_tags():
    return ctes(CORPUS) + f"SELECT _id, category || ', ' || {q(K.NOTE_TAG)} AS tags FROM corpus"


@oracle("note_title")
def _note_title():
    fn = X.note_file_name('title', 'fetched_at')
    return ctes(CORPUS) + f"""
SELECT _id, 'generated' AS kind, replace({fn}, '.md', '') AS title FROM corpus
WHERE NOT (_id IS NULL OR title IS NULL OR trim(title) = '')
UNION ALL
SELECT _id, 'plain' AS kind, trim(substr('# ' || title || ' ', 3)) AS title FROM corpus"""


@oracle("step_duration")
def _step_duration():
    return """
SELECT user_id AS doc_id,
       CAST(CAST(round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000.0) AS BIGINT) AS VARCHAR) || 's' AS elapsed
FROM events GROUP BY user_id"""


# ---------------------------------------------------------------- predicates
def _contains_ci(c: str, term: str) -> str:
    return f"coalesce(contains(lower({c}), lower({q(term)})), false)"


@oracle("search_documents")
def _search_documents():
    t = "Src1"
    return ctes(CORPUS) + f"""
SELECT _id, url, title FROM corpus
WHERE {_contains_ci('title', t)} OR {_contains_ci('description', t)} OR {_contains_ci('url', t)}"""


@oracle("search_index")
def _search_index():
    from .queries import INDEX_QUERIES
    values = ", ".join(f"({q(x)})" for x in INDEX_QUERIES)
    hit = " OR ".join(f"coalesce(contains(lower({f}), lower(q)), false)" for f in ("title", "description", "url"))
    return ctes(CORPUS) + f"SELECT q, _id FROM corpus JOIN (VALUES {values}) v(q) ON {hit}"


@oracle("search_index_page")
def _search_index_page():
    hit = " OR ".join(_contains_ci(f, "Src1") for f in ("title", "description", "url"))
    return ctes(CORPUS) + f"SELECT _id, title, description, url FROM corpus WHERE {hit} ORDER BY _id LIMIT 20 OFFSET 40"


@oracle("documents_by_category")
def _documents_by_category():
    return ctes(CORPUS) + "SELECT _id, title FROM corpus WHERE category = 'fr'"


@oracle("trainable_documents")
def _trainable_documents():
    return ctes(CORPUS) + "SELECT _id, pdf_name FROM corpus WHERE pdf_name IS NOT NULL"


INGEST_REQUESTS = """requests AS (
  SELECT page_id, html,
    CASE page_id % 10
      WHEN 5 THEN 'HTTP' || substr(url, 5)
      WHEN 6 THEN regexp_replace(url, '^https?', 'ftp')
      WHEN 7 THEN regexp_replace(url, '\\.example\\.', '.exa mple.')
      WHEN 8 THEN ''
      WHEN 9 THEN regexp_replace(url, '^https?://', '')
      WHEN 4 THEN url || CASE page_id % 3 WHEN 0 THEN '/%zz' WHEN 1 THEN '/[x]' ELSE '/%7Ex?[y]' END
      WHEN 3 THEN CASE WHEN page_id % 4 = 1 THEN 'http://' ELSE url END
      ELSE url END AS url,
    (page_id % 3 <> 0) AS create_note, CASE WHEN page_id % 2 = 0 THEN 'data-note' ELSE 'language' END AS note_meta_tag,
    CASE WHEN page_id % 11 = 4 THEN 404 WHEN page_id % 13 = 9 THEN 503 WHEN page_id % 17 = 3 THEN 301 ELSE 200 END AS http_status
  FROM pages)"""


def http_reasons_values() -> str:
    rows = ", ".join(f"({a}, {q(b)})" for a, b in K.HTTP_REASONS)
    return f"(VALUES {rows}) AS hr(http_status, reason)"


@oracle("url_validation")
def _url_validation():
    return ctes(INGEST_REQUESTS) + f"""
SELECT page_id, url, ({X.url_check('url')}) IS NULL AS valid, coalesce({X.url_check('url')}, {q(K.MSG_ACCESSIBLE)}) AS message
FROM requests"""


@oracle("fetch_outcome")
def _fetch_outcome():
    return ctes(INGEST_REQUESTS) + f"""
SELECT page_id, r.http_status, (r.http_status >= 200 AND r.http_status < 400) AS accessible,
       {X.fetch_outcome('r.http_status', 'hr.reason')} AS message
FROM requests r LEFT JOIN {http_reasons_values()} ON r.http_status = hr.http_status"""


@oracle("note_quarantine")
def _note_quarantine():
    t = X.raw_title("clean")
    return ctes(META_PAGES_HTML, pages_x("meta_src", "mpages_x", "doc|m")) + f"""
SELECT _id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM (
  SELECT _id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'Document title is required' END AS reason
  FROM (SELECT _id, CASE WHEN NOT {X.is_blank('html')} THEN {t} END AS title FROM mpages_x))"""


PATH_CANDIDATES = f"""cands AS (
  SELECT doc_id,
    CASE doc_id % 6 WHEN 1 THEN '../' || name WHEN 2 THEN 'a/./' || name WHEN 3 THEN 'a/../' || name
      WHEN 4 THEN 'a/../../etc/' || name WHEN 5 THEN 'x\\' || name ELSE name END AS candidate
  FROM (SELECT doc_id, {X.note_file_name('title', 'fetched_at')} AS name FROM corpus))"""


def normalized_path_sql(p: str) -> str:
    step = ("CASE WHEN s = '.' OR s = '' THEN acc "
            "WHEN s = '..' AND acc <> '' AND acc <> '..' AND NOT suffix(acc, '/..') "
            "THEN CASE WHEN contains(acc, '/') THEN regexp_replace(acc, '/[^/]*$', '') ELSE '' END "
            "WHEN acc = '' THEN s ELSE acc || '/' || s END")
    return f"list_reduce(string_split({p}, '/'), lambda acc, s: {step}, '')"


@oracle("path_guard")
def _path_guard():
    n = normalized_path_sql("candidate")
    return ctes(CORPUS, PATH_CANDIDATES) + f"""
SELECT doc_id, candidate, NOT regexp_matches(candidate, '\\.\\.|/|\\\\') AS name_ok,
       {n} AS normalized, NOT ({n} = '..' OR starts_with({n}, '../')) AS inside_vault
FROM cands"""


def builtin_lookup_values() -> str:
    rows = []
    for i, (key, name, _desc) in enumerate(K.BUILTIN_CATEGORIES, start=1):
        rows.append(f"({q(key.lower())}, {q(key)}, {q(name)}, {i})")
        rows.append(f"({q(name.lower())}, {q(key)}, {q(name)}, {i})")
    return f"(SELECT l, arg_min(k, o) AS k, arg_min(n, o) AS n FROM (VALUES {', '.join(rows)}) AS v(l, k, n, o) GROUP BY l)"


CATEGORY_NAME_INPUTS = """names_in AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'technology' WHEN 1 THEN 'NEWSPAPER_ARTICLE'
    WHEN 2 THEN 'Technology Update' WHEN 3 THEN lang WHEN 4 THEN NULL ELSE 'simple article' END AS name
  FROM documents)"""


@oracle("normalize_category")
def _normalize_category():
    return ctes(CATEGORY_NAME_INPUTS) + f"""
SELECT doc_id, name, coalesce(lk.k, 'UNKNOWN') AS category_key, coalesce(lk.n, {q(K.UNKNOWN_NAME)}) AS category_display
FROM names_in LEFT JOIN {builtin_lookup_values()} lk ON lower(name) = lk.l"""


@oracle("category_descriptions")
def _category_descriptions():
    return ctes(CATEGORY_NAME_INPUTS) + f"""
SELECT name, description FROM (
  {with_description_sql(f"(SELECT DISTINCT name FROM (SELECT coalesce(lk.n, {q(K.UNKNOWN_NAME)}) AS name FROM names_in LEFT JOIN {builtin_lookup_values()} lk ON lower(names_in.name) = lk.l UNION SELECT lang FROM documents))")})"""


@oracle("ingest_response")
def _ingest_response():
    return f"""SELECT 'doc|p' || CAST(page_id AS VARCHAR) AS id, 'STORED' AS status,
  {q(K.PDF_URL_PREFIX)} || 'doc|p' || CAST(page_id AS VARCHAR) || {q(K.PDF_URL_SUFFIX)} AS pdf_url FROM pages"""


# ---------------------------------------------------------------- store
@oracle("scan_documents")
def _scan_documents():
    return ctes(CORPUS) + "SELECT _id, title, url, status FROM corpus"


@oracle("scan_categories")
def _scan_categories():
    return "SELECT 'category|' || lang AS _id, lang AS name, CAST(count(*) AS BIGINT) AS document_count FROM documents GROUP BY lang"


JSON_STATE = """lines AS (
  SELECT *, CASE WHEN doc_id % 10 = 1 OR doc_id % 10 = 2 THEN 'broken' WHEN doc_id % 20 = 5 THEN 'empty'
                 WHEN doc_id % 10 = 3 THEN 'type' WHEN doc_id % 10 = 4 THEN 'id' END AS reason FROM corpus)"""


@oracle("json_documents")
def _json_documents():
    return ctes(CORPUS, JSON_STATE) + """
SELECT _id, CAST(_rev AS INTEGER) AS _rev, title, url, CAST(size_bytes AS BIGINT) AS size_bytes, meta_language AS language, category, pdf_name
FROM lines WHERE reason IS NULL"""


@oracle("json_categories")
def _json_categories():
    return "SELECT 'category|' || lang AS _id, lang AS name, count(*) AS document_count FROM documents WHERE lang IS NOT NULL GROUP BY lang"


@oracle("json_rejects")
def _json_rejects():
    return ctes(CORPUS, JSON_STATE) + """
SELECT reason, CASE WHEN reason IN ('broken', 'type') THEN _id END AS _id, count(*) AS times FROM lines WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'unknown field', 'category|' || source, 1 FROM documents WHERE source IS NOT NULL GROUP BY source"""


LOOKUP_KEYS = "keys AS (SELECT DISTINCT 'doc|' || CAST(user_id AS VARCHAR) AS _id FROM events)"


RECLASSIFY_KEYS = """keys AS (
  SELECT 'doc|' || CAST(user_id AS VARCHAR) AS _id FROM events UNION SELECT 'doc|p' || CAST(page_id AS VARCHAR) FROM pages)"""


@oracle("lookup_documents")
def _lookup_documents():
    return ctes(CORPUS, LOOKUP_KEYS) + """
SELECT k._id, c._id IS NOT NULL AS exists, c.title FROM keys k LEFT JOIN corpus c ON k._id = c._id"""


CHANGES = """changes AS (
  SELECT 'doc|' || CAST(doc_id AS VARCHAR) AS _id, quality AS _rev, 'labelled ' || CAST(doc_id AS VARCHAR) AS title, 1 AS seq FROM labels
  UNION ALL
  SELECT 'doc|' || CAST(doc_id AS VARCHAR), quality, 'again labelled ' || CAST(doc_id AS VARCHAR), 2 FROM labels WHERE doc_id % 5 = 0
  UNION ALL
  SELECT 'doc|p' || CAST(page_id AS VARCHAR), CAST(NULL AS INTEGER), url, 1 FROM pages),
ch AS (
  SELECT *, row_number() OVER (PARTITION BY _id, fits ORDER BY seq) AS rn FROM (
    SELECT c.*, b._rev AS cur_rev, coalesce(CASE WHEN b._id IS NULL THEN c._rev IS NULL ELSE c._rev = b._rev END, false) AS fits
    FROM changes c LEFT JOIN corpus b ON c._id = b._id)),
applied AS (SELECT _id, coalesce(cur_rev + 1, 1) AS _rev, title FROM ch WHERE fits AND rn = 1)"""


@oracle("upsert_documents")
def _upsert_documents():
    return ctes(CORPUS, CHANGES) + """
SELECT _id, CAST(_rev AS INTEGER) AS _rev, title FROM corpus WHERE _id NOT IN (SELECT _id FROM applied)
UNION ALL SELECT _id, CAST(_rev AS INTEGER), title FROM applied"""


@oracle("upsert_conflicts")
def _upsert_conflicts():
    return ctes(CORPUS, CHANGES) + """
SELECT _id, CAST(_rev AS INTEGER) AS rejected_rev, CAST(cur_rev AS INTEGER) AS current_rev FROM ch
WHERE NOT (fits AND rn = 1)"""


SAVED = """saved AS (
  SELECT _id, CAST(_rev AS INTEGER) AS _rev, title, lang AS category FROM corpus WHERE _id NOT IN (SELECT _id FROM applied)
  UNION ALL SELECT _id, CAST(_rev AS INTEGER), title, CASE WHEN _id LIKE 'doc|p%' THEN 'page' ELSE 'labelled' END FROM applied)"""


@oracle("store_saved")
def _store_saved():
    return ctes(CORPUS, CHANGES, SAVED) + "SELECT _id, _rev, title, category AS categories FROM saved"


@oracle("store_saved_log")
def _store_saved_log():
    return ctes(CORPUS, CHANGES) + """
SELECT _id, CASE WHEN cur_rev IS NULL THEN 'created' ELSE 'updated' END AS op, CAST(cur_rev AS INTEGER) AS old_rev,
       CAST(coalesce(cur_rev + 1, 1) AS INTEGER) AS new_rev, CAST(NULL AS INTEGER) AS rejected_rev, CAST(NULL AS INTEGER) AS current_rev, CAST(NULL AS BIGINT) AS times
FROM ch WHERE fits AND rn = 1
UNION ALL
SELECT _id, 'rejected', NULL, NULL, CAST(_rev AS INTEGER), CAST(cur_rev AS INTEGER), count(*)
FROM ch WHERE NOT (fits AND rn = 1) GROUP BY _id, _rev, cur_rev, title, seq"""


@oracle("store_feed_counts")
def _store_feed_counts():
    return ctes(CORPUS, CHANGES, SAVED) + """
SELECT category AS name, count(*) AS document_count FROM saved
WHERE _id NOT IN (SELECT 'doc|' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) GROUP BY category"""


@oracle("store_lookup")
def _store_lookup():
    return ctes(CORPUS, CHANGES, SAVED, LOOKUP_KEYS) + "SELECT _id, _rev, title FROM saved WHERE _id IN (SELECT _id FROM keys)"


@oracle("delete_documents")
def _delete_documents():
    return ctes(CORPUS) + """
SELECT _id FROM corpus WHERE _id NOT IN (SELECT 'doc|' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""


ATTACHMENTS = """atts AS (
  SELECT _id AS doc_id, pdf_name AS name, 'application/pdf' AS content_type, encode(body) AS data FROM corpus WHERE pdf_name IS NOT NULL
  UNION ALL
  SELECT 'doc|p' || CAST(page_id AS VARCHAR), 'page.pdf', 'application/pdf', encode(html) FROM pages)"""


@oracle("attachment_join")
def _attachment_join():
    return ctes(CORPUS, ATTACHMENTS) + """
SELECT c._id, c.pdf_name, a.content_type, CAST(octet_length(a.data) AS BIGINT) AS length, md5(a.data) AS data_md5
FROM corpus c JOIN atts a ON a.doc_id = c._id AND a.name = c.pdf_name"""


@oracle("attachment_orphans")
def _attachment_orphans():
    return ctes(CORPUS, ATTACHMENTS) + """
SELECT doc_id, name, CAST(octet_length(data) AS BIGINT) AS length FROM atts WHERE doc_id NOT IN (SELECT _id FROM corpus)"""


@oracle("pdf_lookup_outcome")
def _pdf_lookup_outcome():
    return ctes(CORPUS, ATTACHMENTS, LOOKUP_KEYS) + """
SELECT k._id,
       CASE WHEN c._id IS NULL THEN 'not_found' WHEN c.pdf_name IS NULL OR c.pdf_name = '' OR a.doc_id IS NULL THEN 'no_attachment' ELSE 'ok' END AS outcome,
       CASE WHEN c._id IS NOT NULL AND c.pdf_name IS NOT NULL AND c.pdf_name <> '' AND a.doc_id IS NOT NULL THEN CAST(octet_length(a.data) AS BIGINT) END AS length
FROM keys k LEFT JOIN corpus c ON k._id = c._id LEFT JOIN atts a ON a.doc_id = c._id AND a.name = c.pdf_name"""


# ---------------------------------------------------------------- classification
def r6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c.split('.')[-1]}"


def keyword_rows(src: str, keyword_rules, domain_rules, key: str = "_id") -> str:
    """Long-form keyword/domain scores per (row, category)."""
    t = f"lower({X.rules_text('title', 'description', 'url', 'meta_text')})"
    selects = []
    for cat, kws in keyword_rules.items():
        hits = " + ".join(f"CASE WHEN contains(t, {q(k.lower())}) THEN 1 ELSE 0 END" for k in kws)
        doms = domain_rules.get(cat, [])
        if doms:
            anyd = " OR ".join(f"contains(d, {q(x.lower())})" for x in doms)
            dom = f"CASE WHEN d <> '' AND ({anyd}) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
        else:
            dom = "CAST(0.0 AS DOUBLE)"
        selects.append(f"SELECT {key}, {q(cat)} AS category, CAST({hits} AS INTEGER) AS keyword_hits, "
                       f"({hits}) / {len(kws)} AS keyword_score, {dom} AS domain_score FROM base")
    return (f"(WITH base AS (SELECT {key}, {t} AS t, {X.url_domain('url')} AS d FROM {src}) "
            f"SELECT *, keyword_score * CAST({K.RULE_KEYWORD_WEIGHT} AS DOUBLE) + domain_score * CAST({K.RULE_DOMAIN_WEIGHT} AS DOUBLE) AS confidence "
            f"FROM ({' UNION ALL '.join(selects)}))")


@oracle("rule_scores")
def _rule_scores():
    return ctes(CORPUS) + f"""
SELECT _id, category, keyword_hits, {r6('keyword_score')}, {r6('domain_score')}, {r6('confidence')}
FROM {keyword_rows('corpus', K.DEFAULT_KEYWORD_RULES, K.DEFAULT_DOMAIN_RULES)}"""


@oracle("rule_classify")
def _rule_classify():
    n = len(K.DEFAULT_KEYWORD_RULES)
    titles = " ".join(f"WHEN {i} THEN array_to_string(list_slice([{', '.join(map(q, words))}], 1, {len(words)} - doc_id % 7), ' ')"
                      for i, words in enumerate(K.DEFAULT_KEYWORD_RULES.values()))
    hosts = " ".join(f"WHEN {i} THEN {q(K.DEFAULT_DOMAIN_RULES[c][0])}" for i, c in enumerate(K.DEFAULT_KEYWORD_RULES)
                     if K.DEFAULT_DOMAIN_RULES.get(c))
    topical = (f"SELECT 'doc|t' || CAST(doc_id AS VARCHAR), CASE doc_id % {n} {titles} END, CAST(NULL AS VARCHAR), "
               f"'https://' || CASE doc_id % {n} {hosts} ELSE source END || '/x', '' FROM documents")
    both = ("(SELECT _id, title, description, url, meta_text FROM corpus "
            f"UNION ALL SELECT _id, title, description, url, meta_text FROM cdocs UNION ALL {topical})")
    return ctes(CORPUS, *crawled_docs(), f"alldocs AS {both}") + f"""
SELECT _id AS doc_id, category AS name, {r6('confidence')}, {q(K.RULE_CLASSIFIER)} AS classifier
FROM {keyword_rows('alldocs', K.DEFAULT_KEYWORD_RULES, K.DEFAULT_DOMAIN_RULES)} WHERE confidence >= {K.RULE_THRESHOLD}"""


@oracle("rule_classify_custom")
def _rule_classify_custom():
    from .queries import CORPUS_DOMAIN_RULES, CORPUS_KEYWORD_RULES
    return ctes(CORPUS) + f"""
SELECT _id AS doc_id, category AS name, {r6('confidence')}, {q(K.RULE_CLASSIFIER)} AS classifier
FROM {keyword_rows('corpus', CORPUS_KEYWORD_RULES, CORPUS_DOMAIN_RULES)} WHERE confidence >= {K.RULE_THRESHOLD}"""


def rule_table_rows() -> str:
    t = f"lower({X.rules_text('title', 'description', 'url', 'meta_text')})"
    return ctes(CORPUS) + f"""
, rt AS (SELECT DISTINCT lang || ' ' || keyword[1:1] AS category, keyword
         FROM (SELECT lang, unnest(string_split_regex(lower(title), '[^a-z]+')) AS keyword FROM corpus) WHERE keyword <> '')
, n AS (SELECT category, count(*) AS n FROM rt GROUP BY category)
, rd AS (SELECT DISTINCT 'source ' || source AS category, source || '.' AS dom FROM corpus)
, base AS (SELECT _id, {t} AS t, {X.url_domain('url')} AS d FROM corpus)
, hits AS (
  SELECT _id, category, count(*) AS h, 0 AS dom FROM base JOIN rt ON contains(t, keyword) GROUP BY _id, category
  UNION ALL SELECT _id, category, 0, 1 FROM base JOIN rd ON d <> '' AND contains(d, lower(dom)) GROUP BY _id, category)
, scored AS (
  SELECT _id, category, CAST(h AS INTEGER) AS keyword_hits, coalesce(h / n, CAST(0.0 AS DOUBLE)) AS keyword_score, CAST(dom AS DOUBLE) AS domain_score
  FROM hits LEFT JOIN n USING (category))
, rules AS (SELECT *, keyword_score * CAST({K.RULE_KEYWORD_WEIGHT} AS DOUBLE) + domain_score * CAST({K.RULE_DOMAIN_WEIGHT} AS DOUBLE) AS confidence FROM scored)
"""


@oracle("rule_table_scores")
def _rule_table_scores():
    return rule_table_rows() + f"SELECT _id, category, keyword_hits, {r6('keyword_score')}, {r6('domain_score')}, {r6('confidence')} FROM rules"


@oracle("rule_table_classify")
def _rule_table_classify():
    return rule_table_rows() + f"""
SELECT _id AS doc_id, category AS name, {r6('confidence')}, {q(K.RULE_CLASSIFIER)} AS classifier FROM rules WHERE confidence >= 0.3"""


@oracle("density_scores")
def _density_scores():
    return ctes(CORPUS, density_best("corpus", density_text_sql())) + f"""
SELECT _id AS doc_id, name, CAST(hits AS INTEGER) AS hits, CAST(w AS INTEGER) AS words, {r6('score')} FROM dens_s"""


@oracle("density_classify")
def _density_classify():
    return ctes(CORPUS, density_best("corpus", density_text_sql())) + f"""
SELECT doc_id, name, {r6('confidence')}, classifier FROM dens"""


def tfidf_ctes(first: int | None = None) -> list[str]:
    tok = X.tokens("text")
    return [
        CORPUS,
        f"sdocs AS (SELECT _id AS doc_id, category, pdf_name, {X.tfidf_text('title', 'description', 'meta_text', 'body')} AS text FROM corpus)",
        f"train AS (SELECT doc_id, category, text FROM sdocs WHERE pdf_name IS NOT NULL{f' ORDER BY doc_id LIMIT {first}' if first else ''})",
        "ndocs AS (SELECT count(*) AS n_docs FROM train)",
        f"dfreq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({tok}) AS term FROM train)) GROUP BY term)",
        f"""vocab AS (
  SELECT term, df, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS idx, ln(n_docs / df) AS idf
  FROM (SELECT * FROM dfreq WHERE df >= {K.TFIDF_MIN_DF} ORDER BY df DESC, term LIMIT {K.TFIDF_MAX_FEATURES}), ndocs)""",
        f"""ctf AS (SELECT category, term, count(*) AS tf FROM (SELECT category, unnest({tok}) AS term FROM train) JOIN vocab USING (term) GROUP BY category, term)""",
        """cvec AS (
  SELECT category, term, CASE WHEN norm > 0 THEN w / norm ELSE w END AS weight FROM (
    SELECT c.category, c.term, c.tf * v.idf AS w, sqrt(sum((c.tf * v.idf) * (c.tf * v.idf)) OVER (PARTITION BY c.category)) AS norm
    FROM ctf c JOIN vocab v USING (term)))""",
        f"""dtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok}) AS term FROM sdocs) JOIN vocab USING (term) GROUP BY doc_id, term)""",
        """dvec AS (
  SELECT doc_id, term, CASE WHEN norm > 0 THEN w / norm ELSE w END AS weight FROM (
    SELECT d.doc_id, d.term, d.tf * v.idf AS w, sqrt(sum((d.tf * v.idf) * (d.tf * v.idf)) OVER (PARTITION BY d.doc_id)) AS norm
    FROM dtf d JOIN vocab v USING (term)))""",
        """scores AS (SELECT d.doc_id, c.category, sum(d.weight * c.weight) AS score FROM dvec d JOIN cvec c USING (term) GROUP BY d.doc_id, c.category)""",
        f"""tfc AS (SELECT doc_id, category AS name, score AS confidence, {q(K.TFIDF_CLASSIFIER)} AS classifier FROM scores WHERE score >= {K.TFIDF_THRESHOLD})""",
    ]


@oracle("tfidf_train_idf")
def _tfidf_train_idf():
    return ctes(*tfidf_ctes()) + f"SELECT term, CAST(df AS BIGINT) AS df, idx, {r6('idf')} FROM vocab"


@oracle("top_terms")
def _top_terms():
    return ctes(*tfidf_ctes()) + "SELECT term, CAST(df AS BIGINT) AS df, idx FROM vocab"


@oracle("tfidf_category_vectors")
def _tfidf_category_vectors():
    return ctes(*tfidf_ctes()) + f"SELECT category, term, {r6('weight')} FROM cvec"


def merged_ctes() -> list[str]:
    """The training documents after the three batches, then the model as ``tfidf_ctes`` fits it."""
    kept = f"""trained AS (
  SELECT _id, title, lang AS category, pdf_name, {X.tfidf_text('title', 'description', 'meta_text', 'body')} AS text FROM corpus
  WHERE _id NOT IN (SELECT _id FROM applied)
  UNION ALL
  SELECT a._id, a.title, CASE WHEN a._id LIKE 'doc|p%' THEN 'page' ELSE 'labelled' END, a._id || '.pdf',
         CASE WHEN c._id IS NOT NULL THEN {X.tfidf_text('c.title', 'c.description', 'c.meta_text', 'c.body')} END
  FROM applied a LEFT JOIN corpus c ON c._id = a._id)"""
    train = """train AS (
  SELECT _id AS doc_id, category, concat_ws(' ', title, text) AS text FROM trained
  WHERE pdf_name IS NOT NULL AND _id NOT IN (SELECT 'doc|' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1))"""
    return [CORPUS, CHANGES, kept, train, *tfidf_ctes()[3:8]]


@oracle("training_counts_idf")
def _training_counts_idf():
    return ctes(*merged_ctes()) + f"SELECT term, CAST(df AS BIGINT) AS df, idx, {r6('idf')} FROM vocab"


@oracle("training_counts_vectors")
def _training_counts_vectors():
    return ctes(*merged_ctes()) + f"SELECT category, term, {r6('weight')} FROM cvec"


@oracle("tfidf_vectors")
def _tfidf_vectors():
    return ctes(*tfidf_ctes()) + f"SELECT doc_id, term, {r6('weight')} FROM dvec"


@oracle("tfidf_scores")
def _tfidf_scores():
    return ctes(*tfidf_ctes()) + f"SELECT doc_id, category, {r6('score')} FROM scores"


@oracle("tfidf_classify")
def _tfidf_classify():
    return ctes(*tfidf_ctes()) + f"SELECT doc_id, name, {r6('confidence')}, classifier FROM tfc"


@oracle("model_roundtrip")
def _model_roundtrip():
    return ORACLE["tfidf_scores"]


@oracle("model_requests")
def _model_requests():
    text = X.tfidf_text('title', 'description', 'meta_text', 'body')
    return ctes(CORPUS) + f"""
SELECT _id AS doc_id, sha256(_id) AS request_id,
  to_json({{'jsonrpc': '2.0', 'id': sha256(_id), 'method': {q(K.MODEL_METHOD)},
           'params': {{'name': {q(K.MODEL_TOOL_NAME)}, 'arguments': {{'documentId': _id, 'title': coalesce(title, ''),
             'description': coalesce(description, ''), 'content': coalesce({text}, '')}}}}}})::VARCHAR AS request
FROM corpus"""


PREDICTIONS = """preds AS (
  SELECT 'doc|' || CAST(doc_id AS VARCHAR) AS doc_id,
    CASE WHEN doc_id % 5 = 0 THEN '{"jsonrpc":"2.0","id":"r' || CAST(doc_id AS VARCHAR) || '","error":{"code":-32000,"message":"model busy ' || CAST(doc_id AS VARCHAR) || '"}}'
         WHEN doc_id % 23 = 11 THEN '{"jsonrpc":"2.0","result":' || CAST(doc_id AS VARCHAR)
         ELSE '{"jsonrpc":"2.0","id":"r' || CAST(doc_id AS VARCHAR) || '","result":{"model":' || CASE WHEN doc_id % 7 = 0 THEN 'null' ELSE '"m1"' END
              || ',"confidence":0.5,"categories":[{"name":"' || lang || '","confidence":0.' || lpad(CAST(n_chars % 100 AS VARCHAR), 2, '0')
              || ',"reasoning":"language"},{"name":"Technology","confidence":0.' || lpad(CAST(doc_id % 97 AS VARCHAR), 2, '0')
              || ',"reasoning":"topic"}]}}' END AS response
  FROM documents),
parsed AS (
  SELECT doc_id, response, json_valid(response) AS valid,
    CASE WHEN json_valid(response) THEN json_extract(response, '$.error') END AS err,
    CASE WHEN json_valid(response) THEN json_type(response, '$.result') = 'OBJECT' ELSE false END AS has_result
  FROM preds),
mp AS (
  SELECT doc_id, json_extract_string(c, '$.name') AS name, CAST(json_extract(c, '$.confidence') AS DOUBLE) AS confidence,
         'mcp-' || coalesce(model, 'ai') AS classifier, CAST(pos AS INTEGER) AS pos
  FROM (SELECT doc_id, model, unnest(cats) AS c, unnest(range(0, len(cats))) AS pos FROM (
    SELECT doc_id, json_extract_string(response, '$.result.model') AS model,
           CAST(json_extract(response, '$.result.categories') AS JSON[]) AS cats
    FROM parsed WHERE (err IS NULL OR json_type(err) = 'NULL') AND has_result)))"""


@oracle("model_predictions")
def _model_predictions():
    return ctes(PREDICTIONS) + f"SELECT doc_id, name, {r6('confidence')}, classifier, pos FROM mp"


@oracle("model_failures")
def _model_failures():
    return ctes(PREDICTIONS) + """
SELECT doc_id, CASE WHEN err IS NOT NULL AND json_type(err) <> 'NULL' THEN 'model error: ' || coalesce(json_extract_string(err, '$.message'), '') ELSE 'malformed response' END AS reason
FROM parsed WHERE (err IS NOT NULL AND json_type(err) <> 'NULL') OR NOT has_result"""


def merged_ctes(with_density_src: str = "corpus") -> list[str]:
    return tfidf_ctes() + [PREDICTIONS, density_best(with_density_src, density_text_sql()), """merged AS (
  SELECT doc_id, name, confidence, classifier, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, name) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, src, pos) AS k FROM (
      SELECT doc_id, name, confidence, classifier, 0 AS src, pos FROM mp
      UNION ALL SELECT doc_id, name, confidence, classifier, 1, 0 FROM tfc
      UNION ALL SELECT doc_id, name, confidence, classifier, 2, 0 FROM dens)) WHERE k = 1)"""]


@oracle("merge_assignments")
def _merge_assignments():
    return ctes(*merged_ctes()) + f"SELECT doc_id, name, {r6('confidence')}, classifier FROM merged"


@oracle("ranked_assignments")
def _ranked_assignments():
    return ctes(*merged_ctes()) + f"SELECT doc_id, name, {r6('confidence')}, classifier, CAST(rank AS INTEGER) AS rank FROM merged"


@oracle("primary_category")
def _primary_category():
    return ctes(*merged_ctes()) + f"SELECT doc_id, name, {r6('confidence')}, classifier FROM merged WHERE rank = 1"


@oracle("hybrid_classify")
def _hybrid_classify():
    return ctes(*merged_ctes()) + """
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_categories, arg_min(name, rank) AS primary_name,
       string_agg(name, ', ' ORDER BY rank) AS names
FROM merged GROUP BY doc_id"""


@oracle("reclassify")
def _reclassify():
    return ctes(*merged_ctes(), RECLASSIFY_KEYS) + """
SELECT m.doc_id AS _id, 2 AS _rev, arg_min(m.name, m.rank) AS primary_name, CAST(count(*) AS INTEGER) AS n_categories
FROM merged m JOIN keys k ON m.doc_id = k._id GROUP BY m.doc_id"""


@oracle("reclassify_unknown")
def _reclassify_unknown():
    return ctes(CORPUS, RECLASSIFY_KEYS) + "SELECT _id FROM keys WHERE _id NOT IN (SELECT _id FROM corpus)"


@oracle("custom_classifier")
def _custom_classifier():
    return ctes(CORPUS, density_best("corpus", density_text_sql())) + f"""
SELECT doc_id, name, {r6('confidence')}, classifier, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, name) AS INTEGER) AS rank
FROM (
  SELECT doc_id, name, confidence, classifier FROM dens
  UNION ALL
  SELECT _id, CASE WHEN {X.word_count('body')} > 500 THEN 'Long Read' ELSE 'Short Read' END, CAST(0.5 AS DOUBLE), 'length-v1.0' FROM corpus)"""


# ---------------------------------------------------------------- catalog
@oracle("category_counts_hybrid")
def _category_counts_hybrid():
    return ctes(*merged_ctes()) + f"""
SELECT name, document_count, description FROM (
  {with_description_sql("(SELECT name, CAST(count(DISTINCT doc_id) AS BIGINT) AS document_count FROM merged GROUP BY name)")})"""


@oracle("category_count_deltas")
def _category_count_deltas():
    return ctes(CORPUS, *crawled_docs(), density_best("corpus", density_text_sql()),
                density_best("cdocs", density_text_sql(), name="densc")) + """,
cnt AS (SELECT name, count(DISTINCT doc_id) AS document_count FROM dens GROUP BY name),
dl AS (SELECT name, sum(delta) AS delta FROM (
  SELECT name, -1 AS delta FROM dens WHERE doc_id IN (SELECT 'doc|' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
  UNION ALL SELECT name, 1 FROM densc) GROUP BY name)
SELECT name, CAST(coalesce(document_count, 0) AS BIGINT) AS old_count, CAST(coalesce(delta, 0) AS BIGINT) AS delta,
       CAST(greatest(0, coalesce(document_count, 0) + coalesce(delta, 0)) AS BIGINT) AS document_count
FROM cnt FULL OUTER JOIN dl USING (name)"""


def builtin_names_values() -> str:
    return "(VALUES " + ", ".join(f"({q(n)})" for _, n, _ in K.BUILTIN_CATEGORIES) + ") AS bn(name)"


@oracle("rebuild_categories")
def _rebuild_categories():
    return ctes(*merged_ctes()) + f"""
SELECT name, document_count, description FROM (
  {with_description_sql(f"(SELECT name, CAST(count(DISTINCT doc_id) AS BIGINT) AS document_count FROM merged WHERE name NOT IN (SELECT name FROM {builtin_names_values()}) GROUP BY name)")})"""


@oracle("rebuild_report")
def _rebuild_report():
    return ctes(*merged_ctes()) + f"""
SELECT CAST(count(*) FILTER (WHERE name NOT IN (SELECT name FROM {builtin_names_values()})) AS BIGINT) AS categories_created,
       CAST(count(*) AS BIGINT) AS total_categories
FROM (SELECT DISTINCT name FROM merged)"""


@oracle("training_metrics")
def _training_metrics():
    return ctes(*tfidf_ctes()) + """
SELECT category AS category_name, CAST(count(*) AS BIGINT) AS terms,
       CAST((SELECT count(*) FROM corpus WHERE pdf_name IS NOT NULL) AS BIGINT) AS documents_processed,
       CAST((SELECT count(DISTINCT category) FROM cvec) AS BIGINT) AS categories_learned
FROM cvec GROUP BY category"""


@oracle("classifiable_categories")
def _classifiable_categories():
    rows = ", ".join(f"({q(k)}, {q(n)})" for k, n, _ in K.BUILTIN_CATEGORIES if k != "UNKNOWN")
    return ctes(CORPUS, density_best("corpus", density_text_sql())) + f"""
SELECT key, display_name, CAST((SELECT count(*) FROM dens WHERE name = display_name) AS BIGINT) AS document_count
FROM (VALUES {rows}) v(key, display_name)"""


NOTE_CATS = """ncat AS (
  SELECT doc_id, name, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, name) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, src) AS k FROM (
      SELECT _id AS doc_id, lang AS name, CAST(1.0 AS DOUBLE) AS confidence, 0 AS src FROM corpus
      UNION ALL SELECT doc_id, name, confidence, 1 FROM dens)) WHERE k = 1),
ncat_agg AS (
  SELECT doc_id, string_agg(name, ', ' ORDER BY rank) AS names,
         string_agg('- ' || name || ' (confidence: ' || """ + X.fixed2("confidence") + """ || ')' || chr(10), '' ORDER BY rank) AS lines
  FROM ncat GROUP BY doc_id)"""


def markdown_sql(note: str, tags: str, cat_section: str) -> str:
    nl = "chr(10)"
    iso = X.iso_seconds("fetched_at")
    return (f"'---' || {nl} || 'source_url: ' || coalesce(url, 'null') || {nl} || 'title: ' || coalesce(title, 'null') || {nl}"
            f" || 'pdf_id: ' || _id || {nl} || 'fetchedAt: ' || {iso} || {nl} || 'tags: [' || {tags} || ']' || {nl}"
            f" || '---' || {nl} || {nl} || '# ' || coalesce(title, 'null') || {nl} || {nl}"
            f" || CASE WHEN coalesce(trim(description) <> '', false) THEN '## Description' || {nl} || description || {nl} || {nl} ELSE '' END"
            f" || CASE WHEN ({note}) IS NOT NULL THEN '## Notes' || {nl} || ({note}) || {nl} || {nl} ELSE '' END"
            f" || '## Resources' || {nl} || '[Download PDF](../pdfs/' || {X.path_safe_id('_id')} || '.pdf)' || {nl} || {nl}"
            f" || {cat_section}"
            f" || '## Metadata' || {nl} || '- **Fetched:** ' || {iso} || {nl}"
            f" || CASE WHEN canonical_url IS NOT NULL THEN '- **Canonical URL:** ' || canonical_url || {nl} ELSE '' END"
            f" || CASE WHEN size_bytes IS NOT NULL THEN '- **PDF Size:** ' || {X.size_text('size_bytes')} || {nl} ELSE '' END")


def corpus_notes_sql() -> str:
    note = "CASE WHEN coalesce(trim(meta_language) <> '', false) THEN meta_language END"
    tags = "coalesce(a.names || ', ', '') || 'page-snapshot'"
    cat_section = "CASE WHEN a.lines IS NOT NULL THEN '## Categories' || chr(10) || a.lines || chr(10) ELSE '' END"
    return f"""
SELECT _id AS doc_id, {X.note_file_name('title', 'fetched_at')} AS file_name,
       {markdown_sql(note, tags, cat_section)} AS markdown,
       CASE WHEN pdf_name IS NOT NULL THEN 'pdfs/' || {X.path_safe_id('_id')} || '.pdf' END AS pdf_path, fetched_at
FROM corpus c LEFT JOIN ncat_agg a ON a.doc_id = c._id
WHERE NOT (_id IS NULL OR title IS NULL OR trim(title) = '')"""


@oracle("notes_table")
def _notes_table():
    return ctes(CORPUS, density_best("corpus", density_text_sql()), NOTE_CATS) + f"""
SELECT doc_id, file_name, markdown, pdf_path FROM ({corpus_notes_sql()})"""


@oracle("note_markdown")
def _note_markdown():
    note = "CASE WHEN page_id % 4 = 0 THEN 'Reviewed page ' || CAST(page_id AS VARCHAR) END"
    md = markdown_sql(note, "'page-snapshot'", "''")
    return ctes(pages_x(), extracted()) + f"""
SELECT _id AS doc_id, {X.note_file_name('title', 'fetched_at')} AS file_name, {md} AS markdown
FROM crawled WHERE NOT (_id IS NULL OR title IS NULL OR trim(title) = '')"""


@oracle("note_anti_join")
def _note_anti_join():
    return ctes(CORPUS, density_best("corpus", density_text_sql()), NOTE_CATS) + f"""
SELECT doc_id, file_name FROM ({corpus_notes_sql()})
WHERE doc_id NOT IN (SELECT 'doc|' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""


@oracle("vault_stats")
def _vault_stats():
    return ctes(CORPUS) + """
SELECT CAST(count(*) AS BIGINT) AS total_notes, strftime(max(fetched_at), '%b %d, %Y %H:%M') AS last_modified
FROM corpus WHERE NOT (_id IS NULL OR title IS NULL OR trim(title) = '')"""


def _counts_from_merged() -> str:
    return "counts AS (SELECT name, CAST(count(DISTINCT doc_id) AS BIGINT) AS document_count FROM merged GROUP BY name)"


@oracle("category_graph_nodes")
def _category_graph_nodes():
    return ctes(*merged_ctes(), _counts_from_merged()) + f"""
SELECT {q(K.GRAPH_ROOT_ID)} AS id, {q(K.GRAPH_ROOT_NAME)} AS name, 0 AS "group", CAST(coalesce(sum(document_count), 0) AS BIGINT) AS count FROM counts
UNION ALL
SELECT name, name, CAST(row_number() OVER (ORDER BY name) AS INTEGER), document_count FROM counts"""


@oracle("category_graph_edges")
def _category_graph_edges():
    return ctes(*merged_ctes(), _counts_from_merged()) + f"""
SELECT {q(K.GRAPH_ROOT_ID)} AS source, name AS target, CAST(v AS BIGINT) AS value, round(sqrt(v), 6) AS stroke_width
FROM (SELECT name, CASE WHEN coalesce(document_count, 0) = 0 THEN 1 ELSE document_count END AS v FROM counts)"""


# ---------------------------------------------------------------- paging
LISTING = "_id, url, title, description, status"


@oracle("page_documents")
def _page_documents():
    return ctes(CORPUS) + f"SELECT {LISTING} FROM corpus ORDER BY _id LIMIT 20 OFFSET 20"


@oracle("page_totals")
def _page_totals():
    return "SELECT CAST(count(*) AS BIGINT) AS total_elements, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 20 AS page_size FROM documents"


@oracle("search_page")
def _search_page():
    t = "Src1"
    return ctes(CORPUS) + f"""
SELECT {LISTING} FROM corpus
WHERE {_contains_ci('title', t)} OR {_contains_ci('description', t)} OR {_contains_ci('url', t)}
ORDER BY _id LIMIT 20 OFFSET 40"""


@oracle("category_page")
def _category_page():
    return ctes(CORPUS) + f"SELECT {LISTING} FROM corpus WHERE category = 'fr' ORDER BY _id LIMIT 20 OFFSET 20"


@oracle("page_after")
def _page_after():
    return ctes(CORPUS) + f"""
SELECT {LISTING} FROM corpus WHERE url > 'https://src5' OR (url = 'https://src5' AND _id > 'doc|5') ORDER BY url, _id LIMIT 20"""


@oracle("tfidf_train_bounded")
def _tfidf_train_bounded():
    return ctes(*tfidf_ctes(100)) + f"SELECT term, CAST(df AS BIGINT) AS df, idx, {r6('idf')} FROM vocab"


@oracle("capped_training_set")
def _capped_training_set():
    return ctes(CORPUS) + "SELECT _id, pdf_name FROM (SELECT * FROM corpus ORDER BY _id LIMIT 100) WHERE pdf_name IS NOT NULL"


# ---------------------------------------------------------------- ingest
META_REQUESTS = """requests AS (
  SELECT page_id, url, html, page_id % 3 <> 0 AS create_note, CASE WHEN page_id % 2 = 0 THEN 'language' ELSE 'k0' END AS note_meta_tag,
         CASE WHEN page_id % 9 = 4 THEN 404 ELSE 200 END AS http_status
  FROM meta_src)"""


def ingest_ctes(*requests: str) -> str:
    """CTEs up to ``ingested``: one row per request."""
    verify = (f"CASE WHEN ({X.url_check('url')}) IS NOT NULL THEN {X.url_check('url')} "
              f"WHEN NOT (http_status >= 200 AND http_status < 400) THEN {X.fetch_outcome('http_status', 'reason')} END")
    staged = f"""staged AS (
  SELECT page_id, url, html, create_note, note_meta_tag, verify_err, convert_err,
         CASE WHEN verify_err IS NOT NULL THEN 'URL_VERIFICATION' WHEN convert_err IS NOT NULL THEN 'PDF_CONVERSION' END AS failed_step,
         coalesce(verify_err, convert_err) AS error
  FROM (SELECT *, {verify} AS verify_err,
               CASE WHEN {X.is_blank('html')} THEN 'PDF generation failed: empty page' END AS convert_err
        FROM requests LEFT JOIN {http_reasons_values()} USING (http_status)))"""
    okreq = "okreq AS (SELECT page_id, url, html FROM staged WHERE failed_step IS NULL)"
    cats = "'## Categories' || chr(10) || '- ' || name || ' (confidence: ' || " + X.fixed2("confidence") + " || ')' || chr(10) || chr(10)"
    note = "CASE WHEN coalesce(trim(note_text) <> '', false) THEN note_text END"
    ingested = f"""ingested AS (
  SELECT page_id, _id, url, 'STORED' AS outcome, CAST(NULL AS VARCHAR) AS failed_step, CAST(NULL AS VARCHAR) AS error, title,
         {X.stored_file_name('title')} AS pdf_name, name AS category, confidence,
         CASE WHEN create_note THEN {X.note_file_name('title', 'fetched_at')} END AS note_file,
         CASE WHEN create_note THEN {markdown_sql(note, "name || ', page-snapshot'", cats)} END AS note
  FROM (SELECT d.*, c.name, c.confidence, s.create_note, m.value AS note_text
        FROM idocs d JOIN idens c ON c.doc_id = d._id JOIN staged s ON s.page_id = d.page_id
        LEFT JOIN imeta_long m ON m._id = d._id AND m.key = s.note_meta_tag)
  UNION ALL
  SELECT page_id, 'doc|p' || CAST(page_id AS VARCHAR), url, 'FAILED', failed_step, error, NULL, NULL, NULL, NULL, NULL, NULL
  FROM staged WHERE failed_step IS NOT NULL)"""
    return ctes(*requests, staged, okreq, pages_x("okreq", "ipages_x"), extracted("ipages_x", "icrawled"),
                meta_long("ipages_x", "imeta_long"), meta_text("imeta_long", "imeta_text"),
                "idocs AS (SELECT c.*, coalesce(m.meta_text, '') AS meta_text FROM icrawled c LEFT JOIN imeta_text m USING (_id))",
                density_best("idocs", density_text_sql(), name="idens"), ingested)


def ingest_sql() -> str:
    return ingest_ctes(INGEST_REQUESTS) + """
SELECT page_id, _id, url, outcome, failed_step, error, title, pdf_name, category, round(confidence, 6) AS confidence, note_file, md5(note) AS note_md5
FROM ingested"""


@oracle("ingest_meta_notes")
def _ingest_meta_notes():
    return ingest_ctes(META_PAGES_HTML, META_REQUESTS) + "SELECT _id, outcome, note_file, md5(note) AS note_md5 FROM ingested"


@oracle("ingest_step_log")
def _ingest_step_log():
    steps = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(K.INGEST_STEPS, 1))
    return ingest_ctes(INGEST_REQUESTS) + f"""
, steps AS (SELECT * FROM (VALUES {steps}) v(position, step))
SELECT i._id, CAST(s.position AS INTEGER) AS position, s.step, coalesce(s.step <> i.failed_step, true) AS success,
       CASE WHEN s.step = i.failed_step THEN i.error END AS message
FROM ingested i JOIN steps s ON s.position <= coalesce((SELECT position FROM steps f WHERE f.step = i.failed_step), {len(K.INGEST_STEPS)})"""


@oracle("ingest_counts")
def _ingest_counts():
    return ingest_ctes(META_PAGES_HTML, META_REQUESTS, CORPUS, density_best("corpus", density_text_sql())) + """
, o AS (SELECT name, count(*) AS n FROM dens GROUP BY name), d AS (SELECT category AS name, count(*) AS n FROM ingested WHERE outcome = 'STORED' GROUP BY category)
SELECT coalesce(o.name, d.name) AS name, CAST(coalesce(o.n, 0) AS BIGINT) AS old_count, CAST(coalesce(d.n, 0) AS BIGINT) AS delta,
       CAST(coalesce(o.n, 0) + coalesce(d.n, 0) AS BIGINT) AS document_count
FROM o FULL JOIN d ON o.name = d.name"""


@oracle("ingest_upsert")
def _ingest_upsert():
    return ingest_ctes(META_PAGES_HTML, META_REQUESTS, CORPUS) + """
SELECT _id, CAST(_rev AS INTEGER) AS _rev, title FROM corpus
UNION ALL SELECT _id, 1, title FROM ingested WHERE outcome = 'STORED'"""


@oracle("ingest_hybrid")
def _ingest_hybrid():
    text = X.tfidf_text("title", "description", "meta_text", "''")
    tok = X.tokens("text")
    head = ingest_ctes(META_PAGES_HTML, META_REQUESTS, *tfidf_ctes(), PREDICTIONS)
    return head + f"""
, itok AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok}) AS term FROM (SELECT _id AS doc_id, {text} AS text FROM idocs)) JOIN vocab USING (term) GROUP BY doc_id, term)
, ivec AS (SELECT doc_id, term, CASE WHEN norm > 0 THEN w / norm ELSE w END AS weight FROM (
    SELECT t.doc_id, t.term, t.tf * v.idf AS w, sqrt(sum((t.tf * v.idf) * (t.tf * v.idf)) OVER (PARTITION BY t.doc_id)) AS norm FROM itok t JOIN vocab v USING (term)))
, isc AS (SELECT i.doc_id, c.category AS name, sum(i.weight * c.weight) AS confidence FROM ivec i JOIN cvec c USING (term) GROUP BY i.doc_id, c.category)
, every AS (
    SELECT replace(doc_id, 'doc|', 'doc|p') AS doc_id, name, confidence, 0 AS src, pos FROM mp
    UNION ALL SELECT doc_id, name, confidence, 1, 0 FROM isc WHERE confidence >= {K.TFIDF_THRESHOLD}
    UNION ALL SELECT doc_id, name, confidence, 2, 0 FROM idens)
, best AS (SELECT doc_id, name, confidence, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, src, pos) AS k FROM every)
, ranked AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, name) AS rank FROM best WHERE k = 1)
SELECT i._id, arg_min(r.name, r.rank) AS category, CAST(count(*) AS INTEGER) AS n_categories, string_agg(r.name, ', ' ORDER BY r.rank) AS names
FROM ingested i JOIN ranked r ON r.doc_id = i._id WHERE outcome = 'STORED' GROUP BY i._id"""


@oracle("ingest_pages")
def _ingest_pages():
    return ingest_sql()


@oracle("ingest_stream")
def _ingest_stream():
    return ingest_sql()


@oracle("latest_status")
def _latest_status():
    return """
SELECT user_id AS doc_id, arg_max(event_type, ts) AS current_step,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended,
       CAST(count(*) AS BIGINT) AS n_steps, bool_or(event_type = 'error') AS failed, bool_or(event_type = 'purchase') AS completed,
       strftime(max(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
       CAST(CAST(round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000.0) AS BIGINT) AS VARCHAR) || 's' AS elapsed,
       arg_max(event_type || ' ' || CAST(event_id AS VARCHAR), ts) FILTER (WHERE event_type = 'error') AS last_error
FROM events GROUP BY user_id"""


@oracle("step_progress")
def _step_progress():
    from ..sources.bindings import EVENT_STEPS
    steps = "[" + ", ".join(q(s) for s in EVENT_STEPS) + "]"
    vals = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(EVENT_STEPS, 1))
    return f"""
WITH cur AS (SELECT user_id AS doc_id, coalesce(arg_max(list_position({steps}, event_type), ts) FILTER (event_type <> 'error'), 0) AS current_index
             FROM events GROUP BY user_id)
SELECT doc_id, s.step, CAST(s.idx AS INTEGER) AS step_index,
       CASE WHEN s.idx < current_index THEN 'completed' WHEN s.idx = current_index THEN 'active' ELSE 'pending' END AS state
FROM cur CROSS JOIN (VALUES {vals}) AS s(idx, step)"""


@oracle("vault_listing")
def _vault_listing():
    return ctes(CORPUS, density_best("corpus", density_text_sql()), NOTE_CATS) + f"""
SELECT doc_id, file_name, CAST(octet_length(encode(markdown)) AS BIGINT) AS size,
       strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS modified, replace(file_name, '.md', '') AS title
FROM ({corpus_notes_sql()})"""


@oracle("note_content")
def _note_content():
    return ctes(CORPUS, density_best("corpus", density_text_sql()), NOTE_CATS) + f"""
SELECT doc_id, file_name, markdown AS content FROM ({corpus_notes_sql()}) n
WHERE file_name IN (SELECT file_name FROM ({corpus_notes_sql()}) WHERE CAST(split_part(doc_id, '|', 2) AS BIGINT) % 6 = 0)"""


@oracle("note_exists")
def _note_exists():
    return ctes(CORPUS, RECLASSIFY_KEYS) + """
SELECT k._id AS doc_id, c._id IS NOT NULL AND k._id NOT IN (SELECT 'doc|' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
       AND trim(c.title) <> '' AS exists
FROM keys k LEFT JOIN corpus c ON k._id = c._id"""


@oracle("model_map_batches")
def _model_map_batches():
    req = ORACLE["model_requests"]
    return f"""
SELECT doc_id, CASE WHEN length(request) > 4000 THEN 'Long Read' ELSE 'Short Read' END AS name,
       round(CAST(length(request) % 100 AS DOUBLE) / 100.0, 6) AS confidence, 'mcp-length' AS classifier
FROM ({req})"""


@oracle("documents_by_assignment")
def _documents_by_assignment():
    return ctes(CORPUS, PREDICTIONS) + "SELECT _id, title FROM corpus WHERE _id IN (SELECT doc_id FROM mp WHERE name = 'Technology')"


@oracle("latest_status_stream")
def _latest_status_stream():
    return ORACLE["latest_status"]


@oracle("ingest_stream_hybrid")
def _ingest_stream_hybrid():
    return ORACLE["ingest_hybrid"]


@oracle("status_stream_bounded")
def _status_stream_bounded():
    return ORACLE["latest_status"]
