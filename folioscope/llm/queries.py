"""Registered queries of the subpackage, and DuckDB SQL where it can express them.

Each query applies its operator to a whole table and derives the digest
columns from the operator's real outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import best_fit_pack, bpe_stream, collocations, decontam, fim_rotate, lang_rank, quality_gbdt, quality_sketch, simhash_vp, substring_fm, template_extract, url_reputation, warc_index
from folioscope.llm.common import table


def tokenizer_path() -> str:
    """Where the public word-BPE file lies; a parameter of the operator."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def sha256_of_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that begin earlier."""
    found = substring_fm.deduplicate(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span[1] - span[0])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The url rules of op1: action, host + path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url judged by rule, else by its host's shrunk reputation."""
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's template."""
    found = template_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to the archives and read back through the index."""
    index, base = warc_index.write(table(spark, sf_dir, "pages"))
    return warc_index.read(index, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_vp.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def remainder(column: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as ''."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    profiles = lang_rank.learn(docs.where(~held_out))
    return lang_rank.predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, held against the thresholds of its language and source."""
    return quality_sketch.judge(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    forest = quality_gbdt.train(docs, labels.where(~held_out))
    return quality_gbdt.score(docs, forest).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: token count, digests of ids and text."""
    coded = bpe_stream.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        sha256_of_ids(F.col("ids")).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two and three words of every language."""
    return collocations.mine(table(spark, sf_dir, "documents"), most_words=3, least=10, share=50, top=2000)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its blocks exchanged for filling in the middle, and back."""
    found = fim_rotate.restore(fim_rotate.transform(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces packed into sequences of 2048 tokens."""
    return best_fit_pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op4_decontam": op4_decontam,
    "op5_simhash": op5_simhash,
    "op6_langid": op6_langid,
    "op7_rules": op7_rules,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_substring": op10_substring,
    "op11_collocations": op11_collocations,
    "op12_fim": op12_fim,
    "op13_packing": op13_packing,
}

OP1_SQL = """
WITH seen AS (
  SELECT page_id, u AS url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, url AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages)
), outcome AS (
  SELECT doc_id, min(CASE WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END END) AS good
  FROM labels GROUP BY doc_id
), h AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good,
         split_part(host, '.', -1) AS suffix,
         CASE WHEN strpos(host, '.') > 0 THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain
  FROM seen LEFT JOIN outcome ON page_id = doc_id GROUP BY host
), d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL
), m AS (
  SELECT lvl, sum(n) AS n, sum(good) / sum(n) AS p, count(*) AS k, sum(n * n) AS nn, sum(good * good / n) AS gg
  FROM (SELECT 'h' AS lvl, n::DOUBLE AS n, good::DOUBLE AS good FROM h WHERE n > 0 UNION ALL SELECT 'd', n, good FROM d WHERE n > 0 UNION ALL SELECT 's', n, good FROM s WHERE n > 0)
  GROUP BY lvl
), b AS (SELECT lvl, p, (gg - p * p * n - (k - 1) * p * (1 - p)) / nullif(n - nn / n, 0) AS between_ FROM m
), prior AS (SELECT lvl, p, greatest(1.0, least(1000.0, CASE WHEN between_ > 0 THEN p * (1 - p) / between_ - 1 ELSE 1000.0 END)) AS k FROM b
), ks AS (SELECT coalesce((SELECT k FROM prior WHERE lvl = 's'), 1.0) AS s, coalesce((SELECT k FROM prior WHERE lvl = 'd'), 1.0) AS d,
                 coalesce((SELECT k FROM prior WHERE lvl = 'h'), 1.0) AS h, coalesce((SELECT p FROM prior WHERE lvl = 's'), 0.5) AS p
), sr AS (SELECT suffix, (good + ks.s * ks.p) / (n + ks.s) AS rate FROM s, ks
), dr AS (SELECT domain, (good + ks.d * sr.rate) / (n + ks.d) AS rate FROM d JOIN sr USING (suffix), ks
), hr AS (SELECT host, n, ks.h AS k, (good + ks.h * dr.rate) / (n + ks.h) AS rate FROM h JOIN dr USING (domain), ks
), rules AS (SELECT * FROM (VALUES ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'),
    ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')) t(action, rhost, rpath, rule)
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM seen) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN rate + 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       n AS n_labelled
FROM seen JOIN hr USING (host) LEFT JOIN best USING (host, path)
"""

OP7_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w
), win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos
), rep AS (SELECT doc_id, count(DISTINCT i + d) AS r FROM win, (VALUES (0), (1), (2)) v(d) WHERE c > 1 GROUP BY doc_id
), c AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), v AS (
  SELECT lang, source, rate, CASE WHEN value > 0 THEN ceil(ln(value) / ln(1.01 / 0.99)) END AS bucket
  FROM (SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS rate,
               unnest([word_chars / greatest(n_words, 1), n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1)]) AS value
        FROM c)
), b AS (SELECT lang, source, rate, bucket, count(*) AS n FROM v GROUP BY ALL
), cum AS (
  SELECT *, coalesce(pow(1.01 / 0.99, bucket) * (2 / (1.01 / 0.99 + 1)), 0) AS value,
         sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket NULLS FIRST) AS c, sum(n) OVER (PARTITION BY lang, source, rate) AS a FROM b
), q AS (
  SELECT lang, source, rate, min(value) FILTER (c >= a * 0.5) AS mid, min(value) FILTER (c >= a * 0.85) AS high FROM cum GROUP BY ALL
), m AS (SELECT lang, source, rate, high + 3 * (high - mid) AS most FROM q
), lim AS (
  SELECT lang, source, max(most) FILTER (rate = 'word_length') AS wl, max(most) FILTER (rate = 'symbols') AS sy,
         max(most) FILTER (rate = 'dup_lines') AS dl, max(most) FILTER (rate = 'repeats') AS re FROM m GROUP BY ALL
), f AS (
  SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, wl, sy, dl, re
  FROM c JOIN lim ON c.lang IS NOT DISTINCT FROM lim.lang AND c.source IS NOT DISTINCT FROM lim.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars <= wl * n_words + 3 * sqrt(wl * n_words + 1) AND n_symbols <= sy * n_words + 3 * sqrt(sy * n_words + 1)
       AND n_dup_lines <= dl * n_lines + 3 * sqrt(dl * n_lines + 1) AND n_repeat_words <= re * n_words + 3 * sqrt(6 * (re * n_words + 6)) AS kept
FROM f
"""

OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (length(t) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (length(t) + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS q FROM t
), f AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain'
                            WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form, least(c1, c2) AS a, greatest(c1, c2) AS b FROM d
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

OP11_SQL = r"""
WITH p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), s AS MATERIALIZED (SELECT lang, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b, unnest(list_concat(w[3:], [NULL, NULL])) AS c FROM w WHERE len(w) > 0
), g AS MATERIALIZED (
  SELECT lang, 1 AS m, a AS phrase, a, NULL AS b, NULL AS c, count(*)::BIGINT AS f FROM s WHERE a IS NOT NULL GROUP BY lang, a
  UNION ALL SELECT lang, 2, a || ' ' || b, a, b, NULL, count(*)::BIGINT FROM s WHERE b IS NOT NULL GROUP BY lang, a, b HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, a, b, c, count(*)::BIGINT FROM s WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 10
), tot AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang
), c AS MATERIALIZED (SELECT lang, m, phrase, a AS w1, b AS w2, c AS w3, f AS a FROM g WHERE m > 1
), parts AS (
  SELECT lang, phrase, a, 1 AS k, w1 AS x, CASE m WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, w1 || ' ' || w2, w3 FROM c WHERE m = 3
), cut AS (
  SELECT p.lang, p.phrase, p.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * p.a * p.a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN g x ON x.lang || chr(10) || x.phrase = p.lang || chr(10) || p.x JOIN g y ON y.lang || chr(10) || y.phrase = p.lang || chr(10) || p.y
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE m = 3) GROUP BY ALL
), alone AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op11_collocations": OP11_SQL,
    "op12_fim": OP12_SQL,
    "op7_rules": OP7_SQL,
    "op1_url_reputation": OP1_SQL,
}
