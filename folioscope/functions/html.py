"""Page metadata from raw HTML: title, description, canonical URL, meta tags.

Comments, ``<script>`` and ``<style>`` blocks go first, since a parser sees
no tags in them. Then one pattern finds the ``meta`` and ``link`` tags,
stepping over quoted values, and one cuts each tag into its attributes from
left to right. Every step's array is a column of its own before the next
step looks into it (an array named inside a lambda is otherwise computed
once per element), so the cost grows with the size of the page only.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .text import col_

STRIP_BLOCKS = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
#: a tag: names and stray quotes, spaces, and '=' with a quoted or bare value
TAG = r"""(?is)<%s(?=[\s/>])(?:[^\s"'>=]++|\s++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+>"""
#: an attribute: its name, then its value in double quotes, single quotes or bare
ATTRIBUTE = r"""(?s)([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?)?"""
#: a character reference, or a run of other text
REFERENCE = r"&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"


def strip_blocks(html) -> Column:
    return F.regexp_replace(col_(html), STRIP_BLOCKS, " ")


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    safe = F.when(bad | code.isNull(), F.lit(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(s) -> Column:
    """Decimal, hexadecimal and the HTML 4 named references, in one pass: what
    a reference stands for is not decoded again."""
    c = col_(s)
    names = F.create_map(*(F.lit(x) for pair in sorted(name2codepoint.items()) for x in (pair[0], chr(pair[1]))))
    names = F.map_concat(names, F.create_map(F.lit("apos"), F.lit("'")))

    def one(t: Column) -> Column:
        body = F.rtrim(t, F.lit(";"))
        return (F.when(t.rlike("^&#[xX]"), _character(F.conv(F.substr(body, F.lit(4)), 16, 10).cast("long")))
                .when(F.startswith(t, F.lit("&#")), _character(F.substr(body, F.lit(3)).cast("long")))
                .when(F.startswith(t, F.lit("&")) & F.endswith(t, F.lit(";")), F.coalesce(F.try_element_at(names, F.substr(body, F.lit(2))), t))
                .otherwise(t))
    parts = F.regexp_extract_all(c, F.lit(REFERENCE), 0)
    return F.when(F.instr(c, "&") > 0, F.array_join(F.transform(parts, one), "")).otherwise(c)


def normalize_ws(s) -> Column:
    return F.trim(F.regexp_replace(col_(s), r"\s+", " "))


def is_blank(html) -> Column:
    h = col_(html)
    return h.isNull() | (F.trim(h) == "")


def raw_title(clean_html) -> Column:
    return normalize_ws(decode_entities(F.regexp_extract(col_(clean_html), TITLE, 1)))


def title(clean_html, html) -> Column:
    t = raw_title(clean_html)
    return (F.when(is_blank(html), F.lit(K.FALLBACK_TITLE))
            .when(t == "", F.lit(K.UNTITLED)).otherwise(t))


def _attributes(clean_html: Column, tag: str) -> Column:
    """Per tag the attributes' names (lower case) and values, in order."""
    def cut(t: Column) -> Column:
        inner = F.substr(t, F.lit(len(tag) + 2))
        group = lambda i: F.regexp_extract_all(inner, F.lit(ATTRIBUTE), i)
        join = lambda a, b: F.concat(a, b)
        values = F.zip_with(F.zip_with(group(2), group(3), join), group(4), join)
        return F.struct(F.transform(group(1), lambda x: F.lower(x)).alias("names"), values.alias("values"))
    return F.transform(F.regexp_extract_all(clean_html, F.lit(TAG % tag), 0), cut)


def _fields(attributes: Column, wanted: tuple[str, ...]) -> Column:
    """Per tag each wanted attribute's decoded value; null if it has none. Of a
    repeated attribute the first counts."""
    def pick(a: Column, name: str) -> Column:
        at = F.array_position(a["names"], name)
        return F.when(at > 0, decode_entities(F.get(a["values"], (at - 1).cast("int"))))
    return F.transform(attributes, lambda a: F.struct(*(pick(a, name).alias(name) for name in wanted)))


def _first(tags: str, key: str, wanted: str, value: str) -> Column:
    """``value`` of the first tag that has it and whose ``key`` is ``wanted``
    (any case, blanks around it); null if there is none or it is empty."""
    hits = F.filter(F.col(tags), lambda t: (F.lower(F.trim(t[key])) == wanted) & t[value].isNotNull())
    return F.nullif(F.get(hits, 0)[value], F.lit(""))


def with_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with ``title``, ``description``, ``canonical_url`` and ``meta_tags`` (a
    map; of a repeated key the last value counts; null without HTML)."""
    blank, keep = is_blank(html), [F.col(c) for c in pages.columns]
    df = pages.select(*keep, strip_blocks(html).alias("_clean"))
    df = df.select(*keep, title("_clean", html).alias("title"),
                   _attributes(F.col("_clean"), "meta").alias("_metas"), _attributes(F.col("_clean"), "link").alias("_links"))
    df = df.select(*keep, "title", _fields(F.col("_metas"), ("name", "property", "content")).alias("_metas"),
                   _fields(F.col("_links"), ("rel", "href")).alias("_links"))
    pairs = F.transform(F.col("_metas"), lambda t, i: F.struct(
        F.coalesce(F.nullif(t["name"], F.lit("")), t["property"], F.lit("")).alias("key"), (-i).alias("back"),
        F.coalesce(t["content"], F.lit("")).alias("value")))
    df = df.select(
        *keep, "title",
        F.when(blank, F.lit(K.FALLBACK_DESCRIPTION)).otherwise(F.coalesce(
            _first("_metas", "name", "description", "content"), _first("_metas", "property", "og:description", "content"),
            F.concat(F.lit(K.DESCRIPTION_PREFIX), F.col(url)))).alias("description"),
        F.when(blank, F.col(url)).otherwise(F.coalesce(
            _first("_links", "rel", "canonical", "href"), _first("_metas", "property", "og:url", "content"),
            F.col(url))).alias("canonical_url"),
        F.array_sort(F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != ""))).alias("_pairs"))
    # sorted by key, newest first: the first entry of a key is its last tag. The array is
    # bound by an outer lambda: a pushed-down filter would otherwise put its whole
    # expression inside the inner one
    def last_of_key(p: Column) -> Column:
        return F.filter(p, lambda e, i: (i == 0) | (F.get(p, i - 1)["key"] != e["key"]))
    kept = F.get(F.transform(F.array(F.col("_pairs")), last_of_key), F.lit(0))
    entries = F.transform(kept, lambda e: F.struct(e["key"], e["value"]))
    return df.select(*keep, "title", "description", "canonical_url",
                     F.when(~blank, F.map_from_entries(entries)).alias("meta_tags"))
