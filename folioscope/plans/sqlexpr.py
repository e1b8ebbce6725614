"""DuckDB SQL expression builders that restate the column functions.

The correctness gate runs every registered query next to an independent SQL
statement over the same Parquet tables. These helpers spell out each rule
once in SQL text (with DuckDB spellings: the 'g' flag for global replace,
``len(regexp_extract_all(...))`` for regex counts, DOUBLE casts where a
decimal literal would change the arithmetic).
"""

from __future__ import annotations

from .. import constants as K

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def part(c: str) -> str:
    return f"coalesce({c} || ' ', '')"


def lower(c: str) -> str:
    return f"lower({c})"


def rules_text(title, desc, url, meta_text) -> str:
    return f"({part(title)} || {part(desc)} || {part(url)} || {meta_text})"


def density_text(title, desc, url, meta_text) -> str:
    return f"lower({part(title)} || {part(desc)} || {meta_text} || {part(url)})"


def tfidf_text(title, desc, meta_text, body) -> str:
    return f"({part(title)} || {part(desc)} || {meta_text} || coalesce({body}, ''))"


def fold(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]', '_', 'g')"


def word_count(c: str) -> str:
    return f"len(string_split_regex(regexp_replace({c}, '\\s+$', ''), '\\s+'))"


def regex_count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def density_hits(folded: str, patterns) -> str:
    return " + ".join(regex_count(folded, r"(?i)\b(" + p + r")\b") for p in patterns)


def tokens(c: str) -> str:
    stop = ", ".join(q(w) for w in K.STOP_WORDS)
    return (f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[\\W_]+'), "
            f"lambda t: length(t) >= {K.MIN_TOKEN_LENGTH} AND t NOT IN ({stop}))")


def url_domain(c: str) -> str:
    d = f"regexp_replace({c}, '^https?://', '')"
    d = f"regexp_replace({d}, '^www\\.', '')"
    d = f"regexp_replace({d}, '/.*$', '')"
    return f"coalesce(lower({d}), '')"


def url_check(c: str) -> str:
    """Spelt out on its own: split at '#', '?' and the scheme's ':', then one
    character class per part."""
    esc, other = "%[0-9A-Fa-f]{2}", "[^\\x00-\\x7F\\s\\p{Z}\\p{C}]"
    name = f"([A-Za-z0-9_.!~*''(),;:$&+=@-]|{esc}|{other})*"
    path, any_ = name.replace(";:", ";:/"), name.replace(";:", ";:/?\\[\\]")
    ref, frag = f"regexp_replace({c}, '(?s)#.*$', '')", f"regexp_extract({c}, '(?s)#(.*)$', 1)"
    scheme = f"regexp_extract({ref}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    rest = f"(CASE WHEN {scheme} <> '' THEN substr({ref}, length({scheme}) + 2) ELSE {ref} END)"
    hier, query = f"regexp_replace({rest}, '(?s)[?].*$', '')", f"regexp_extract({rest}, '(?s)[?](.*)$', 1)"
    good = (f"regexp_full_match({frag}, '{any_}') AND CASE "
            f"WHEN {scheme} <> '' AND NOT starts_with({rest}, '/') THEN {rest} <> '' AND regexp_full_match({rest}, '{any_}') "
            f"WHEN starts_with({hier}, '//') THEN regexp_full_match({query}, '{any_}') AND ({hier} <> '//' OR contains({c}, '?') OR contains({c}, '#')) "
            f"AND regexp_full_match(regexp_extract({hier}, '^//([^/]*)', 1), '{name}(\\[[0-9A-Fa-f:.%]+\\](:[0-9]*)?)?') "
            f"AND regexp_full_match(regexp_replace({hier}, '^//[^/]*', ''), '{path}') "
            f"ELSE regexp_full_match({query}, '{any_}') AND regexp_full_match({hier}, '{path}') "
            f"AND ({scheme} <> '' OR NOT contains(split_part({hier}, '/', 1), ':')) END")
    return (f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN {q(K.MSG_URL_REQUIRED)} WHEN NOT ({good}) THEN {q(K.MSG_BAD_FORMAT)} "
            f"WHEN NOT regexp_matches({c}, '^https?:') THEN {q(K.MSG_BAD_SCHEME)} END")


def fetch_outcome(status: str, reason: str) -> str:
    return (f"CASE WHEN {status} >= 200 AND {status} < 400 THEN {q(K.MSG_ACCESSIBLE)} "
            f"WHEN {status} >= 400 AND {status} < 500 THEN 'Client error: ' || CAST({status} AS VARCHAR) || ' ' || coalesce({reason}, '') "
            f"ELSE 'Server error: ' || CAST({status} AS VARCHAR) || ' ' || coalesce({reason}, '') END")


def stored_file_base(t: str) -> str:
    s = f"regexp_replace({t}, '[\\\\/:*?\"<>|]', '_', 'g')"
    s = f"regexp_replace({s}, '\\s+', '_', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    s = f"substr(trim({s}), 1, {K.STORED_NAME_MAX})"
    s = f"(CASE WHEN suffix({s}, '_') THEN substr({s}, 1, length({s}) - 1) ELSE {s} END)"
    return f"(CASE WHEN {t} IS NULL OR trim({t}) = '' OR {s} = '' THEN {q(K.DEFAULT_FILE_BASE)} ELSE {s} END)"


def stored_file_name(t: str) -> str:
    return f"({stored_file_base(t)} || '.pdf')"


def download_file_name(n: str) -> str:
    s = f"coalesce(nullif({n}, ''), 'document.pdf')"
    s = f"regexp_replace({s}, '[^a-zA-Z0-9._-]', '_', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    s = f"(CASE WHEN suffix(lower({s}), '.pdf') THEN {s} ELSE {s} || '.pdf' END)"
    return f"(CASE WHEN length({s}) > {K.DOWNLOAD_NAME_MAX} THEN substr({s}, 1, {K.DOWNLOAD_NAME_MAX - 4}) || '.pdf' ELSE {s} END)"


def link_file_name(n: str) -> str:
    return f"substr(regexp_replace(coalesce({n}, 'document.pdf'), '[<>:\"/\\\\|?*]', '_', 'g'), 1, {K.LINK_NAME_MAX})"


def path_safe_id(c: str) -> str:
    return f"replace({c}, '|', '-')"


def note_file_name(title: str, ts: str) -> str:
    s = f"regexp_replace({title}, '[^a-zA-Z0-9\\s\\-_]', '', 'g')"
    s = f"lower(regexp_replace({s}, '\\s+', '_', 'g'))"
    return f"(substr({s}, 1, {K.NOTE_TITLE_MAX}) || '_' || strftime({ts}, '%Y%m%d_%H%M%S') || '.md')"


def fixed1(x: str) -> str:
    """One decimal, half-up on the shortest decimal text of the double."""
    return f"CAST(round(CAST(CAST({x} AS DOUBLE) AS DECIMAL(38,10)), 1) AS DECIMAL(38,1))::VARCHAR"


def fixed2(x: str) -> str:
    return f"CAST(round(CAST(CAST({x} AS DOUBLE) AS DECIMAL(38,10)), 2) AS DECIMAL(38,2))::VARCHAR"


def size_text(b: str) -> str:
    parts = [f"WHEN {b} < 1024 THEN CAST({b} AS VARCHAR) || ' B'"]
    units = list(K.SIZE_UNITS)
    for k, u in enumerate(units, start=1):
        lo = 1024 ** k
        cond = f"{b} >= {lo}" if k == len(units) else f"{b} < {lo * 1024}"
        parts.append(f"WHEN {cond} THEN {fixed1(f'{b} / {float(lo)!r}')} || ' {u}B'")
    return "(CASE " + " ".join(parts) + " END)"


def size_label(b: str) -> str:
    e = f"(CASE WHEN {b} < 1024 THEN 0 WHEN {b} < 1048576 THEN 1 ELSE 2 END)"
    v = f"round({b} / pow(1024.0, {e}), 2)"
    txt = f"regexp_replace(printf('%.2f', {v}), '\\.?0+$', '')"
    return f"(CASE WHEN {b} = 0 THEN '0 Bytes' ELSE {txt} || ' ' || ['Bytes', 'KB', 'MB'][{e} + 1] END)"


def iso_seconds(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


# ---------------------------------------------------------------- HTML
# Written on its own, with RE2 patterns: nothing here comes from functions/html.py.
def strip_blocks(h: str) -> str:
    p = r"(?is)<!--.*?(-->|$)|<script\b[^>]*>.*?(</script\s*>|$)|<style\b[^>]*>.*?(</style\s*>|$)"
    return f"regexp_replace({h}, {q(p)}, ' ', 'g')"


def decode_entities(s: str) -> str:
    # the names that the test tables hold
    known = [("amp", 38), ("lt", 60), ("gt", 62), ("quot", 34), ("apos", 39), ("nbsp", 160), ("copy", 169), ("middot", 183),
             ("eacute", 233), ("euro", 8364)]
    names = "[" + ", ".join(q("&" + n + ";") for n, _ in known) + "]"
    codes = "[" + ", ".join(str(c) for _, c in known) + "]"
    hexa, deci = "('0x' || regexp_extract(t, '[xX]([0-9a-fA-F]+)', 1))::BIGINT", "regexp_extract(t, '[0-9]+')::BIGINT"
    one = lambda n: f"CASE WHEN {n} = 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(({n})::INTEGER) END"
    return (f"CASE WHEN contains({s}, '&') THEN array_to_string(list_transform("
            f"regexp_extract_all({s}, '&#[0-9]{{1,7}};?|&#[xX][0-9a-fA-F]{{1,6}};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&'), "
            f"lambda t: CASE WHEN regexp_matches(t, '^&#[xX]') THEN {one(hexa)} WHEN regexp_matches(t, '^&#') THEN {one(deci)} "
            f"WHEN list_contains({names}, t) THEN chr(({codes}[list_position({names}, t)])::INTEGER) ELSE t END), '') ELSE {s} END")


def normalize_ws(s: str) -> str:
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


ATTRS = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?"""


def parts(tag: str, group: int) -> str:
    return f"regexp_extract_all(regexp_replace({tag}, '^<[a-zA-Z]+', ''), {q(ATTRS)}, {group})"


def attr_at(tag: str, name: str) -> str:
    return f"list_position(list_transform({parts(tag, 1)}, lambda n: lower(n)), {q(name)})"


def attr(tag: str, name: str) -> str:
    """Decoded value of the first attribute of that name; '' if there is none."""
    at = attr_at(tag, name)
    raw = " || ".join(f"coalesce({parts(tag, g)}[{at}], '')" for g in (2, 3, 4))
    return f"(CASE WHEN coalesce({at}, 0) > 0 THEN {decode_entities(f'({raw})')} ELSE '' END)"


def has_attr(tag: str, name: str) -> str:
    return f"coalesce({attr_at(tag, name)}, 0) > 0"


def is_blank(h: str) -> str:
    return f"({h} IS NULL OR trim({h}) = '')"


def raw_title(clean: str) -> str:
    p = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
    return normalize_ws(decode_entities(f"regexp_extract({clean}, {q(p)}, 1)"))


def title(clean: str, h: str) -> str:
    t = raw_title(clean)
    return f"(CASE WHEN {is_blank(h)} THEN {q(K.FALLBACK_TITLE)} WHEN {t} = '' THEN {q(K.UNTITLED)} ELSE {t} END)"


def _first_content(tags: str, key_attr: str, key_value: str, value_attr: str) -> str:
    hit = f"list_filter({tags}, lambda t: lower(trim({attr('t', key_attr)})) = {q(key_value)} AND {has_attr('t', value_attr)})[1]"
    return f"coalesce({attr(hit, value_attr)}, '')"


def _tags(clean: str, name: str) -> str:
    p = r"""(?is)<NAME(?:\s|/)(?:[^"'>=]|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s>"'][^\s>]*|["'=])*>""".replace("NAME", name)
    return f"regexp_extract_all({clean}, {q(p)})"


def meta_tags(clean: str) -> str:
    return _tags(clean, "meta")


def link_tags(clean: str) -> str:
    return _tags(clean, "link")


def description(clean: str, h: str, url: str) -> str:
    by_name = _first_content(meta_tags(clean), "name", "description", "content")
    by_og = _first_content(meta_tags(clean), "property", "og:description", "content")
    return (f"(CASE WHEN {is_blank(h)} THEN {q(K.FALLBACK_DESCRIPTION)} ELSE coalesce(nullif({by_name}, ''), "
            f"nullif({by_og}, ''), {q(K.DESCRIPTION_PREFIX)} || {url}) END)")


def canonical(clean: str, h: str, url: str) -> str:
    by_link = _first_content(link_tags(clean), "rel", "canonical", "href")
    by_og = _first_content(meta_tags(clean), "property", "og:url", "content")
    return (f"(CASE WHEN {is_blank(h)} THEN {url} ELSE coalesce(nullif({by_link}, ''), nullif({by_og}, ''), {url}) END)")
