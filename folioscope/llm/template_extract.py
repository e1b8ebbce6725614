"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its elements, told apart by their path of
element names and classes. Over all pages of a host every token has an
occurrence vector (how often it occurs on each page); tokens with the same
vector form a class. Vectors are never gathered: a task folds, per token, the
hash of (page, count) into a 64-bit fingerprint by exclusive or, next to the
number of pages and occurrences, and Spark folds the tasks' rows, so a host
with a third of all pages is a few hundred rows.

Classes found on at least half of the host's pages are nested by their paths
into the host's template. Its slots are the places of the template where text
varies. The main slots are the article (or main) elements of the template,
else the smallest place that holds most of the text which is neither link nor
boilerplate. A second pass takes the blocks of text in the main slots, without
menus, headers, footers, sidebars, notices, adverts, forms and reader comments
nested there. What a class word or a form marks is no boilerplate if it holds
most of the plain text and no article or main element lies outside, or if
nothing else is left.

Defined results: null and empty html give an empty text. A page without any of
its host's main slots falls back to its own article or main element, else to
its body; an article or main element outside the slots that holds more plain
text than they do counts as a slot of the page. Pages without a host share the host ''. Repeated rows stay; ids may
be null. Unclosed, stray and misnested tags are tolerated. Other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import map_slices, slices, written
from folioscope.llm.url_reputation import url_host

#: Share of a host's pages that a token of the template is found on.
SUPPORT = 0.5
#: Share of the text that a slot must hold to be the main one where no element says so.
MAIN_SHARE = 0.6
#: Templates are broadcast up to this many bytes of paths, else joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Elements deeper than this no longer lengthen a path.
DEEPEST = 64
#: Distinct tokens that a task holds before it passes its counts on.
HELD_TOKENS = 200_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)

# FIXED VALUES: element kinds of HTML
RAW = frozenset("script style textarea title noscript template iframe svg select annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small "
                   "span strike strong sub sup time tt u var wbr img math semantics mrow mi mn mo ms mtext msup msub msubsup "
                   "mfrac msqrt mroot mover munder munderover mstyle mpadded".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 "
                     "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDS_SIBLINGS = frozenset("ul ol dl table select menu".split())
# FIXED VALUES: elements and class words that are not main text
BOILERPLATE = frozenset("nav aside footer button head menu dialog".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer menu modal nav navbar navigation newsletter notice notices popup promo related replies reply respond share "
    "sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
#: A class name with one of these tells a state of the page, not what an element is.
STATE_WORDS = frozenset("has no not without with is open opened closed enabled disabled".split())
#: Elements that hold the page or its main text, whatever their classes say.
HOLDERS = frozenset("html body main article".split())


@lru_cache(maxsize=100_000)
def label(name: str, attributes: str) -> str:
    """An element's name with its class and id words, digits made alike."""
    found = sorted({w for m in ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()})
    return ".".join([name, *(re.sub(r"[\d>#]+", "0", w) for w in found)])


@lru_cache(maxsize=100_000)
def is_named_boilerplate(part: str) -> bool:
    """Whether an element counts as boilerplate by a class word, or as a form."""
    name, *classes = part.split(".")
    if name in HOLDERS:
        return False
    parts = [set(re.split(r"[^a-z]+", c)) for c in classes]
    return name == "form" or any(BOILERPLATE_WORDS & w and not STATE_WORDS & w for w in parts)


@lru_cache(maxsize=100_000)
def is_boilerplate(part: str) -> bool:
    return part.partition(".")[0] in BOILERPLATE or is_named_boilerplate(part)


@lru_cache(maxsize=100_000)
def in_boilerplate(path: str, spared: frozenset[str] = frozenset()) -> bool:
    """Whether a path leads through boilerplate other than the places
    ``spared``; a header counts outside an article only."""
    parts = path.split(">")
    if any(is_boilerplate(p) and not (spared and ">".join(parts[:i + 1]) in spared) for i, p in enumerate(parts)):
        return True
    names = [p.partition(".")[0] for p in parts]
    return "header" in names and "article" not in names[:names.index("header")]


@lru_cache(maxsize=100_000)
def named_places(path: str) -> tuple[str, ...] | None:
    """The places on a path that count as boilerplate by name only; None if others are on it."""
    parts = path.split(">")
    places = [">".join(parts[:i + 1]) for i, p in enumerate(parts) if is_named_boilerplate(p)]
    return None if in_boilerplate(path, frozenset(places)) else tuple(places)


def spared_places(sizes: list[tuple[str, int]]) -> frozenset[str]:
    """Places that hold most of the plain text (path, characters) and are
    therefore no boilerplate, unless an article or main element outside has text."""
    total, holds, own = 0, Counter(), False
    for path, n in sizes:
        places = named_places(path)
        if places is not None:
            total += n
            own |= bool(n) and not places and any(p.partition(".")[0] in ("article", "main") for p in path.split(">"))
            for place in places:
                holds[place] += n
    return frozenset() if own else frozenset(p for p, n in holds.items() if 2 * n > total)


def walk(page: str) -> Iterator[tuple[str, str | None, bool]]:
    """The page's tokens in order: (path, None, False) for an element that
    opens, ('', None, True) at an edge between blocks, (path, text, in a link) for text."""
    stack: list[tuple[str, str]] = [("", "")]
    opened: Counter[str] = Counter()
    at, end = 0, len(page)

    def close(name: str) -> None:
        """Ends the innermost open element of that name and all within."""
        while opened[name]:
            ended = stack.pop()[0]
            opened[ended] -= 1
            if ended == name:
                return

    def path_of(part: str) -> str:
        """Where an element lies; below DEEPEST only boilerplate adds to it."""
        above = stack[-1][1]
        if len(stack) > DEEPEST and (in_boilerplate(above) or not is_boilerplate(part)):
            return above
        return f"{above}>{part}" if above else part

    while at < end:
        m = TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            yield stack[-1][1], text, opened["a"] > 0
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name not in INLINE:
            yield "", None, True
        if closing:
            close(name)
            continue
        if name in CLOSES_P:
            close("p")
        if name in SIBLINGS:
            for n, _ in stack[:-DEEPEST:-1]:
                if n in HOLDS_SIBLINGS:
                    break
                if n in SIBLINGS[name]:
                    close(n)
        if name == "body":
            close("head")
        path = path_of(label(name, attributes))
        yield path, None, False
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in CLOSES_P:
            continue
        if name in RAW:
            last = re.compile(rf"</{re.escape(name)}\s*+[^>]*+>", re.I).search(page, at)
            at = last.end() if last else end
            continue
        stack.append((name, path))
        opened[name] += 1


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, characters outside links) of each block that holds text,
    character references decoded, white space turned into single spaces."""
    out: list[tuple[str, str, int]] = []
    path, parts, plain = "", [], 0

    def flush() -> None:
        nonlocal plain
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((path, text, plain))
            parts.clear()
            plain = 0

    for where, text, flag in walk(page):
        if text is not None:
            if parts and where != path and (in_boilerplate(where) != in_boilerplate(path)):
                flush()
            if not parts or not "".join(parts).strip():
                path = where
            parts.append(text)
            plain += 0 if flag else len(text) - text.count(" ")
        elif flag:
            flush()
    flush()
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and path: pages, occurrences, fingerprint of the occurrence
    vector, characters of text and of links directly in it."""
    held: dict[tuple[str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        made = pa.record_batch(
            [pa.array([k[0] for k in held]), pa.array([k[1] for k in held]),
             *(pa.array([v[i] - (1 << 64) if i == 2 and v[i] >> 63 else v[i] for v in held.values()], pa.int64()) for i in range(5))],
            names=["host", "path", "pages", "total", "vector", "chars", "links"])
        held.clear()
        return made

    for part in slices(batches, 2):
        for page_id, host, page in zip(*(c.to_pylist() for c in part.columns)):
            counts: dict[str, list[int]] = {"": [1, 0, 0]}
            for path, text, flag in walk(page or ""):
                if text is not None:
                    seen = counts.setdefault(path, [0, 0, 0])
                    n = len(text) - text.count(" ")
                    seen[1] += n
                    seen[2] += n if flag else 0
                elif not flag:
                    counts.setdefault(path, [0, 0, 0])[0] += 1
            page_hash = f"{page_id}|{xxhash.xxh64_hexdigest((page or '').encode('utf-8', 'surrogatepass'))}|"
            for path, (n, chars, links) in counts.items():
                row = held.setdefault((host, path), [0, 0, 0, 0, 0])
                row[0] += 1
                row[1] += n
                row[2] ^= xxhash.xxh64_intdigest(page_hash + str(n))
                row[3] += chars
                row[4] += links
        if len(held) > HELD_TOKENS:
            yield out()
    if held:
        yield out()


def nest(classes: list[tuple[list[str], int, int]]) -> list[tuple[str, list[str], int]]:
    """Valid classes as (path of the class they are nested in, own paths, text
    characters). A class is valid if its paths lie below one place of its
    parent: an earlier class holds the longest path that leads to all of them."""
    known = {p for paths, _, _ in classes for p in paths}
    out = []
    for paths, chars, _ in classes:
        paths = sorted(paths, key=lambda p: (p.count(">"), p))
        above = paths[0]
        while above:
            above = above.rpartition(">")[0]
            if above in known and above not in paths:
                break
        if all(not above or p.startswith(above + ">") for p in paths):
            out.append((above, paths, chars))
    return out


def main_slots(classes: list[tuple[list[str], int, int]], direct: dict[str, tuple[int, int]]) -> list[str]:
    """The main slots of a template. ``direct``: characters of text and of
    links that lie directly in each path."""
    spared = spared_places([(p, n - links) for p, (n, links) in direct.items()])
    places = [p for _, paths, _ in nest(classes) for p in paths if p and not in_boilerplate(p, spared)]
    for wanted in ("article", "main"):
        found = sorted(p for p in places if p.rpartition(">")[2].partition(".")[0] == wanted)
        if found:
            return [p for p in found if not any(p.startswith(o + ">") for o in found)]
    plain = {p: n - links for p, (n, links) in direct.items() if not in_boilerplate(p, spared)}
    total = sum(plain.values())
    holds = {p: sum(n for q, n in plain.items() if q == p or q.startswith(p + ">")) for p in places}
    best = [p for p, n in holds.items() if total and n >= MAIN_SHARE * total]
    return [max(best, key=lambda p: (p.count(">"), p))] if best else []


def templates(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``host`` and ``slots`` (paths of its main slots) of every host."""
    rows = pages.select(F.col(id_column).cast("string").alias("id"), url_host(F.col(url_column)).alias("host"),
                        F.col(html_column).alias("page"))
    counted = rows.mapInArrow(_tokens, "host string, path string, pages bigint, total bigint, vector bigint, chars bigint, links bigint")
    tokens = counted.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "chars", "links")),
                                                 F.bit_xor("vector").alias("vector"))
    tokens = written(tokens, "tokens")
    of_host = tokens.where("path = ''").select("host", F.col("pages").alias("all"))
    frequent = tokens.join(of_host, "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    classes = frequent.groupBy("host", "pages", "total", "vector").agg(
        F.collect_list(F.struct("path", "chars", "links")).alias("members"))
    hosts = classes.groupBy("host").agg(F.collect_list(F.struct("members", "total")).alias("classes"))

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = []
            for found in batch.column(1).to_pylist():
                direct = {m["path"]: (m["chars"], m["links"]) for c in found for m in c["members"]}
                slots.append(main_slots([([m["path"] for m in c["members"]], sum(m["chars"] for m in c["members"]), c["total"])
                                         for c in found], direct))
            yield pa.record_batch([batch.column(0), pa.array(slots, pa.list_(pa.string()))], names=["host", "slots"])

    return written(hosts.mapInArrow(deduce, "host string, slots array<string>"), "templates")


def own_place(path: str, slots: list[str]) -> str | None:
    """The outermost article or main element on a path that holds no slot."""
    parts = path.split(">")
    for i, part in enumerate(parts):
        place = ">".join(parts[:i + 1])
        if part.partition(".")[0] in ("article", "main") and not any(s.startswith(place + ">") for s in slots):
            return place
    return None


def main_text(page: str | None, slots: list[str]) -> str:
    found = blocks(page or "")
    spared = spared_places([(p, n) for p, _, n in found])
    left = [b for b in found if not in_boilerplate(b[0], spared)]
    if not left:  # nothing else: the outermost places that are boilerplate by name count after all
        spared = frozenset(places[0] for p, _, _ in found if (places := named_places(p)))
        left = [b for b in found if not in_boilerplate(b[0], spared)]
    within = lambda p, places: any(p == s or p.startswith(s + ">") for s in places)
    own = Counter()
    for p, _, n in left:
        if not within(p, slots) and (place := own_place(p, slots)):
            own[place] += n
    held = sum(n for p, _, n in left if within(p, slots))
    slots = [*slots, *(p for p, n in own.items() if n > held)]
    chosen = [t for p, t, _ in left if within(p, slots)]
    for wanted in ("article", "main", "body"):
        if chosen:
            break
        chosen = [t for p, t, _ in left if any(x.partition(".")[0] == wanted for x in p.split(">"))]
    return " ".join(chosen or [t for _, t, _ in left])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``id_column``, ``url_column`` and ``text`` of every page."""
    template = templates(pages, id_column, url_column, html_column)
    size = template.agg(F.sum(F.length("host") + F.length(F.array_join("slots", " ")) + 64)).first()[0] or 0
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("page"),
                        url_host(F.col(url_column)).alias("host"))
    rows = rows.join(F.broadcast(template) if size <= BROADCAST_BYTES else template, "host", "left")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page, slots or []) for page, slots in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
        return pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = rows.select("id", "url", "page", "slots")
    kind = rows.schema[0].dataType.simpleString()
    made = map_slices(rows, work, f"id {kind}, url string, text string", 2)
    return made.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text")
