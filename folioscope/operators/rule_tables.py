"""Keyword and domain rules from tables of any size.

``rules.keyword_scores`` turns a few rules into one expression each; that grows
with the rules, in plan and in time. Here the patterns are matched together: an
Aho-Corasick automaton finds all of them in one pass over a text, however many
there are.

A worker builds the automaton once. It comes from a broadcast of at most
``MOST_BYTES`` of rules; a larger table is split into groups by the hash of the
rule, each with its own broadcast and pass, whose result is written before the
next one begins. Hits of a category are then summed up over the groups.
"""

from __future__ import annotations

import uuid
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..session import reliable

#: Bytes of patterns and category names in one broadcast, with ``ROW_BYTES`` a rule for its numbers.
#: Each worker holds an automaton of them, some ten times as large.
MOST_BYTES, ROW_BYTES = 40 << 20, 64
#: Texts whose hits a worker holds at a time.
SLICE_ROWS = 1000

_AUTOMATA: dict[str, tuple] = {}


def automaton(patterns: list[str]):
    """Finds patterns; the value of each is its number. None if there are none."""
    import ahocorasick
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, pattern in enumerate(patterns):
        out.add_word(pattern, i)  # an empty one is not added
    if len(out):
        out.make_automaton()
        return out
    return None


def found(machine, text: str) -> set[int]:
    return {i for _, i in machine.iter(text)} if machine is not None and text else set()


def _packed(rules: list) -> dict:
    """Rules (kind, category, word, times, n) as flat arrays: ``words`` of each kind in
    order, the ``first`` rule of each word, and by rule the number of its category and
    its times. Categories are named once, with their n."""
    codes: dict[str, int] = {}
    of_category, out = array("q"), {}
    for kind in ("keyword", "domain"):
        words, first, code, often = [], array("q"), array("i"), array("q")
        for word, category, times, n in sorted((r[2], r[1], r[3], r[4]) for r in rules if r[0] == kind):
            if not words or words[-1] != word:
                words.append(word)
                first.append(len(code))
            if category not in codes:
                codes[category] = len(codes)
                of_category.append(n)
            code.append(codes[category])
            often.append(times)
        first.append(len(code))
        out[kind] = ("\0".join(words) if words and not any("\0" in w for w in words) else words, first, code, often)
    return out | {"categories": pa.array(list(codes), pa.string()), "n": of_category}


class _Matcher:
    """The rules of one kind; words are forgotten once the automaton has them."""

    def __init__(self, words, first, code, often):
        words = words.split("\0") if isinstance(words, str) else words
        self.first, self.code, self.often = first, code, often
        self.always = range(first[0], first[1]) if words and words[0] == "" else ()  # the empty word comes first
        self.machine = automaton(words)

    def rules(self, text: str):
        """Numbers of the rules whose word is in the text."""
        yield from self.always
        for i in found(self.machine, text):
            yield from range(self.first[i], self.first[i + 1])


def _scan(texts: DataFrame, rules: list, key: str) -> DataFrame:
    """``key``, ``category``, ``keyword_hits``, ``_n``, ``domain_hit`` of one group's rules, where there is a hit."""
    packed = _packed(rules)
    shared = texts.sparkSession.sparkContext.broadcast(packed)
    name = uuid.uuid4().hex

    def machines():
        if name not in _AUTOMATA:
            _AUTOMATA.clear()
            got = shared.value
            _AUTOMATA[name] = _Matcher(*got["keyword"]), _Matcher(*got["domain"]), got["categories"], got["n"]
        return _AUTOMATA[name]

    def run(batches):
        words, domains, categories, n = machines()
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            at, codes, hit, dom = array("q"), array("q"), array("q"), []
            for row, (text, domain) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                hits: dict[int, int] = {}
                for r in words.rules(text) if text is not None else ():
                    hits[words.code[r]] = hits.get(words.code[r], 0) + words.often[r]
                near = {domains.code[r] for r in domains.rules(domain)} if domain else set()
                for c in near:
                    hits.setdefault(c, 0)
                at.extend(row for _ in hits)
                codes.extend(hits)
                hit.extend(hits.values())
                dom += [c in near for c in hits]
            if len(at):
                of = pa.array(codes, pa.int64())
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), categories.take(of), pa.array(hit, pa.int64()),
                                       pa.array(n, pa.int64()).take(of), pa.array(dom)], names=[key, "category", "keyword_hits", "_n", "domain_hit"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInArrow(run, f"`{key}` {kind}, category string, keyword_hits long, _n long, domain_hit boolean")


def table_scores(docs: DataFrame, keywords: DataFrame, domains: DataFrame, key: str = "_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``rules.keyword_scores`` that have a hit, for rules from tables:
    ``keywords`` (category, keyword) and ``domains`` (category, domain).

    A keyword that a category lists twice counts twice, as there. Null patterns
    and categories are no rules. A category with domains only has a keyword
    score of 0. ``key`` is unique in ``docs``."""
    rows = (keywords.select(F.lit("keyword").alias("kind"), "category", F.lower("keyword").alias("word"))
            .unionByName(domains.select(F.lit("domain").alias("kind"), "category", F.lower("domain").alias("word")))
            .where("category IS NOT NULL AND word IS NOT NULL").groupBy("kind", "category", "word").agg(F.count(F.lit(1)).alias("times")))
    sizes = rows.where("kind = 'keyword'").groupBy("category").agg(F.sum("times").alias("n"))
    rows = reliable(rows.join(sizes, "category", "left").select("kind", "category", "word", "times", F.coalesce("n", F.lit(0)).alias("n")), "rules")
    size = rows.agg(F.sum(F.octet_length("word") + F.octet_length("category") + ROW_BYTES)).first()[0] or 0
    groups = -(-size // most_bytes)

    texts = docs.select(key, F.lower(T.rules_text("title", "description", "url", "meta_tags")).alias("_t"), T.url_domain("url").alias("_d"))
    if groups > 1:
        texts = reliable(texts, "rule-texts")  # built once, not by every pass
    parts = []
    for g in range(groups):
        mine = rows.where(F.pmod(F.xxhash64("kind", "category", "word"), F.lit(groups)) == g) if groups > 1 else rows
        part = _scan(texts, mine.collect(), key)  # at most about ``most_bytes``
        parts.append(reliable(part, "rule-hits") if groups > 1 else part)
    if not parts:
        return docs.sparkSession.createDataFrame([], f"`{key}` {dict(docs.dtypes)[key]}, category string, keyword_hits long, "
                                                     "keyword_score double, domain_score double, confidence double")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    if groups > 1:
        hits = hits.groupBy(key, "category").agg(F.sum("keyword_hits").alias("keyword_hits"), F.max("_n").alias("_n"), F.max("domain_hit").alias("domain_hit"))
    scored = hits.select(key, "category", "keyword_hits", F.when(F.col("_n") > 0, F.col("keyword_hits") / F.col("_n")).otherwise(F.lit(0.0)).alias("keyword_score"),
                         F.when(F.col("domain_hit"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("domain_score"))
    return scored.withColumn("confidence", F.col("keyword_score") * K.RULE_KEYWORD_WEIGHT + F.col("domain_score") * K.RULE_DOMAIN_WEIGHT)


def table_classify(docs: DataFrame, keywords: DataFrame, domains: DataFrame, threshold: float = K.RULE_THRESHOLD, key: str = "_id",
                   most_bytes: int = MOST_BYTES) -> DataFrame:
    """Categories at or above the threshold. A threshold of 0 or less gives the rows with a hit only."""
    return (table_scores(docs, keywords, domains, key, most_bytes).where(F.col("confidence") >= threshold)
            .select(F.col(key).alias("doc_id"), F.col("category").alias("name"), "confidence", F.lit(K.RULE_CLASSIFIER).alias("classifier")))
