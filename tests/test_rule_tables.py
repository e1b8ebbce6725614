"""Rules from tables against the expression form."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.operators import rule_tables as R
from folioscope.operators import rules

DOCS = "_id string, title string, description string, url string, meta_tags map<string,string>"


def tables(spark, keywords, domains):
    return (spark.createDataFrame([(c, w) for c, ws in keywords.items() for w in ws], "category string, keyword string"),
            spark.createDataFrame([(c, w) for c, ws in domains.items() for w in ws], "category string, domain string"))


def rows(df):
    return sorted((r["_id"], r["category"], int(r["keyword_hits"]), round(r["keyword_score"], 9), r["domain_score"], round(r["confidence"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcé%_ ") for _ in range(rnd.randint(0, 40)))
    data = [(f"d{i}", word(), rnd.choice([None, word().upper()]), rnd.choice([None, "", "http://www.abc.org/x", "https://a_b.com"]),
             rnd.choice([None, {"k": word()}])) for i in range(120)]
    return spark.createDataFrame(data + [("empty", None, None, None, None)], DOCS).repartition(3)


@pytest.mark.parametrize("most_bytes", [R.MOST_BYTES, 300])
def test_equal_to_expressions(spark, docs, most_bytes):
    keywords = {"one": ["ab", "AB", "b", "bc", "abc", "%", "_", "É", "zz"], "two": ["a", "aa", "aaa", "c a"], "three": ["q"], "all": ["", "x"]}
    domains = {"one": ["abc.org", "Bc"], "two": ["nowhere"], "three": ["a_b"]}
    want = [r for r in rows(rules.keyword_scores(docs, keywords, domains)) if r[2] or r[4]]
    kw, dom = tables(spark, keywords, domains)
    assert rows(R.table_scores(docs, kw, dom, most_bytes=most_bytes)) == want != []
    got = sorted(map(tuple, R.table_classify(docs, kw, dom, 0.3, most_bytes=most_bytes).collect()))
    assert [g[:2] for g in got] == [(r[0], r[1]) for r in want if r[5] >= 0.3]


def test_nulls_domain_only_and_empty_tables(spark, docs):
    none, no_domain = tables(spark, {}, {})
    assert R.table_scores(docs, none, no_domain).collect() == []
    kw = spark.createDataFrame([("c", None), (None, "a")], "category string, keyword string")
    dom = spark.createDataFrame([("d", "abc"), ("c", None)], "category string, domain string")
    got = rows(R.table_scores(docs, kw, dom))
    assert {r[1:5] for r in got} == {("d", 0, 0.0, 1.0)}
    assert R.table_scores(docs.where("1 = 0"), kw, dom).collect() == []


def test_time_does_not_grow_with_the_rules(spark):
    text = F.concat_ws(" ", *(F.sha2((F.col("id") + i).cast("string"), 256) for i in range(20)))
    docs = spark.range(3000).select(F.col("id").cast("string").alias("_id"), text.alias("title"), F.lit(None).cast("string").alias("description"),
                                    F.lit("http://a.b/").alias("url"), F.create_map(F.lit("k"), F.lit("v")).alias("meta_tags")).repartition(4).cache()
    docs.count()
    dom = spark.createDataFrame([], "category string, domain string")
    seconds = []
    for n in (50, 5000):
        kw = spark.range(n).select(F.concat(F.lit("c"), F.col("id") % 9).alias("category"), F.substring(F.sha2(F.concat(F.lit("k"), F.col("id")), 256), 1, 9).alias("keyword"))
        R.table_scores(docs, kw, dom).count()
        start = time.perf_counter()
        R.table_scores(docs, kw, dom).count()
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 4 * seconds[0] + 2
    docs.unpersist()


def test_what_a_worker_holds_of_a_full_group_stays_small():
    import multiprocessing
    with multiprocessing.get_context("spawn").Pool(1) as one:
        grown = one.apply(_held, (R.MOST_BYTES,))
    assert grown < 500


def _held(most_bytes):
    import re
    anonymous = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
    rnd, before = random.Random(5), anonymous()
    rules_ = [("keyword", f"c{i % 90}", f"{rnd.getrandbits(40):x}", 1, 9) for i in range(most_bytes // (R.ROW_BYTES + 12))]
    packed = R._packed(rules_)
    del rules_
    matcher = R._Matcher(*packed["keyword"])
    assert list(matcher.rules(f"- {packed['keyword'][0].split(chr(0))[7]} -"))
    return anonymous() - before
