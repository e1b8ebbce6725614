import base64
import hashlib
import html
import re

import duckdb
import pytest

from folioscope.llm import template_extract, url_reputation, warc_index
from folioscope.llm.queries import OP1_SQL, URL_RULES, op1_url_reputation, op2_html, op3_warc

DIR = "/root/testdata/sf0.001"
PAGES = [(1, "http://A.example.com/en/x?q#f", "<p>one</p>"), (2, None, None), (3, "no scheme", ""), (4, "https://www.example.com/en/", "<p>one</p>"),
         (5, "ftp://h", "<p>one</p>"), (None, "http://x.net/es/1", "<p>null id</p>"), (6, "http://x.net/es", "é\U0001f600\r\n\r\nWARC/1.1"),
         (6, "http://x.net/es", "é\U0001f600\r\n\r\nWARC/1.1"), (7, "http://sp ace/%41\n?x", "z" * 300_000), (8, "a://b://c/d", "<p>one</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1, "y") for p in PAGES],
                                 "page_id bigint, url string, html string, host string, digest int, text string").repartition(2).cache()


def test_warc_round_trip(pages):
    index, base = warc_index.write(pages)
    rows = warc_index.read(index, base).collect()
    assert len(rows) == len(PAGES)
    first = {}
    for page_id, _, text in PAGES:
        if page_id is not None:
            first[text or ""] = min(first.get(text or "", 99), page_id)
    want = []
    for page_id, url, text in PAGES:
        data = (text or "").encode()
        to = first.get(text or "")
        kept = to in (page_id, None)
        want.append((str(page_id), str(url), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if kept else "revisit", None if kept else to, data if kept else None))
    got = [(str(r["page_id"]), str(r["url"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
            None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_selection_of_the_index_reads_only_that(pages):
    index, base = warc_index.write(pages, least_bytes=11)
    chosen = warc_index.read(index.where("page_id in (1, 4, 7)"), base).collect()
    assert sorted(r["page_id"] for r in chosen) == [1, 4, 7]
    assert all(r["record_type"] == "response" for r in chosen)  # the shared payload has 10 bytes
    assert warc_index.read(index.where("1 = 0"), base).count() == 0
    assert warc_index.write(pages.where("1 = 0"))[0].count() == 0


def test_neighbouring_ranges_are_read_at_once():
    found = list(warc_index._ranges([("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("a", 10_000_000, 5), ("b", 0, 5)]))
    assert [(f, a, b, len(p)) for f, a, b, p in found] == [("a", 0, 105, 3), ("a", 10_000_000, 10_000_005, 1), ("b", 0, 5, 1)]


def test_warc_query(spark):
    rows = op3_warc(spark, DIR).collect()
    table = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    assert len(rows) == len(table)
    for r in rows:
        assert r["payload_bytes"] == len(table[r["page_id"]].encode())


def test_articles_whole(spark):
    got = {r["page_id"]: r for r in op2_html(spark, DIR).collect()}
    for page in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*)</article>", page["html"])[1]
        blocks = re.split(r"<(?:p|/p|br|h1|/h1)>", article.replace("<b>", ""))
        want = " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
        assert got[page["page_id"]]["text"] == want and got[page["page_id"]]["n_chars"] == len(want)


NEWS = ('<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>'
        '<div class="cookie-notice">We use cookies</div><div class="page">%s</div>'
        '<aside>other news</aside><form><input> <button>Go</button></form><footer>&copy; 2020</footer></body></html>')


def test_slots_of_a_template_without_article(spark):
    rows = [(i, f"http://news.test/{i}", NEWS % (f"<h2>Story {i}</h2><p>{'word%d ' % i * 40}<br>a<b>b</b> &amp; c</p>"
                                                 f"<section id='comments'><p>reader {i}</p></section>")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert template_extract.templates(df).first()["slots"][0].startswith("html>body>div.page")
    got = {r["page_id"]: r["text"] for r in template_extract.extract(df).collect()}
    for i in range(6):
        assert got[i].endswith(f"{('word%d ' % i * 40).strip()} ab & c") and "reader" not in got[i] and "cookies" not in got[i]


def test_class_words_do_not_empty_a_page():
    text = template_extract.main_text
    for page in ('<html class="no-sidebar"><body class="has-sidebar comments-open"><article class="post share-post"><p>whole story</p></article>%s</body></html>',
                 '<body><form id="aspnet"><div><p>whole story</p></div></form>%s</body>', '<body><div class="widget"><p>whole story</p></div>%s</body>',
                 '<body><div class="with-sidebar"><p>whole story</p></div>%s</body>'):
        assert text(page % '<nav>menu</nav><div class="cookie-notice">ok</div>', []) == "whole story", page
    assert text('<article><p>story</p></article><div id="comments"><p>long reader comments</p></div>', []) == "story"
    assert text('<body><div class="ad"><a>only links</a></div></body>', []) == "only links"
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object><p>seen</p></object>", []) == "so x=2 holds seen"


def test_host_of_pages_in_one_form(spark):
    rows = [(i, f"http://form.test/{i}", f"<body class='has-sidebar'><form id='f'><div class='page'><p>{f'word{i} ' * 30}</p></div></form></body>") for i in range(4)]
    got = template_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: (f"word{i} " * 30).strip() for i in range(4)}


def test_stories_on_a_host_of_lists(spark):
    teaser = '<article class="teaser"><a href="/x">teaser %d</a></article>'
    rows = [(i, f"http://mixed.test/{i}", f"<body><main>{''.join(teaser % j for j in range(i, i + 6))}</main></body>") for i in range(6)]
    rows += [(i, f"http://mixed.test/{i}", f'<body><main><article class="story"><p>{f"word{i} " * 50}</p></article>{teaser % 1}</main></body>') for i in (6, 7)]
    got = {r["page_id"]: r["text"] for r in template_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == " ".join(f"teaser {j}" for j in range(6))
    assert all(got[i] == f"word{i} " * 50 + "teaser 1" for i in (6, 7))


def test_classes_nest():
    classes = [(["html", "html>body"], 0, 1), (["html>body>ul"], 0, 3), (["html>body>ul>li", "html>body>ul>li>a"], 9, 9)]
    assert [(a, p) for a, p, _ in template_extract.nest(classes)] == [
        ("", ["html", "html>body"]), ("html>body", ["html>body>ul"]), ("html>body>ul", ["html>body>ul>li", "html>body>ul>li>a"])]


def test_broken_markup():
    text = template_extract.main_text
    assert text('<div class=x><p>hi <i>t</i></div> tail <p title="a>b">q', []) == "hi t tail q"
    assert text('<article><script>var a="</p>";</script><p>x&nbsp;y &am<style>p{}', []) == "x y &am"
    assert text("a < b <p>c</z><!-- never closed", []) == "a < b c"
    assert text(None, []) == text("", []) == ""
    assert text("<article>" + "<div>" * 3000 + "deep" + "<nav>menu", []) == "deep"
    assert text('<p "unclosed>x</p><main>y</main>', []) in ("y", "x y")


def test_template_edges(pages):
    got = template_extract.extract(pages).collect()
    assert len(got) == len(PAGES) and {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    assert template_extract.extract(pages.where("1 = 0")).count() == 0


def test_url_parts_and_rules(spark, pages):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (5, 1, None), (None, 1, 0), (99, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, labels, URL_RULES).collect()}
    part = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert part(1) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert part(4) == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert part(2)[:3] == part(3)[:3] == ("", "", None)
    assert part(5)[:3] == ("h", "", None) and part(8)[:2] == ("b:", "//c/d") and part(6)[:3] == ("x.net", "/es", None)
    assert part(None) == ("x.net", "/es/1", "net/es/", "block")
    assert url_reputation.judge(pages, labels, URL_RULES).count() == len(PAGES)
    none = labels.where("1 = 0")
    assert {r["verdict"] for r in url_reputation.judge(pages, none, []).collect()} == {"allow"}
    assert url_reputation.judge(pages.where("1 = 0"), labels, URL_RULES).count() == 0


def test_bad_hosts_are_blocked_and_rates_shrink(spark):
    outcomes = spark.createDataFrame([("bad.a.com", 0)] * 60 + [("good.a.com", 1)] * 60 + [("one.a.com", 0)] + [("new.a.com", None)]
                                     + [("x.b.org", 1)] * 40 + [("y.c.org", 1)] * 30, "host string, good long")
    got = {r["host"]: r for r in url_reputation.reputation(outcomes).collect()}
    assert got["bad.a.com"]["high"] < 0.5 < got["good.a.com"]["low"]
    assert 0 < got["one.a.com"]["rate"] < got["new.a.com"]["rate"] < 1 and got["new.a.com"]["n"] == 0


def test_registered_domains_below_long_suffixes(spark):
    want = [("new.badsite.co.uk", "badsite.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("a.b.me.github.io:80", "me.github.io", "github.io"),
            ("www.x.com:8080", "x.com", "com"), ("10.0.0.1:81", "10.0.0.1", "10.0.0.1"), ("[::1]:80", "[::1]", "[::1]"), ("h", "h", "h"), ("", "", "")]
    host = url_reputation.F.col("host")
    got = spark.createDataFrame([w[:1] for w in want], "host string").select("host", url_reputation.domain_of(host), url_reputation.suffix_of(host))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    outcomes = [("old.badsite.co.uk", 0)] * 60 + [("new.badsite.co.uk", None), ("new.other.co.uk", None)] + [("www.fine.co.uk", 1)] * 60 + [("x.org", 1)] * 9
    rate = {r["host"]: r["rate"] for r in url_reputation.reputation(spark.createDataFrame(outcomes, "host string, good long")).collect()}
    assert rate["new.badsite.co.uk"] < rate["new.other.co.uk"]


def test_url_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict", "n_labelled"]
    got = [tuple(r[c] for c in cols) for r in op1_url_reputation(spark, DIR).collect()]
    assert sorted(got, key=str) == sorted(con.sql(f"select {', '.join(cols)} from ({OP1_SQL})").fetchall(), key=str)
