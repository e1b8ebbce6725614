"""Rotations against slicing; the transformation against its definition and back."""

import hashlib
import random

import pytest

from folioscope.llm import fim_rotate as R
from folioscope.llm import queries as Q
from folioscope.plans.compare import duck, norm


def slow(row_id, text):
    """(n, form, prefix, middle, output) by slicing the text."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in R.MARKS) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 16])
def test_rotation(monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(200):
        data = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 40)))
        i, m, j = sorted(rnd.randint(0, len(data)) for _ in range(3))
        buf = bytearray(data)
        R.rotate(buf, i, m, j)
        assert buf == data[:i] + data[m:j] + data[i:m] + data[j:]
        text = "".join(rnd.choice("aé€😀") for _ in range(rnd.randint(0, 30)))
        at = rnd.randint(0, len(text))
        assert R.byte_offset(text.encode(), at) == len(text[:at].encode())


def test_blocks_and_back():
    signs = tuple(m.encode() for m in R.MARKS)
    for text in (b"", b"a", b">M><<P<S<M<S", b"abcdef"):  # parts of sentinels at the cuts
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form, want in (("psm", b"<P>" + text[:a] + b"<S>" + text[b:] + b"<M>" + text[a:b]),
                                   ("spm", b"<S>" + text[b:] + b"<P>" + text[:a] + b"<M>" + text[a:b])):
                    buf = bytearray(text)
                    R.blocks(buf, a, b, form, signs)
                    assert buf == want
                    R.unblocks(buf, form, signs)
                    assert buf == text


def test_transform_is_its_definition_and_restores(spark, edge, nothing, small):
    more = spark.createDataFrame([(i, "".join(random.Random(i).choice("ab é€😀<PSM>") for _ in range(i))) for i in range(400)] + [(900, "a<S>b")],
                                 "doc_id long, text string")
    for docs in (edge, small, more):
        want = [(r["doc_id"], *slow(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()]
        got = [tuple(r) for r in R.restore(R.transform(docs)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {r[2] for r in got} >= {"plain", "psm"}
    assert R.restore(R.transform(nothing)).collect() == []


def test_other_marks_and_string_ids(spark):
    docs = spark.createDataFrame([("a", "héllo wörld"), ("b", "x[F]y"), (None, "z")], "key string, body string")
    rows = R.restore(R.transform(docs, "key", "body", seed=9, marks=("[F]", "[B]", "[H]"), plain_from=100, spm=100), ("[F]", "[B]", "[H]")).collect()
    assert [r["form"] for r in rows] == ["spm", "plain", "spm"]
    assert [r["restored"] for r in rows] == ["héllo wörld", "x[F]y", "z"]


def test_query_is_its_sql(spark):
    con = duck("/root/testdata/sf0.01")
    assert norm(Q.QUERIES["op12_fim"](spark, "/root/testdata/sf0.01").toPandas()) == norm(con.execute(Q.ORACLE["op12_fim"]).df())
