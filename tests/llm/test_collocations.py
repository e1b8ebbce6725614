"""HAT-tries against counters; phrases against a brute-force count and SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from folioscope.llm import collocations as C
from folioscope.llm import hat_trie as H
from folioscope.llm import queries as Q
from folioscope.plans.compare import duck, norm


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_trie_counts_all_sequences(words):
    rnd, want, got = random.Random(words), Counter(), Counter()
    trie = H.HatTrie(words, burst=20)
    runs = 0

    def collect(runs_):
        nonlocal runs
        for keys, n in runs_:
            runs += 1
            assert (np.diff(keys) > 0).all()
            got.update(dict(zip(keys.tolist(), n.tolist())))

    for turn in range(60):
        ids = [rnd.choice([0, 1, 1, 1, 2, rnd.randint(1, 900)]) for _ in range(rnd.randint(0, 300))]
        known = rnd.randint(0, min(len(ids), 3))
        for m in range(1, words + 1):
            for i in range(len(ids) - m + 1):
                if 0 not in ids[i:i + m] and i + m > known:
                    want[sum(x << trie.shift(j) for j, x in enumerate(ids[i:i + m]))] += 1
        trie.add(trie.keys_of(np.array(ids, np.int64), known))
        if len(trie) > 1500:
            collect(trie.spill(700))
            assert len(trie) <= 700
    assert any(isinstance(c, H.Node) for c in trie.root.children) or words == 1
    collect(trie.spill())
    assert len(trie) == 0 and got == want and runs > 5


def test_trie_goes_down_a_level_for_a_frequent_word():
    trie = H.HatTrie(3, burst=50)
    ids = np.array([x for i in range(1, 400) for x in (7, i + 10, 0)], np.int64)
    trie.add(trie.keys_of(ids))
    depths = {c.depth for c in trie.root.children if isinstance(c, H.Node)}
    assert depths == {1}
    assert sum(n.sum() for _, n in trie.spill()) == 3 * 399


def slow_counts(rows, most=3):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang if lang is not None else "und"][" ".join(w[i:i + m])] += 1
            if w:
                f[lang if lang is not None else "und"][""] += len(w)
    return f


def slow_mine(f, most=3, least=10, share=50, top=2000):
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if " " in p and a >= least}
        rows = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(10**6 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= share * a for q, b in cand.items()):
                continue
            rows.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, c[""], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rnd, rows = random.Random(4), []
    vocab = ["new", "New", "york", "city", "the", "of", "\u00c9t\u00e9", "x\x1cy", "a\u00a0b", "caf\u00e9"] + [f"w{i}" for i in range(40)]
    for i in range(300):
        text = "".join(rnd.choice(vocab) + rnd.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rnd.randint(0, 120)))
        rows.append((rnd.choice(["en", "en", "de", None, "und", ""]), text + " new york city" * rnd.randint(0, 3)))
    rows += [("en", None), (None, None), ("fr", ""), ("en", "new york city. " * 4000)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, phrase string").repartition(5)


@pytest.mark.parametrize("keys,words,chunk", [(1_000_000, 1 << 19, 1 << 17), (400, 60, 13)])
def test_counts_and_phrases(monkeypatch, docs, keys, words, chunk):
    monkeypatch.setattr(C, "MOST_KEYS", keys)
    monkeypatch.setattr(C, "MOST_WORDS", words)
    monkeypatch.setattr(C, "CHUNK_WORDS", chunk)
    part = docs if keys > 400 else docs.where(F.length("text") < 2000)
    # small limits hold in this process only, so the counting runs here
    rows = [(r["lang"], r["text"]) for r in part.collect()]
    want = slow_counts(rows)
    counting, got = C.Counting(3, 7), defaultdict(Counter)
    batches = [b for lang, text in rows for b in counting.add("und" if lang is None else lang, [(text or "").encode()])] + list(counting.end())
    runs = pa.Table.from_batches(batches)
    for part in range(7):
        for r in C.merged(runs.filter(pc.equal(runs["part"], part)), 0).to_pylist():
            assert r["phrase"] not in got[r["lang"]]  # a phrase is in one partition only
            got[r["lang"]][r["phrase"]] = r["f"]
    assert {k: Counter({p: n for p, n in v.items() if n}) for k, v in got.items() if any(v.values())} == dict(want)
    if keys > 400:
        assert rows_of(C.mine(docs)) == slow_mine(want) != []
        assert rows_of(C.mine(docs, least=3, share=80, top=7)) == slow_mine(want, least=3, share=80, top=7)
        four = slow_counts(rows, 4)
        assert rows_of(C.mine(docs, most_words=4, least=6)) == slow_mine(four, 4, least=6)


def test_scores_are_exact(spark):
    a, l, r = 10**11 + 7, 10**12 + 39, 10**11 + 9
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "alr"}
    got = df.select(F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide["a"] * wide["a"], wide["l"] * wide["r"])).first()[0]
    assert got == 10**6 * a * a // (l * r)


def test_edge_and_empty_tables(edge, nothing):
    rows = [(r["lang"], r["text"]) for r in edge.collect()]
    assert rows_of(C.mine(edge, least=2)) == slow_mine(slow_counts(rows), least=2) != []
    assert C.mine(nothing).collect() == []
    assert C.mine(edge, least=10**6).collect() == []


def test_query_is_its_sql(spark):
    con = duck("/root/testdata/sf0.01")
    got = Q.QUERIES["op11_collocations"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) and norm(got) == norm(con.execute(Q.ORACLE["op11_collocations"]).df())
