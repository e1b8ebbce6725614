"""Bin completion against all solutions of small instances; packing against the library and its own rules."""

import random
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import best_fit_pack as P
from folioscope.llm import bin_completion as B
from folioscope.llm import queries as Q


def fewest(items, capacity):
    """Bins that the items need, by trying all ways."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                j = rooms.index(room)
                rooms[j] -= items[i]
                go(i + 1, rooms)
                rooms[j] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def held(runs):
    out = Counter()
    for pattern, times in runs:
        for size, n in pattern:
            out[size] += n * times
    return out


def test_bins_are_the_fewest():
    rnd, better = random.Random(3), 0
    for turn in range(400):
        capacity, n = rnd.choice([10, 20, 50, 100]), rnd.randint(0, 10)
        low, high = (1, capacity) if turn % 2 else (max(1, capacity // 5), capacity // 2)
        items = [rnd.randint(low, high) for _ in range(n)]
        runs = B.complete(Counter(items), capacity)
        assert held(runs) == Counter(items)
        assert all(sum(s * k for s, k in p) <= capacity for p, _ in runs)
        bins = sum(t for _, t in runs)
        assert B.lower_bound(Counter(items), capacity) <= fewest(items, capacity) == bins
        better += sum(t for _, t in B.best_fit(Counter(items), capacity)) > bins
    assert better  # the search does more than best fit


def test_dominated_fillings_are_left_out():
    counts = {5: 1, 4: 1, 3: 1, 2: 2, 1: 1}
    assert [f for _, f in B.fillings(counts, 5, 5)] == [[(5, 1)]]
    for waste, filling in B.fillings({4: 1, 3: 1, 2: 1}, 5, 5):
        assert not B.dominated(filling, waste, {4: 1, 3: 1, 2: 1})
    assert B.dominated([(3, 1), (1, 1)], 1, {4: 1, 3: 1, 1: 1})  # 4 takes the place of both
    assert B.dominated([(3, 1)], 2, {3: 1, 2: 1})  # 2 still fits
    assert not B.dominated([(4, 1)], 1, {4: 1, 3: 1})


def test_large_counts_take_few_steps_and_hold_all():
    rnd = random.Random(5)
    counts = Counter(min(2048, int(rnd.lognormvariate(6.4, 1)) + 1) for _ in range(20000))
    counts[1] = 3_000_000_000  # a third of all pieces of one length
    runs = B.complete(counts, 2048)
    assert held(runs) == counts and len(runs) < 4 * 2048
    assert sum(t for _, t in runs) == B.lower_bound(counts, 2048)


def test_empty_and_wrong_sizes():
    assert B.complete({}, 8) == [] and B.complete({3: 0}, 8) == []
    with pytest.raises(ValueError):
        B.complete({9: 1}, 8)


TEXTS = ["Hello, World! it's THE End... a.b c\x1dd <|endoftext|> x", "Café　CAFÉ é İx naïve don't", "", " \t\n", "word " * 5000,
         "<|startoftext|>", "A1 22b c3.d! ??", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "x" * 3000, "́abc ̈.", "I'LL we've. the.'s don't.", "Élan vital, Straße über ÀÉÎÕÜ ÿ ß þ Æther! ×÷ µm ªº", "été. Été? e\u0301te\u0301 Ångström Œuvre,"]


def library(text):
    return P.id_bytes(Q.tokenizer_path()).tokenizer.encode(text, add_special_tokens=False).ids


def test_stretches_are_encoded_like_whole_texts(small):
    known = P.id_bytes(Q.tokenizer_path())
    for text in TEXTS + [r["text"] for r in small.select("text").where("text is not null").limit(60).collect()]:
        assert list(array("I", known.of(text))) == library(text)


def test_cache_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 3)
    known = P.IdBytes(Q.tokenizer_path())
    text = "One two, three four. Five six! seven eight one two"
    assert list(array("I", known.of(text))) == library(text) and len(known) <= 3


def valid(rows, texts, capacity):
    """Pieces are those of the texts, sequences are gapless and hold at most ``capacity``."""
    want, bins = Counter(), {}
    for doc_id, text in texts:
        ids = [*(library(text) if text else []), 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            here = ids[at:at + capacity]
            want[doc_id, k, at, len(here), zlib.crc32(array("I", here).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_edge_texts(edge, nothing):
    texts = [(r["doc_id"], r["text"]) for r in edge.collect()]
    for capacity in (2048, 64):
        rows = P.pack(edge, Q.tokenizer_path(), capacity=capacity).collect()
        n = valid(rows, texts, capacity)
        assert n == B.lower_bound(Counter(r["length"] for r in rows), capacity)
    assert P.pack(nothing, Q.tokenizer_path()).collect() == []


def test_one_length_in_all_rows_over_many_parts(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).repartition(7)
    rows = P.pack(df, Q.tokenizer_path(), capacity=16).collect()
    assert valid(rows, [(i, "") for i in range(5000)], 16) == -(-5000 // 16)


def test_sequences_hold_the_ids(edge):
    packed = P.pack(edge, Q.tokenizer_path(), capacity=128, end_id=49407, keep_ids=True).persist()
    rows, whole = packed.collect(), {r["sequence_id"]: r["ids"] for r in P.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(r["length"] for r in rows)
    for r in rows:
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
    packed.unpersist()


def test_query_packs_the_whole_table(spark, small):
    rows = Q.QUERIES["op13_packing"](spark, "/root/testdata/sf0.001").collect()
    n = valid(rows, [(r["doc_id"], r["text"]) for r in small.collect()], 2048)
    assert n == B.lower_bound(Counter(r["length"] for r in rows), 2048)
