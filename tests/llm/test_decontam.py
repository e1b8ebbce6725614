from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from collections import Counter

from folioscope.llm import decontam

ITEMS = [(0, "The quick brown fox jumps over a lazy dog. It never slept."), (1, "What is the tallest hill in the county? Gorse Beacon."),
         (2, "of the and a to in is it"), (3, None), (4, ""), (5, "The quick brown fox jumps over a lazy dog. It never slept."),
         (6, "Rivers carry silt towards the wide delta where herons wait for evening tides")]
FILLER = " ".join(f"the of word{i} and a" for i in range(60))


def build(items, threshold=0.5):
    frequency, lengths = Counter(), []
    for _, t in items:
        if found := decontam.terms(t):
            frequency.update(set(found))
            lengths.append(len(found))
    return decontam.Index(items, frequency, len(lengths), sum(lengths) / len(lengths), threshold)


def test_search_equals_scoring_every_item():
    items = [(i, " ".join(f"t{(i * j * 7 + j) % (40 + i)}" for j in range(4, 20)) + ". " + f"a{i % 5} b{i} the of") for i in range(70)]
    index = build(items)
    text = " ".join(f"{t} the" for _, t in items[:20]) + " the of t3 t5 t9 " + FILLER
    numbers, at = decontam.numbered(pa.array([text, None, ""]), index)
    assert at.tolist()[1:] == [len(numbers)] * 3
    import numpy as np
    for begin in range(0, len(numbers), 37):
        words = np.unique(numbers[begin:begin + 90])
        words = words[words >= 0]
        _, item, score = index.search(np.zeros(len(words), np.int64), words)
        want = {}
        for w in words.tolist():
            for k in range(index.post_at[w], index.post_at[w + 1]):
                want[int(index.post_item[k])] = want.get(int(index.post_item[k]), 0.0) + index.post_share[k]
        want = {j: s for j, s in want.items() if s >= 0.5 - 1e-9}
        assert dict(zip(item.tolist(), score.round(9).tolist())) == {j: round(s, 9) for j, s in want.items()}


def test_in_order_is_the_longest_common_subsequence():
    def slow(a, b):
        return max((n for n in range(len(a) + 1) for c in combinations(range(len(a)), n)
                    if _inside([a[i] for i in c], b)), default=0)

    def _inside(part, b):
        it = iter(b)
        return all(x in it for x in part)

    for a, b in (([1, 2, 3], [3, 1, 2]), ([1, 1, 2], [1, 2, 1, 2]), ([5], []), ([1, 2, 3, 4, 2], [2, 4, 1, 2, 3, 2])):
        assert decontam.in_order(a, b) == slow(a, b) / len(a)


def test_leaks(spark, edge, nothing):
    docs = [(1, f"{FILLER} The QUICK brown fox jumps over a lazy dog. It never slept. {FILLER}"),
            (2, f"{FILLER} the quick brown fox jumps over a lazy dog. {FILLER}"),  # no answer
            (3, f"{FILLER} What is the tallest hill in that county? Gorse Beacon. {FILLER}"),  # one word changed
            (4, FILLER), (5, None), (6, ""), (None, "What is the tallest hill in the county? Gorse Beacon."),
            (7, "Rivers carry silt towards the wide delta where herons wait for evening tides")]
    docs = spark.createDataFrame([(*d, 0, 1.0) for d in docs + docs[:1]], "doc_id bigint, text string, item_id int, score double")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert got == {(1, 0), (1, 5), (3, 1), (None, 1), (7, 6)}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6]
    assert decontam.leaks(nothing, items).count() == 0
    assert decontam.leaks(docs, items.where("1 = 0")).count() == 0 and decontam.clean(docs, items.where("1 = 0")).count() == 9
    assert decontam.leaks(edge, items).count() == 0


def test_a_long_item_does_not_loosen_the_check_of_others(spark, monkeypatch):
    words = [f"the of word{i} and a" for i in range(400)]
    about = f"{' '.join(words[:9])} What is known of France? {' '.join(words[:30])} The town is the old capital of it, {' '.join(words[:20])} in Paris."
    leak = "Asked: what is the capital city of France? Answer: Paris. " + " ".join(words[:30])
    reading = " ".join(f"read{i}" for i in range(1999))
    docs = [(1, about), (2, leak), (3, "One day in Lyon and the next " + FILLER), (4, "Lyon"), (5, f"{FILLER} red green blue sea {FILLER}"),
            (6, f"{FILLER} red green and blue sea {FILLER}"), (7, f"{FILLER} {reading.replace('read7 ', '')} End. {FILLER}")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = [(0, "What is the capital of France? Paris."), (1, "Lyon"), (2, "?! Red green blue sea"), (3, reading + ". End.")]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(2, 0), (4, 1), (5, 2), (7, 3)}
    assert [r["doc_id"] for r in decontam.clean(docs, items).orderBy("doc_id").collect()] == [1, 3, 6]
    monkeypatch.setattr(decontam, "GROUP_WORDS", 1)
    round_ = lambda rows: sorted(tuple(round(x, 9) for x in r) for r in rows)
    assert round_(decontam.leaks(docs, items).collect()) == round_(rows)


def test_copies_with_other_spaces_are_found(spark):
    spaces = "\xa0\u3000\u2009\u2028\x85\u202f\u1680\x1c\x1f"
    items = [(0, "東京は\u3000日本の\u3000首都ですか?\u3000はい\u3000そうです。")]
    items += [(1 + i, c.join(f"What is{i} the name{i} of the{i} tallest hill{i}? Gorse{i} Beacon{i}.".split())) for i, c in enumerate(spaces)]
    docs = [(i, f"{FILLER} {text} {FILLER}") for i, text in items]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i, _ in items}
    texts = ["a" + chr(c) + "b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert pc.utf8_split_whitespace(pa.array(texts)).to_pylist() == [t.split() for t in texts]


def test_groups_of_items_give_the_same(spark, small, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = {(r[0], r[1]) for r in decontam.leaks(small, items).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(decontam, "GROUP_WORDS", 300)
    parts = {(r[0], r[1]) for r in decontam.leaks(small, items).select("doc_id", "item_id").collect()}
    texts = {r["doc_id"]: " ".join(r["text"].split()) for r in small.collect()}
    planted = {(i, r["item_id"]) for r in items.collect() for i, t in texts.items() if " ".join(r["text"].split()) in t}
    assert planted and whole == parts and planted <= whole
