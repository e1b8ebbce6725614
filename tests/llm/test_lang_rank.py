from pyspark.sql import functions as F

from folioscope.llm import lang_rank
from folioscope.llm.queries import op6_langid


def slow_ranks(texts, size):
    counts = {}
    for text in texts:
        word = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        for w in word:
            padded = f"_{w}_"
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i:i + n]
                    if g.strip("_") and not (n == 3 and g[1] == "_"):
                        counts[g] = counts.get(g, 0) + 1
    key = lambda g: (-counts[g], len(g), [0 if c == "_" else ord(c) for c in g])
    return sorted(counts, key=key)[:size]


def test_profiles_and_distances_equal_the_definition(spark):
    texts = [("en", "The cat sat, on THE mat!"), ("en", "a dog ran"), ("de", "Die Straße über 3 Öfen"), (None, "skip me"), ("de", None)]
    df = spark.createDataFrame(texts, "lang string, text string")
    size = 12
    profiles = lang_rank.learn(df, size)
    assert set(profiles) == {"en", "de"}
    for lang, found in profiles.items():
        want = slow_ranks([t for x, t in texts if x == lang], 10_000)
        assert set(found[:4]) <= set(want) and len(found) == min(size, len(want))
    judged = ["the mat", "Straße Öfen", "12 !", "", None, "日本", "ca"]
    preds, scores = lang_rank.Ranker(profiles, size).judge(judged)
    for text, pred, score in zip(judged, preds, scores):
        own = slow_ranks([text], size)
        if not own:
            assert (pred, score) == ("und", 0.0)
            continue
        apart = {x: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert pred == best and abs(score - (1 - apart[best] / (size * len(own)))) < 1e-12


def test_held_out_accuracy(spark):
    found = op6_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    share = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_edges(edge, nothing):
    profiles = lang_rank.learn(edge)
    found = lang_rank.predict(edge, profiles).collect()
    assert len(found) == edge.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 13)) for r in found if r["doc_id"] is not None)
    assert lang_rank.learn(nothing) == {} and lang_rank.predict(nothing, {}).count() == 0
    assert {r["lang_pred"] for r in lang_rank.predict(edge, {}).collect()} == {"und"}
