from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import quality_gbdt, quality_sketch
from folioscope.llm.queries import op8_quality
from tests.llm.conftest import EDGE_TEXTS


def test_forest_learns_and_walks_like_single_rows():
    dice = np.random.default_rng(1)
    x = dice.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = quality_gbdt.fit(x[:2000], y[:2000], trees=40)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97

    def single(row):
        raw = forest.bias
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            raw += value[node - len(feature)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(forest.score(x[:50]), [single(r) for r in x[:50]])


def test_held_out_labels(spark):
    found = op8_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = found.where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert share >= 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def test_classifier_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (10, 0, 0, "x"), (10, 1, 0, "x"), (None, 1, 0, "x"), (5, None, 1, "x")],
                                   "doc_id bigint, quality int, toxic int, text string")
    forest = quality_gbdt.train(edge, labels)
    found = quality_gbdt.score(edge, forest).collect()
    assert len(found) == len(EDGE_TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    none = quality_gbdt.train(nothing, labels)
    assert {r["score"] for r in quality_gbdt.score(edge, none).collect()} == {0.5}
    assert quality_gbdt.keep(edge, none).count() == edge.count() and quality_gbdt.keep(edge, none).columns == edge.columns
    assert quality_gbdt.score(nothing, forest).count() == 0


def test_the_sample_is_bounded(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert len(quality_gbdt.train(small, labels, most_rows=12, trees=2).value) == 2


def slow_counts(text):
    import re
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {
        w for w in set(windows) if sum(v == w for v in windows) > 1}
    covered = {i + d for i, w in enumerate(windows) if w in often for d in range(3)}
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_counts_of_edges(spark, edge, nothing):
    fixed = [r for r in EDGE_TEXTS if len(r[1] or "") < 20_000] + [(20, "a b\na b\n\n# $ a b c a b c\r\n|x", "en", "a"), (21, "a a a a", "en", None)]
    df = spark.createDataFrame([(*r, 1) for r in fixed], "doc_id bigint, text string, lang string, source string, n_words int")
    got = sorted((str(r[0]), *r[1:6]) for r in quality_sketch.judge(df).collect())
    assert got == sorted((str(r[0]), *slow_counts(r[1])) for r in fixed)
    assert quality_sketch.judge(edge).count() == len(EDGE_TEXTS) and quality_sketch.judge(nothing).count() == 0


def test_sketch_quantiles_are_close(spark):
    dice = np.random.default_rng(2)
    values = dice.integers(1, 4000, 3000)
    rows = spark.createDataFrame([("en", "s", 1, int(v), 0, 1, 0, 0) for v in values],
                                 "_lang string, _source string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint")
    found = quality_sketch.thresholds(quality_sketch.sketch(rows), reach=0.0).first()
    exact = float(np.quantile(values, 0.85, method="inverted_cdf"))
    assert abs(found["_most_word_length"] - exact) <= 0.011 * exact
    assert found["_most_symbols"] == 0


def test_thresholds_follow_their_group(spark):
    """The same texts pass where such texts are usual and fail where they are not, by each rate."""
    plain = [f"w{i:03d}" for i in range(200)]
    marked = ["#" + x[1:] if i % 5 == 0 else x for i, x in enumerate(plain)]
    long = [x + "abcdefgh" for x in plain]
    lined = [x + "\n" + "same line" * (i % 3 == 0) + "\n" for i, x in enumerate(plain)]
    twice = plain[:150] + plain[:40] + plain[150:]
    odd = {"symbols": marked, "long": long, "lines": lined, "repeats": twice}
    texts, want = [], []
    for name, words in odd.items():
        for source, usual in ((f"{name}-usual", words), (f"{name}-rare", plain)):
            texts += [(" ".join(usual), "en", source)] * 20 + [(" ".join(words), "en", source), (" ".join(plain), "en", source)]
            want += [True] * 20 + [source.endswith("usual"), True]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    got = sorted(quality_sketch.judge(df).select("doc_id", "base_failed", "kept").collect())
    assert not any(r["base_failed"] for r in got)
    assert [r["kept"] for r in got] == want


def test_repeats_of_a_long_text(spark):
    dice = np.random.default_rng(7)
    words = [f"w{x}" for x in dice.integers(0, 120, 300_000)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, x in enumerate(zip(words, words[1:], words[2:])) if seen[x] > 1 for d in range(3)}
    row = quality_sketch.counts(spark.createDataFrame([(1, " ".join(words), "en", "s")], "doc_id int, text string, lang string, source string")).first()
    assert row["n_repeat_words"] == len(covered)


def test_rules_use_no_python(small):
    plan = quality_sketch.counts(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
