"""Training counts that merge: any sequence of batches equals a refit."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.operators import tfidf
from folioscope.operators.training_counts import TrainingCounts
from folioscope.session import shared_path

SIDE = "struct<category:string,text:string>"
CHANGES = f"doc_id string, before {SIDE}, after {SIDE}"
WORDS = ["river", "stone", "cloud", "north", "the", "of", "a", "Ash", "träger", "x_y", "north-east"]


def fresh(spark):
    return TrainingCounts(spark, shared_path(spark, "test-counts-" + uuid.uuid4().hex[:8]))


def batch(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_model(spark, got, docs):
    want = tfidf.train(spark.createDataFrame([(k, c, t) for k, (c, t) in docs.items()], "doc_id string, category string, text string"))
    assert rows(got.vocab.select("term", "df", "idx")) == rows(want.vocab.select("term", "df", "idx"))
    for table, value in (("vocab", "idf"), ("class_vectors", "weight")):
        a, b = (rows(getattr(m, table).withColumn(value, F.round(value, 9))) for m in (got, want))
        assert a == b
    assert rows(got.n_docs) == rows(want.n_docs)


def turn(rnd, docs, step):
    """A batch of new, changed and deleted documents; applies it to ``docs``."""
    out = []
    for key in rnd.sample([f"d{i}" for i in range(30)], 12):
        old = docs.get(key)
        text = rnd.choice([None, "", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 40)))])
        new = None if old and rnd.random() < 0.3 else rnd.choice([old, (rnd.choice(["news", "blog", None]), text)])
        out.append((key, old, new))
        docs.pop(key, None)
        if new is not None:
            docs[key] = new
    return out


def test_batches_equal_a_refit(spark):
    rnd, docs, counts, states = random.Random(5), {}, fresh(spark), []
    for step in range(4):
        changes = turn(rnd, docs, step)
        assert counts.apply(batch(spark, changes), f"b{step}") == step + 1
        assert counts.apply(batch(spark, changes), f"b{step}") == step + 1  # once only
        states.append(dict(docs))
        if step == 1:
            assert counts.compact() == 2
    same_model(spark, counts.model(), states[-1])
    same_model(spark, counts.model(version=1), states[0])
    same_model(spark, counts.model(version=3), states[2])  # base of version 2 and one delta
    assert counts.below_zero().count() == 0
    last = rows(counts.counts())
    counts.compact()
    counts.forget()
    assert rows(counts.counts()) == last
    assert counts.apply(batch(spark, changes), "b3") == 4  # still known
    with pytest.raises(ValueError):
        counts.counts(1)


def test_all_deleted_leaves_nothing(spark):
    counts = fresh(spark)
    old = [(f"d{i}", None, ("news", "river stone river")) for i in range(3)]
    counts.apply(batch(spark, old), "a")
    assert rows(counts.counts().select("term", "docs", "tf")) == [(tfidf.DOC_SENTINEL, 3, 0), ("river", 3, 6), ("stone", 3, 3)]
    counts.apply(batch(spark, [(k, after, None) for k, _, after in old]), "b")
    assert rows(counts.counts()) == [] and rows(counts.model().vocab) == []


def test_edges(spark):
    counts = fresh(spark)
    assert counts.version() == 0 and rows(counts.counts()) == []
    assert counts.apply(batch(spark, []), "empty") == 1 and rows(counts.counts()) == []
    # a document without class or text counts, an unchanged one and none at all do not
    counts.apply(batch(spark, [("a", None, (None, None)), ("b", ("x", "river"), ("x", "river")), ("c", None, None)]), "n")
    assert rows(counts.counts()) == [(None, tfidf.DOC_SENTINEL, 1, 0)]
    counts.apply(batch(spark, [("z", ("news", "cloud"), None)]), "wrong")  # never counted
    assert {r["term"] for r in counts.below_zero().collect()} == {"cloud", tfidf.DOC_SENTINEL}
    with pytest.raises(ValueError):
        counts.apply(batch(spark, []), "../up")
    with pytest.raises(ValueError):
        counts.counts(9)


def test_lost_batch_is_counted_once(spark, monkeypatch):
    counts, changes = fresh(spark), [("a", None, ("news", "river stone"))]

    def lost(*_, **__):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(TrainingCounts, "_mark", lost)
        with pytest.raises(RuntimeError):
            counts.apply(batch(spark, changes), "b")
    assert counts.version() == 0 and rows(counts.counts()) == []  # written, not published
    again = TrainingCounts(spark, counts.path)
    assert again.apply(batch(spark, changes), "b") == 1 and again.counts().count() == 3


def test_model_is_published_whole(spark, monkeypatch):
    path = shared_path(spark, "test-model-" + uuid.uuid4().hex[:8])
    data = lambda word: spark.createDataFrame([(str(i), "c", f"{word} {word} other{i}") for i in range(4)], "doc_id string, category string, text string")
    assert not tfidf.has_model(spark, path)
    tfidf.save_model(tfidf.train(data("river")), path)
    loaded = tfidf.load_model(spark, path)

    from folioscope.operators.folder import Folder
    with monkeypatch.context() as m:
        m.setattr(Folder, "_mark", lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tfidf.save_model(tfidf.train(data("stone")), path)
    assert [r["term"] for r in tfidf.load_model(spark, path).vocab.collect()] == ["river"]
    tfidf.save_model(tfidf.train(data("cloud")), path)
    assert [r["term"] for r in tfidf.load_model(spark, path).vocab.collect()] == ["cloud"]
    assert [r["term"] for r in loaded.vocab.collect()] == ["river"]  # a reader keeps its own
