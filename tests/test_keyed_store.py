"""The keyed store on disk: rules of upsert, untouched buckets, repeated and broken-off batches, the feed."""

import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.operators import store as S
from folioscope.operators.keyed_store import KeyedStore, counts_of_feed
from folioscope.session import shared_path

SCHEMA = "_id string, _rev int, title string, categories array<string>"


def fresh(spark, buckets=8):
    schema = spark.createDataFrame([], SCHEMA).schema
    return KeyedStore.create(spark, shared_path(spark, "test-store-" + uuid.uuid4().hex[:8]), schema, buckets=buckets)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(store):
    out = {}
    for f in glob.glob(store.path.removeprefix("file:") + "/data/_bucket=*/*.parquet"):
        out.setdefault(f.split("_bucket=")[1].split("/")[0], set()).add((os.path.basename(f), os.stat(f).st_mtime_ns))
    return out


def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def recount(store):
    return rows(store.read().select(F.explode(F.array_distinct("categories")).alias("name")).groupBy("name").count())


def test_batches_equal_upsert_and_keep_other_buckets(spark):
    store, rnd = fresh(spark), random.Random(2)
    first = docs(spark, [(f"doc|{i}", None, f"t{i}", ["en"]) for i in range(60)])
    log = store.save(first, "b0")
    assert log.where("op = 'created'").count() == 60
    assert len(files(store)) == 8
    for turn in range(2):
        keys = rnd.sample(range(75), 3)
        data = [(f"doc|{k}", r, f"new{turn}-{k}-{j}", ["de", "en", "de"][:j + 1]) for k in keys for j, r in enumerate((1 + turn, None, 1))]
        data += [data[0], data[0]]
        changes = docs(spark, data)
        want, conflicts = S.upsert(docs(spark, rows(store.read())), changes)
        want, conflicts, before = rows(want), conflicts.count(), files(store)
        log = store.save(changes, f"c{turn}")
        assert rows(store.read()) == want
        assert log.where("op = 'rejected'").agg(F.sum("times")).first()[0] == conflicts
        touched = {str(r[0]) for r in log.where("op <> 'rejected'").select(store.bucket(F.col("_id"))).distinct().collect()}
        after = files(store)
        assert {b for b in set(before) | set(after) if before.get(b) != after.get(b)} == touched and len(touched) < 8
        # the same batch again does nothing
        assert rows(store.save(changes, f"c{turn}")) == rows(log)
        assert files(store) == after and rows(store.read()) == want
        assert rows(counts_of_feed(store.feed())) == recount(store)


def test_changed_columns_only_and_types(spark):
    store = fresh(spark)
    store.save(docs(spark, [("a", None, "one", ["x"]), ("b", None, "two", None)]), "b0")
    store.save(spark.createDataFrame([("a", 1, ["y"], 7), ("c", None, ["z"], 7)], "_id string, _rev long, categories array<string>, extra int"), "b1")
    assert rows(store.read()) == [("a", 2, "one", ["y"]), ("b", 1, "two", None), ("c", 1, None, ["z"])]
    assert rows(store.lookup(spark.createDataFrame([("a",), ("q",), ("a",)], "_id string"))) == [("a", 2, "one", ["y"])]


def test_delete_removes_empty_buckets_and_is_idempotent(spark):
    store = fresh(spark)
    store.save(docs(spark, [(f"k{i}", None, "t", ["x"]) for i in range(20)]), "b0")
    bucket = store.read().select(store.bucket(F.col("_id"))).first()[0]
    gone = store.read([bucket]).select("_id").unionByName(spark.createDataFrame([("nobody",)], "_id string"))
    gone = spark.createDataFrame(gone.collect(), "_id string")
    log = store.delete(gone, "d0")
    assert str(bucket) not in files(store) and store.read([bucket]).count() == 0
    assert store.read().count() + log.count() == 20
    left = rows(store.read())
    store.delete(gone, "d1")
    assert rows(store.read()) == left and rows(counts_of_feed(store.feed())) == recount(store)


def lost():
    raise RuntimeError("lost")


@pytest.mark.parametrize("step", ["log", "pending", "half", "marked"])
def test_a_batch_that_broke_off_is_finished(spark, monkeypatch, step):
    store = fresh(spark)
    store.save(docs(spark, [(f"k{i}", None, "old", ["x"]) for i in range(30)]), "b0")
    changes = docs(spark, [(f"k{i}", 1, "new", ["y"]) for i in range(0, 30, 4)] + [("k1", 9, "late", ["z"]), ("fresh", None, "f", ["y"])])
    want = rows(S.upsert(docs(spark, rows(store.read())), changes)[0])

    with monkeypatch.context() as m:
        real_remove = KeyedStore._remove
        if step == "log":  # the driver is lost when the decision is written
            m.setattr(KeyedStore, "_publish", lambda self, name: lost() if name == "b1" else None)
        elif step == "marked":  # lost before the pending rows are removed
            m.setattr(KeyedStore, "_remove", lambda self, name: lost() if "pending/b1" in name else real_remove(self, name))
        else:  # lost before the mark, all buckets written; or with some of them written
            m.setattr(KeyedStore, "_mark", lambda self, name: lost())
        with pytest.raises(RuntimeError):
            store.save(changes, "b1")
    if step == "half":  # a bucket of the last step is gone, as between its delete and its rename
        touched = store._touched(store._log("b1").where("op <> 'rejected'"))
        store._remove(f"data/_bucket={touched[0]}")
    again = KeyedStore(spark, store.path)
    if step in ("log", "half"):  # another batch finishes it first
        again.save(docs(spark, []), "b2")
    else:
        again.save(changes, "b1")
    assert rows(again.read()) == want
    assert rows(counts_of_feed(again.feed())) == recount(again)
    again.save(changes, "b1")
    assert rows(again.read()) == want


def test_empty_store_and_wrong_use(spark):
    store = fresh(spark)
    assert store.read().count() == 0 and store.feed().count() == 0 and rows(counts_of_feed(store.feed())) == []
    store.save(docs(spark, []), "b0")
    store.delete(spark.createDataFrame([("a",)], "_id string"), "d0")
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        store.save(docs(spark, []), "../b")
    with pytest.raises(ValueError):
        KeyedStore.create(spark, store.path + "-x", spark.createDataFrame([], "id string").schema)
    with pytest.raises(Exception):
        KeyedStore.create(spark, store.path, store.schema)


def test_reads_only_the_buckets_it_needs(spark):
    store = fresh(spark, buckets=16)
    store.save(docs(spark, [(f"k{i}", None, "t", ["x"]) for i in range(200)]), "b0")
    plan = store.lookup(spark.createDataFrame([("k3",)], "_id string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan
    assert len(store.read([3]).inputFiles()) <= 16
    assert store.read([3]).select(F.input_file_name()).distinct().count() == 1


def test_a_driver_lost_while_buckets_move_and_buckets_that_end_empty(spark, monkeypatch):
    import uuid

    from folioscope.operators.folder import Folder
    from folioscope.operators.keyed_store import KeyedStore
    from folioscope.session import shared_path
    rows = spark.range(40).selectExpr("CAST(id AS STRING) AS _id", "CAST(NULL AS INT) AS _rev", "concat('t', id) AS title")
    store = KeyedStore.create(spark, shared_path(spark, "test-moves-" + uuid.uuid4().hex[:8]), spark.createDataFrame([], "_id string, _rev int, title string").schema, buckets=6)
    moved, move = [], Folder._replace

    def lost(self, name, source):
        if len(moved) == 3:
            raise KeyboardInterrupt
        moved.append(name)
        move(self, name, source)

    for step, call in enumerate((lambda: store.save(rows, "one"), lambda: store.delete(rows.where("_id < 30"), "two"), lambda: store.delete(rows, "three"))):
        moved.clear()
        monkeypatch.setattr(Folder, "_replace", lost)
        if step < 2:
            try:
                call()
                raise AssertionError("the driver was not lost")
            except KeyboardInterrupt:
                pass
        monkeypatch.setattr(Folder, "_replace", move)
        call()
        assert {int(r["_id"]) for r in store.read().collect()} == set(range(*[(0, 40), (30, 40), (0, 0)][step]))
    assert not store._names("pending")
