"""Pages and requests as streams: equal to the batch plan in either order, each row in one output, nothing twice."""

import datetime as dt
import uuid

import pytest

from folioscope.operators.keyed_store import KeyedStore
from folioscope.plans import ingest as I
from folioscope.session import shared_path
from folioscope.sources import bindings as B
from folioscope.streaming import joined_ingest as J

T0 = dt.datetime(2024, 5, 1, 12)
HOUR = dt.timedelta(hours=1)


def page(i, at, html="<title>T{}</title>", late=0):
    return i, f"http://a.org/{i}", html.format(i) if html else None, T0 + at * HOUR, T0 + (at + 0.1 + late) * HOUR


def request(i, at, status=200, late=0):
    return i, i % 2 == 0, "k", status, T0 + at * HOUR, T0 + (at + 0.1 + late) * HOUR


@pytest.fixture
def run(spark):
    class Run:
        path = shared_path(spark, "test-joined-" + uuid.uuid4().hex[:8])
        store = KeyedStore.create(spark, f"{path}/store", J.STORED, buckets=4)
        n = 0

        def land(self, pages=(), requests=()):
            Run.n += 1
            for name, rows, schema in (("pages", pages, J.PAGES), ("requests", requests, J.REQUESTS)):
                spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

        def go(self):
            J.run(spark, f"{self.path}/pages", f"{self.path}/requests", f"{self.path}/run", self.store)

        def unmatched(self):
            return sorted((r["page_id"] or r["_page"], r["reason"]) for r in spark.read.parquet(f"{self.path}/run/rejects/unmatched").collect())

        def late(self):
            return sorted(r["page_id"] for n in ("pages", "requests") for r in spark.read.parquet(f"{self.path}/run/rejects/late/{n}").collect())

        def stored(self):
            return sorted((r["_id"], r["title"], r["_rev"]) for r in self.store.read().collect())

    return Run()


@pytest.mark.parametrize("first", ["pages", "requests", "both"])
def test_either_order_gives_the_rows_of_the_batch(spark, run, first):
    ids = range(6)
    pages, requests = [page(i, i / 100) for i in ids], [request(i, i / 100 + 0.2, 404 if i == 3 else 200) for i in ids]
    run.land(pages=pages if first != "requests" else (), requests=requests if first != "pages" else ())
    run.go()
    if first != "both":
        assert run.stored() == []
        run.land(pages=pages if first == "requests" else (), requests=requests if first == "pages" else ())
        run.go()
    batch = spark.createDataFrame([(p[0], p[1], p[2], *r[1:4]) for p, r in zip(pages, requests)],
                                  "page_id long, url string, html string, create_note boolean, note_meta_tag string, http_status int")
    want = J.documents(I.ingest(batch, B.http_reasons(spark))).drop("_rev")
    got = run.store.read().drop("_rev")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len(run.stored()) == 5 and run.late() == []
    feed = run.store.feed().count()
    run.go()  # nothing new: nothing is done twice
    assert run.store.feed().count() == feed and len(run.stored()) == 5


def test_every_row_is_in_one_output(spark, run):
    run.land(pages=[page(1, 0), page(2, 0), page(3, 0, late=5), page(1, 0.01, "<title>longer title</title>")],
             requests=[request(1, 0.1), request(3, 0.1), request(4, 0), (5, True, "k", 200, None, T0)])
    run.go()
    assert run.stored() == [("doc|p1", "longer title", 1)]
    assert run.late() == [3, 5]
    # six hours later the rows without a partner leave the state
    run.land(pages=[page(8, 6)], requests=[request(8, 6)])
    run.go()
    run.land(pages=[page(9, 7), page(1, 7, "<title>once more</title>")], requests=[request(9, 7), request(1, 7)])
    run.go()
    assert run.unmatched() == [(2, "no request"), (3, "no page"), (4, "no page")]
    assert [r[0] for r in run.stored()] == ["doc|p1", "doc|p8", "doc|p9"]
    # the second page 1 is in the store's log as rejected
    assert [r["_id"] for r in run.store.feed().where("op = 'rejected'").collect()] == ["doc|p1"]
