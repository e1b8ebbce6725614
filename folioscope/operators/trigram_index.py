"""Substring search that does not read every document.

The index is three tables: postings (field, gram, key), where a gram is three
code points of a lower-cased field as one number; how many documents each gram
has; and the searched fields themselves, sorted by key. The postings lie in
segments: one file for the documents of one task, sorted by gram, so building
them shuffles the fields only. A query looks up the postings of its ``RAREST``
rarest grams (a filter on sorted files), keeps the keys that have them all in
one field, and tests the exact condition of ``search.search`` on those documents
only. Queries below three characters have no gram and scan the fields.

The postings of a gram that very many documents have are spread over the
segments; of such grams a query with rarer ones reads none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..session import read_bytes, reliable

#: Grams of a query that are looked up; the exact test follows in any case.
RAREST = 3
#: Up to so many candidate keys become a filter on the files, more a join.
PUSHED_KEYS = 1000
#: Bytes of input files whose postings make one segment.
SEGMENT_BYTES = 16 << 20
#: Postings that a Python worker gathers before it hands them on.
OUT_ROWS = 200_000
#: Bits of a code point; three of them fit a long.
BITS = 21


def grams(text):
    """The distinct grams of a lower-cased text, as a column; linear in its length.
    For the few texts of queries, documents go through ``gram_codes``."""
    letters = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))  # its code points
    three = lambda c: F.when(F.size(c) >= 3, F.transform(
        F.slice(c, F.lit(1), F.size(c) - 2),
        lambda x, i: F.shiftleft(x, 2 * BITS) + F.shiftleft(F.element_at(c, i + 2), BITS) + F.element_at(c, i + 3))).otherwise(F.array().cast("array<bigint>"))
    # the code points are bound once, as the one element of an array
    return F.array_distinct(F.flatten(F.transform(F.array(letters), three)))


def gram_codes(text: bytes) -> np.ndarray:
    """What ``grams`` gives, sorted, of a lower-cased text in UTF-8."""
    c = np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), "<u4").astype(np.int64)
    codes = np.sort(c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def _postings(key: str, fields: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, lower-cased fields as binary) → batches of (field, gram, key)."""
    def batch(keys: pa.Array, rows: list[int], numbers: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(c) for c in codes]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(numbers, np.int32), sizes)), pa.array(np.concatenate(codes)),
                                           keys.take(pa.array(np.repeat(np.array(rows, np.int64), sizes)))], ["field", "gram", key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, numbers, codes, n = b.column(0), [], [], [], 0
            for i in range(b.num_rows):
                for f in range(len(fields)):
                    text = b.column(f + 1)[i].as_py()
                    if text:
                        rows.append(i)
                        numbers.append(f)
                        codes.append(gram_codes(text))
                        n += len(codes[-1])
                if n >= OUT_ROWS:
                    yield batch(keys, rows, numbers, codes)
                    rows, numbers, codes, n = [], [], [], 0
            if n:
                yield batch(keys, rows, numbers, codes)

    return run


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str, key: str, fields: tuple[str, ...]):
        self.spark, self.path, self.key, self.fields = spark, path, key, fields

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "_id", fields: tuple[str, ...] = ("title", "description", "url")) -> TrigramIndex:
        """Writes the index of ``docs`` to a fresh folder. ``key`` is unique; null fields have no grams."""
        index = cls(docs.sparkSession, path.rstrip("/"), key, tuple(fields))
        kept = docs.select(key, *fields)
        kept.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{index.path}/fields")

        segments = max(docs.sparkSession.sparkContext.defaultParallelism, -(-read_bytes(docs) // SEGMENT_BYTES))
        schema = TT.StructType([TT.StructField("field", TT.IntegerType()), TT.StructField("gram", TT.LongType()), kept.schema[key]])
        texts = index._read("fields").repartition(segments, key).select(key, *(F.lower(f).cast("binary").alias(f) for f in fields))
        texts.mapInArrow(_postings(key, index.fields), schema).sortWithinPartitions("gram").write.parquet(f"{index.path}/postings")
        counts = index._read("postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{index.path}/counts")
        return index

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _matches(self, q):
        return [F.coalesce(F.contains(F.lower(F.col(f)), F.lower(q)), F.lit(False)) for f in self.fields]

    def candidates(self, q: str) -> DataFrame | None:
        """Keys that may match, a superset; None where ``q`` has no gram."""
        of_q = self.spark.range(1).select(F.explode(grams(F.lower(F.lit(q)))).alias("gram"))
        wanted = [r["gram"] for r in of_q.collect()]
        if not wanted:
            return None
        known = {r["gram"]: r["n"] for r in self._read("counts").where(F.col("gram").isin(wanted)).collect()}
        if len(known) < len(wanted):  # no document has the gram
            return self._read("postings").select(self.key).where(F.lit(False))
        rare = sorted(wanted, key=lambda g: (known[g], g))[:RAREST]
        hits = self._read("postings").where(F.col("gram").isin(rare)).groupBy("field", self.key).agg(F.count(F.lit(1)).alias("_n"))
        return hits.where(F.col("_n") == len(rare)).select(self.key).distinct()

    def search(self, q: str) -> DataFrame:
        """Key and fields of the documents that ``search.search`` finds."""
        docs, keys, any_field = self._read("fields"), self.candidates(q), F.lit(False)
        for hit in self._matches(F.lit(q)):
            any_field = any_field | hit
        if keys is not None:
            few = [r[0] for r in keys.limit(PUSHED_KEYS + 1).collect()]
            docs = docs.where(F.col(self.key).isin(few)) if len(few) <= PUSHED_KEYS else docs.join(keys, self.key, "left_semi")
        return docs.where(any_field)

    def search_all(self, queries: DataFrame) -> DataFrame:
        """``q`` and key of every match of a table of queries (q): one pass for all.
        Queries below three characters are few and scan the fields."""
        asked = queries.select("q").where("q IS NOT NULL").distinct()
        asked = asked.select("q", grams(F.lower("q")).alias("_g"))
        wanted = asked.select("q", F.size("_g").alias("_all"), F.explode("_g").alias("gram"))
        by_count = Window.partitionBy("q").orderBy("n", "gram")
        rare = (wanted.join(self._read("counts"), "gram").withColumn("_found", F.count(F.lit(1)).over(Window.partitionBy("q")))
                .where("_found = _all").withColumn("_r", F.row_number().over(by_count)).where(F.col("_r") <= RAREST)
                .select("q", "gram", F.least(F.col("_all"), F.lit(RAREST)).alias("_need")))
        rare = reliable(rare, "rare-grams")  # of known size: while small it is broadcast, and the postings are not shuffled
        hits = self._read("postings").join(rare, "gram").groupBy("q", "field", self.key, "_need").agg(F.count(F.lit(1)).alias("_n"))
        pairs = hits.where("_n = _need").select("q", self.key).distinct()
        docs, any_field = self._read("fields"), F.lit(False)
        for hit in self._matches(F.col("q")):
            any_field = any_field | hit
        long = docs.join(pairs, self.key).where(any_field)
        short = docs.join(F.broadcast(asked.where(F.size("_g") == 0).select("q")), any_field)
        return long.select("q", self.key).unionByName(short.select("q", self.key))
