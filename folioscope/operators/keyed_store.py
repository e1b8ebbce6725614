"""A keyed document store on disk.

The rows lie in ``<path>/data`` by bucket of the key's hash. A batch of changes
reads and rewrites the buckets it touches and no others (partition pruning; the
folders of the new buckets take the place of the old ones). Every batch has a name and leaves a log of
what it did to each key, with the row before and after: the change feed.

A batch goes through four steps, each complete or void, so that it survives a
lost executor or driver and may be called again under its name:

1. ``log/batch=<name>``: the decision. Once it is written it stands.
2. ``pending/<name>``: the new rows of the touched buckets.
3. the pending buckets take the place of those in ``data``.
4. ``done/<name>``; the pending rows are removed.

A call finds the last complete step and goes on from there; a batch that is
done is not done again. There is one writer at a time. While step 3 runs, a
reader may see the batch in some of its buckets only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from . import store as S
from .folder import Folder

BUCKET = "_bucket"
#: Of the rows, which are written twice a batch, in the log and in the buckets.
CODEC = "zstd"


class KeyedStore(Folder):
    """The store at ``path``. Its columns are the key, ``_rev`` and others.

    ``buckets`` is fixed when the store is created: about the size of the store
    over the size of a file that one task rewrites with ease."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.key, self.buckets = meta["key"], meta["buckets"]
        self.schema = TT.StructType.fromJson(json.loads(meta["schema"]))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: TT.StructType, key: str = "_id", buckets: int = 64) -> KeyedStore:
        """An empty store; an error if there is one."""
        missing = {key, "_rev"} - set(schema.names)
        if missing or BUCKET in schema.names:
            raise ValueError(f"a store has the columns {key!r} and '_rev' and none named {BUCKET!r}")
        rows = spark.createDataFrame([(key, buckets, schema.json())], "key string, buckets int, schema string")
        rows.coalesce(1).write.parquet(f"{path.rstrip('/')}/meta")
        return cls(spark, path)

    # ------------------------------------------------------------ reading
    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; other buckets are not read."""
        if not self._exists("data"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(TT.StructType([*self.schema, TT.StructField(BUCKET, TT.IntegerType())])).parquet(f"{self.path}/data")
        if only is not None:
            rows = rows.where(F.col(BUCKET).isin(only)) if only else rows.where(F.lit(False))
        return rows.drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        return self.read(self._touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def feed(self) -> DataFrame:
        """What all finished batches did: ``batch``, the key, ``op`` (created, updated,
        deleted or rejected), ``before`` and ``after`` (the other columns),
        ``rejected_rev``, ``current_rev`` and, of rejected ones, ``times``."""
        logs = [f"{self.path}/log/batch={name}" for name in self._names("done")]
        if not logs:
            return self.spark.createDataFrame([], TT.StructType([TT.StructField("batch", TT.StringType()), *self._log_schema()]))
        rows = self.spark.read.schema(TT.StructType([*self._log_schema(), TT.StructField("batch", TT.StringType())]))
        return rows.option("basePath", f"{self.path}/log").parquet(*logs)

    # ------------------------------------------------------------ writing
    def save(self, changes: DataFrame, batch: str, order: tuple[str, ...] = ()) -> DataFrame:
        """Applies a batch by the rules of ``store.upsert`` and returns its log.

        ``changes`` has the key, ``_rev`` and any of the other columns; a column that
        it lacks keeps its stored value (null in a new row). Columns that the
        store does not have serve ``order`` only."""
        def decide() -> DataFrame:
            base = self.read(self._touched(changes))
            judged = S.judge(base.select(self.key, "_rev"), changes, self.key, order)
            stored = base.select(self.key, self._others(base.columns).alias("before"))
            rows = judged.where("_won OR _late > 0").join(stored, self.key, "left")
            given = lambda c: S.next_revision() if c == "_rev" else F.col(c) if c in changes.columns else F.col(f"before.{c}")
            after = F.struct(*(given(c).cast(self.schema[c].dataType).alias(c) for c in self._other_names()))
            applied = {"op": F.when(F.col("_stored"), F.lit("updated")).otherwise(F.lit("created")), "before": F.col("before"), "after": after}
            late = {"op": F.lit("rejected"), "rejected_rev": F.col("_rev"), "current_rev": F.when(F.col("_stored"), F.col("_current")), "times": F.col("_late")}
            entry = lambda of: F.struct(*(of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self._log_schema() if f.name != self.key))
            # both entries of a change in one pass over the judged rows
            entries = F.array_compact(F.array(F.when(F.col("_won"), entry(applied)), F.when(F.col("_late") > 0, entry(late))))
            return rows.select(self.key, F.explode(entries).alias("_e")).select(self.key, "_e.*")
        return self._run(batch, decide)

    def delete(self, keys: DataFrame, batch: str) -> DataFrame:
        """Deletes the rows of some keys; keys that are not stored are no error."""
        def decide() -> DataFrame:
            gone = self.lookup(keys)
            return gone.select(self.key, F.lit("deleted").alias("op"), self._others(gone.columns).alias("before"))
        return self._run(batch, decide)

    def _run(self, batch: str, decide) -> DataFrame:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError("the name of a batch has letters, digits, '.', '_' and '-' only")
        for name in set(self._names("log")) - set(self._names("done")) - {batch}:  # a batch that a lost driver left
            if self._exists(f"log/batch={name}/_SUCCESS"):
                self._publish(name)
        if not self._exists(f"log/batch={batch}/_SUCCESS"):
            log = decide()
            for f in self._log_schema():
                log = log.withColumn(f.name, F.col(f.name).cast(f.dataType) if f.name in log.columns else F.lit(None).cast(f.dataType))
            log.select(*self._log_schema().names).write.mode("overwrite").option("compression", CODEC).parquet(f"{self.path}/log/batch={batch}")
        self._publish(batch)
        return self._log(batch)

    def _publish(self, batch: str) -> None:
        """Steps 2 to 4 of a batch whose log is written."""
        if self._exists(f"done/{batch}"):
            return
        done = self._log(batch).where("op <> 'rejected'")
        touched = self._touched(done)
        pending = f"{self.path}/pending/{batch}"
        if touched:
            if not self._exists(f"pending/{batch}/_SUCCESS"):
                kept = self.read(touched).join(done.select(self.key), self.key, "left_anti")
                rows = kept.unionByName(done.where("op <> 'deleted'").select(self.key, "after.*"))
                (rows.withColumn(BUCKET, self.bucket(F.col(self.key))).repartition(BUCKET).sortWithinPartitions(BUCKET, self.key)
                 .write.mode("overwrite").option("compression", CODEC).partitionBy(BUCKET).parquet(pending))
            buckets = [x for x in self._names(f"pending/{batch}") if x.startswith(f"{BUCKET}=")]
            if not self._exists(f"pending/{batch}/_moving"):  # until then none has moved
                for bucket in {f"{BUCKET}={b}" for b in touched} - set(buckets):
                    self._remove(f"data/{bucket}")  # all its rows are deleted
                self._mark(f"pending/{batch}/_moving")
            for bucket in buckets:
                self._replace(f"data/{bucket}", f"pending/{batch}/{bucket}")
        self._mark(f"done/{batch}")
        self._remove(f"pending/{batch}")

    # ------------------------------------------------------------ helpers
    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: numbers, at most ``buckets``."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(self.key))).distinct().collect())

    def _other_names(self) -> list[str]:
        return [c for c in self.schema.names if c != self.key]

    def _others(self, columns: list[str]) -> Column:
        return F.struct(*(F.col(c) for c in columns if c != self.key))

    def _log_schema(self) -> TT.StructType:
        others = TT.StructType([TT.StructField(f.name, f.dataType) for f in self.schema if f.name != self.key])
        return (TT.StructType([TT.StructField(self.key, self.schema[self.key].dataType), TT.StructField("op", TT.StringType())])
                .add("before", others).add("after", others).add("rejected_rev", "long").add("current_rev", "long").add("times", "long"))

    def _log(self, batch: str) -> DataFrame:
        return self.spark.read.schema(self._log_schema()).parquet(f"{self.path}/log/batch={batch}")


def counts_of_feed(feed: DataFrame, names: str = "categories") -> DataFrame:
    """Rows per name, from the feed alone: +1 for each name of the row after a
    change, -1 for each of the row before. The feed holds every change of the
    store, so the counts equal a recount. Partial sums shuffle one row per name
    and task. A name that a row lists twice counts once."""
    signed = lambda side, n: F.transform(F.coalesce(F.array_distinct(f"{side}.{names}"), F.array()),
                                         lambda x: F.struct(x.alias("name"), F.lit(n).alias("delta")))
    rows = feed.where("op <> 'rejected'").select(F.explode(F.concat(signed("after", 1), signed("before", -1))).alias("_d")).select("_d.*")
    sums = rows.groupBy("name").agg(F.sum("delta").cast("long").alias("document_count"))
    return sums.where("document_count <> 0")
