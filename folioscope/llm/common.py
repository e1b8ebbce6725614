"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from folioscope.session import shared_path

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: a lost
    executor then costs a re-read, not the work that led here."""
    path = shared_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Characters at which str.split() splits too, though they are part of words.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    if not text:
        return []
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def slices(batches: Iterable[pa.RecordBatch], text_column: int,
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about ``most`` bytes
    (a single longer text makes a run of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema,
               text_column: int) -> DataFrame:
    """``work`` on bounded slices of ``df`` in Arrow batches."""
    def run(batches):
        for part in slices(batches, text_column):
            out = work(part)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)
