"""SimHash near-duplicates: fingerprints linked exactly within a Hamming distance
by vantage-point trees over shards.

On all 64 bits a vantage-point tree prunes little: distances to any point
gather around 32, and a ball of radius 4 overlaps more than half of the rings.
So the tree is built on each third of the bits: two fingerprints that differ in
at most 4 bits differ in at most 1 bit of some third, and a ball of radius 1
meets few rings.

A shard is a ring combination: the distances of a third to the first
``levels`` vantage points. The triangle bound says that a fingerprint within r
bits lies within r rings of each vantage point; Hamming distances also keep
parity, so rings at odd steps need an odd distance. Each fingerprint is stored
in its shard and is a query to the shards its ball overlaps (of two
neighbours only the one with the nearer first ring asks). Within a shard the
same tree goes on, one vantage point deeper at a time, down to leaves small
enough to compare.

Only distinct fingerprints are compared, so copies cost nothing: and however
many near copies a text has, few distinct fingerprints lie within 4 bits of
each other. A shard hands on the edges of a spanning forest of its links, not
all pairs.

Defined results: null and empty texts have fingerprint 0 and link like any
other. Texts of fewer words than a shingle are one shingle. Repeated rows and
ids stay. The component id is the smallest non-null id of the component. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.llm.common import map_slices, written
from folioscope.llm.components import roots

SEED = 42
#: Vantage points whose rings make up a shard's key; more for more shards.
LEVELS = 3
#: Compared at once within a leaf.
LEAF_PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
    n = len(found)
    if not n:
        return 0
    whole = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = np.array([digest(whole, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[:n - shingle]]).tolist()
        hashes = np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())],
                             np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``fp`` (the 64 bits as a signed integer)."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
        return pa.record_batch([part.column(0), pa.array(made.view(np.int64))], names=[id_column, "fp"])

    rows = df.select(F.col(id_column), F.col(text_column))
    return map_slices(rows, work, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, fp bigint", 1)


class Space:
    """The blocks of a fingerprint, each with its vantage points."""

    def __init__(self, max_bits: int, blocks: int = 3):
        self.max_bits, self.radius = max_bits, max_bits // blocks
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        self.masks = [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]

    def ring(self, fps: np.ndarray, block: int, level: int) -> np.ndarray:
        """Distances of a block to the vantage point of a level, a fixed random one."""
        point = np.uint64(xxhash.xxh64_intdigest(f"{block}/{level}", SEED))
        return np.bitwise_count((fps ^ point) & self.masks[block]).astype(np.int64)

    def steps(self, levels: int) -> list[tuple[int, ...]]:
        """Ring steps to the shards a query visits: within the radius, all of
        one parity, and the first one not nearer than its own."""
        out = []
        for apart in range(self.radius + 1):
            reach = [s for s in range(-apart, apart + 1) if (s - apart) % 2 == 0]
            combos: list[tuple[int, ...]] = [(s,) for s in reach if s >= 0]
            for _ in range(levels - 1):
                combos = [c + (s,) for c in combos for s in reach]
            out += combos
        return sorted(set(out))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star edge to its component's smallest node for every linked node."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if np.array_equal(label[a], label[b]):
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def links(fps: np.ndarray, stored: np.ndarray, queries: np.ndarray, space: Space, block: int,
          level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``fps`` at most ``max_bits`` apart, a stored one
    and a query each, as edges with the same components."""
    if not len(stored) or not len(queries):
        return
    if len(stored) * len(queries) > LEAF_PAIRS and level < 64:
        mine, theirs = space.ring(fps[stored], block, level), space.ring(fps[queries], block, level)
        if mine.min() < mine.max():
            for ring in np.unique(mine).tolist():
                yield from links(fps, stored[mine == ring], queries[np.abs(theirs - ring) <= space.radius], space, block, level + 1)
            return
        queries = queries[np.abs(theirs - mine[0]) <= space.radius]
        yield from links(fps, stored, queries, space, block, level + 1)
        return
    own = fps[stored]
    for i in range(0, len(queries), step := max(1, LEAF_PAIRS // len(stored))):
        asked = queries[i:i + step]
        q, s = np.nonzero(np.bitwise_count(fps[asked][:, None] ^ own[None, :]) <= space.max_bits)
        if len(q):
            yield asked[q], stored[s]


def edges(distinct: DataFrame, max_bits: int = 4, levels: int = LEVELS) -> DataFrame:
    """``a`` and ``b``: edges between distinct ``fp`` of ``distinct`` whose
    components are those of all links within ``max_bits``."""
    space = Space(max_bits)
    steps = space.steps(levels)
    zero = (0,) * levels

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for block in range(len(space.masks)):
                rings = [space.ring(fps, block, k) for k in range(levels)]
                for step in steps:
                    shard = np.full(len(fps), block, np.int64)
                    for ring, s in zip(rings, step):
                        shard = shard * 256 + ring + s + 64  # a ring of no point is an empty shard
                    yield pa.record_batch([pa.array(shard), batch.column(0), pa.array(np.full(len(fps), step == zero))],
                                          names=["shard", "fp", "stored"])

    nothing = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def match(key, table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("stored").to_numpy()
        stored = np.flatnonzero(home)
        if not len(stored):
            return nothing
        block = key[0].as_py() >> (8 * levels)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for found in links(fps, stored, np.arange(len(fps)), space, block, levels):
            held.append(found)
            count += len(found[0])
            if count > 4 * len(fps) + LEAF_PAIRS:
                held = [_forest(*map(np.concatenate, zip(*held)), len(fps))]
                count = len(held[0][0])
        if not held:
            return nothing
        a, b = _forest(*map(np.concatenate, zip(*held)), len(fps))
        return pa.table({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    rows = distinct.select("fp").mapInArrow(spread, "shard bigint, fp bigint, stored boolean")
    return rows.groupBy("shard").applyInArrow(match, "a bigint, b bigint")


def near_duplicates(df: DataFrame, shingle: int = 4, max_bits: int = 4, levels: int = LEVELS,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``fp``, ``root`` (the component's smallest fingerprint) and
    ``component_id`` of every row."""
    marked = written(fingerprints(df, shingle, id_column, text_column), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(id_column).alias("first"))
    root = roots(edges(distinct, max_bits, levels))
    grouped = distinct.join(root, distinct["fp"] == root["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = grouped.join(least, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select(id_column, "fp", "root", "component_id")


def keep_one(df: DataFrame, shingle: int = 4, max_bits: int = 4, levels: int = LEVELS, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """One row of every component, with all columns: that of the smallest id."""
    found = near_duplicates(df, shingle, max_bits, levels, id_column, text_column)
    chosen = (found.where(F.col(id_column).eqNullSafe(F.col("component_id"))).groupBy("root")
              .agg(F.min("fp").alias("_fp"), F.min(id_column).alias("_id")))
    # a null id is told apart by its fingerprint
    none = F.lit("none")
    chosen = written(chosen.select("_fp", F.coalesce(F.col("_id").cast("string"), none).alias("_key")), "kept")
    names = df.columns
    key, fp = (next(x for x in (w + "_" * i for i in range(len(names) + 1)) if x not in names) for w in ("_key", "_fp"))
    chosen = chosen.withColumnsRenamed({"_key": key, "_fp": fp})

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t, shingle) for t in part.column(names.index(text_column)).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(made.view(np.int64))], names=[*names, fp])

    marked = map_slices(df, work, StructType([*df.schema.fields, StructField(fp, LongType())]), names.index(text_column))
    marked = marked.withColumn(key, F.coalesce(F.col(id_column).cast("string"), none))
    return marked.join(chosen, [key, fp], "left_semi").dropDuplicates([key, fp]).select(*names)


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
