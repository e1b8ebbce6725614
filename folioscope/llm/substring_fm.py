"""Substring deduplication with a compressed FM-index per shard.

A window is ``width`` consecutive words of one document. A word goes if a
window over it also begins earlier (smaller id, or the same document further
left).

Sharding. Every window holds a smallest hash among its ``ANCHOR``-word runs;
equal windows have equal ones. Neighbouring windows with the same anchor make a
segment, so a document is cut into segments, and a window can only repeat
between segments of one anchor. Anchors that occur once in the whole corpus
need no look at their text (``repeated_anchors``). For the others, equal segments are
aggregated: all but the first go whole. What remains, the first ones of anchors
with several different segments, is dealt into shards of bounded size. An anchor
with very many different segments (the edges of a passage found everywhere), or
with very long ones, would not fit one: its windows are aggregated by their hash
like equal segments, all but the earliest go, and none needs an index.

Per shard an FM-index (``fm_index``) is built over the segments and the same
segments are streamed through it by backward search, giving for each window
the earliest place it occurs at.

Intervals of removed windows are then collected per document and cut out.

Defined results: null and empty texts have no words. Documents shorter than a
window keep everything. Rows that share an id are told apart by a hash of
their texts; windows of theirs at the same place do not remove one another, so
repeated rows are judged alike. A null id sorts before all others. Texts may be arbitrarily long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from folioscope.llm.common import map_slices, slices, words, written
from folioscope.llm.fm_index import FMIndex, repeated

#: Words whose hash can be an anchor.
ANCHOR = 5
#: Words of a shard's index.
SHARD_WORDS = 1_500_000
#: Different segments, or twice as many windows' widths of words in them, from
#: which an anchor is searched by single windows.
HOT_SEGMENTS = 2_000
#: Stands for a null id.
NO_ID = -(1 << 63)

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
_BASE = 0x9E3779B97F4A7C55  # odd: powers can be undone modulo 2^64
_UNDO = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[3]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n; the longest table so far is kept."""
    if len(_TABLES.get(base, ())) <= n:
        _TABLES[base] = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)
    return _TABLES[base][:n + 1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text begins."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # the spaces of words(); leaves empty strings at the ends
    coded = split.flatten().dictionary_encode()
    found = coded.dictionary.to_pylist()
    known = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    codes = coded.indices.to_numpy()
    real = np.fromiter(map(bool, found), bool, len(found))[codes]
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    return known[codes][real], np.concatenate([[0], np.cumsum(real)])[at]


def spans(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``first`` up to ``end``, the same wherever they stand."""
    up = _powers(_BASE, len(hashes))
    sums = np.append(np.uint64(0), np.cumsum(hashes * up[:-1], dtype=np.uint64))
    return (sums[end] - sums[first]) * _powers(_UNDO, len(hashes))[first]


def segments(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A document's segments: anchor, first window, number of windows, and
    whether the anchor occurs twice within the segment."""
    n = len(hashes) - width + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    span = len(hashes) - ANCHOR + 1
    runs = hashes[:span].copy()
    for i in range(1, ANCHOR):
        runs = runs * _MIX[i % 3] + hashes[i:span + i]
    runs = _mixed(runs)
    least, have, need = runs, 1, width - ANCHOR + 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    count = np.diff(np.append(first, n))
    anchor = least[first]
    # occurrences of the anchor in the segment: at its windows' first words, or after the last one
    times = np.add.reduceat((runs[:n] == least).astype(np.int64), first)
    last = first + count - 1
    for i in range(1, need):
        times += runs[last + i] == anchor
    return anchor, first, count, times > 1


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            hashes, at = word_hashes(part.column(1))
            found, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                anchor, _, _, twice = segments(hashes[a:b], width)
                both = np.concatenate([anchor, anchor[twice]])  # twice in one segment counts twice
                found.append(both)
                own.append(np.full(len(both), i))
            ids = part.column(0).take(pa.array(np.concatenate(own)))
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), ids], names=["anchor", "id"])
    return run


def repeated_anchors(docs: DataFrame, width: int) -> DataFrame:
    """``id`` and ``anchors``: its anchors that occur more than once in the corpus."""
    # used twice below: the texts are read and hashed once
    rows = written(docs.mapInArrow(_anchors(width), "anchor bigint, id bigint"), "anchor-rows")
    often = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    return written(rows.join(often, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "anchors")


SEGMENT_SCHEMA = "anchor bigint, content bigint, id bigint, row bigint, start bigint, windows bigint, twice boolean, text string"


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            hashes, at = word_hashes(part.column(1))
            wanted = part.column(3)
            out: list[list] = [[] for _ in range(8)]
            for i, (doc_id, row, text) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).to_pylist())):
                own, found = hashes[at[i]:at[i + 1]], words(text)
                anchor, first, count, twice = segments(own, width)
                content = _mixed(spans(own, first, first + count + width - 1) + count.astype(np.uint64))
                for k in np.flatnonzero(np.isin(anchor.view(np.int64), wanted[i].values.to_numpy())).tolist():
                    a, n = int(first[k]), int(count[k])
                    for column, x in zip(out, (anchor.view(np.int64)[k], content.view(np.int64)[k], doc_id, row, a, n, twice[k],
                                               " ".join(found[a:a + n + width - 1]))):
                        column.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 6, pa.bool_(), pa.string()))],
                                  names=["anchor", "content", "id", "row", "start", "windows", "twice", "text"])
    return run


DEALT = ["anchor", "id", "row", "start", "windows", "text", "content"]


def _dealt(width: int):
    """Segments as they are; of hot anchors the single windows, with the hash
    of the content instead of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 5):
            cold = part.filter(pc.invert(part.column(6)))
            yield pa.record_batch([*cold.columns[:6], pa.nulls(cold.num_rows, pa.int64())], names=DEALT)
            part = part.filter(part.column(6))
            hashes, at = word_hashes(part.column(5))
            counts = part.column(4).to_numpy()
            own = np.repeat(np.arange(len(counts)), counts)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = at[:-1][own] + nth
            content = _mixed(spans(hashes, first, first + width)).view(np.int64)
            anchor, doc_id, row, start = (part.column(i).to_numpy()[own] for i in range(4))
            made = [pa.array(c) for c in (anchor, doc_id, row, start + nth, np.ones_like(nth))]
            yield pa.record_batch([*made, pa.nulls(len(own), pa.string()), pa.array(content)], names=DEALT)
    return run


def shard_repeats(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, texts: pa.Array,
                  width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows (id, row, start, windows) among a shard's segments."""
    order = np.lexsort((starts, ids))
    ids, rows, starts, counts, texts = ids[order], rows[order], starts[order], counts[order], texts.take(pa.array(order))
    split = pc.split_pattern(texts, " ")
    numbers = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    sizes = counts + width - 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    inner = np.ones(len(text), bool)
    inner[begin + sizes] = False
    text[inner] = numbers
    nth = np.cumsum(np.append(0, ids[1:] != ids[:-1]))  # ids by rank, so that id and word fit one integer
    place = np.repeat((nth << 40) + starts - begin, sizes + 1) + np.arange(len(text))
    found = repeated(FMIndex(text, width, place), text, begin, counts)
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(begin, a, side="right") - 1
    return ids[own], rows[own], starts[own] + a - begin[own], b - a


def removed_windows(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``row``, ``start`` and ``windows`` of the runs of windows that begin
    earlier too; ``docs`` has ``id``, ``text`` and ``row``."""
    wanted = repeated_anchors(docs.select("id", "text"), width)
    cut = written(docs.join(wanted, "id").select("id", "text", "row", "anchors").mapInArrow(_cut(width), SEGMENT_SCHEMA), "segments")
    place = (F.col("id").cast("decimal(38,0)") * F.lit(1 << 40).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col("start")
    place = place.cast("decimal(38,0)")
    # which segment of each content comes first, and how many contents its anchor has: no text moves for that
    firsts = cut.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.max("windows").alias("n"), F.max("twice").alias("twice"))
    several = firsts.groupBy("anchor").agg(F.count("*").alias("different"), F.sum(F.col("n") + width).alias("words"))
    wanted = (F.col("different") > 1) | F.col("twice")
    many = (F.col("different") > HOT_SEGMENTS) | (F.col("words") > 2 * width * HOT_SEGMENTS)
    firsts = written(firsts.join(several, "anchor").select(
        "anchor", "content", "first", "n", wanted.alias("searched"), (wanted & many).alias("hot")), "firsts")
    total, hot = firsts.agg(F.sum(F.when(F.col("searched") & ~F.col("hot"), F.col("n") + width)), F.max("hot")).first()
    shards = int((total or 0) // SHARD_WORDS) + 1
    chosen = firsts.select("anchor", "content", "first", "searched", "hot")
    copies = (cut.select("anchor", "content", "id", "row", "start", "windows").join(chosen, ["anchor", "content"])
              .where(place != F.col("first")).select("id", "row", "start", "windows"))

    searched = (cut.drop("twice").join(chosen.where("searched"), ["anchor", "content"]).where(place == F.col("first"))
                .dropDuplicates(["anchor", "content", "row"]).select("anchor", "id", "row", "start", "windows", "text", "hot"))
    if hot:
        searched = written(searched.mapInArrow(_dealt(width), "anchor bigint, id bigint, row bigint, start bigint, windows bigint, "
                                                              "text string, content bigint"), "dealt")

    def search(table):
        found = shard_repeats(*(table.column(c).to_numpy() for c in ("id", "row", "start", "windows")),
                              table.column("text").combine_chunks(), width)
        return pa.table(dict(zip(("id", "row", "start", "windows"), found)))

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    indexed = searched.where("content is null") if hot else searched
    runs = (indexed.withColumn("shard", shard).select("shard", "id", "row", "start", "windows", "text").groupBy("shard")
            .applyInArrow(lambda table: search(table), "id bigint, row bigint, start bigint, windows bigint"))
    runs = runs.union(copies)
    if hot:
        windows = searched.where("content is not null").select("anchor", "content", "id", "row", "start")
        earliest = written(windows.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                           .where("n > 1").drop("n"), "earliest")
        later = windows.join(earliest, ["anchor", "content"]).where(place != F.col("first"))
        runs = runs.union(later.select("id", "row", "start", F.lit(1).cast("long").alias("windows")))
    return written(runs, "removed")


def _kept(width: int):
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(3)]
        for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            found = words(text)
            gone = np.zeros(len(found) + 1, np.int64)
            for run in runs or ():
                gone[run["start"]] += 1
                gone[run["start"] + run["windows"] + width - 1] -= 1
            left = np.cumsum(gone[:-1]) == 0
            spans = np.flatnonzero(np.diff(np.concatenate([[1], left.astype(np.int8), [1]]))).reshape(-1, 2)
            kept = [w for w, k in zip(found, left.tolist()) if k] if len(spans) else found
            for column, x in zip(out, (len(found), spans.tolist(), " ".join(kept))):
                column.append(x)
        made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()))]
        return pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[3:]],
                                          names=["id", "n_words", "removed", "kept", *part.schema.names[3:]])
    return work


def _deduplicated(df: DataFrame, width: int, id_column: str, text_column: str, carried: Sequence[str]) -> DataFrame:
    """``id``, ``n_words``, ``removed``, ``kept`` and ``carried_0`` ... of every row."""
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id")
    text, row = F.col(text_column).alias("text"), F.xxhash64(F.col(text_column)).alias("row")
    runs = removed_windows(df.select(key, text, row), width).groupBy("id", "row").agg(
        F.collect_set(F.struct("start", "windows")).alias("runs"))
    more = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carried)]
    rows = df.select(key, text, row, *more).join(runs, ["id", "row"], "left").select("id", "text", "runs", *(f"carried_{i}" for i in range(len(more))))
    made = StructType([StructField("id", LongType()), StructField("n_words", LongType()),
                       StructField("removed", ArrayType(ArrayType(LongType()))), StructField("kept", StringType()), *rows.schema.fields[3:]])
    made = map_slices(rows, _kept(width), made, 1)
    return made.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def deduplicate(df: DataFrame, width: int = 20, id_column: str = "doc_id", text_column: str = "text",
                carried: Sequence[str] = ()) -> DataFrame:
    """``id_column``, ``n_words``, ``removed`` (spans of words, [from, to) each), ``kept``
    (the other words, joined by one space) and the ``carried`` columns of every row.
    Ids are integers."""
    return _deduplicated(df, width, id_column, text_column, carried).toDF(id_column, "n_words", "removed", "kept", *carried)


def without_repeats(df: DataFrame, width: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with all columns, each text cut down to its kept words; a text
    that loses nothing stays as it is."""
    found = _deduplicated(df, width, id_column, text_column, df.columns)
    own = {c: F.col(f"carried_{i}") for i, c in enumerate(df.columns)}
    own[text_column] = F.when(F.size("removed") > 0, F.col("kept")).otherwise(own[text_column])
    return found.select(*(column.alias(c) for c, column in own.items()))
