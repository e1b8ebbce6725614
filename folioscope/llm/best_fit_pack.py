"""Documents packed into sequences of a fixed number of tokens by bin completion.

1. One pass over the texts gives the pieces: a document's ids and an end id,
   cut where longer than a sequence. A piece keeps the number of its task and
   its number among the pieces of that length there. The pieces (without texts)
   are written to the shared folder.
2. Pieces of one length are interchangeable, so only their counts decide: at
   most ``capacity`` numbers, whatever the corpus. ``bin_completion`` turns them
   into runs of equal bins on the driver. A run of the plan holds a length at
   most once, so the plan has less than ``capacity * sqrt(2 * capacity)`` rows.
3. Counts per (task, length), summed up over the tasks, number all pieces of a
   length without bringing them together; a piece's number finds its run, and
   with it its sequence and place, by binary search.

Null texts count as empty: a document of the end id alone. Rows are kept as
they are, repeated ones and null ids too; other columns are ignored. No rows
give no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import bin_completion
from folioscope.llm.bpe_stream import byte_symbols
from folioscope.llm.common import slices, written

#: Entries of a worker's cache of encoded words; emptied when full, longer words are not kept.
CACHE_WORDS, CACHED_CHARS = 400_000, 64


class IdBytes(dict):
    """A stretch of text without white space -> its ids as little-endian unsigned
    32-bit numbers, by the tokenizers library.

    The tokenizer file lower-cases, drops white space and cuts words from
    punctuation, so what is parted by white space is encoded apart, and letters
    apart from the stops that follow them. A word of Latin-1 letters is then one
    word for the library's BPE model, with a symbol for each byte."""

    WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        return ids.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(".,;:!?")
        if not self.WORD.fullmatch(word):
            data = self.encode(chunk)
        elif word != chunk:
            data = self[word.lower()] + self[chunk[len(word):]]
        elif word != (low := word.lower()):
            data = self[low]
        else:
            symbols = word.encode().decode("latin-1").translate(self.symbols)
            data = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = data
        return data

    def of(self, text: str) -> bytes:
        """The ids of a whole text. Added tokens may hold white space and the
        characters U+001C to U+001F, at which ``split`` parts, are none for the
        tokenizer: such texts are encoded in one go."""
        if any(map(text.__contains__, chain(self.marks, "\x1c\x1d\x1e\x1f"))):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def id_bytes(path: str) -> IdBytes:
    return IdBytes(path)


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id",
           text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id_column``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece, with
    ``ids`` if ``keep_ids``; ``_part`` and ``_nth`` number the pieces of a length in a task."""
    rows = df.select(F.col(id_column), F.col(text_column))
    kind = rows.schema[0].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = id_bytes(path)
        part_id = TaskContext.get().partitionId()
        nth: dict[int, int] = defaultdict(int)
        for part in slices(batches, 1):
            owner, out, ids = [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                data = (encoder.of(text) if text else b"") + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    here = data[4 * at:4 * (at + capacity)]
                    length = len(here) // 4
                    owner.append(i)
                    out.append((k, at, length, zlib.crc32(here), part_id, nth[length]))
                    if keep_ids:
                        ids.append(np.frombuffer(here, "<u4").astype(np.int32))
                    nth[length] += 1
            if not out:
                continue
            numbers = np.array(out, np.int64).T
            columns = [part.column(0).take(pa.array(owner)), pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:])]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.record_batch(columns, names=names)

    names = [id_column, "piece", "start", "length", "ids_crc32", "_part", "_nth", *(["ids"] if keep_ids else [])]
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, _part long, _nth long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Columns: length, first number of the run among the pieces of that length,
    pieces of it in a sequence, first sequence, place of the first of them in its
    sequence. Sorted by length and number."""
    rows, taken, sequence = [], defaultdict(int), 0
    for pattern, times in bin_completion.complete(counts, capacity):
        offset = 0
        for length, n in pattern:
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id",
         text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, gapless from 0 in every sequence."""
    cut = written(pieces(df, path, capacity, end_id, id_column, text_column, keep_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    length, first, each, sequence, offset = plan(counts, capacity)
    # numbers of pieces stay below 2**48, so one number orders (length, number)
    key = (length << 48) | first

    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    here = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    base = here.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    numbered = cut.join(base, ["length", "_part"]).withColumn("_key", F.shiftleft("length", 48).bitwiseOR(F.col("_base") + F.col("_nth")))
    wanted = [id_column, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    numbered = numbered.select(*wanted, "_key")

    def place(batches):
        for part in batches:
            number = part.column(part.num_columns - 1).to_numpy()
            i = np.searchsorted(key, number, "right") - 1
            at, slot = np.divmod(number - key[i], each[i])
            yield pa.record_batch([*part.columns[:-1], pa.array(sequence[i] + at), pa.array(offset[i] + slot * length[i])],
                                  names=[*wanted, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("_key").schema)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of every sequence, from ``pack(..., keep_ids=True)``.
    A group is one sequence, so at most ``capacity`` ids."""
    found = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return found.select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))
