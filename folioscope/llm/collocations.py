"""Phrases that occur more often together than apart, counted in HAT-tries.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, the
pieces into words at spaces and tabs; a phrase lies within a piece. Counting is
per language.

1. Every task counts its sequences of one to ``most_words`` words in a HAT-trie
   per language, over word numbers of its own. When the tries hold ``MOST_KEYS``
   keys or ``MOST_WORDS`` words, whole subtrees leave as sorted runs, one
   compressed row for each prefix partition. The prefix that deals is the whole
   phrase, so that a frequent first word or pair does not meet in one task; a
   partition holds a ``SHARES``-th of what a shuffle partition does. The runs of
   a partition are merged together.
2. Phrases with at least ``least`` occurrences are written; all parts of such a
   phrase are among them. Cuts are joined to the counts of both parts. The
   score is exact: whole numbers of 38 digits.
3. The first ``top`` of a language are found among the first of ``SALTS`` groups.

Null texts count as empty; a null language as ``und``; ids are not used, so
repeated rows count as often as they stand there. Other columns are ignored.
No rows, or no phrase with ``least`` occurrences, give no rows. A task holds
the slice of texts it works on (a very long text whole) and the bounded tries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import slices, written
from folioscope.llm.hat_trie import HatTrie

#: Keys that the tries of a task hold, and words of its dictionary.
MOST_KEYS, MOST_WORDS = 1_000_000, 1 << 19
#: Words that are numbered together, bytes of text that are cut together.
CHUNK_WORDS, SLICE_BYTES = 1 << 17, 2 << 20
#: Prefix partitions for each shuffle partition.
SHARES = 16
#: Groups in which the first phrases of a language are looked for.
SALTS = 64

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Lower case, a line end for all that ends a piece, a space for a tab.
_LETTERS = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordNumbers(dict):
    """Word -> its number in the task, from 1 on; 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return ids[ids >= 0]


class Counting:
    """What a task has counted: a trie and the number of words for each language."""

    def __init__(self, most_words: int, parts: int):
        self.most_words, self.parts = most_words, parts
        self.room = min(MOST_WORDS, (1 << 63 // most_words) - 1)
        self.chunk = max(1, min(CHUNK_WORDS, self.room // 4))
        self.numbers, self.tries, self.totals = WordNumbers(), {}, {}

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Counts the texts; yields the runs that have to leave."""
        words = b"\n".join(texts).translate(_LETTERS).replace(b"\n", b" \n ").split(b" ")
        before: list[bytes] = []  # the last words of the chunk before: sequences may begin there
        for at in range(0, len(words), self.chunk):
            here = words[at:at + self.chunk]
            if len(self.numbers.words) + len(here) + len(before) > self.room:
                yield from self.leave(0)
                self.numbers = WordNumbers()
            ids = self.numbers.of(before + here)
            trie = self.tries.setdefault(lang, HatTrie(self.most_words))
            trie.add(trie.keys_of(ids, len(before)))
            self.totals[lang] = self.totals.get(lang, 0) + int(np.count_nonzero(ids[len(before):]))
            before = [self.numbers.words[i] for i in ids[max(0, len(ids) - self.most_words + 1):].tolist()]
            if sum(map(len, self.tries.values())) > MOST_KEYS:
                yield from self.leave(MOST_KEYS // 2)

    def leave(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Runs of whole subtrees, until each trie holds at most its share of ``keep``
        keys: a row for each prefix partition, its phrases by language."""
        names = pa.array(self.numbers.words, pa.binary())
        hashes = np.fromiter(map(zlib.crc32, self.numbers.words), np.uint64, len(self.numbers.words))
        hashes[0] = 0
        langs, runs = list(self.tries), []
        for i, lang in enumerate(langs):
            trie = self.tries[lang]
            for keys, n in trie.spill(keep // len(langs)):
                runs.append((keys, n, np.full(len(keys), i, np.int32), prefix_partition(hashes, keys, trie, self.parts)))
        if runs:
            keys, n, lang, part = (np.concatenate(x) for x in zip(*runs))
            order = np.lexsort((lang, part))
            keys, n, lang, part = keys[order], n[order], lang[order], part[order]
            texts = pa.concat_arrays([phrases(names, keys[i:i + 200_000], trie) for i in range(0, len(keys), 200_000)])
            yield rows_of_runs(langs, part, lang, texts, n)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.leave(0)
        if self.totals:
            k = len(self.totals)
            yield rows_of_runs(list(self.totals), np.zeros(k, np.int32), np.arange(k), pa.array([b""] * k, pa.binary()), np.array(list(self.totals.values())))


def prefix_partition(hashes: np.ndarray, keys: np.ndarray, trie: HatTrie, parts: int) -> np.ndarray:
    """The partition of each key, from the words alone: the same in every task."""
    mask, mixed = (1 << trie.bits) - 1, np.zeros(len(keys), np.uint64)
    for m in range(trie.words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[keys >> trie.shift(m) & mask]
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def rows_of_runs(langs: list[str], part: np.ndarray, lang: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    """A row for each partition of phrases sorted by partition and language. Its run
    is compressed: counts, lengths, texts, after the number of their bytes."""
    _, offsets, data = phrase.buffers()
    at = np.frombuffer(offsets, np.int32, len(phrase) + 1)
    counts, lengths, data = f.astype("<i8"), np.diff(at).astype("<i4"), data or pa.py_buffer(b"")
    cut = np.flatnonzero(np.diff(part) | np.diff(lang)) + 1
    starts, ends = np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(part)]]).tolist()
    rows: dict[int, tuple[list, list, list]] = {}
    for start, end in zip(starts, ends):
        row = rows.setdefault(int(part[start]), ([], [], [start, end]))
        row[0].append(langs[lang[start]])
        row[1].append(end - start)
        row[2][1] = end
    runs = []
    for _, _, (start, end) in rows.values():
        raw = b"".join((counts[start:end].tobytes(), lengths[start:end].tobytes(), data.slice(int(at[start]), int(at[end] - at[start]))))
        runs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
    return pa.record_batch([pa.array(list(rows), pa.int32()), pa.array([r[0] for r in rows.values()], pa.list_(pa.string())),
                            pa.array([r[1] for r in rows.values()], pa.list_(pa.int64())), pa.array(runs, pa.binary())],
                           names=["part", "lang", "size", "run"])


def unpacked(langs: list[str], sizes: list[int], run: bytes) -> Iterator[tuple[str, pa.Array, pa.Array]]:
    """(language, phrases, counts) of a row."""
    size, raw = sum(sizes), pa.decompress(run[8:], int.from_bytes(run[:8], "little"), codec="zstd")
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i4", size, 8 * size))]).astype(np.int32)
    phrase = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends), raw.slice(12 * size)])
    f, at = pa.array(np.frombuffer(raw, "<i8", size)), 0
    for lang, n in zip(langs, sizes):
        yield lang, phrase.slice(at, n), f.slice(at, n)
        at += n


def merged(runs: pa.Table, least: int) -> pa.Table:
    """The phrases of a prefix partition with at least ``least`` occurrences, and the empty ones."""
    found: dict[str, tuple[list, list]] = {}
    for langs, sizes, run in zip(runs["lang"].to_pylist(), runs["size"].to_pylist(), runs["run"].to_pylist()):
        for lang, phrase, f in unpacked(langs, sizes, run):
            own = found.setdefault(lang, ([], []))
            own[0].append(phrase)
            own[1].append(f)
    out = []
    for lang, (phrase, f) in found.items():
        sums = pa.table({"phrase": pa.chunked_array(phrase), "f": pa.chunked_array(f)}).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
        sums = sums.filter(pc.or_(pc.greater_equal(sums["f_sum"], least), pc.equal(pc.binary_length(sums["phrase"]), 0)))
        out.append(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(sums)), "phrase": sums["phrase"].cast(pa.string()), "f": sums["f_sum"]}))
    return pa.concat_tables(out)


def phrases(names: pa.Array, keys: np.ndarray, trie: HatTrie) -> pa.Array:
    """The texts of keys, words joined by one space."""
    mask, space = (1 << trie.bits) - 1, pa.scalar(b" ", pa.binary())
    out = names.take(pa.array(keys >> trie.shift(0)))
    for m in range(1, trie.words):
        word = keys >> trie.shift(m) & mask
        more = word > 0
        if not more.any():
            break
        joined = pc.binary_join_element_wise(out.filter(pa.array(more)), names.take(pa.array(word[more])), space)
        out = pc.replace_with_mask(out, pa.array(more), joined)
    return out


def counts(df: DataFrame, most_words: int = 3, least: int = 1, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang``, ``phrase``, ``f`` of all phrases of at most ``most_words`` words with
    at least ``least`` occurrences; the empty phrase counts all words of a language."""
    parts = SHARES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        found = Counting(most_words, parts)
        for part in slices(batches, 1, SLICE_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                yield from found.add(lang, texts)
        yield from found.end()

    rows = df.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    runs = rows.mapInArrow(run, "part int, lang array<string>, size array<long>, run binary")
    return runs.groupBy("part").applyInArrow(lambda table: merged(table, least), "lang string, phrase string, f long")


def mine(df: DataFrame, most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000,
         text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of the
    parts at its lowest-scoring cut, the first of equal ones), ``n`` (words of the
    language), ``score`` (floor of a million times a*a / (l*r)) of the ``top``
    phrases of two to ``most_words`` words of every language.

    A phrase inside a longer candidate that has at least ``share`` percent of
    its occurrences is left out, whether the longer one stays or not."""
    kept = written(counts(df, most_words, least, text_column, lang_column), "phrases")
    part = kept.where("phrase <> ''")
    candidates = part.withColumn("_w", F.split("phrase", " ")).withColumn("_m", F.size("_w")).where("_m > 1").withColumnRenamed("f", "a")

    joined = lambda start, length: F.array_join(F.slice("_w", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("_first"), joined(F.col("k") + 1, F.col("_m") - F.col("k")).alias("_rest"))
    first = part.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rest = part.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    cuts = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).select(
        "lang", "phrase", "a", "k", "l", "r",
        F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide["a"] * wide["a"], wide["l"] * wide["r"]).alias("score"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_s"))

    starts = F.sequence(F.lit(1), F.col("_m") - F.col("_size") + 1)
    inner = (candidates.where("_m > 2").withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("_m") - 1)))
             .withColumn("_at", F.explode(starts)).select("lang", joined(F.col("_at"), F.col("_size")).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("_longer")))
    alone = scored.join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))

    rows = alone.select("lang", "phrase", "a", "_s.l", "_s.r", "_s.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = kept.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
