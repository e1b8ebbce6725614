"""Benchmark decontamination: BM25 over an inverted index of the test items,
searched with block-max bounds, then a check of question and answer.

Every document is read as overlapping passages, each long enough that a test
item lies whole in one of them. A passage is a query against the items: an
item's score is the BM25 sum over its words that the passage has, divided by
the item's own score, so 1 means that every word of the item is there and one
threshold fits all items.

Items lie in blocks; postings keep each word's largest share per block. As in
WAND with block maxima, words of many items are not looked up at first: their
shares, summed per item, are known before any query (``rest``). A block is
skipped if the rarer words' block maxima plus the block's largest ``rest`` stay
below the threshold; an item of a block that is left is skipped if its own
rarer words plus its ``rest`` do. Only what remains is scored in full. Nothing
above the threshold is lost.

A retrieved item is a leak if some window of the passage reaches the threshold
and holds, in order, at least ``least_overlap`` of the words of its question and
as much of its answer: the answer is the item's last sentence, the question what
comes before it. Windows are sized by the item alone (``window``), so what an
item finds does not depend on the other items of its group. An item without a
question or without an answer has to stand there whole, word after word; one of
a single word is no passage and is found only in a text that is that word.

The items are the stated query set: they are read once on the driver, in
groups of ``GROUP_WORDS`` words, each broadcast for one pass over the
documents. Word statistics are those of all items.

Defined results: null and empty texts, and items without a word, match
nothing. Items with equal text are all reported. Repeated ids give one row per
id and item. An item of one sentence has its first half as question. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import map_slices

#: Words of the items that are broadcast at a time.
GROUP_WORDS = 2_000_000
BLOCK_ITEMS = 16
K1, B = 1.2, 0.75

_OUTSIDE = re.compile(r"^[\W_]+|[\W_]+$")


def term(word: str) -> str:
    """A word in lower case without what surrounds its letters and digits; may be empty."""
    return _OUTSIDE.sub("", word).lower()


def terms(text: str | None) -> list[str]:
    return [t for w in (text or "").split() if (t := term(w))]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    sentences = re.split(r"(?<=[.?!])\s+", (text or "").strip())
    if len(sentences) > 1:
        return terms(" ".join(sentences[:-1])), terms(sentences[-1])
    found = terms(text)
    return found[:len(found) // 2], found[len(found) // 2:]


def window(n: int) -> int:
    """Words among which an item of ``n`` words is looked for: room for a quarter more, at least for four."""
    return n + max(4, n // 4)


def positions(part: list[int]) -> dict[int, int]:
    """Bits of the places where each word occurs."""
    where: dict[int, int] = {}
    for i, x in enumerate(part):
        where[x] = where.get(x, 0) | 1 << i
    return where


def common(where: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence of a part of ``n`` words, given
    by its ``positions``, and ``text`` (bit-parallel)."""
    every = (1 << n) - 1
    state = every
    for x in text:
        hit = state & where.get(x, 0)
        state = (state + hit | state - hit) & every
    return n - state.bit_count()


def in_order(part: list[int], text: list[int]) -> float:
    """Share of ``part`` that is a common subsequence with ``text``."""
    return common(positions(part), len(part), text) / len(part) if part else 1.0


class Index:
    """The inverted index of a group of items, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], frequency: Counter, n_items: int, mean_length: float, threshold: float):
        self.threshold = threshold
        split = [(*question_and_answer(t), i) for i, t in items]
        split = [x for x in split if x[0] or x[1]]
        split.sort(key=lambda x: (len(x[0]) + len(x[1]), x[2]))  # blocks of items alike in length
        self.items = [i for _, _, i in split]
        vocabulary = sorted({w for q, a, _ in split for w in (*q, *a)})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.parts = [([self.number[w] for w in q], [self.number[w] for w in a]) for q, a, _ in split]
        self.longest = max((len(q) + len(a) for q, a in self.parts), default=0)
        df = np.array([frequency[w] for w in vocabulary], float)
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        rows = []
        for j, (q, a) in enumerate(self.parts):
            length = K1 * (1 - B + B * (len(q) + len(a)) / mean_length)
            share = {w: idf[w] * n * (K1 + 1) / (n + length) for w, n in Counter(q + a).items()}
            whole = sum(share.values())
            rows += [(w, j, x / whole) for w, x in share.items()]
        rows.sort()
        n, m = len(vocabulary), len(self.items)
        self.post_item = np.array([r[1] for r in rows], np.int64)
        self.post_share = np.array([r[2] for r in rows], float)
        self.post_at = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(n + 1))
        held = np.diff(self.post_at)
        # the most common words, as long as no item gets half the threshold from them
        self.common = np.zeros(n, bool)
        self.rest = np.zeros(m)
        for w in np.argsort(-held, kind="stable").tolist():
            a, b = self.post_at[w], self.post_at[w + 1]
            if (self.rest[self.post_item[a:b]] + self.post_share[a:b]).max() > threshold / 2:
                break
            self.rest[self.post_item[a:b]] += self.post_share[a:b]
            self.common[w] = True
        self.n_blocks = max(1, -(-m // BLOCK_ITEMS))
        self.block_rest = np.maximum.reduceat(self.rest, np.arange(0, m, BLOCK_ITEMS)) if m else np.zeros(1)
        key = np.repeat(np.arange(n), held) * self.n_blocks + self.post_item // BLOCK_ITEMS
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_of = key[first] % self.n_blocks
        self.block_most = np.maximum.reduceat(self.post_share, first) if len(first) else np.zeros(0)
        self.block_at = np.searchsorted(key[first] // self.n_blocks, np.arange(n + 1))

    @staticmethod
    def _lists(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words' list entries, and which word each belongs to."""
        sizes = at[words + 1] - at[words]
        own = np.repeat(np.arange(len(words)), sizes)
        return np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[words][own], own

    def score(self, item: int, words: set[int]) -> float:
        """The score of an item by some of its words."""
        total = 0.0
        for w in sorted(words):
            a, b = self.post_at[w], self.post_at[w + 1]
            total += self.post_share[a + np.searchsorted(self.post_item[a:b], item)]
        return float(total)

    def search(self, passages: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all that reach the threshold, from the
        distinct (passage, word) pairs, sorted."""
        slack = self.threshold - 1e-9
        rare = ~self.common[words]
        p, w = passages[rare], words[rare]
        n = int(passages.max(initial=-1)) + 1
        # block bounds
        entry, own = self._lists(w, self.block_at)
        key, inverse = np.unique(p[own] * self.n_blocks + self.block_of[entry], return_inverse=True)
        bound = np.bincount(inverse, self.block_most[entry], len(key)) + self.block_rest[key % self.n_blocks]
        alive = np.zeros(n, bool)
        left = key[bound >= slack]
        alive[left // self.n_blocks] = True
        # bounds of single items within the blocks that are left
        keep = alive[p]
        p, w = p[keep], w[keep]
        entry, own = self._lists(w, self.post_at)
        item = self.post_item[entry]
        inside = np.isin(p[own] * self.n_blocks + item // BLOCK_ITEMS, left)
        m = len(self.items)
        key, inverse = np.unique(p[own][inside] * m + item[inside], return_inverse=True)
        partial = np.bincount(inverse, self.post_share[entry][inside], len(key))
        fits = partial + self.rest[key % m] >= slack
        key, partial = key[fits], partial[fits]
        if not len(key):
            return key, key, partial
        # the common words of those
        asked = np.zeros(n, bool)
        asked[key // m] = True
        common = ~rare & asked[passages]
        p, w = passages[common], words[common]
        entry, own = self._lists(w, self.post_at)
        pair = p[own] * m + self.post_item[entry]
        place = np.minimum(np.searchsorted(key, pair), len(key) - 1)
        hit = key[place] == pair
        score = partial + np.bincount(place[hit], self.post_share[entry][hit], len(key))
        good = score >= slack
        return key[good] // m, key[good] % m, score[good]


def numbered(texts: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Item word numbers (-1: in no item) of all words that are terms, and
    where each text begins. Spaces are those of str.split(), as in the items."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    known = np.array([index.number.get(t, -1) if (t := term(w)) else -2 for w in coded.dictionary.to_pylist()] or [-2], np.int64)
    numbers = known[coded.indices.to_numpy()]
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    real = numbers > -2
    return numbers[real], np.concatenate([[0], np.cumsum(real)])[at]


def held(index: Index, item: int, text: np.ndarray, least_overlap: float, alone: bool) -> tuple | None:
    """(words found, score, question overlap, answer overlap) of the best window
    of a text in which an item is a leak; ``alone``: the text is a whole document."""
    q, a = index.parts[item]
    whole = np.array(q + a, np.int64)
    n = len(whole)
    if not q or not a:
        if n > len(text) or n == 1 and not (alone and len(text) == 1):
            return None
        at = np.arange(len(text) - n + 1)
        for i in range(n):
            at = at[text[at + i] == whole[i]]
        return (n, 1.0, 1.0, 1.0) if len(at) else None
    place = np.flatnonzero(np.isin(text, whole))
    found = text[place]
    last = max(0, len(text) - window(n))
    # a window that begins with another word holds no more than the next one
    starts = np.append(place[place < last], last)
    low, high = np.searchsorted(place, starts), np.searchsorted(place, starts + window(n))
    parts = [(positions(p), len(p), math.ceil(least_overlap * len(p) - 1e-9)) for p in (q, a)]
    for p, (_, _, need) in zip((q, a), parts):
        before = np.append(0, np.cumsum(np.isin(found, p)))
        enough = before[high] - before[low] >= need
        starts, low, high = starts[enough], low[enough], high[enough]
    words = found.tolist()
    best, following = None, 0
    for start, i, j in zip(starts.tolist(), low.tolist(), high.tolist()):
        if start < following:
            continue
        # a step to the right adds one word at most: what is missing says how far to go
        counts = []
        for where, size, need in parts:
            counts.append(common(where, size, words[i:j]))
            if counts[-1] < need:
                following = start + need - counts[-1]
                break
        else:
            total = sum(counts)
            if best and total < best[0]:
                following = start + (best[0] - total + 1) // 2
                continue
            score = index.score(item, set(words[i:j]))
            if score >= index.threshold - 1e-9:
                best = max(best or (0,), (total, score, counts[0] / len(q), counts[1] / len(a)))
                if total == n:
                    break
    return best


def find(index: Index, ids: list, texts: pa.Array, least_overlap: float) -> list[tuple]:
    numbers, at = numbered(texts, index)
    # half a passage holds the longest item's window, so every window lies in some passage
    half = max(32, window(index.longest))
    sizes = np.diff(at)
    count = np.maximum(1, -(-sizes // half) - 1)  # passages of two halves, each half in two of them
    own = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][own] + nth * half
    end = np.where(nth == count[own] - 1, at[1:][own], begin + 2 * half)
    spread = np.repeat(np.arange(len(own)), end - begin)
    place = np.arange(len(spread)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[spread]
    word = numbers[place]
    some = word >= 0
    key = np.unique(spread[some] * len(index.number) + word[some]) if len(index.number) else np.zeros(0, np.int64)
    passage, item, _ = index.search(key // max(1, len(index.number)), key % max(1, len(index.number)))
    best: dict[tuple, tuple] = {}
    for p, j in zip(passage.tolist(), item.tolist()):
        hit = held(index, j, numbers[begin[p]:end[p]], least_overlap, count[own[p]] == 1)
        if hit:
            k = ids[own[p]], index.items[j]
            best[k] = max(best.get(k, (0,)), hit)
    return [(*k, *v[1:]) for k, v in best.items()]


def read_items(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[int, str]]:
    for row in benchmark.select(id_column, text_column).toLocalIterator():
        yield row[0], row[1]


def groups(benchmark: DataFrame, threshold: float, id_column: str, text_column: str) -> Iterator[Index]:
    frequency, n, length = Counter(), 0, 0
    for _, text in read_items(benchmark, id_column, text_column):
        found = terms(text)
        if found:
            frequency.update(set(found))
            n, length = n + 1, length + len(found)
    held, size = [], 0
    for item in read_items(benchmark, id_column, text_column):
        held.append(item)
        size += len(terms(item[1]))
        if size >= GROUP_WORDS:
            yield Index(held, frequency, n, length / n, threshold)
            held, size = [], 0
    if held:
        yield Index(held, frequency, n, length / max(n, 1) or 1.0, threshold)


LEAK_SCHEMA = "{id} {kind}, item_id bigint, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least_overlap: float = 0.8, id_column: str = "doc_id",
          text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_column``, ``item_id``, best ``score``, ``question_overlap`` and ``answer_overlap`` of
    every document and test item that it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = LEAK_SCHEMA.format(id="id", kind=kind)

    def one(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)  # at most GROUP_WORDS words

        def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
            found = find(shared.value, part.column(0).to_pylist(), part.column(1), least_overlap)
            if not found:
                return None
            kinds = (part.schema[0].type, pa.int64(), pa.float64(), pa.float64(), pa.float64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), kinds)],
                                   names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        return map_slices(rows, work, schema, 1)

    found = [one(index) for index in groups(benchmark, threshold, item_column, item_text)]
    every = reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
    best = every.groupBy("id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))
    return best.withColumnRenamed("id", id_column)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least_overlap: float = 0.8, text_column: str = "text",
          item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all columns, whose text holds no test item. No shuffle."""
    at = docs.columns.index(text_column)

    def without(rows: DataFrame, index: Index) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            hit = {row[0] for row in find(shared.value, list(range(part.num_rows)), part.column(at), least_overlap)}
            return part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))

        return map_slices(rows, work, docs.schema, at)

    return reduce(without, groups(benchmark, threshold, item_column, item_text), docs)
