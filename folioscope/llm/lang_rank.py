"""Language identification by rank-order n-gram profiles.

A language's profile ranks its ``profile_size`` most frequent letter n-grams
(one to three letters, with word edges). A document's own most frequent n-grams
are ranked in the same way; its distance to a language is the sum of how far
each n-gram's rank is out of place there, with the full profile size for an
n-gram the profile lacks. The nearest language wins.

Learning is one pass over all labelled texts: each task adds up its counts per
language, Spark sums them and keeps the top ranks. What reaches the driver is
``profile_size`` rows per language. Prediction is one pass without a shuffle.

Defined results: a text without a letter (null and empty too) is ``und`` with
score 0, and so is every text if nothing could be learned. Ties of counts go to
the shorter, then alphabetically first n-gram; ties of distance to the
alphabetically first language. Rows with a null language teach nothing. Other
columns are ignored; repeated rows are judged and counted as often as they
occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import map_slices, slices

PROFILE_SIZE = 300
#: n-grams that a task holds before it passes its counts on.
HELD_GRAMS = 500_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as one array of code points, each run of other
    characters turned into one 0; the sorted alphabet of the array; and where
    each text begins (it begins and ends with a 0)."""
    parts = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
    codes = np.frombuffer("".join(f" {t} " for t in parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes[~letters()[codes]] = 0
    edge = np.zeros(len(codes), bool)
    edge[starts[:-1]] = True
    keep = (codes != 0) | edge
    keep[1:] |= codes[:-1] != 0
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    codes = codes[keep]
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    seen[0] = True
    return codes, np.flatnonzero(seen), at


def grams(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """For each position the numbers of the 1-, 2- and 3-gram that begin there
    (-1: none), in base ``len(alphabet)`` so that they sort by length, then
    text; shape (positions, 3). A 1-gram is a letter; longer ones have edges
    (0) only at an end, and a letter."""
    n = len(alphabet)
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(n)
    a = rank[codes]
    b, c = np.append(a[1:], 0), np.append(a[2:], [0, 0])[:len(a)]
    out = np.full((len(a), 3), -1, np.int64)
    last = np.arange(len(a))
    out[:, 0] = np.where(a > 0, a, -1)
    out[:, 1] = np.where(((a > 0) | (b > 0)) & (last < len(a) - 1), n + a * n + b, -1)
    out[:, 2] = np.where((b > 0) & (last < len(a) - 2), n + n * n + (a * n + b) * n + c, -1)
    return out


def canonical(numbers: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Gram numbers of one alphabet as rows (length, up to three code points)."""
    n = len(alphabet)
    points = alphabet.astype(np.int64)
    one, two = numbers < n, (numbers >= n) & (numbers < n + n * n)
    x = np.where(one, numbers, np.where(two, numbers - n, numbers - n - n * n))
    three = ~one & ~two
    first = np.where(one, x, np.where(two, x // n, x // (n * n)))
    second = np.where(two, x % n, np.where(three, x // n % n, 0))
    third = np.where(three, x % n, 0)
    length = np.where(one, 1, np.where(two, 2, 3))
    return np.stack([length, points[first], points[second], points[third]], 1)


def count_grams(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = numbers.ravel()
    flat = np.sort(flat[flat >= 0])
    if not len(flat):
        return flat, flat
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[at], np.diff(np.append(at, len(flat)))


def learn(df: DataFrame, profile_size: int = PROFILE_SIZE, text_column: str = "text",
          lang_column: str = "lang") -> dict[str, list[str]]:
    """The profile of each language: its n-grams, most frequent first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            made = pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                    pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"])
            held.clear()
            return made

        for part in slices(batches, 1):
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes, alphabet, _ = coded([t for t, x in zip(texts, langs) if x == lang])
                numbers, counts = count_grams(grams(codes, alphabet))
                for row, n in zip(canonical(numbers, alphabet).tolist(), counts.tolist()):
                    key = lang, "".join(chr(c) if c else "_" for c in row[1:1 + row[0]])
                    held[key] = held.get(key, 0) + n
            if len(held) > HELD_GRAMS:
                yield out()
        if held:
            yield out()

    rows = df.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    counts = (rows.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
              .mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    profiles: dict[str, list[str]] = {}
    for row in top.orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """Distances of documents to all profiles."""

    def __init__(self, profiles: dict[str, list[str]], profile_size: int):
        self.langs, self.size = sorted(profiles), profile_size
        self.grams = sorted({g for p in profiles.values() for g in p})
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # last row: in no profile
        at = {g: i for i, g in enumerate(self.grams)}
        for j, lang in enumerate(self.langs):
            for r, g in enumerate(profiles[lang]):
                self.ranks[at[g], j] = r
        self.points = [[0 if c == "_" else ord(c) for c in g] for g in self.grams]

    def local(self, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The profiles' grams as sorted numbers of an alphabet, with their rows."""
        rank, n, found = {int(c): i for i, c in enumerate(alphabet)}, len(alphabet), []
        for i, points in enumerate(self.points):
            x = [rank.get(c) for c in points]
            if None in x:
                continue
            number = x[0] if len(x) == 1 else n + x[0] * n + x[1] if len(x) == 2 else n + n * n + (x[0] * n + x[1]) * n + x[2]
            found.append((number, i))
        found.sort()
        return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes, alphabet, at = coded(texts)
        numbers = grams(codes, alphabet)
        if len(alphabet) ** 3 < 2 ** 30:
            numbers = numbers.astype(np.int32)  # sorts faster
        known, rows = self.local(alphabet)
        preds, scores = [], []
        place = np.arange(self.size)
        for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
            # the last 0 belongs to this text: grams must not reach the next
            mine = numbers[start:end]
            mine = np.concatenate([mine[:, 0], mine[:-1, 1], mine[:-2, 2]])
            found, counts = count_grams(mine)
            if not len(found) or not self.langs:
                preds.append("und")
                scores.append(0.0)
                continue
            top = found[np.argsort(-counts, kind="stable")[:self.size]]
            if len(known):
                i = np.minimum(np.searchsorted(known, top), len(known) - 1)
                ranks = self.ranks[np.where(known[i] == top, rows[i], len(self.grams))]
            else:
                ranks = np.full((len(top), len(self.langs)), -1)
            apart = np.where(ranks >= 0, np.abs(ranks - place[:len(top), None]), self.size).sum(0)
            best = int(np.argmin(apart))
            preds.append(self.langs[best])
            scores.append(1.0 - float(apart[best]) / (self.size * len(top)))
        return preds, scores


def predict(df: DataFrame, profiles: dict[str, list[str]], profile_size: int = PROFILE_SIZE,
            id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``lang_pred`` and ``score`` (0 to 1, 1: every rank in place)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Ranker(profiles, profile_size))  # profile_size grams per language

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        preds, scores = shared.value.judge(part.column(1).to_pylist())
        return pa.record_batch([part.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                               names=[id_column, "lang_pred", "score"])

    rows = df.select(F.col(id_column), F.col(text_column))
    kind = rows.schema[0].dataType.simpleString()
    return map_slices(rows, work, f"`{id_column}` {kind}, lang_pred string, score double", 1)
