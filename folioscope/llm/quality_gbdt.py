"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` of a whole text are counts and ratios of characters, words and
lines. ``fit`` bins each statistic at quantiles of the training rows and grows
complete trees of fixed depth, level by level, from gradient histograms of the
logistic loss. The forest is flattened into arrays (feature, threshold, leaf
value); scoring walks all rows down all trees at once with numpy.

Training rows are a bounded sample (``most_rows``, the rows with the smallest
hash of the id): it fits the driver, where the forest is grown. Scoring is one
pass over all rows without a shuffle.

Defined results: null and empty texts have statistics 0 and are scored like any
other. Rows without a label teach nothing; an id labelled twice counts with its
lower label; without any label every score is 0.5. Ids may repeat or be null.
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import map_slices, words

#: Bound on the labelled rows that a fit reads.
MOST_ROWS = 20_000

FEATURES = ("n_bytes", "n_words", "word_length", "word_length_spread", "upper", "digit", "space", "punctuation",
            "symbol", "exclamation", "bar", "not_ascii", "lines", "words_per_line", "distinct_words", "top_word",
            "repeated_pairs", "distinct_lines", "letter_words", "capital_words", "stops_per_word", "commas_per_word",
            "odd_ends")

_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": [32, *range(9, 14)],
    "punctuation": [ord(c) for c in ".,;:'\"()-?"], "symbol": [ord(c) for c in "#*$%&<>@^~=+_[]{}/\\"],
    "exclamation": [33], "bar": [124], "not_ascii": range(128, 256),
}
_MASKS = np.zeros((256, len(_CLASSES)))
for _i, _codes in enumerate(_CLASSES.values()):
    _MASKS[list(_codes), _i] = 1


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = words(text)
    if not found:
        return [float(len(data))] + [0.0] * (len(FEATURES) - 1)
    n = len(found)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MASKS / len(data)
    lengths = np.fromiter(map(len, found), np.int64, n)
    counts = Counter(found)
    pairs = sum(map(str.__eq__, found, found[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, found))
    return [float(len(data)), float(n), float(lengths.mean()), float(lengths.std()), *shares.tolist(),
            float(len(lines)), n / len(lines) if lines else 0.0, len(counts) / n, max(counts.values()) / n, pairs / n,
            len(set(lines)) / len(lines) if lines else 0.0, letters / n, sum(map(str.istitle, found)) / n,
            data.count(b".") / n, data.count(b",") / n,
            sum(1 for w in found if not w[-1].isalnum() and w[-1] not in ".,;:?") / n]


@dataclass
class Forest:
    """Complete trees of one depth: node k has children 2k+1 and 2k+2."""
    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); a value above it goes right
    value: np.ndarray      # (trees, leaves)
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        raw, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - len(feature)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
        l2: float = 1.0, least_rows: int = 10) -> Forest:
    """Rows ``x`` (n, features) with labels ``y`` (0 or 1)."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y):
        return Forest(feature[:0], threshold[:0], value[:0], 0.0, depth)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # > edge: next bin
    slots = binned + np.arange(m) * bins
    raw = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            at = ((node - first)[:, None] * (m * bins) + slots).ravel()
            sums = [np.bincount(at, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(2)
                    for v in (grad, hess, np.ones(n))]
            (g, h, c), total = sums, [s[:, :, -1:] for s in sums]
            gain = g ** 2 / (h + l2) + (total[0] - g) ** 2 / (total[1] - h + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(c < least_rows) | (total[2] - c < least_rows)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        raw += value[t, leaf]
    return Forest(feature, threshold, value, bias, depth)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "quality", **shape) -> Forest:
    """A forest from the labelled rows of ``docs``; at most ``most_rows`` of them."""
    chosen = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
              .groupBy(F.col(id_column).alias("_id")).agg(F.min(label_column).alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(most_rows))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), "_id")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([part.column(0), pa.array([statistics(t) for t in part.column(1).to_pylist()],
                                                         pa.list_(pa.float64()))], names=["label", "x"])

    found = map_slices(rows.select(F.col("_label").cast("int").alias("label"), "_text"), work,
                       "label int, x array<double>", 1)
    # sorted, so that sums and so the forest do not depend on how tasks ended
    found = sorted((tuple(r["x"]), r["label"]) for r in found.collect())
    x = np.array([r[0] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float), **shape)


def score(df: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5) of every row."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in part.column(1).to_pylist()], float).reshape(part.num_rows, len(FEATURES))
        s = forest.score(x)
        return pa.record_batch([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                               names=[id_column, "score", "predicted"])

    rows = df.select(F.col(id_column), F.col(text_column))
    kind = rows.schema[0].dataType.simpleString()
    return map_slices(rows, work, f"`{id_column}` {kind}, score double, predicted int", 1)


def keep(df: DataFrame, forest: Forest, text_column: str = "text") -> DataFrame:
    """The rows whose text scores at least 0.5, with all their columns."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(part.schema.get_field_index(text_column)).to_pylist()
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return part.filter(pa.array(forest.score(x) >= 0.5))

    return map_slices(df, work, df.schema, df.columns.index(text_column))
