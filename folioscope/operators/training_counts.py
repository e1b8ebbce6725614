"""Training counts that merge: a TF-IDF model kept up to date by batches.

Everything the model needs is a sum over documents: how many documents of a
class hold a term, how often, and how many documents there are. So a batch of
new, changed and deleted documents is counted once, with a sign, and written as
a delta; the state after a batch is the sum of all deltas up to it. Documents
outside a batch are not read again, and building a model reads no text.

A batch lies in ``deltas/batch=<name>``; a file ``done/<version>.<name>`` makes
it count. A batch that a lost driver left without that file is written anew by
the next call under its name; a batch that is done is not done again. There is
one writer at a time. ``compact`` writes the sum up to the last version as
``base/version=<version>``, from which readers go on; every version stays
readable until ``forget`` removes what the last base replaces.

Rows, as everywhere below: ``category``, ``term``, ``docs`` (documents that
hold the term) and ``tf`` (occurrences). Documents themselves are counted under
``tfidf.DOC_SENTINEL``. Partial sums leave every task, so neither a frequent
term nor a class with a third of all documents is collected anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import reliable
from . import tfidf
from .folder import Folder

SCHEMA = "category string, term string, docs long, tf long"


def changes_of_feed(feed: DataFrame, training: Callable[[str], Column]) -> DataFrame:
    """(before, after) of a store's change feed. ``training(side)`` gives the training
    row of ``before`` or ``after``: a struct of ``category`` and ``text``, null for
    a document that is not trained on."""
    return feed.where("op <> 'rejected'").select(*(F.when(F.col(side).isNotNull(), training(side)).alias(side) for side in ("before", "after")))


def signed_counts(changes: DataFrame) -> DataFrame:
    """The counts of ``after`` less those of ``before``, over all rows; zero rows are
    left out. A side is a struct with ``category`` and ``text``; a null side is no
    document, a null text a document without terms. Rows whose sides are equal are
    not tokenised."""
    def side(name: str, sign: int) -> Column:
        row = F.struct(F.col(f"{name}.category").alias("category"), F.col(f"{name}.text").alias("text"), F.lit(sign).alias("sign"))
        return F.when(F.col(name).isNotNull(), row)

    moved = changes.where(~F.struct("before.category", "before.text").eqNullSafe(F.struct("after.category", "after.text"))
                          | (F.col("before").isNull() != F.col("after").isNull()))
    rows = moved.select(F.explode(F.array_compact(F.array(side("after", 1), side("before", -1)))).alias("_s")).select("_s.*")
    # sorted, so that a term's first place in its document is the one after another term
    parts = rows.select("category", "sign", F.sort_array(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\W_]+")).alias("_t"))
    terms = (parts.select("category", "sign", "_t", F.posexplode(F.concat("_t", F.array(F.lit(tfidf.DOC_SENTINEL)))).alias("_i", "term"))
             .where((F.length("term") >= K.MIN_TOKEN_LENGTH) & ~F.col("term").isin(list(K.STOP_WORDS))))
    first = F.coalesce(F.get("_t", F.col("_i") - 1) != F.col("term"), F.lit(True))
    seen = F.col("term") != tfidf.DOC_SENTINEL
    counted = lambda when: F.sum(F.when(when, F.col("sign")).otherwise(F.lit(0)))
    sums = terms.groupBy("category", "term").agg(counted(first).alias("docs"), counted(seen).alias("tf"))
    return sums.where("docs <> 0 OR tf <> 0")


class TrainingCounts(Folder):
    """The counts at a path; version 0 is empty."""

    def apply(self, changes: DataFrame, batch: str) -> int:
        """Counts a batch of (before, after) rows and returns its version. ``before``
        is what an earlier batch counted for the document, as a change feed gives
        it. The order of rows does not matter."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError("the name of a batch has letters, digits, '.', '_' and '-' only")
        done = self._done()
        for version, name in done.items():
            if name == batch:
                return version
        signed_counts(changes).select("category", "term", "docs", "tf").write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        version = max(done, default=0) + 1
        self._mark(f"done/{version:08d}.{batch}", overwrite=False)
        return version

    def version(self) -> int:
        """The last version."""
        return max(self._done(), default=0)

    def counts(self, version: int | None = None) -> DataFrame:
        """The counts after a version (None: the last)."""
        version = self.version() if version is None else version
        done, bases = self._done(), [b for b in self._bases() if b <= version]
        base = max(bases, default=0)
        if version not in {0, *done} or base < self._forgotten():
            raise ValueError(f"there is no version {version}")
        paths = [f"{self.path}/base/version={base}"] if base else []
        paths += [f"{self.path}/deltas/batch={name}" for v, name in done.items() if base < v <= version]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        if len(paths) == 1:
            return rows
        return rows.groupBy("category", "term").agg(F.sum("docs").alias("docs"), F.sum("tf").alias("tf")).where("docs <> 0 OR tf <> 0")

    def below_zero(self) -> DataFrame:
        """Counts that cannot be: a batch took away what none had added."""
        return self.counts().where("docs < 0 OR tf < 0")

    def model(self, version: int | None = None, min_df: int = K.TFIDF_MIN_DF, max_features: int = K.TFIDF_MAX_FEATURES) -> tfidf.TfidfModel:
        """What ``tfidf.train`` gives for the documents of that version."""
        counts = self.counts(version)
        vocab, n_docs = tfidf.vocabulary_of(counts.groupBy("term").agg(F.sum("docs").alias("df")), min_df, max_features)
        tf = counts.where("tf > 0").join(vocab.select("term", "idf"), "term").select("category", "term", "tf", "idf")
        return tfidf.TfidfModel(vocab, reliable(tfidf._normalised(tf, "category", "category"), "tfidf-classes"), n_docs)

    def compact(self) -> int:
        """Writes the sum of all versions as one table; returns the last version."""
        version = self.version()
        if version and version not in self._bases():
            self.counts(version).write.mode("overwrite").parquet(f"{self.path}/base/version={version}")
        return version

    def forget(self) -> None:
        """Removes the deltas and bases that the last base replaces; earlier versions
        can no longer be read, the names of their batches stay known."""
        last = max(self._bases(), default=0)
        if not last:
            return
        self._mark(f"forgotten/{last:08d}")
        for version, name in self._done().items():
            if version <= last:
                self._remove(f"deltas/batch={name}")
        for version in self._bases():
            if version < last:
                self._remove(f"base/version={version}")

    # ------------------------------------------------------------ helpers
    def _done(self) -> dict[int, str]:
        """version → batch, one entry a batch."""
        return {int(number): name for number, name in sorted(x.split(".", 1) for x in self._names("done"))}

    def _bases(self) -> list[int]:
        """Versions with a complete base."""
        return [int(x.removeprefix("version=")) for x in self._names("base") if self._exists(f"base/{x}/_SUCCESS")]

    def _forgotten(self) -> int:
        return max((int(x) for x in self._names("forgotten")), default=0)
