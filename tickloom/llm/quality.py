"""Quality score: regularised quadratic discriminant over transformed statistics of a text.

Shares go through an arc sine of their root and counts through a logarithm, so that each class is closer to a normal distribution. Each
class has a mean and a covariance, shrunk towards the pooled one and its diagonal. The score is the posterior of label 1: a difference of two
Mahalanobis log densities, from Cholesky factors made once per model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import written
from tickloom.llm.text import IS_SPACE, column, slices, words

STATISTICS = ("words", "word_length", "word_length_spread", "upper", "digits", "symbols", "stops", "symbol_words", "repeated_words", "upper_words",
              "distinct_words", "top_word", "line_length", "repeated_lines", "wide", "long_words", "pipes", "entropy")
POOLED, DIAGONAL = 0.1, 0.05  # shares of the pooled covariance and of its diagonal in a class covariance
FLOOR = 1e-4  # least variance added to every statistic
_UPPER, _DIGIT, _SYMBOL, _STOP = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 1
_STOP[list(b".,;:?'\"()-")] = 1


def root(x: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(x, 0, 1)))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros."""
    made = []
    for _, _, data, offsets in slices(texts):
        w, docs = words(data, offsets), len(offsets) - 1
        sums = lambda flag: np.concatenate([[0], np.cumsum(flag[data])])
        of = lambda total: np.diff(total[offsets]).astype(float)
        per = lambda total: total[w.end] - total[w.start]
        upper, digit, symbol, stop = map(sums, (_UPPER, _DIGIT, _SYMBOL, _STOP))
        size = np.maximum(np.diff(offsets) - of(sums(IS_SPACE.astype(np.int64))), 1)
        length = (w.end - w.start).astype(float)
        n = np.diff(w.first).astype(float)
        by_doc = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[w.first])
        many = np.maximum(n, 1)
        mean = by_doc(length) / many
        same = np.zeros(len(w.hash))
        same[1:] = w.hash[1:] == w.hash[:-1]
        breaks = np.flatnonzero(data == 10)
        out = np.zeros((docs, len(STATISTICS)))
        out[:, 0] = np.log1p(n)
        out[:, 1] = np.log1p(mean)
        out[:, 2] = np.log1p(np.sqrt(np.maximum(by_doc(length**2) / many - mean**2, 0)))
        out[:, 3:7] = np.stack([root(of(x) / size) for x in (upper, digit, symbol, stop)], 1)
        out[:, 7] = root(by_doc((per(symbol) > 0).astype(float)) / many)
        out[:, 8] = root(by_doc(same) / many)
        out[:, 9] = root(by_doc((per(upper) > 1).astype(float)) / many)
        out[:, 14] = root(of(sums((np.arange(256) > 127).astype(np.int64))) / size)
        out[:, 15] = root(by_doc((length >= 16).astype(float)) / many)
        out[:, 16] = root(of(sums((np.arange(256) == 124).astype(np.int64))) / size)
        at = np.searchsorted(breaks, offsets)
        for d in range(docs):
            if not n[d]:
                out[d] = 0
                continue
            h, low, high = w.hash[w.first[d]:w.first[d + 1]], offsets[d], offsets[d + 1]
            counts = np.unique(h, return_counts=True)[1]
            out[d, 10] = np.log1p(len(counts)) / np.log1p(n[d])
            out[d, 11] = root(counts.max() / n[d])
            cuts = np.concatenate([[low], breaks[at[d]:at[d + 1]] + 1, [high]])
            out[d, 12] = np.log1p((high - low) / (len(cuts) - 1))
            if len(cuts) > 2:  # a line is told by the words in it
                lines = np.searchsorted(w.start, cuts)
                total = np.concatenate([[np.uint64(0)], np.cumsum(w.hash[lines[0]:lines[-1]] * (np.arange(lines[-1] - lines[0], dtype=np.uint64) + np.uint64(1)), dtype=np.uint64)])
                plain = np.concatenate([[np.uint64(0)], np.cumsum(w.hash[lines[0]:lines[-1]], dtype=np.uint64)])
                rel = lines - lines[0]
                told = (total[rel[1:]] - total[rel[:-1]]) - (plain[rel[1:]] - plain[rel[:-1]]) * rel[:-1].astype(np.uint64)
                told = told[np.diff(lines) > 0]
                out[d, 13] = root(1 - len(np.unique(told)) / max(len(told), 1))
            seen = np.bincount(data[low:high], minlength=256)
            p = seen[seen > 0] / (high - low)
            out[d, 17] = -(p * np.log(p)).sum()
        made.append(out)
    return np.concatenate(made) if made else np.zeros((0, len(STATISTICS)))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


class Discriminant:
    """Two normal distributions with shrunk covariances, from class counts, sums and sums of outer products."""

    def __init__(self, count: np.ndarray, total: np.ndarray, outer: np.ndarray):
        d = total.shape[1]
        self.prior = np.log((count + 0.5) / (count.sum() + 1))
        self.mean = total / np.maximum(count, 1)[:, None]
        scatter = outer - count[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(0) / max(count.sum() - 2, 1)
        self.informed = bool((count > 0).all())
        self.factor, self.log_det = [], []
        for c in (0, 1):
            own = scatter[c] / count[c] if count[c] > d else pooled
            cov = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.factor.append(np.linalg.inv(factor))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of class 1."""
        if not self.informed:  # nothing to tell the classes by
            return np.full(len(x), 1 / (1 + np.exp(self.prior[0] - self.prior[1])))
        log = [self.prior[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T)**2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", training: str = "true", threshold: float = 0.3,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: the posterior of label 1, and 1 where it is at least ``threshold``.

    Learns from every row of ``labels`` (id, ``label`` 0/1) for which the SQL condition ``training`` holds, by sums that Spark adds up; other
    columns are never looked at. A null or empty text has all statistics 0 and is scored like any other. Null ids or labels teach nothing;
    without labelled texts of both classes every score is the smoothed share of label 1. Repeated rows are scored each, repeated labels count.
    """
    d = len(STATISTICS)
    known = labels.where(training).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(column(batch, "text"))
            yield pa.RecordBatch.from_pydict({"id": column(batch, "id"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))})

    kind = docs.schema[id_column].dataType.simpleString()
    table = written(plain.mapInArrow(measured, f"id {kind}, x array<double>"), "statistics")  # texts are read once; only these rows are joined

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = matrix(batch), np.array(column(batch, "label"), np.int64)
            for c in (0, 1):
                z = x[y == c]
                sums[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(sums.size)), "x": pa.array(sums.ravel())})

    rows = table.join(known, "id").select("label", "x").mapInArrow(summed, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(2 * (1 + d + d * d))
    for r in rows:
        sums[r["at"]] = r["x"]
    sums = sums.reshape(2, -1)
    shared = docs.sparkSession.sparkContext.broadcast(Discriminant(sums[:, 0], sums[:, 1:1 + d], sums[:, 1 + d:].reshape(2, d, d)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": column(batch, "id"), "score": pa.array(shared.value.score(matrix(batch)))})

    got = table.mapInArrow(scored, f"id {kind}, score double")
    return got.select(F.col("id").alias(id_column), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
