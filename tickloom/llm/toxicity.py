"""Toxicity score: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased words (a word keeps one blank on each side), hashed into ``1 << BITS`` bins.
Each bin's value is the log ratio of its smoothed document rates in the two classes; regularised logistic regression weighs the bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import IS_SPACE, LOWER, column, mix, powers, slices

GRAMS = (4, 5, 6)
BITS = 19
SAMPLE_ROWS = 2_000  # labelled rows of each class that a fit uses at most
SMOOTH, RIDGE, STEPS, STEP = 0.5, 1.0, 200, 0.02
SIGNIFICANT = 4.0  # standard errors that a bin's rates in the two classes must be apart
_stamp: list[np.ndarray] = []


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct feature bins of each row of a slice."""
    if not _stamp:
        _stamp.append(np.zeros(1 << BITS, np.int32))
    stamp, sizes = _stamp[0], np.diff(offsets)
    # One blank before every row, and blanks for white space, of which runs become one.
    spaced = np.full(len(data) + len(sizes) + 1, 0x20, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = LOWER[data]
    blank = IS_SPACE[spaced]
    own = offsets + np.arange(len(offsets))  # the blanks around rows are always kept, any others of their runs never
    begins = blank & ~np.concatenate([[False], blank[:-1]])
    run = np.cumsum(begins)
    outer, between = np.zeros(run[-1] + 1, bool), np.zeros(len(blank), bool)
    outer[run[own]] = between[own] = True
    keep = np.flatnonzero(~blank | between | (begins & ~outer[run]))
    first = np.searchsorted(keep, own)
    text = np.where(blank[keep], np.uint8(0x20), spaced[keep])
    up, down = powers(len(text) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    starts = np.flatnonzero((text & 0xC0) != 0x80)  # of characters
    ends = np.append(starts, len(text))
    made = []
    for n in GRAMS:
        end = ends[n:]
        at = starts[:len(end)]
        made.append((mix((sums[end] - sums[at]) * down[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    at = np.searchsorted(starts, first)
    for d in range(len(sizes)):
        low, high = at[d], at[d + 1] + 1  # up to the next row's blank
        bins = np.concatenate([m[low:max(low, high - n + 1)] for n, m in zip(GRAMS, made)])
        order = np.arange(len(bins), dtype=np.int32)
        stamp[bins] = order
        yield bins[stamp[bins] == order]


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in slices(texts):
        yield from grams(data, offsets)


def fit(bins: list[np.ndarray], labels: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of the bins and a bias, such that 1 / (1 + exp(-(bias + sum of a text's weights))) is the probability of label 1.

    ``prior``: the share of label 1 among all labelled rows, as the sample may be balanced.
    """
    width, y, base = 1 << BITS, labels.astype(np.float64), float(np.log(prior / (1 - prior)))
    ones, zeros = y.sum(), len(y) - y.sum()
    if not ones or not zeros:
        return np.zeros(width, np.float32), base
    in_one, in_zero = np.zeros(width), np.zeros(width)
    for b, label in zip(bins, labels):  # the bins of a text are distinct
        (in_one if label else in_zero)[b] += 1
    ratio = np.log((in_one + SMOOTH) / (ones + 2 * SMOOTH)) - np.log((in_zero + SMOOTH) / (zeros + 2 * SMOOTH))
    pooled = np.clip((in_one + in_zero) / len(y), 1e-9, 1 - 1e-9)
    apart = np.abs(in_one / ones - in_zero / zeros) / np.sqrt(pooled * (1 - pooled) * (1 / ones + 1 / zeros))
    ratio[apart < SIGNIFICANT] = 0
    used = [b[ratio[b] != 0] for b in bins]
    flat, row = np.concatenate(used), np.repeat(np.arange(len(used)), [len(b) for b in used])
    value = ratio[flat]
    scale = 1.0 / (np.bincount(flat, weights=value**2, minlength=width) / len(y) + 1e-2)  # even steps for all bins
    share = np.where(y == 1, prior * len(y) / ones, (1 - prior) * len(y) / zeros)
    w, b, push_w, push_b = np.zeros(width), base, np.zeros(width), 0.0
    for _ in range(STEPS):
        z = b + np.bincount(row, weights=value * w[flat], minlength=len(y))
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(flat, weights=value * g[row], minlength=width) / len(y) + RIDGE * w / len(y)
        push_w = 0.9 * push_w - STEP * scale * grad
        push_b = 0.9 * push_b - g.mean()
        w, b = w + push_w, b + push_b
    return (w * ratio).astype(np.float32), float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: str = "true", id_column: str = "doc_id",
                    text_column: str = "text", text_hash: bool = False) -> DataFrame:
    """(id, score, predicted) of every row: the probability of label 1, and 1 where it is at least 0.5.

    Learns from rows of ``labels`` (id, ``label`` 0/1) for which the SQL condition ``training`` holds, at most ``SAMPLE_ROWS`` of each class,
    chosen by a hash of the id; other rows and columns are never looked at. A null or empty text has no features and so the score of the
    bias. Null ids or labels teach nothing; with no labelled text, or one class only, every score is the (smoothed) share of label 1.
    Repeated rows are scored each. With ``text_hash`` a column of that name (xxhash64 of the text) tells rows of one id apart.
    """
    spark = docs.sparkSession
    known = labels.where(training).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    sums = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    prior = (sums.ones + 0.5) / (sums.n + 1)
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS) for v in (0, 1)]
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
                        F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"))
    sample = plain.join(F.broadcast(picked[0].union(picked[1])), "id").select("label", "text")  # at most 2 * SAMPLE_ROWS ids

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [b.astype(np.int32).tobytes() for b in features(column(batch, "text"))]
            yield pa.RecordBatch.from_pydict({"label": column(batch, "label"), "bins": pa.array(made, pa.binary())})

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y = [], []
        for batch in batches:
            bins += [np.frombuffer(x.as_buffer(), np.int32) for x in column(batch, "bins")]
            y += column(batch, "label").to_pylist()
        order = sorted(range(len(y)), key=lambda i: (y[i], len(bins[i]), bins[i].tobytes()))  # whatever order tasks ended in
        w, b = fit([bins[i] for i in order], np.array([y[i] for i in order], np.int64), prior)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary()), "b": pa.array([b], pa.float64())})

    model = sample.mapInArrow(drawn, "label int, bins binary").repartition(1).mapInArrow(learnt, "w binary, b double").first()
    shared = spark.sparkContext.broadcast((bytes(model.w), model.b))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = np.frombuffer(shared.value[0], np.float32), shared.value[1]
        for batch in batches:
            z = np.array([b + float(w[f].sum(dtype=np.float64)) for f in features(column(batch, "text"))])
            yield pa.RecordBatch.from_pydict({"id": column(batch, "id"), "text_hash": column(batch, "text_hash"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())})

    kind = docs.schema[id_column].dataType.simpleString()
    got = plain.mapInArrow(scored, f"id {kind}, text_hash bigint, score double")
    return got.select(F.col("id").alias(id_column), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["text_hash"] if text_hash else []))
