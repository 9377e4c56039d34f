"""Held-out accuracy of the two classifiers, and their parts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import text_of

from tickloom.llm import quality, toxicity

TRAINING = "crc32(cast(doc_id as string)) % 5 <> 0"
WORDS = ("grubble", "snarkle", "vilefen")


@pytest.fixture(scope="module")
def toxic(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(900):
        words = text_of(rng, rng.randint(20, 300)).split()
        bad = i % 6 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(WORDS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def held_out(spark, got, labels, label):
    both = got.join(labels, "doc_id").where(f"not ({TRAINING})").select(label, "predicted", "score").collect()
    assert all(0 <= r.score <= 1 for r in both) and len(both) > 50
    return np.mean([r[label] == r.predicted for r in both])


def test_toxicity_is_learnt(spark, toxic):
    docs, labels = toxic
    assert held_out(spark, toxicity.toxicity_scores(docs, labels, training=TRAINING), labels, "toxic") > 0.97


def test_toxicity_uses_training_rows_only(spark, toxic):
    docs, labels = toxic
    changed = labels.selectExpr("doc_id", f"case when {TRAINING} then toxic else 1 - toxic end as toxic")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, x, training=TRAINING).collect()) for x in (labels, changed))
    assert a == b


def test_grams_are_those_of_characters():
    """The distinct n-grams of characters of the lowered text between blanks, whatever rows stand around it; white space runs are one blank."""
    texts = ["Plan  vital \n", "", " ", "x\nplan é日本語", "\tX plan", "ab", "x\nplan é日本語"]
    bins = [set(b.tolist()) for b in toxicity.features(pa.array(texts))]
    alone = [set(next(toxicity.features(pa.array([t]))).tolist()) for t in texts]
    assert bins == alone
    plain = [" " + " ".join(t.lower().split()) + " " if t.strip() else "" for t in texts]
    grams = [{s[i:i + n] for n in toxicity.GRAMS for i in range(len(s) - n + 1)} for s in plain]
    assert [len(b) for b in bins] == [len(g) for g in grams]
    assert [[len(a & b) for b in bins] for a in bins] == [[len(a & b) for b in grams] for a in grams]


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (None, 1), (7, None), (1, 1), (99, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.toxicity_scores(nothing, labels).count() == 0
    assert len({r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()}) == 1


def test_quality_is_learnt(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(900):
        words, kind = text_of(rng, rng.randint(20, 300)).split(), i % 10
        if kind == 0:
            words = [w.upper() + "!!" for w in words[:20]] * 4
        elif kind == 1:
            words = words[:3] * 40
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind > 1)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert held_out(spark, quality.quality_scores(docs, labels, training=TRAINING), labels, "quality") > 0.97


def test_discriminant_equals_the_density_formula():
    rng = np.random.default_rng(2)
    d = 4
    x = [rng.standard_normal((200, d)) @ rng.standard_normal((d, d)), rng.standard_normal((300, d)) + 1]
    count, total = np.array([len(z) for z in x], float), np.stack([z.sum(0) for z in x])
    made = quality.Discriminant(count, total, np.stack([z.T @ z for z in x]))
    own = [np.cov(z.T, bias=True) for z in x]
    pooled = sum(len(z) * c for z, c in zip(x, own)) / (count.sum() - 2)
    log = []
    at = rng.standard_normal((10, d))
    for c in (0, 1):
        cov = (1 - quality.POOLED - quality.DIAGONAL) * own[c] + quality.POOLED * pooled + quality.DIAGONAL * np.diag(np.diag(pooled)) + quality.FLOOR * np.eye(d)
        off = at - x[c].mean(0)
        log.append(np.log((count[c] + 0.5) / (count.sum() + 1)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (off @ np.linalg.inv(cov) * off).sum(1))
    assert np.allclose(made.score(at), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(nothing, labels).count() == 0
    assert len({r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()}) == 1
