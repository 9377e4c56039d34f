"""Recall against brute force, and exact order and scores of what is found."""

import numpy as np
import pytest

from tickloom.llm import neighbours as N

SF = "/root/testdata/sf0.01"


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


@pytest.mark.parametrize("block", [12_000, 150])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_VECTORS", block)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding]
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    at = {int(i): n for n, i in enumerate(ids)}
    got: dict = {}
    for r in N.nearest(table, "vec_id % 20 = 0", 20).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    assert sum(len({r.vec_id for r in got[q]} & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - vectors[at[r.vec_id]] @ vectors[at[q]]) < 1e-12 for r in found)


def test_lengths_count(spark):
    """Inner products, not angles: long vectors win."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 8)) * rng.uniform(0.1, 5, (400, 1))
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in N.nearest(table, "vec_id % 20 = 0", 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(400), v, range(0, 400, 20), 20)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 400


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 3), (3, None, 4), (4, [0.0, 0.0], 5), (5, [nan, 1.0], 6), (6, [inf, 1.0], 7), (7, [None, 1.0], 8), (8, [], 9),
            (None, [1.0, 1.0], 1), (20, [0.5, 0.5], 1), (1, [1.0, 0.0], 2), (40, [0.0, 0.0], 1), (60, None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in N.nearest(table, "vec_id % 20 = 0", 20).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert N.nearest(table.limit(0), "vec_id % 20 = 0").count() == 0
