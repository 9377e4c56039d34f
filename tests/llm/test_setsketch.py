"""Components against an exact join of all sets; the sketch's properties."""

import random
import re

import numpy as np
import pytest
from conftest import SF, text_of

from tickloom.llm import setsketch as S
from tickloom.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def brute(texts, k, percent):
    """Component of each id over all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice("qwxyz") + str(rng.randrange(1000))
    return " ".join(words)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rng = random.Random(k)
    texts = []
    for _ in range(6):  # families around the threshold: many members are near some and not near others
        base = text_of(rng, 150)
        texts += [base, base.upper()] + [family(rng, base, rng.randrange(0, 16 if k == 2 else 6)) for _ in range(25)]
    rng.shuffle(texts)
    given = dict(enumerate([*texts, "", None, "one", "ONE ", "one two", " \n"]))
    docs = spark.createDataFrame([(i, t) for i, t in given.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(docs, k, 80).collect()}
    assert got == brute(given, k, 80)


def test_leftovers_are_held_against_all(spark, monkeypatch):
    """Blocks of a few texts only, so that the last step runs in many passes."""
    monkeypatch.setattr(S, "BLOCK_BYTES", 4000)
    rng = random.Random(9)
    base = text_of(rng, 120)
    given = dict(enumerate(family(rng, base, rng.randrange(0, 14)) for _ in range(60)))
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(docs, 2, 80).collect()}
    assert got == brute(given, 2, 80)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(docs, 2, 80).collect()}
    assert got == brute({r.doc_id: r.text for r in docs.collect()}, 2, 80)


def test_odd_rows(odd, nothing):
    got = S.near_duplicates(odd, 5).collect()
    assert len(got) == odd.count() and S.near_duplicates(nothing).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].component_id == 2 and by[4].kept
    assert by[7].n_shingles == 1 and by[7].component_id == 7


def test_one_id_with_several_texts(spark):
    rng = random.Random(17)
    a, b = text_of(rng, 90), text_of(rng, 90)
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, text_of(rng, 90))]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    drawn_a, drawn_b = S.registers(a), S.registers(b)
    assert (S.merge(drawn_a, drawn_b) == S.registers(pool[:2500])).all()
    assert abs(S.estimate(drawn_a, drawn_b, 2000, 2000) - 0.6) < 0.12
    agree = np.mean([np.mean(S.registers(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) == S.registers(rng.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(20)])
    assert agree < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (7, 7), (None, 3), (100, 102)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_its_sql(spark):
    from oracle import compare, duck

    from tickloom.llm.queries import all_queries, all_sql

    for name, sql in all_sql().items():
        assert compare(all_queries()[name](spark, SF).toPandas(), duck(SF).execute(sql).df()) is None
