"""Spelling variants against plain Python: counting, near words in plain and split groups, roots; and the query against its SQL."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from conftest import SF
from oracle import duck, rows_of

from tickloom.llm import queries, spelling


def plain_counts(ids, texts):
    counts = Counter()
    for i, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % spelling.DROP == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= spelling.LETTERS:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_near(n):
    out = {}
    for w in n:
        near = [o for o in n if one_edit(w, o)]
        if near:
            best = min(near, key=lambda o: (-n[o], o))
            out[w] = (len(near), best, n[best])
    return out


def plain_rows(counts):
    n = {w: k for w, k in counts.items() if k >= spelling.TIMES}
    near = plain_near(n)
    form = {w: near[w][1] for w in near if near[w][2] >= spelling.RATIO * n[w]}
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], near[w][0] if w in near else 0, n[form[w]] if w in form else None))
    return sorted(rows)


def test_words_of_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcABCéèÿÀxyz .,1÷ñ日-") for _ in range(rng.randint(0, 400))) for _ in range(300)] + [None, "", "abcdefgh" * 3]
    ids = [rng.choice([None, str(i), "12"]) for i in range(len(texts))]
    got = Counter()
    for words, n in spelling.words_of(ids, pa.array(texts)):
        for w, k in zip(words.to_pylist(), n.tolist()):
            got[w] += k
    assert +got == plain_counts(ids, texts)


@pytest.mark.parametrize("group", [4096, 20])
def test_near_words(spark, monkeypatch, group):
    """Short words over three letters, so that most have many near ones; with small groups every level of splitting is used."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng, words = random.Random(6), set()
    while len(words) < 900:
        words.add("".join(rng.choice("abé") for _ in range(rng.randint(2, 9))))
    n = {w: rng.choice([2, 5, 5, 60, 700, 8000]) for w in sorted(words)}
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == plain_near(n)


def test_blocks_of_groups(spark, monkeypatch):
    """Groups that do not fit into one block, and blocks cut within a batch."""
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rng = random.Random(3)
    n = {"".join(rng.choice("abcdé") for _ in range(rng.randint(6, 8))): rng.randint(2, 90) for _ in range(500)}
    rows = [(f"{size}:{w[:size // 2]}", w, k, size, size // 2, 0) for w, k in n.items() for size in (len(w), len(w) - 1)]
    rows.sort()
    table = pa.Table.from_pylist([dict(zip(("key", "word", "n", "size", "prefix", "suffix"), r)) for r in rows])
    whole = spelling.best_near(table).to_pylist()
    parts = [r for b in spelling.searched(iter(table.to_batches(max_chunksize=50))) for r in b.to_pylist()]
    total = lambda got: sorted((w, sum(r["n_near"] for r in got if r["word"] == w), min((-r["form_n"], r["form"]) for r in got if r["word"] == w)) for w in {r["word"] for r in got})
    assert whole and total(whole) == total(parts)


def test_variants_and_roots(spark):
    """A chain of forms: each ten times as frequent as the one before."""
    texts = [(1, " ".join(["letterbox"] * 3000)), (2, " ".join(["letterbux"] * 250)), (3, " ".join(["lettertbux"] * 20)), (4, "lettertbuz lettertbuz Lettertbuz's"), (5, "lettertbux! 12"), (None, "letterbox " * 2), (6, None)]
    got = spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain_rows(plain_counts(*zip(*texts)))
    assert max(Counter(r.root for r in got).values()) >= 3


def test_query_equals_sql(spark):
    got = queries.all_queries()["op13_spelling_variants"](spark, SF).toPandas()
    assert len(got) > 100 and (got.n_near > 0).any()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = duck(SF).execute(queries.all_sql()["op13_spelling_variants"]).df().astype({"form_n": "float64"})
    assert rows_of(got) == rows_of(want)
    assert sorted(got.word) == sorted(w for w, k in plain_counts([r.doc_id for r in docs], [r.text for r in docs]).items() if k >= 2)


def test_odd_rows(odd, nothing):
    got = spelling.spelling_variants(odd).collect()
    rows = odd.collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain_rows(plain_counts([r.doc_id for r in rows], [r.text for r in rows]))
    assert spelling.spelling_variants(nothing).count() == 0
