"""Language filters: n-grams and votes against plain Python, held-out accuracy, and learning from training rows only."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from tickloom.llm import langid, queries
from tickloom.llm.text import slices

TEXTS = ["Hello, wörld! a", "", "12", "é日本 X", "a", "zz top-of É́x", " lead", "trail ", "ТЕСТ слов", "हिन्दी", "İx", "😀 q", "x" * 50]
SYLLABLES = {"aa": ["ka", "lo", "mi", "ren", "tu"], "bb": ["ka", "zo", "vi", "ret", "xu"], "cc": ["пре", "ло", "ми", "тор"]}


def plain_grams(text):
    s = "".join(c.lower()[0] if c.isalpha() else c if ord(c) > 127 and unicodedata.category(c)[0] == "M" else " " for c in text)
    s = re.sub(" +", " ", f" {s} ")
    return {n: [s[i:i + n] for i in range(len(s) - n + 1) if " " not in s[i + 1:i + n - 1]] for n in langid.GRAMS}


def made(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = [(i, made(rng, lang := rng.choice(["aa", "aa", "aa", "bb", "cc"]), rng.randint(4, 60)), lang) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_grams_are_those_of_plain_python():
    _, _, data, offsets = next(slices(pa.array(TEXTS)))
    by, has_letter = langid.grams(data, offsets)
    assert has_letter.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]
    for n, (hashed, first) in zip(langid.GRAMS, by):
        want = [plain_grams(t)[n] for t in TEXTS]
        assert np.diff(first).tolist() == [len(w) for w in want]
        same = dict(zip([g for w in want for g in w], hashed.tolist()))
        assert [same[g] for w in want for g in w] == hashed.tolist() and len(set(same.values())) == len(same)


def test_votes_are_membership_less_false_positives(spark, texts):
    """Every n-gram of a filter is found, others at the predicted rate, and votes are the counts corrected by it."""
    filters = langid.fit(texts.select("text", "lang"))
    counts = {name: Counter() for name in filters.languages}
    for r in texts.collect():
        for n, g in plain_grams(r.text).items():
            counts[r.lang].update(g)
    share = {name: {g: k / sum(c.values()) for g, k in c.items()} for name, c in counts.items()}
    held = {name: {g for g, x in s.items() if x >= langid.RATE and x >= langid.SHARE * max(o.get(g, 0) for o in share.values())} for name, s in share.items()}
    rng = random.Random(4)
    tests = ["".join(rng.choice("abcdeklmorstuvxzилмопрт ") for _ in range(300)) for _ in range(40)] + [r.text for r in texts.limit(40).collect()]
    _, _, data, offsets = next(slices(pa.array(tests)))
    votes, _ = filters.votes(data, offsets)
    for i, name in enumerate(filters.languages):
        true = np.array([sum(g in held[name] for gs in plain_grams(t).values() for g in gs) for t in tests])
        total = np.array([sum(map(len, plain_grams(t).values())) for t in tests])
        assert filters.false[i] < 0.03
        assert np.abs(votes[:, i] - true).max() <= 6 + 6 * np.sqrt(total.max() * filters.false[i])
        assert abs((votes[:, i] - true).sum()) <= 6 + 6 * np.sqrt(total.sum() * filters.false[i])


def test_held_out_texts(spark, texts):
    training = "crc32(cast(doc_id as string)) % 3 <> 1"
    got = {r.doc_id: r for r in langid.predicted_languages(texts, training).collect()}
    wrong = texts.withColumnRenamed("lang", "was").selectExpr("doc_id", f"case when {training} then was else 'aa' end as lang", "text")
    again = {r.doc_id: r for r in langid.predicted_languages(wrong, training).collect()}
    assert got == again  # what held-out rows are labelled is not seen
    rows = texts.where(f"not ({training})").collect()
    assert len(rows) > 100 and all(got[r.doc_id].lang_pred == r.lang and 0 <= got[r.doc_id].score <= 1 for r in rows)


def test_query_on_the_documents(spark):
    got = queries.all_queries()["op12_language_filters"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert got and {r.held_out for r in got} == {True, False} and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out and any(c.isalpha() for c in r.text or "")]) > 0.97
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)


def test_more_than_one_word_of_languages(spark):
    """Seventy languages of one word each: bits beyond the first 64."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(70)]
    docs = spark.createDataFrame([(i, words[i], f"l{i:02}") for i in range(70)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == f"l{r.doc_id:02}" for r in langid.predicted_languages(docs).collect())


def test_odd_rows(spark, odd, nothing):
    got = langid.predicted_languages(odd, "doc_id is null or doc_id <> 3", lang_column="label").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)} == {(i, "und", 0.0) for i in (2, 3, 4)}
    assert all(r.lang_pred in ("x", "y", "z", "und") and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id == 9} == {"z"}
    assert langid.predicted_languages(nothing, lang_column="label").count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predicted_languages(odd, "false", lang_column="label").collect()} == {("und", 0.0)}
