"""Regions against a plain edit distance."""

import random

import numpy as np
import pyarrow as pa
from conftest import text_of

from tickloom.llm import decontaminate as D
from tickloom.llm.text import slices


def best(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def found(index, text):
    return [x for first, _, data, offsets in slices(pa.array([text])) for x in index.found(data, offsets)]


def test_edits_equal_brute_force():
    rng = random.Random(5)
    items = [text_of(rng, n) for n in (6, 12, 25, 40)]
    index = D.Items(list(range(len(items))), items)
    for trial in range(40):
        k = trial % len(items)
        chars = list(items[k])
        for _ in range(rng.randrange(0, 14)):
            at, kind = rng.randrange(len(chars)), rng.random()
            if kind < 0.34:
                chars[at] = rng.choice("qwz")
            elif kind < 0.67:
                del chars[at]
            else:
                chars.insert(at, rng.choice("qwz"))
        text = text_of(rng, 20) + "\n " + "".join(chars).upper() + "  " + text_of(rng, 20)
        want, allowed = best(D.normal(items[k]), D.normal(text)), D.budget(len(D.normal(items[k])))
        got = [e for _, i, _, _, e in found(index, text) if index.ids[i] == k]
        assert (want <= allowed) == bool(got) and (not got or min(got) == want)


def test_spans_are_code_points():
    index = D.Items([4], ["élan vital über alles und noch mehr davon"])
    text = "日本 ÉLAN xx élan  vital\nüber alles und noch mehr davon, ß"
    (_, _, s, e, edits), = found(index, text)
    assert text[s:e] == "élan  vital\nüber alles und noch mehr davon" and edits == 0


def test_short_items_and_overlaps():
    index = D.Items([1, 2], ["abc abc", ""])
    assert [(s, e) for _, _, s, e, _ in found(index, "abc abc abc")] == [(0, 7), (4, 11)]


def test_squeeze_keeps_rows_apart():
    data = np.frombuffer(b"a  b c", np.uint8)
    text, origin, rows = D.squeezed(data, np.array([0, 2, 6]))
    assert [text[rows[i]:rows[i + 1]].tobytes() for i in range(2)] == [b"a ", b" b c"] and origin.tolist() == [0, 1, 2, 3, 4, 5]


def test_odd_rows(spark, odd, nothing):
    texts = {r.doc_id: r.text for r in odd.collect()}
    items = spark.createDataFrame([(1, texts[1][10:200], "l"), (2, None, "l"), (3, "", "l"), (4, texts[1][10:200], "l"), (5, texts[5][100_000:100_300], "l")], "item_id long, text string, label string")
    got = D.leaks(odd, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 4), (5, 5), (6, 5)]
    assert D.leaks(nothing, items).count() == 0 and D.leaks(odd, items.limit(0)).count() == 0
    left = D.decontaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 3


def test_blocks_of_items_change_nothing(spark, odd, monkeypatch):
    texts = [r.text for r in odd.where("doc_id in (1, 5)").collect()]
    items = spark.createDataFrame([(i, t[100 * i + 5:100 * i + 95]) for t in texts for i in range(4) if len(t) > 500], "item_id long, text string")
    whole = sorted(D.leaks(odd, items).collect(), key=str)
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    assert sorted(D.leaks(odd, items).collect(), key=str) == whole


def test_repetitive_texts(monkeypatch):
    """Rules of one character and periodic texts: the same regions as a spelt-out count finds, in small windows too; a megabyte of dashes in bounded time and memory."""
    import resource
    import time

    rng = random.Random(4)
    items = ["-" * 200, "Heading of the task\n" + "=" * 60 + "\nThe first line of it says what is to be done", "ab " * 40, "-" * 30 + " mixed " + "-" * 30, text_of(rng, 20)]
    index = D.Items(list(range(len(items))), items)
    texts = ["-" * 700, "x " + items[1] + " y", items[1].replace("first", "fxrst"), "ab " * 100, text_of(rng, 30) + " " + items[4] + " " + "-" * 250 + items[3], "=" * 300, "- " * 200, "-" * 199, items[3].replace("mixed", "mxed")]

    def spelt_out(t):
        """Bands with q-grams enough, counting each hit on its own."""
        out = set()
        for k, item in enumerate(index.text):
            half, held = int(index.edits[k]) + 1, {}
            at = {}
            for a in range(len(item) - D.Q + 1):
                at.setdefault(item[a:a + D.Q], []).append(a)
            for p in range(len(t) - D.Q + 1):
                for a in at.get(t[p:p + D.Q], ()):
                    for b in ((p - a) // half, (p - a) // half - 1):
                        held.setdefault(b, set()).add(a)
            out |= {(k, b * half) for b, seen in held.items() if len(seen) >= index.need[k]}
        return out

    for size in (1 << 20, 40):
        monkeypatch.setattr(D, "WINDOW_HITS", size)
        for text in texts:
            t = np.frombuffer(D.normal(text), np.uint8)
            got = [(k, d) for _, k, d in index.regions(t, np.array([0, len(t)]))]
            assert len(got) == len(set(got)) and set(got) >= spelt_out(t.tobytes()), text[:40]
            assert len(got) <= 1.2 * len(spelt_out(t.tobytes())) + 10  # a q-gram that two runs give to a band may count twice
    assert {k for _, k, *_ in index.found(np.frombuffer(texts[2].encode(), np.uint8), np.array([0, len(texts[2])]))} == {1}
    assert 3 in {k for _, k, *_ in index.found(np.frombuffer(texts[8].encode(), np.uint8), np.array([0, len(texts[8])]))}
    monkeypatch.setattr(D, "WINDOW_HITS", 1 << 20)
    alone = D.Items([0], ["-" * 200])
    data = np.frombuffer(b"-" * 1_000_000, np.uint8)
    before, begin = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert sum(1 for _ in alone.found(data, np.array([0, len(data)]))) > 1000
    assert time.time() - begin < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
