"""The audit of filter orders against its SQL and against plain Python that applies every order to every document."""

import random
import re
from itertools import permutations


from conftest import SF, text_of
from oracle import compare, duck

from tickloom.llm import filter_audit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    """Rows by applying the filters one after the other."""
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    fails = []
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A"} if len(w) < 100 else set()
        failed |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        failed |= {"D"} if re.search("[#$%&*|]", text) else set()
        failed |= {"E"} if i is not None and first[text] < i else set()
        fails.append((i, part or "", failed))
    rows = {}
    for part in {p for _, p, _ in fails}:
        shapley, mine = dict.fromkeys("ABCDE", 0), [(i, f) for i, p, f in fails if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                out = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(out)
                rows[part, "".join(order), step] = [len(left), len(out), sum(name in f for _, f in mine) - len(out), sum(f == {name} for _, f in mine),
                                                    sum(i is not None and i in good for i, _ in out), sum(i is not None and i in toxic for i, _ in out)]
        for key in [k for k in rows if k[0] == part]:
            rows[key].append(shapley[key[1][key[2] - 1]])
    return sorted([*k, *v] for k, v in rows.items())


def test_path_counts():
    """Weights of the edges of one filter add up to all orders; an edge's weight is the number of orders that pass it."""
    weights = filter_audit.path_counts(4)
    assert all(sum(w for (_, f), w in weights.items() if f == g) == 24 for g in range(4))
    for (state, f), weight in weights.items():
        assert weight == sum(any(sum(1 << x for x in o[:i]) == state and o[i] == f for i in range(4)) for o in permutations(range(4)))


def test_equals_plain_python(spark):
    rng, docs = random.Random(5), []
    for i in range(150):
        text = rng.choice([text_of(rng, rng.randint(90, 130)), text_of(rng, 5) * 30, "A" * rng.randint(1, 5) + " " + text_of(rng, 3), "x # y", "", None, "same text"])
        text = text.upper() if text and rng.random() < 0.2 else text
        docs.append((rng.choice([i, i, i, None, 3]), text, rng.choice(["en", "fr", None, ""])))
    docs += docs[:20]
    labels = [(rng.choice([i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(150) for _ in range(rng.randint(0, 2))]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, id string, n int")
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(*COLUMNS).collect()
    assert sorted(list(r) for r in got) == plain(docs, labels)


def test_query_equals_sql(spark):
    got = queries.all_queries()["op11_filter_audit"](spark, SF).toPandas()
    assert len(got) % 600 == 0 and len(got) > 0
    assert compare(got, duck(SF).execute(queries.all_sql()["op11_filter_audit"]).df()) is None


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(odd, labels, part_column="label").collect()
    assert len(got) == 600 * len({r.label or "" for r in odd.collect()})
    docs = [(r.doc_id, r.text, r.label) for r in odd.collect()]
    assert sorted(list(r) for r in got) == plain(docs, [tuple(r) for r in labels.collect()])
    assert filter_audit.audit(nothing, labels, part_column="label").count() == 0
    assert filter_audit.audit(odd, labels.limit(0), part_column="label").where("good_lost + toxic_lost > 0").count() == 0
