"""How quality filters interact: what each removes in every order of application, and its Shapley share.

A document is told by the set of filters that it fails, so all orders are answered by the counts of those sets. The subsets of filters form a
lattice: a state is the set already applied, an edge applies one filter more. What an edge removes does not depend on the order that led to it.
A forward pass counts the orders that reach a state, a backward pass those that lead on from it; their product weights the edge for Shapley,
and the steps of each order are read from the same edges.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
DUPLICATE = "E"
Edge = tuple[int, int]


def rules(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: short, repetitive, upper-case, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * upper > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def path_counts(k: int) -> dict[Edge, int]:
    """For every edge (state, filter) of the lattice of ``k`` filters, the number of orders that pass it: ways to its start x ways from its end."""
    full = (1 << k) - 1
    to, onward = {0: 1}, {full: 1}
    for state in range(1, full + 1):
        to[state] = sum(to[state & ~(1 << f)] for f in range(k) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        onward[state] = sum(onward[state | 1 << f] for f in range(k) if not state >> f & 1)
    return {(s, f): to[s] * onward[s | 1 << f] for s in range(full) for f in range(k) if not s >> f & 1}


def failure_sets(docs: DataFrame, labels: DataFrame, conditions=rules, duplicate: str = DUPLICATE, part_column: str = "lang", id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters failed, bit i for the i-th name in ``conditions``, then ``duplicate``."""
    text = F.col("text")
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    failed = list(conditions(text).values())
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    # one row for each text, id, part: repeated rows are counted here, before any key meets
    texts = written(plain.select("id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), mask.cast("int").alias("mask")).groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")), "failures")
    named = texts.where("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))  # few rows for a hot text: combined in each task
    marked = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    held = named.join(first, ["digest", "id"], "left").join(marked, "id", "left").select(
        "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << len(failed))).alias("mask"), "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    unnamed = texts.where("id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return held.unionAll(unnamed).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def orders(sets: DataFrame, names: str) -> DataFrame:
    """The audit of all orders of ``names`` (a letter for each filter, in the order of the bits of ``mask``) from the counts of failure sets.

    The tables of edges and steps have k * 2**(k-1) * 2**k and k * k! rows for k filters, whatever the input; they are broadcast.
    """
    spark, k = sets.sparkSession, len(names)
    meets = [(mask, s, f, w, not mask & (s | 1 << f), bool(mask >> f & 1 and not mask & s), bool(mask >> f & 1 and mask & s), mask == 1 << f)
             for (s, f), w in path_counts(k).items() for mask in range(1 << k)]
    edges = spark.createDataFrame(meets, "mask int, state int, filter int, weight long, is_kept boolean, is_removed boolean, is_redundant boolean, is_only boolean")
    total = lambda flag, value: F.sum(F.when(F.col(flag), F.col(value)).otherwise(0))
    counts = sets.join(F.broadcast(edges), "mask").groupBy("part", "state", "filter", "weight").agg(
        total("is_kept", "n").alias("kept"), total("is_removed", "n").alias("removed"), total("is_redundant", "n").alias("redundant"), total("is_only", "n").alias("unique_fails"),
        total("is_removed", "good").alias("good_lost"), total("is_removed", "toxic").alias("toxic_lost"))
    counts = written(counts, "edges")
    shapley = counts.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    steps = [("".join(names[f] for f in order), i + 1, sum(1 << f for f in order[:i]), order[i]) for order in permutations(range(k)) for i in range(k)]
    walked = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return counts.join(shapley, ["part", "filter"]).join(F.broadcast(walked), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, conditions=rules, duplicate: str = DUPLICATE, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each part, order of the filters and step: documents kept after the step, removed by it, redundant (failing it, gone already),
    unique_fails (failing it alone), good_lost and toxic_lost (removed by it and labelled so), and shapley (removed by its filter, over all orders).

    ``conditions(text)`` gives the filters by letter; ``duplicate`` fails where a smaller id has the same text (told by SHA-256), removed or not. A null text is
    empty, a null part is the empty string. A row with a null id is no copy, is nobody's original and has no label; of repeated rows of one id none is a copy
    of the other. An id with several labels counts as good or toxic if one of them says so; null labels say nothing. No documents: no rows.
    """
    return orders(failure_sets(docs, labels, conditions, duplicate, part_column, id_column, text_column), "".join(conditions(F.lit(""))) + duplicate)
