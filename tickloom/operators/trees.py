"""Regression forests and boosted trees of all folds at once, grown level by level from histograms.

Features are cut at quantiles of each fold's training rows. For a level of all trees of all folds one job sums weight and weighted target by (fold, tree, node, feature, bin); the best cut of each node follows
from running sums over its bins, and only the cuts (a row for each node) come to the driver, where the trees live as arrays of folds x trees x 2**(depth + 1) nodes. So the driver loops over levels, never over rows or folds.

A tree asks a row for nothing but its bins. Where few features leave few combinations of bins, one job first sums what every tree sees of each combination (``_combined``); all levels then read these sums, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import materialise

MOST_NODES = 1 << 24  # of all trees of a model; its arrays are sent to every worker
HELD = 1 << 22  # cells that a task holds before it adds them up


@dataclass(frozen=True)
class Grow:
    """``trees`` of ``depth`` levels. A boosted model grows them one after the other on what is left, each scaled by ``rate``; a forest at once, each on rows drawn with replacement, and takes their mean.

    ``sample``: share of rows a boosted tree sees. ``bins``: cuts of a feature at most. ``least``: weight below which a side of a cut may not fall.
    """

    trees: int = 200
    depth: int = 6
    bins: int = 32
    least: float = 1.0
    boosted: bool = False
    rate: float = 1.0
    sample: float = 1.0
    seed: int = 42


class Trees:
    """Cuts and values: node i has children 2i + 1 (bin <= cut) and 2i + 2; a feature of -1 ends a path."""

    def __init__(self, folds: int, spec: Grow):
        shape = (folds, spec.trees, (2 << spec.depth) - 1)
        if np.prod(shape) > MOST_NODES:
            raise ValueError(f"{shape} folds x trees x nodes are more than {MOST_NODES}")
        self.spec, self.base = spec, np.zeros(folds)
        self.feature, self.cut, self.value = np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape)

    def leaf(self, fold: np.ndarray, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` steps, or where its path ends."""
        node = np.zeros(len(fold), np.int64)
        for _ in range(levels):
            f = self.feature[fold, tree, node]
            right = bins[np.arange(len(fold)), np.maximum(f, 0)] > self.cut[fold, tree, node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return node

    def predict(self, fold: np.ndarray, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        """The prediction of the first ``trees`` trees."""
        total = np.zeros(len(fold))
        for t in range(self.spec.trees if trees is None else trees):
            total += self.value[fold, t, self.leaf(fold, t, bins, self.spec.depth)]
        return self.base[fold] + self.spec.rate * total if self.spec.boosted else total / self.spec.trees

    def weights(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """How often a tree sees each row, from the row's hash: Poisson of mean 1 for a forest, 0 or 1 for a boosted tree."""
        x = rows ^ np.uint64((self.spec.seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
        u = (x >> np.uint64(11)).astype(float) / (1 << 53)
        if self.spec.boosted:
            return (u < self.spec.sample).astype(float)
        steps = np.exp(-1.0) * np.cumsum([1, 1, 1 / 2, 1 / 6, 1 / 24, 1 / 120, 1 / 720, 1 / 5040])
        return np.searchsorted(steps, u, "right").astype(float)


def _binned(splits: DataFrame, features: Sequence[str], target: str, bins: int) -> DataFrame:
    """(fold, role, y, row, bins) with the bin of each feature by the fold's quantiles, written once: every level reads it."""
    probs = [i / bins for i in range(1, bins)]
    edges = splits.where("role = 'train'").groupBy("fold").agg(*[F.array_distinct(F.percentile_approx(f, probs, 10_000)).alias(f"__e_{f}") for f in features])
    at = [F.expr(f"cast(size(filter(`__e_{f}`, e -> e < `{f}`)) as smallint)") for f in features]
    rows = splits.join(edges, "fold")
    return materialise(rows.select(F.col("fold").cast("int").alias("fold"), "role", F.col(target).cast("double").alias("y"), F.xxhash64(*[F.col(f) for f in features], target).alias("row"), F.array(*at).alias("bins")).repartition("row"), "bins")  # the folds are few, the files must not be


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    return get("fold").to_numpy(), get("y").to_numpy(), get("row").to_numpy().view(np.uint64), get("bins").flatten().to_numpy().reshape(-1, width)


def _combined(rows: DataFrame, model: Trees, fold_at: np.ndarray, width: int) -> DataFrame | None:
    """(fold, tree, code, w, wy): for each combination of bins, weight and weighted target of the training rows as each tree sees them; ``fold`` is the place in the model. None if a task would hold more than ``HELD`` of them."""
    spec, places = model.spec, model.spec.bins ** width
    folds = len(model.base)
    if folds * spec.trees * places > HELD:
        return None
    shared = rows.sparkSession.sparkContext.broadcast((model, fold_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fold_index = shared.value
        w, wy = np.zeros((spec.trees, folds * places)), np.zeros((spec.trees, folds * places))
        for batch in batches:
            fold, y, row, bins = _arrays(batch, width)
            code, at = np.unique(fold_index[fold] * places + bins.astype(np.int64) @ spec.bins ** np.arange(width), return_inverse=True)
            for t in range(spec.trees):
                seen = held.weights(row, t)
                w[t, code] += np.bincount(at, seen, minlength=len(code))
                wy[t, code] += np.bincount(at, seen * y, minlength=len(code))
        tree, code = np.nonzero(w)
        for i in range(0, len(tree), 1 << 16):
            t, c = tree[i:i + (1 << 16)], code[i:i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"fold": pa.array(c // places), "tree": pa.array(t), "code": pa.array(c % places), "w": pa.array(w[t, c]), "wy": pa.array(wy[t, c])})

    got = rows.where("role = 'train'").select("fold", "y", "row", "bins").mapInArrow(run, "fold bigint, tree bigint, code bigint, w double, wy double")
    return materialise(got.groupBy("fold", "tree", "code").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")), "cells")


def _histograms(rows: DataFrame, model: Trees, fold_at: np.ndarray, trees: range, level: int, width: int, combined: DataFrame | None = None) -> DataFrame:
    """(node, feature, bin, w, wy): sums over the training rows; a node is (fold x trees + tree) x nodes of the level + its place in it."""
    spec, nodes, first = model.spec, 1 << level, (1 << level) - 1
    shared = rows.sparkSession.sparkContext.broadcast((model, fold_at))

    def of_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        held, fold_index = shared.value
        fold, y, row, bins = _arrays(batch, width)
        fold = fold_index[fold].astype(np.int64)
        if spec.boosted:
            y = y - held.predict(fold, bins, trees.start)
        for t in trees:
            w = held.weights(row, t)
            yield fold, np.full(len(fold), t), bins, w, w * y

    def of_combined(batch: pa.RecordBatch) -> Iterator[tuple]:
        fold, tree, code, w, wy = (c.to_numpy() for c in batch.columns)
        bins = code[:, None] // spec.bins ** np.arange(width) % spec.bins
        if spec.boosted:
            wy = wy - w * shared.value[0].predict(fold, bins, trees.start)
        yield fold, tree, bins, w, wy

    read = of_rows if combined is None else of_combined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value[0]
        sums: list[tuple[np.ndarray, ...]] = []

        def folded() -> None:
            cell, w, wy = (np.concatenate(x) for x in zip(*sums))
            cell, at = np.unique(cell, return_inverse=True)
            sums[:] = [(cell, *(np.bincount(at, x, minlength=len(cell)) for x in (w, wy)))]

        for batch in batches:
            for fold, tree, bins, w, wy in read(batch):
                node = held.leaf(fold, tree, bins, level)
                on = (w > 0) & (node >= first) & ((level == 0) | (held.feature[fold, tree, (node - 1) // 2] >= 0))
                key = ((fold[on] * spec.trees + tree[on]) * nodes + node[on] - first)[:, None] * width + np.arange(width)
                sums.append(((key * spec.bins + bins[on]).ravel(), np.repeat(w[on], width), np.repeat(wy[on], width)))
                if sum(len(c) for c, _, _ in sums) > HELD:
                    folded()
        if sums:
            folded()
            cell, w, wy = sums[0]
            for i in range(0, len(cell), 1 << 16):
                c = cell[i:i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"node": pa.array(c // (spec.bins * width)), "feature": pa.array(c // spec.bins % width), "bin": pa.array(c % spec.bins), "w": pa.array(w[i:i + len(c)]), "wy": pa.array(wy[i:i + len(c)])})

    source = rows.where("role = 'train'").select("fold", "y", "row", "bins") if combined is None else combined.where(F.col("tree").between(trees.start, trees.stop - 1)).select("fold", "tree", "code", "w", "wy")
    got = source.mapInArrow(run, "node bigint, feature bigint, bin bigint, w double, wy double")
    # a task sends at most one row for each cell; all that follows is within a node
    return got.repartition("node").groupBy("node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))


def _cuts(cells: DataFrame, spec: Grow) -> DataFrame:
    """(node, w, wy, best) for each node: its sums, and the cut that lowers the squared error most: (gain, feature, bin, left weight, left sum)."""
    own = W.partitionBy("node", "feature")
    upto = own.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # at most ``bins`` rows
    sides = cells.select("node", "feature", "bin", F.sum("w").over(upto).alias("lw"), F.sum("wy").over(upto).alias("ls"), F.sum("w").over(own).alias("tw"), F.sum("wy").over(own).alias("ts"))
    rw, rs = F.col("tw") - F.col("lw"), F.col("ts") - F.col("ls")
    gain = F.when((F.col("lw") >= spec.least) & (rw >= spec.least), F.col("ls") * F.col("ls") / F.col("lw") + rs * rs / rw - F.col("ts") * F.col("ts") / F.col("tw"))
    best = F.max(F.when(gain > 1e-9, F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "lw", "ls")))
    return sides.groupBy("node").agg(F.first("tw").alias("w"), F.first("ts").alias("wy"), best.alias("best"))


def grow(rows: DataFrame, folds: Sequence[int], width: int, spec: Grow, combine: bool = True) -> Trees:
    """The trees of every fold from binned rows; ``combine``: from sums over combinations of bins where those are few."""
    model = Trees(len(folds), spec)
    fold_at = np.zeros(max(folds) + 1, np.int64)
    fold_at[list(folds)] = np.arange(len(folds))
    if spec.boosted:
        for r in rows.where("role = 'train'").groupBy("fold").agg(F.avg("y").alias("y")).collect():
            model.base[fold_at[r["fold"]]] = r["y"]
    combined = _combined(rows, model, fold_at, width) if combine else None
    for trees in ([range(t, t + 1) for t in range(spec.trees)] if spec.boosted else [range(spec.trees)]):
        for level in range(spec.depth):
            cuts = _cuts(_histograms(rows, model, fold_at, trees, level, width, combined), spec).toArrow()
            if not len(cuts):
                break
            at = cuts["node"].to_numpy()
            fold, tree, node = at // (1 << level) // spec.trees, at // (1 << level) % spec.trees, at % (1 << level) + (1 << level) - 1
            w, wy = cuts["w"].to_numpy(), cuts["wy"].to_numpy()
            if level == 0:
                model.value[fold, tree, node] = wy / w
            found = np.array([b is not None for b in cuts["best"].to_pylist()], bool)
            best = [b for b in cuts["best"].to_pylist() if b is not None]
            if not best:
                break
            f, t, i = fold[found], tree[found], node[found]
            lw, ls = np.array([b["lw"] for b in best]), np.array([b["ls"] for b in best])
            model.feature[f, t, i], model.cut[f, t, i] = [-b["feature"] for b in best], [-b["bin"] for b in best]
            model.value[f, t, 2 * i + 1], model.value[f, t, 2 * i + 2] = ls / lw, (wy[found] - ls) / (w[found] - lw)
    return model


def tree_predictions(splits: DataFrame, features: Sequence[str], target: str, spec: Grow) -> DataFrame:
    """(fold, target, ``__pred``) of the test rows of every fold, by the trees grown on the fold's training rows. Rows (fold, role, features, target) must have no NULL."""
    rows = _binned(splits, features, target, spec.bins)
    folds = sorted(r[0] for r in rows.where("role = 'train'").select("fold").distinct().collect())  # as many as the caller asked for
    if not folds:
        return splits.limit(0).select("fold", target, F.lit(0.0).alias("__pred"))
    model, width = grow(rows, folds, len(features), spec), len(features)
    fold_at = np.zeros(max(folds) + 1, np.int64)
    fold_at[folds] = np.arange(len(folds))
    shared = splits.sparkSession.sparkContext.broadcast((model, fold_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fold_index = shared.value
        for batch in batches:
            fold, y, _, bins = _arrays(batch, width)
            alike, at = np.unique(np.column_stack([fold_index[fold], bins]), axis=0, return_inverse=True)  # rows of the same bins have the same prediction
            yield pa.RecordBatch.from_pydict({"fold": pa.array(fold.astype(np.int64)), target: pa.array(y), "__pred": pa.array(held.predict(alike[:, 0], alike[:, 1:])[at.ravel()])})

    tests = rows.where(F.col("role") == "test").where(F.col("fold").isin(folds)).select("fold", "y", "row", "bins")
    return tests.mapInArrow(run, f"fold bigint, `{target}` double, __pred double")
