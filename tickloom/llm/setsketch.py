"""Near-duplicate detection with SetSketch registers.

A register is the least of exponentially distributed values, one drawn by each element of a set from its hash, kept as a whole number on a
logarithmic scale and cut off at both ends. Registers of a union are the larger of two registers, and two sets agree in a register about as often
as their Jaccard similarity. Five registers make a band, forty bands a sketch: two sets at similarity 0.8 share no band with probability
(1 - 0.8**5)**40 = 1.3e-7. Texts in one bucket of a band are compared in three steps: registers of both and the two set sizes give the
likelihood of every similarity; if 0.8 or more is possible at all, the full sets decide.

Pairs are never spelled out in a bucket. Equal sets are one class, stood for by its smallest id. In a bucket every class is held against one
hub; what is then still outside its hub's component is held, in blocks, against the other members of its buckets. A pair inside one component cannot change
the result and is not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.scratch import small, written
from tickloom.llm.text import column, droppers, mix, shingles, slices, words

ROWS, BANDS = 5, 40
M = ROWS * BANDS
RATE, SPACING = 20.0, 1.001
IMPOSSIBLE = 30.0  # log likelihood that a similarity must lose against the best to be given up: odds of 1e13
BLOCK_BYTES = 8 << 20  # of texts and registers that are broadcast at once
_blocks: dict = {}  # the block last built in this worker
droppers.append(_blocks.clear)
_rng = np.random.default_rng(0x5E75)
FACTOR = (_rng.integers(0, 1 << 32, M, dtype=np.uint32) | np.uint32(1))[:, None]
SHIFT = _rng.integers(0, 1 << 32, M, dtype=np.uint32)[:, None]
BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def registers(elements: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes."""
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    half = M // 2
    for at in range(0, len(elements), 1024):
        part = elements[at:at + 1024]
        for rows, x in ((slice(0, half), (part >> np.uint64(32)).astype(np.uint32)), (slice(half, M), part.astype(np.uint32))):
            np.minimum(least[rows], (x[None, :] * FACTOR[rows] + SHIFT[rows]).min(axis=1), out=least[rows])
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(SPACING)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def buckets(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of each row of registers."""
    bands = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(BAND_SALT, bands.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return out


def log_likelihood(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities possible for the two set sizes, and the log likelihood of each given both sketches."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    grid = np.linspace(0, min(u / v, v / u), 201)
    p = lambda x: np.clip(-np.log1p(-x * (SPACING - 1) / SPACING) / np.log(SPACING), 1e-12, 1)
    more, less = p(u - v * grid), p(v - u * grid)
    above, below = int((a > b).sum()), int((a < b).sum())
    return grid, above * np.log(more) + below * np.log(less) + (len(a) - above - below) * np.log(np.clip(1 - more - less, 1e-12, 1))


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> float:
    """The likeliest Jaccard similarity."""
    grid, log = log_likelihood(a, b, size_a, size_b)
    return float(grid[np.argmax(log)])


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in slices(texts):
        w = words(data, offsets)
        for d in range(len(offsets) - 1):
            yield np.unique(shingles(w.hash[w.first[d]:w.first[d + 1]], k))


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(id, text_hash, n, fa, fb, registers) of each row: set size, a 128-bit fingerprint of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, prints, made = [], [], []
            for s in sets(column(batch, "text"), k):
                size.append(len(s))
                prints.append((int(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5A5A5A)).sum(dtype=np.uint64).astype(np.int64))))
                made.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                "id": column(batch, "id"), "text_hash": column(batch, "text_hash"), "n": pa.array(size, pa.int64()), "fa": pa.array([x for x, _ in prints], pa.int64()),
                "fb": pa.array([x for _, x in prints], pa.int64()), "registers": pa.array(made, pa.binary())})

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "id bigint, text_hash bigint, n bigint, fa bigint, fb bigint, registers binary")


def spread(classes: DataFrame) -> DataFrame:
    """(node, bucket), a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(x.as_py() for x in column(batch, "registers"))
            got = buckets(np.frombuffer(raw, np.uint16).reshape(-1, M)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(column(batch, "node").to_numpy(), BANDS)), "bucket": pa.array(got.ravel())})

    return classes.select("node", "registers").mapInArrow(run, "node bigint, bucket bigint")


def confirmed(pairs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = range(batch.num_rows)
            size = [column(batch, f"n_{s}").to_numpy() for s in "ab"]
            drawn = [[np.frombuffer(x.as_buffer(), np.uint16) for x in column(batch, f"registers_{s}")] for s in "ab"]
            maybe = []
            for i in rows:
                x, y = int(size[0][i]), int(size[1][i])
                if 100 * min(x, y) < percent * max(x, y):
                    continue
                grid, log = log_likelihood(drawn[0][i], drawn[1][i], x, y)
                high = log[grid >= percent / 100 - 1e-9]
                if not len(high) or high.max() >= log.max() - IMPOSSIBLE:
                    maybe.append(i)
            picked = pa.array(maybe, pa.int64())
            keep = []
            for i, x, y in zip(maybe, sets(column(batch, "text_a").take(picked), k), sets(column(batch, "text_b").take(picked), k)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": column(batch, "a").take(kept), "b": column(batch, "b").take(kept)})
            pa.default_memory_pool().release_unused()

    side = lambda s: members.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "registers", "text")))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


class Outside:
    """A bounded block of texts with their sets, registers and buckets, to be held against others."""

    def __init__(self, rows: list, k: int):
        self.node = np.array([r.node for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.size = np.array([r.n for r in rows], np.int64)
        self.drawn = np.stack([np.frombuffer(r.registers, np.uint16) for r in rows])
        self.sets = list(sets(pa.array([r.text for r in rows], pa.string()), k))
        self.at: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            for bucket in r.buckets:
                self.at.setdefault(bucket, []).append(i)

    def near(self, label: int, n: int, met: list[int], percent: int) -> np.ndarray:
        """Places of the block in other components that share a bucket and are of like size."""
        near = np.unique(np.array([i for bucket in met for i in self.at.get(bucket, ())], np.int64))
        near = near[self.label[near] != label]
        size = self.size[near]
        return near[100 * np.minimum(size, n) >= percent * np.maximum(size, n)]

    def links(self, near: np.ndarray, drawn: np.ndarray, elements: np.ndarray, percent: int) -> np.ndarray:
        """Nodes of those places that reach the threshold."""
        n, maybe = len(elements), []
        for i, agree in zip(near, (self.drawn[near] == drawn).sum(1)):
            if agree >= 0.9 * percent / 100 * M:
                maybe.append(i)
                continue
            grid, log = log_likelihood(drawn, self.drawn[i], n, int(self.size[i]))
            high = log[grid >= percent / 100 - 1e-9]
            if not len(high) or high.max() >= log.max() - IMPOSSIBLE:
                maybe.append(i)
        out = []
        for i in maybe:
            at = np.searchsorted(elements, self.sets[i])
            at[at == n] = 0
            both = int((elements[at] == self.sets[i]).sum())
            if 100 * both >= percent * (n + int(self.size[i]) - both):
                out.append(int(self.node[i]))
        return np.array(out, np.int64)


def rest(shared: DataFrame, labels: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components that hubs did not find.

    Members outside their hub's component are held, in blocks of bounded size, against every member of the buckets they are in. Members
    stay where they are: no pair becomes a row unless it is a link, and no bucket is gathered in one place.
    """
    placed = shared.join(labels, "node", "left").select("node", "bucket", "hub", F.coalesce("label", "node").alias("label"))
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    outside = written(placed.join(of_hub, "hub", "left").where(F.col("label") != F.coalesce("hub_label", "hub")).select("node", "bucket", "label"), "outside")
    if outside.isEmpty():
        return outside.select(F.col("node").alias("a"), F.col("node").alias("b"))
    gathered = lambda rows: rows.groupBy("node", "label").agg(F.collect_list("bucket").alias("buckets")).join(members, "node")  # noqa: E731  at most BANDS buckets each
    asked = written(gathered(outside), "asked")
    against = written(gathered(placed.join(outside.select("bucket").distinct(), "bucket", "left_semi")), "against")
    total = asked.agg(F.sum(F.octet_length("text") + 3 * M)).first()[0]
    blocks = -(-total // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        got = against.mapInArrow(_held_against(members.sparkSession.sparkContext.broadcast(rows), k, percent), "a bigint, b bigint")
        out = got if out is None else out.union(got)
    return out


def _held_against(shared, k: int, percent: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if _blocks.get("name") != name:
                _blocks.update(name=name, block=Outside(shared.value, k))
            block = _blocks["block"]
            a, b = [], []
            node, label, size = (column(batch, c).to_numpy() for c in ("node", "label", "n"))
            met = [block.near(int(label[i]), int(size[i]), m, percent) for i, m in enumerate(column(batch, "buckets").to_pylist())]
            some = [i for i, m in enumerate(met) if len(m)]  # only their texts are looked at
            kept = pa.array(some, pa.int64())
            for i, drawn, elements in zip(some, column(batch, "registers").take(kept), sets(column(batch, "text").take(kept), k)):
                found = block.links(met[i], np.frombuffer(drawn.as_buffer(), np.uint16), elements, percent)
                a += [node[i]] * len(found)
                b += found.tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            pa.default_memory_pool().release_unused()

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
                    text_hash: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: its set of distinct ``k``-word shingles, and the smallest id reachable over links of
    Jaccard similarity ``percent`` / 100 or more.

    Words are lower-cased (A-Z) runs between white space. A text with fewer than ``k`` words is one shingle; a null or empty text has none and
    is linked with nothing, so it is its own component. Rows with one id are one document; a null id counts as linked only as a copy (its
    component is the smallest id of its equals, or null). Other columns are not read. An empty table gives no rows. With ``text_hash`` a column of that name (xxhash64 of the text) tells
    rows of one id apart.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    drawn = written(sketch(plain, k), "sketches")
    classes = written(drawn.where("n > 0").groupBy("fa", "fb").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("registers").alias("registers")), "classes")
    nodes = classes.where("node is not null")
    laid = spread(nodes)
    hubs = laid.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("bucket", "hub")
    shared = written(laid.join(written(hubs, "hubs"), "bucket"), "buckets")  # written, so that Spark can split the join at a large bucket
    wanted = small(written(shared.select("node").distinct(), "wanted"))
    members = written(plain.join(wanted.withColumnRenamed("node", "id"), "id").join(nodes.select(F.col("node").alias("id"), "n", "registers"), "id")
                      .withColumnRenamed("id", "node"), "members")
    starred = shared.where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("bands"))
    starred = written(starred, "stars")
    first = starred.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    links = written(confirmed(first, members, k, percent), "links")
    labels = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs not in one component by now."""
        at = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))
        got = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
        return got.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")

    more = written(confirmed(apart(starred.join(first, ["a", "b"], "left_anti")), members, k, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)

    more = written(rest(shared, labels, members, k, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = classes.join(labels, "node", "left").select("fa", "fb", F.coalesce("label", "node").alias("component_id"))
    got = drawn.select("id", "text_hash", "n", "fa", "fb").join(named, ["fa", "fb"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return got.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"), *(["text_hash"] if text_hash else []))
