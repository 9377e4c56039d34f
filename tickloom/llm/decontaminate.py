"""Benchmark decontamination by the q-gram lemma.

Text and items are lowered (A-Z) and runs of white space become one blank. An item of n bytes that occurs in a text with at most e edits shares at
least n - q + 1 - e * q of its q-grams with it, all within a band of e + 1 neighbouring diagonals (position in the text minus position in
the item). So q-grams of the text are looked up among those of the items, hits are counted in bands of width 2 * (e + 1) that overlap by half
(every e + 1 diagonals lie wholly inside one), bands that reach the bound are kept, and a banded alignment of the item with that stretch decides.
Items shorter than 2 * q are looked for as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import small, written
from tickloom.llm.text import IS_SPACE, LOWER, column, release, slices

Q = 12
ERROR_RATE = 0.07  # edits allowed for each byte of an item
BLOCK_BYTES = 8 << 20  # of items that one pass over the documents looks for
FILTER_BITS = 22
WINDOW_HITS = 1 << 20  # of q-grams spelt out at once
HEAD, TAIL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of a slice, where each came from, and the rows' offsets in them."""
    blank = IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = np.flatnonzero(~blank | np.concatenate([[True], ~blank[:-1]])[:len(blank)] | first[:-1])
    return np.where(blank[keep], np.uint8(0x20), LOWER[data[keep]]), keep, np.searchsorted(keep, offsets)


def normal(text: str) -> bytes:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return squeezed(data, np.array([0, len(data)]))[0].tobytes().strip()


def grams(text: np.ndarray) -> np.ndarray:
    """A 64-bit value of every run of Q bytes, from its first eight bytes and its last eight."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    held = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.ndarray((n + Q - 8,), "<u8", held, strides=(1,))
    out = word[:n] * HEAD
    out += word[Q - 8:] * TAIL
    return out


def budget(n: int) -> int:
    """Edits allowed in an item of n bytes: the rate, but no more than leave a shared q-gram certain."""
    return max(0, min(int(n * ERROR_RATE), (n - Q) // Q))


def alignment(item: bytes, stretch: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The least number of edits that turn ``item`` into a run of ``stretch``, with the run's ends, looking at diagonals low..high only.

    None if it takes more than ``most``. Row by row over the item; a row is the band. Insertions are settled by a running minimum.
    """
    n, width = len(item), high - low + 1
    exact = stretch[max(low, 0):max(high + n, 0)].tobytes().find(item)
    if exact >= 0:  # no edits on one of the diagonals: nothing can be less
        return 0, max(low, 0) + exact, max(low, 0) + exact + n
    t = np.full(n + width + 1, 256, np.int32)  # t[i + k] is the byte before diagonal low + k in row i
    at = np.arange(low - 1, low + n + width)
    inside = (at >= 0) & (at < len(stretch))
    t[inside] = stretch[at[inside]]
    steps = np.arange(width, dtype=np.int32)
    far = np.int32(1 << 20)
    ends = np.arange(low, high + 1)
    cost = np.where((ends >= 0) & (ends <= len(stretch)), 0, far).astype(np.int32)
    start = ends.copy()
    for i in range(1, n + 1):
        change = cost + (t[i:i + width] != item[i - 1])
        drop = np.concatenate([cost[1:] + 1, [far]])
        best = np.minimum(change, drop)
        begun = np.where(drop < change, np.concatenate([start[1:], [0]]), start)
        valid = (ends + i >= 0) & (ends + i <= len(stretch))
        best = np.where(valid, best, far)
        lead = best - steps
        run = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == run, steps, -1))
        cost, start = run + steps, begun[source]
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(k + low + n)) if cost[k] <= most else None


class Items:
    """Items of one block, and an index of their q-grams."""

    def __init__(self, ids: list[int], texts: list[str]):
        named = sorted({(i, normal(t or "")) for i, t in zip(ids, texts)})
        self.ids = [i for i, _ in named]
        self.text = [t for _, t in named]
        self.edits = np.array([budget(len(t)) for t in self.text], np.int64)
        self.need = np.array([len(t) for t in self.text], np.int64) - Q + 1 - self.edits * Q
        self.short = [(k, t) for k, t in enumerate(self.text) if 0 < len(t) < 2 * Q]
        made = [grams(np.frombuffer(t, np.uint8)) if len(t) >= 2 * Q else np.zeros(0, np.uint64) for t in self.text]
        gram, item, at = np.concatenate([*made, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(made)), [len(m) for m in made]), np.concatenate([*(np.arange(len(m)) for m in made), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.at = gram[order], item[order], at[order].astype(np.int64)
        # stretches of an item where one byte goes on: q-gram -> (item, first place, last place)
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        one = np.flatnonzero(np.isin(self.gram, np.concatenate([grams(np.full(Q, b, np.uint8)) for b in range(256)])))
        self.repeated, self.longest = np.bincount(self.item[one], minlength=len(self.text)), max(map(len, self.text), default=0)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(self.gram[one]) != 0) | (np.diff(self.item[one]) != 0) | (np.diff(self.at[one]) != 1)])[:len(one)])
        begin, ends = one[cut], one[np.append(cut[1:], len(one))[:len(cut)] - 1]
        for low, high in zip(begin.tolist(), ends.tolist()):
            self.runs.setdefault(int(self.gram[low]), []).append((int(self.item[low]), int(self.at[low]), int(self.at[high])))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.gram >> np.uint64(64 - FILTER_BITS)] = True

    def regions(self, text: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, lowest diagonal of a band) wherever a band of a row has q-grams enough.

        A byte repeated in the text meets one repeated in an item as a whole: how many of the item's q-grams a band gets from the two runs follows from their ends. All other
        hits are spelt out, a window of the text at a time; windows overlap by the longest item and its band, so a region lies wholly inside one.
        """
        value = grams(text)
        hit = np.flatnonzero(self.maybe[value >> np.uint64(64 - FILTER_BITS)])
        low, high = np.searchsorted(self.gram, value[hit], "left"), np.searchsorted(self.gram, value[hit], "right")
        known = high > low
        hit, low, high = hit[known], low[known], high[known]
        if not len(hit):
            return
        ends = rows[np.searchsorted(rows, hit, "right")]
        inside = hit + Q <= ends  # not across a row's end
        hit, low, high = hit[inside], low[inside], high[inside]
        again = (np.diff(hit) == 1) & (value[hit[1:]] == value[hit[:-1]])
        in_run = np.concatenate([[False], again]) | np.concatenate([again, [False]]) if len(hit) else again
        near: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        yielded: set[tuple[int, int, int]] = set()
        for row, item, band, count in self._counted(hit[~in_run], low[~in_run], high[~in_run], rows):
            sure = count >= self.need[item]
            for r, k, b in zip(row[sure].tolist(), item[sure].tolist(), band[sure].tolist()):
                if (r, k, b) not in yielded:
                    yielded.add((r, k, b))
                    yield r, k, b * (int(self.edits[k]) + 1)
            for r, k, b, c in zip(row[~sure].tolist(), item[~sure].tolist(), band[~sure].tolist(), count[~sure].tolist()):
                near.setdefault((r, k), []).append((np.array([b]), np.array([c])))
        hit, low = hit[in_run], low[in_run]
        if not len(hit):
            return
        first = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (value[hit[1:]] != value[hit[:-1]])]))
        meets: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for begin, end, entry in zip(hit[first].tolist(), hit[np.append(first[1:], len(hit)) - 1].tolist(), low[first].tolist()):
            r = int(np.searchsorted(rows, begin, "right")) - 1
            for k, x, y in self.runs[int(self.gram[entry])]:
                meets.setdefault((r, k), []).append((begin - int(rows[r]), end - int(rows[r]), x, y))
        for (r, k), several in meets.items():
            half, parts = int(self.edits[k]) + 1, near.get((r, k), [])
            for p1, p2, a1, a2 in several:
                b = np.arange((p1 - a2) // half - 1, (p2 - a1) // half + 1)
                parts.append((b, np.maximum(np.minimum(a2, p2 - b * half) - np.maximum(a1, p1 - (b + 2) * half + 1) + 1, 0)))
            bands, of = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
            for b in bands[np.bincount(of, np.concatenate([c for _, c in parts])) >= self.need[k]].tolist():
                if (r, k, b) not in yielded:
                    yield r, k, b * half

    def _counted(self, hit: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, item, band, q-grams of the item in it) of bands that have enough, but for those that runs of one byte may add."""
        if not len(hit):
            return
        reach = 2 * (self.longest + int(self.edits.max()) + 1)
        total = np.cumsum(high - low)
        begin = 0
        while begin < len(hit):
            end = int(np.searchsorted(total, total[begin] + WINDOW_HITS, "right"))
            end = max(end, int(np.searchsorted(hit, hit[begin] + 2 * reach, "left")))
            yield from self._bands(hit[begin:end], low[begin:end], high[begin:end], rows)
            begin = end if end >= len(hit) else int(np.searchsorted(hit, hit[end] - reach, "left"))

    def _bands(self, hit: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        times = high - low
        pos = np.repeat(hit, times)
        entry = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        row, item = np.searchsorted(rows, pos, "right") - 1, self.item[entry]
        least = np.maximum(self.need - self.repeated, 1)
        pair = row * len(self.text) + item
        order = np.argsort(pair, kind="stable")
        edge = np.flatnonzero(np.diff(pair[order], prepend=-1))
        count = np.empty(len(pair), np.int64)
        count[order] = np.repeat(np.diff(edge, append=len(pair)), np.diff(edge, append=len(pair)))
        kept = count >= least[item]  # enough at all
        pos, entry, row, item = pos[kept], entry[kept], row[kept], item[kept]
        if not len(pos):
            return
        half = self.edits[item] + 1
        band = (pos - rows[row] - self.at[entry]) // half
        key = np.concatenate([np.stack([row, item, band - shift, self.at[entry]], 1) for shift in (0, 1)])
        once = np.unique(key, axis=0)  # a q-gram of the item counts once in a band
        bands, count = np.unique(once[:, :3], axis=0, return_counts=True)
        enough = count >= least[bands[:, 1]]
        yield bands[enough, 0], bands[enough, 1], bands[enough, 2], count[enough]

    def found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first code point, end code point, edits) of every confirmed region in a slice."""
        text, origin, rows = squeezed(data, offsets)
        got: dict[tuple[int, int, int], tuple[int, int]] = {}  # by row, item and end: edits and start
        if len(self.gram):
            for r, k, diagonal in self.regions(text, rows):
                e = int(self.edits[k])
                best = alignment(self.text[k], text[rows[r]:rows[r + 1]], diagonal - e, diagonal + 2 * e + 1 + e, e)
                if best and best[:1] < got.get((r, k, best[2]), (e + 1,)):
                    got[r, k, best[2]] = best[0], best[1]
        for r in range(len(rows) - 1) if self.short else ():
            line = text[rows[r]:rows[r + 1]].tobytes()
            for k, t in self.short:
                at = line.find(t)
                while at >= 0:
                    got[r, k, at + len(t)] = 0, at
                    at = line.find(t, at + 1)
        held = None
        for (r, k, end), (edits, start) in sorted(got.items()):
            if r != held:
                held, points = r, np.cumsum((data[offsets[r]:offsets[r + 1]] & 0xC0) != 0x80)
            low, high = (int(origin[rows[r] + x] - offsets[r]) for x in (start, end - 1))
            yield r, k, int(points[low]) - 1, int(points[high]), edits


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
          item_text_column: str = "text") -> DataFrame:
    """(id, item_id, start, end, edits) for every stretch of a text that is an item within its edit budget; code points, end exclusive.

    The documents are only scanned: items are broadcast in blocks of about ``BLOCK_BYTES``, one pass for each block. An item's budget is
    ``ERROR_RATE`` of its normalised bytes. Null or empty texts and items match nothing; items with equal texts are each reported; rows are
    independent, so a repeated or null id gives its rows again. Other columns are not read. Empty tables give no rows.
    """
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, item_id bigint, start bigint, end bigint, edits int"
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def scan(block: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            index = Items([i for i, _ in shared.value], [t for _, t in shared.value])
            for batch in batches:
                hits = []
                for first, _, data, offsets in slices(column(batch, "text")):
                    hits += [(first + r, index.ids[k], s, t, e) for r, k, s, t, e in index.found(data, offsets)]
                rows, ids, start, end, edits = zip(*hits) if hits else ((), (), (), (), ())
                yield pa.RecordBatch.from_pydict({
                    "id": column(batch, "id").take(pa.array(rows, pa.int64())), "item_id": pa.array(ids, pa.int64()), "start": pa.array(start, pa.int64()),
                    "end": pa.array(end, pa.int64()), "edits": pa.array(edits, pa.int32())})

        return plain.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        out = out.union(scan(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)))
    return out.withColumnRenamed("id", id_column)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark; all columns stay. Matches are few, so they are written once and anti-joined
    by id and text hash: rows of one id, or of none, are judged each by its own text."""
    text = F.col(text_column).cast("string")
    named = docs.select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text).alias("hash")).alias("_key"), text.alias("_text"))
    hit = written(leaks(named, benchmark, "_key", "_text").select(F.col("_key.id").alias("_hit"), F.col("_key.hash").alias("_hash")).distinct(), "leaks")
    return docs.join(small(hit), docs[id_column].eqNullSafe(F.col("_hit")) & F.xxhash64(docs[text_column].cast("string")).eqNullSafe(F.col("_hash")), "left_anti")
