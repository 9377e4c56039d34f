"""Language of a text by bit-sliced Bloom filters over character n-grams.

Every language has a Bloom filter of the n-grams that are usual in it; the filters share their positions, so that one slot holds a bit for each language.
The slots of an n-gram, and-ed, give all languages that have it. A text's votes for a language are the n-grams whose bit is set, less those expected
from false positives at that language's fill.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import written
from tickloom.llm.text import column, mix, slices

GRAMS = (3, 4)
RATE = 1e-5  # least share of a language's n-grams; so a language has at most 1 / RATE of them in its filter
SHARE = 0.5  # an n-gram belongs to the languages where its share is at least this part of its largest one
HASHES, SLOTS_A_GRAM = 3, 10
MOST_LANGUAGES = 512  # with 1 / RATE this bounds the filters: 64 MB; more distinct labels are an error
HELD = 1 << 21  # counts held by a task before they are sent on
UNKNOWN = "und"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form, or 0 outside words (letters and the marks on them); and whether it is a letter."""
    if not _tables:
        lower, alpha = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                lower[i], alpha[i] = ord(c.lower()[0]), True
            elif i > 127 and unicodedata.category(c)[0] == "M":
                lower[i] = i
        _tables[:] = [lower, alpha]
    return _tables[0], _tables[1]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte each starts at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.uint32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        rest = np.concatenate([data, np.zeros(3, np.uint8)])
        more = [(rest[at[wide] + i] & 0x3F).astype(np.uint32) for i in (1, 2, 3)]
        lead = points[wide]
        points[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | more[0], np.where(lead < 0xF0, (lead & 0x0F) << 12 | more[0] << 6 | more[1],
                                (lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
    return np.minimum(points, 0x10FFFF), at


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length in ``GRAMS`` the 64-bit hashes of the n-grams of every row and the first of each row; and whether a row has a letter.

    Lower-case words stand between single blanks, anything else is a blank; an n-gram has blanks at its ends only.
    """
    lower, alpha = letters()
    points, at = code_points(data)
    first = np.searchsorted(at, offsets)
    n = np.concatenate([[0], np.cumsum(alpha[points])])
    has_letter = n[first[1:]] > n[first[:-1]]
    chars = np.insert(lower[points], first[:-1], 0)  # a blank before every row
    first = first + np.concatenate([np.arange(len(first) - 1), [len(first) - 1]])
    inside = chars != 0
    keep = inside | np.concatenate([[True], inside[:-1]])
    keep[first[:-1]] = True  # a second blank beside it makes no n-gram
    kept = np.concatenate([[0], np.cumsum(keep)])
    chars, first = np.concatenate([chars[keep], np.zeros(1, np.uint32)]).astype(np.uint64), kept[first]
    inside = chars != 0
    out = []
    for n in GRAMS:
        size = max(len(chars) - n + 1, 0)
        ok = np.ones(size, bool)
        hashed = np.full(size, np.uint64(n))
        for i in range(n):
            hashed = hashed * _FACTOR + chars[i:i + size]
            if 0 < i < n - 1:
                ok &= inside[i:i + size]
        before = np.concatenate([[0], np.cumsum(ok)])
        # an n-gram that starts at the blank before a row belongs to that row, for a blank is first in it
        out.append((mix(hashed[ok]), before[np.minimum(first, size)]))
    return out, has_letter


class Counts:
    """N-grams of each language, added up in a task."""

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, language: str, hashed: np.ndarray) -> None:
        got = np.unique(hashed, return_counts=True)
        self.parts.setdefault(language, []).append(got)
        self.size += len(got[0])
        if self.size > HELD:
            self.fold()

    def fold(self) -> None:
        for language, parts in self.parts.items():
            keys, times = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys)
            keys, times = keys[order], times[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts[language] = [(keys[start], np.add.reduceat(times, start))] if len(keys) else []
        self.size = sum(len(k) for parts in self.parts.values() for k, _ in parts)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        for language, parts in self.parts.items():
            for keys, times in parts:
                for i in range(0, len(keys), 1 << 16):
                    k = keys[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"lang": pa.repeat(language, len(k)), "gram": pa.array(k.view(np.int64)), "n": pa.array(times[i:i + (1 << 16)])})
        self.parts, self.size = {}, 0


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        known = np.array(column(batch, "lang").to_pylist(), object)
        for low, high, data, offsets in slices(column(batch, "text")):
            by, _ = grams(data, offsets)
            names, code = np.unique(known[low:high].astype(str), return_inverse=True)
            for hashed, first in by:
                of = np.repeat(code, np.diff(first))
                for i, name in enumerate(names):
                    counts.add(str(name), hashed[of == i] if len(names) > 1 else hashed)
        if counts.size > HELD // 2:
            yield from counts.batches()
    yield from counts.batches()


class Filters:
    """Bloom filters of all languages, bit-sliced: ``slots[word, position]`` has bit l % 64 of word l // 64 set where language l has the position."""

    def __init__(self, languages: list[str], slots: np.ndarray, usual: int):
        self.languages, self.slots, self.usual = languages, slots, usual
        fill = np.array([np.count_nonzero(slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]) / max(slots.shape[1], 1)
        self.false = fill**HASHES

    def holders(self, hashed: np.ndarray) -> np.ndarray:
        """A word of bits for each n-gram and 64 languages."""
        low, high, m = hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32) | np.uint64(1), np.uint64(self.slots.shape[1])
        out = self.slots[:, (low % m).astype(np.int64)]
        for j in range(1, HASHES):
            out &= self.slots[:, ((low + np.uint64(j) * high) % m).astype(np.int64)]
        return out

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected votes of each row for each language, and whether it has a letter."""
        by, has_letter = grams(data, offsets)
        seen, total = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for hashed, first in by:
            held = self.holders(hashed)
            total += np.diff(first)
            for i in range(len(self.languages)):
                hits = np.concatenate([[0], np.cumsum(held[i // 64] >> np.uint64(i % 64) & np.uint64(1), dtype=np.int64)])
                seen[:, i] += np.diff(hits[first])
        room = np.maximum(1 - self.false, 1e-9)
        return np.maximum((seen - total[:, None] * self.false) / room, 0), has_letter

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, _, data, offsets in slices(texts):
            votes, has_letter = self.votes(data, offsets)
            most, total = votes.max(1), votes.sum(1)
            chosen = np.where(most > 0, votes.argmax(1), self.usual)
            names += [self.languages[c] if ok else UNKNOWN for c, ok in zip(chosen, has_letter)]
            scores.append(np.where(has_letter & (total > 0), most / np.maximum(total, 1e-300), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(known: DataFrame) -> Filters | None:
    """Filters of the languages in ``known`` (text, lang); None if it has no n-gram.

    All texts are counted. What comes to the driver is one row for each language and slots in use, at most ``HASHES / RATE`` for each language.
    """
    counts = written(known.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = sorted((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return None
    languages = [name for name, _ in totals]
    index = known.sparkSession.createDataFrame([(name, i, n) for i, (name, n) in enumerate(totals)], "lang string, at int, total long")
    usual = counts.join(F.broadcast(index), "lang").select("gram", "at", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= RATE)
    held = usual.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("at", "rate")).alias("by"))  # a row for each language at most
    held = written(held.select("gram", F.inline("by"), "top").where(F.col("rate") >= SHARE * F.col("top")).select("gram", "at"), "usual")
    largest = held.groupBy("at").count().agg(F.max("count")).first()[0]
    m = SLOTS_A_GRAM * largest + 1
    low, high = F.col("gram").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("gram", 32).bitwiseOR(1)
    places = held.select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, at % 64)").alias("bit"), F.explode(F.array(*[(low + j * high) % m for j in range(HASHES)])).alias("slot"))
    rows = places.groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    slots = np.zeros((-(-len(languages) // 64), m), np.uint64)
    slots[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filters(languages, slots, max(range(len(totals)), key=lambda i: (totals[i][1], -i)))


def predicted_languages(docs: DataFrame, training: str = "true", lang_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the language of most corrected votes, and its share of all of them.

    Learns from all rows for which the SQL condition ``training`` holds and whose language is not null; at most ``MOST_LANGUAGES`` distinct ones. A null text, or one
    without a letter, is ``und`` with score 0. So is every text if nothing could be learnt. A text without a known n-gram gets the language of most training text, with score 0;
    ties go to the first by name. Repeated rows teach and are answered each; null ids are answered, and teach if ``training`` holds for them.
    """
    text = F.col(text_column).cast("string")
    known = docs.where(training).where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(text.alias("text"), F.col(lang_column).cast("string").alias("lang"))
    filters = fit(known)
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    if filters is None:
        return plain.select(F.col("id").alias(id_column), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(column(batch, "text"))
            yield pa.RecordBatch.from_pydict({"id": column(batch, "id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return plain.mapInArrow(answered, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)
