"""Live order books from snapshot and diff messages, kept between micro-batches in the state store.

A book is one map for each side, price to quantity, and a head: the sequence it stands at, the time of its last image, and the diffs applied since. Books share stored states by the hash of their
key (``core.fold``): a micro-batch reads and writes the books of a bucket at once, so many books of few messages each do not cost a call for every level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import micros
from tickloom.streaming.core import fold

SIDES = ("bid", "ask")
MESSAGE = ("kind", "sequence_start", "sequence_end", "ts", "levels")
OUT = "kind string, sequence long, expected long, event_us long, side string, price double, quantity double, level int"


@dataclass(frozen=True)
class Images:
    """When an image of a book is put out: after ``interval`` seconds of event time or ``diffs`` diffs since the last one. ``depth``: levels of a side (None: all)."""

    interval: float = 60.0
    diffs: int = 1000
    depth: int | None = None


@dataclass
class Book:
    images: Images
    sides: dict[str, dict[float, float]]
    sequence: int | None = None
    event: int | None = None
    image: int | None = None
    diffs: int = 0

    def imaged(self) -> list[tuple]:
        rows = []
        for side, levels in self.sides.items():
            found = sorted(levels.items(), reverse=side == "bid")[:self.images.depth]
            rows += [("image", self.sequence, None, self.event, side, price, quantity, level) for level, (price, quantity) in enumerate(found, 1)]
        return rows or [("image", self.sequence, None, self.event, None, None, None, None)]

    def take(self, row: dict) -> list[tuple]:
        """Apply one message; the rows to put out."""
        event_us, first, last = row["__us"], row["sequence_start"], row["sequence_end"]

        def told(kind: str, at: int, expected: int | None = None) -> list[tuple]:
            return [(kind, at, expected, event_us, None, None, None, None)]

        snapshot = row["kind"] == "snapshot"
        if snapshot:
            self.sides = {side: {} for side in SIDES}
            self.sequence, self.event, self.image, self.diffs = last, event_us, event_us, 0
        elif self.sequence is None:
            return told("baseline", last)
        elif last < self.sequence + 1:
            return told("stale", last, self.sequence + 1)
        elif first > self.sequence + 1:
            return told("gap", first, self.sequence + 1)
        else:
            self.sequence, self.event, self.diffs = last, event_us, self.diffs + 1
        for level in row["levels"] if row["levels"] is not None else ():
            if level["quantity"] > 0:
                self.sides[level["side"]][level["price"]] = level["quantity"]
            else:
                self.sides[level["side"]].pop(level["price"], None)
        if snapshot or not (self.event - self.image >= self.images.interval * 1e6 or self.diffs >= self.images.diffs):
            return []
        self.image, self.diffs = self.event, 0
        return self.imaged()


def live_books(messages: DataFrame, keys: Sequence[str], images: Images = Images()) -> DataFrame:
    """Apply a stream of messages to one book for each value of ``keys``; rows (keys, kind, sequence, expected, event_us, side, price, quantity, level).

    A message has ``kind`` (snapshot or diff), ``sequence_start``, ``sequence_end``, ``ts`` and ``levels``, an array of (side, price, quantity): a snapshot replaces the book, a diff's quantity replaces
    that of its level, and none or less deletes it. Messages of a book are taken by time and sequence within a micro-batch. A diff is applied if it holds the next sequence number. Otherwise nothing changes and
    a row says why: ``baseline`` (no snapshot yet), ``gap`` (numbers are missing, a snapshot is needed) or ``stale``. ``image`` rows are the levels of a book, best first, when ``images`` says so; an empty book gives
    one without a level. The messages of a bucket of books in one micro-batch are sorted in memory, beside the levels of those books.
    """
    slim = messages.select(*keys, *MESSAGE, micros("ts").alias("__us"))
    columns = {f.name: f.dataType for f in T._parse_datatype_string(OUT).fields}

    def step(book: Book, row: dict) -> tuple[Book, list[tuple]]:
        return book, book.take(row)

    order = ["__us", "sequence_start", "sequence_end"]
    return fold(slim, keys, order, lambda: Book(images, {side: {} for side in SIDES}), step, columns, [*order, "kind", "levels"])
