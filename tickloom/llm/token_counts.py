"""Token counts without a shuffle of texts or pre-tokens.

Two tiers hold the lengths of pre-tokens: a compact table of frequent ones, broadcast to every task, and a bounded cache in each Python
worker, filled by the tokenizers library's own merge model when a pre-token is first met. Rows never leave their partition.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pretokens import LETTER, NUMBER, Splitter, byte_alphabet
from tickloom.llm.text import column

PATTERN = rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"
FREQUENT = 32_768  # entries of the broadcast table at most
WARM_SHARE = 64  # of so many texts, told by a hash, one has its pre-tokens counted to choose the table's entries; it saves work and never changes a count
HELD = 10  # times the table's entries that a task counts at most
CACHE_ENTRIES = 600_000
_counters: dict[str, TokenCounter] = {}


class Lengths(dict):
    """First tier, falling through to the worker's cache."""

    def __init__(self, known, miss):
        super().__init__(known)
        self.__dict__["miss"] = miss

    def __missing__(self, piece: str) -> int:
        return self.miss[piece]


class Cache(dict):
    """Second tier: lengths met by this worker; the older half is forgotten when full."""

    def __init__(self, measure):
        super().__init__()
        self.measure = measure

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            for old in list(islice(self, CACHE_ENTRIES // 2)):
                del self[old]
        n = self[piece] = self.measure(piece)
        return n


class TokenCounter:
    """Counts the tokens of texts; one lives in each Python worker."""

    def __init__(self, path: str):
        self.splitter = Splitter(path, PATTERN, fold=True)
        self.model = self.splitter.tokenizer.model
        self.alphabet = byte_alphabet()
        self.cache = Cache(self.measure)
        self.lengths = Lengths({}, self.cache)

    def measure(self, piece: str) -> int:
        return len(self.model.tokenize(piece if piece.isascii() and piece.isprintable() else "".join(self.alphabet[b] for b in piece.encode("utf-8"))))

    def load(self, table: dict[str, int]) -> None:
        if len(self.lengths) != len(table):
            self.lengths = Lengths(table, self.cache)

    def count(self, text: str) -> int:
        return sum(1 if pieces is None else sum(map(self.lengths.__getitem__, pieces)) for _, pieces in self.splitter.split(text))


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def frequent_lengths(docs: DataFrame, path: str, text_column: str = "text", share: int = WARM_SHARE, entries: int = FREQUENT) -> tuple[bytes, bytes]:
    """The broadcast table as packed words and one byte of length each; at most ``entries``. Sampled texts are counted where they are read, and only words with counts move."""

    def counted(batches):
        seen: Counter[str] = Counter()
        c = counter(path)
        for batch in batches:
            for text in column(batch, "text"):
                for _, pieces in c.splitter.split(text.as_py() or ""):
                    seen.update(pieces or ())
                if len(seen) > 2 * HELD * entries:
                    seen = Counter(dict(seen.most_common(HELD * entries)))
        words = [(w, n) for w, n in seen.most_common(entries) if len(w) < 64]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in words], pa.string()), "n": pa.array([n for _, n in words], pa.int64())})

    text = F.col(text_column).cast("string")
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    top = sample.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    words = [r.word for r in top.collect()]
    c = counter(path)
    return "\n".join(words).encode("utf-8"), np.array([c.measure(w) for w in words], np.uint8).tobytes()


def token_counts(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit = n_tokens > ``limit``) of every text, as the library counts them without added special tokens.

    A null text counts as empty (0 bytes, 0 tokens). Rows are independent: repeated ids give repeated rows, a null id stays null; other
    columns are not read. No truncation, at any length.
    """
    packed = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        words, lengths = packed.value
        c.load(dict(zip(words.decode("utf-8").split("\n"), lengths)) if words else {})
        for batch in batches:
            counts = [c.count(text.as_py() or "") for text in column(batch, "text")]
            yield pa.RecordBatch.from_pydict({"id": column(batch, "id"), "n_bytes": column(batch, "n_bytes"), "n_tokens": pa.array(counts, pa.int64())})

    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    got = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return got.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
