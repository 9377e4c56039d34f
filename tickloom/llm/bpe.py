"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

A pre-token's merged form is unique, and so is the merged form of each of its prefixes. So one token is stored for every prefix: the last
of that prefix's encoding. A vocabulary token ending at the prefix's end (found by an automaton that reports all suffix matches) is that last
token if and only if the remaining prefix's own last token may stand before it, which is a test on the pair alone: no merge across their
border would have been done before the merges that make the two. Following the stored tokens back from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pretokens import LETTER, NUMBER, Splitter, byte_alphabet
from tickloom.llm.text import column, release

PATTERN = rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
CACHE_BYTES = 72 << 20  # of pre-tokens and their ids in a worker
ENTRY_BYTES = 220  # of the objects and the dictionary's slot of an entry, beside its letters and ids
PAIR_ENTRIES = 150_000
SENT_BYTES = 4 << 20  # of text whose ids are held before they are sent on
_codecs: dict[str, Codec] = {}


class Flat:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.length = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        at = np.repeat(self.start[ids] - (end - length), length)
        at += np.arange(len(at))
        return self.data[at].tobytes()


class Pieces(dict):
    """Pre-token to its ids as bytes of uint32; encoded when first asked for. At half of ``CACHE_BYTES`` what is here becomes the old generation, and the
    old one before it is forgotten but for the pre-tokens asked for since."""

    def __init__(self, ids):
        super().__init__()
        self.ids, self.old, self.bytes = ids, {}, 0

    def __missing__(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            made = np.array(self.ids(piece), np.uint32).tobytes()
        self.bytes += len(piece) + len(made) + ENTRY_BYTES
        if 2 * self.bytes > CACHE_BYTES:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[piece] = made
        return made


class Codec:
    """Encoder and decoder of one vocabulary file, with bounded caches. One lives in each Python worker.

    ``size``: only tokens of smaller ids, which is the vocabulary after its first merges.
    """

    def __init__(self, path: str, size: int | None = None):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = {t: i for t, i in model["vocab"].items() if size is None or i < size}
        back = {c: b for b, c in byte_alphabet().items()}
        raw = {t: bytes(back[c] for c in t) for t in vocab}
        self.splitter = Splitter(path, PATTERN, fold=False)
        by_id = {i: raw[t] for t, i in vocab.items()} | {i: s.encode() for s, i in self.splitter.special.items()}
        self.bytes_of = Flat([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self.decimal = Flat([b"%d," % i for i in range(max(by_id) + 1)])
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(raw[t].decode("latin-1"), (i, len(raw[t])))
        self.automaton.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}  # pair -> the token it becomes
        self.order: dict[int, int] = {}  # token -> when its merge is done; bytes: before all
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab.get(left + right)
            if whole is None:
                break
            self.merged[vocab[left], vocab[right]] = whole
            if whole not in self.halves:
                self.halves[whole], self.order[whole] = (vocab[left], vocab[right]), rank
        self.pairs: dict[int, bool] = {}  # left << 32 | right
        self.cache = Pieces(self.ids)

    def forget(self) -> None:
        """Empty the caches."""
        self.cache.clear()
        self.cache.old, self.cache.bytes = {}, 0
        self.pairs.clear()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are left alone.

        The border is looked at backwards in time: undo the later of the two tokens' merges (of equal ones the right's, as the leftmost
        merge of a rank is done first). The pair then facing each other at the border must not merge before the one just undone.
        """
        a, b, until, order = left, right, 1 << 60, self.order
        fine = True
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and order[whole] < until:
                fine = False
                break
            at_a, at_b = order.get(a, -1), order.get(b, -1)
            if at_a < 0 and at_b < 0:
                break
            if at_a > at_b:
                until, a = at_a, self.halves[a][1]  # a merge of this very rank across the border would come later, from the right
            else:
                until, b = at_b + 1, self.halves[b][0]  # across the border comes first, being further left
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        self.pairs[left << 32 | right] = fine
        return fine

    def ids(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return self.ids_of_bytes(piece if piece.isascii() else piece.encode("utf-8").decode("latin-1"))

    def ids_of_bytes(self, text: str) -> list[int]:
        """Ids of one pre-token, given as one character for each byte."""
        last: list[int] = [-1] * (len(text) + 1)
        width = last.copy()
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(text):  # for each end, the longest suffix first
            end += 1
            if last[end] >= 0:
                continue
            if end == size:
                last[end], width[end] = token, size
            elif (left := last[end - size]) >= 0:
                fine = pairs.get(left << 32 | token)
                if fine is None:
                    fine = self.compatible(left, token)
                if fine:
                    last[end], width[end] = token, size
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= width[at]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        parts = [special.to_bytes(4, "little") if pieces is None else b"".join(map(self.cache.__getitem__, pieces)) for special, pieces in self.splitter.split(text)]
        return np.frombuffer(b"".join(parts), np.uint32)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Ids in decimal, joined by commas."""
        return self.decimal.join(ids)[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; broken UTF-8 gives replacement characters."""
        return self.bytes_of.join(ids).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every text and decode it again: (id, ids array<int> if ``keep_ids``, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty: no tokens, digests of the empty string. Rows are independent (repeated ids give repeated rows; a null id stays
    null); other columns are not read. ``path`` is a vocabulary file every worker can read.
    """

    def coded(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids_column = column(batch, "text"), column(batch, "id")
            low, held, rows = 0, 0, []
            for high in range(1, batch.num_rows + 1):
                text = texts[high - 1].as_py() or ""
                ids = c.encode(text)
                held += len(text)
                rows.append((len(ids), hashlib.sha256(c.decimals(ids)).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), ids.astype(np.int32) if keep_ids else None))
                if held >= SENT_BYTES or high == batch.num_rows:
                    counts, ids_sha, text_sha, ids_of = zip(*rows)
                    out = {"id": ids_column[low:high], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                    if keep_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate(ids_of)))
                    yield pa.RecordBatch.from_pydict(out)
                    low, held, rows = high, 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        c = codec(path)
        try:
            yield from coded(batches, c)
        finally:  # an idle worker keeps the vocabulary only
            c.forget()
            release()

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    got = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)
    return got.withColumnRenamed("id", id_column)
