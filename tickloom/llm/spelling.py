"""Spelling variants: words one edit apart, and the far more frequent word that each is a form of.

Words are counted in the tasks that read the texts. Two words one edit apart share the first or the second half of the shorter one, so words meet by halves:
a group holds the words of one length, and those a letter longer, that share a prefix and a suffix but for a short rest. A group too large for a task is
split by halves of its rest, again without losing a pair, until the rest is one letter, where a group cannot exceed the alphabet and its square.

Within a group the rests are sorted. The edit matrix of a word against all of them is filled along the sorted list: rows up to the longest common prefix with
the entry before are shared by the whole range that has that prefix, only the band of one edit is kept, and a range is skipped when its row exceeds one edit. All
words of a task advance together, a letter at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import written
from tickloom.llm.text import LOWER, column, slices

LETTERS, TIMES, RATIO = 7, 2, 10  # least length and count of a word, least ratio of a form's count
DROP = 31  # of so many (document, run) pairs one loses a letter
GROUP = 4096  # rows of a group beyond which it is split by its rest
BLOCK = 1 << 15  # rows that advance together
HELD = 1 << 19  # words held by a task before they are sent on
_IN_RUN = np.zeros(256, bool)
_IN_RUN[65:91] = _IN_RUN[97:123] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


# ---------------------------------------------------------------- counting


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in every row, and their lengths in code points."""
    lead = data == 0xC3
    inside = _IN_RUN[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], inside]), np.concatenate([inside, [False]])
    start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    leads = np.concatenate([[0], np.cumsum(lead)])
    return start, end, end - start - (leads[end] - leads[start])


def check_sums(prefixes: np.ndarray, of: np.ndarray, letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of a prefix, given by its crc32, followed by bytes ``letters[first:first + size]``, for each entry of ``of`` (the prefixes' index)."""
    crc = prefixes[of] ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    crc, first, size = crc[order], first[order], size[order]
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))  # those longer than i
        crc[:n] = _CRC[(crc[:n] ^ letters[first[:n] + i]) & np.uint32(0xFF)] ^ crc[:n] >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(ids: list, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of at least ``LETTERS`` letters and their counts, a slice of texts at a time; a word may come more than once."""
    for low, high, data, offsets in slices(texts):
        start, end, points = runs(data, offsets)
        long = points >= LETTERS
        start, end, points = start[long], end[long], points[long]
        if not len(start):
            continue
        sizes = end - start
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        joined = LOWER[data[np.repeat(start - bounds[:-1], sizes) + np.arange(bounds[-1])]]
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined)).dictionary_encode()
        code, vocabulary = found.indices.to_numpy().astype(np.int64), found.dictionary
        doc = np.searchsorted(offsets, start, "right") - 1
        pair, times = np.unique(doc * len(vocabulary) + code, return_counts=True)
        doc, code = pair // len(vocabulary), pair % len(vocabulary)
        ends = np.frombuffer(vocabulary.buffers()[1], np.int32)[:len(vocabulary) + 1].astype(np.int64)
        letters = np.frombuffer(vocabulary.buffers()[2], np.uint8)
        prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[low:high]], np.uint32)
        crc = check_sums(prefixes, doc, letters, ends[code], (ends[1:] - ends[:-1])[code])
        cut = crc % DROP == 0
        yield vocabulary, np.bincount(code[~cut], times[~cut], minlength=len(vocabulary)).astype(np.int64)
        if cut.any():
            changed = []
            for c, h in zip(code[cut].tolist(), crc[cut].tolist()):
                word = letters[ends[c]:ends[c + 1]].tobytes().decode()
                at = h % len(word)
                changed.append(word[:at] + word[at + 1:])
            keep = np.array([len(w) >= LETTERS for w in changed])
            yield pa.array(changed, pa.string()).filter(pa.array(keep)), times[cut][keep]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts of a task, added up while they fit."""
    parts: list[pa.Table] = []

    def folded() -> pa.Table:
        got = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        parts[:] = [got]
        return got

    held = 0
    for batch in batches:
        for words, n in words_of(column(batch, "id").to_pylist(), column(batch, "text")):
            used = pa.array(n > 0)
            parts.append(pa.table({"word": words.filter(used), "n": pa.array(n).filter(used)}))
            held += parts[-1].num_rows
            if held > HELD:
                held = folded().num_rows
                if held > HELD // 2:
                    yield from parts.pop().to_batches(max_chunksize=1 << 16)
                    held = 0
    if parts:
        yield from folded().to_batches(max_chunksize=1 << 16)


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``LETTERS`` letters that occur ``TIMES`` times or more."""
    plain = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    return plain.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


# ---------------------------------------------------------------- near words


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points (all under 256) padded with 0, and their lengths."""
    encoded = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.array([len(w) for w in encoded], np.int64)
    width = int(size.max(initial=0)) + 1
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in encoded), np.uint8).reshape(len(encoded), width), size


def pairs_within(rest: np.ndarray, group: np.ndarray, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (word, other) of one group whose rests are one edit apart, for the words ``query`` with rests of ``length`` letters; ``other`` has as many or one more.

    ``rest`` holds rows of letters padded with 0, sorted within the groups, which are contiguous; rests of a group are distinct.
    """
    n, width = rest.shape
    same = rest[1:] == rest[:-1]
    prefix = np.where(same.all(1), width, same.argmin(1)) if n > 1 else np.zeros(0, np.int64)
    shared = np.concatenate([[-1], np.where(group[1:] == group[:-1], prefix, -1)])  # letters in common with the entry before
    ranges = np.flatnonzero(shared < 0)
    at = np.searchsorted(ranges, query, "right") - 1  # the range of t common letters that each word is being held against
    even, short = np.zeros(len(query), np.int8), np.full(len(query), 2, np.int8)  # edits against as many letters of the word, against one fewer
    left, right = [query[:0]], [query[:0]]
    for t in range(width):
        starts = np.flatnonzero(shared <= t)  # where ranges of t + 1 common letters begin
        first = np.searchsorted(starts, np.append(ranges, n))
        letters = rest[starts, t]
        keys = np.repeat(np.arange(len(ranges)), np.diff(first)) << 8 | letters
        fresh = np.flatnonzero(np.minimum(even, short) == 0)
        times = (first[1:] - first[:-1])[at[fresh]]
        item = [np.repeat(fresh, times)]
        child = [np.arange(len(item[0])) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[at[fresh]], times)]
        own, last = rest[query, t], rest[query, t - 1] if t else np.zeros(len(query), np.uint8)
        # after one edit only the next letter can follow, in either place of the band
        for spent in (np.flatnonzero((even == 1) & (short > 0)), np.flatnonzero((short == 1) & (even > 0) & ((even > 1) | (own != last)))):
            wanted = at[spent] << 8 | np.where(len(item) == 1, own[spent], last[spent])
            found = np.searchsorted(keys, wanted)
            ok = keys[np.minimum(found, len(keys) - 1)] == wanted
            item.append(spent[ok])
            child.append(found[ok])
        item, child = np.concatenate(item), np.concatenate(child)
        e, s, q, letter, size = even[item], short[item], query[item], letters[child], length[item]
        over = letter == 0  # the rest ends here
        hit = over & (starts[child] != q) & (np.where(t == size, e, np.where(t == size + 1, s, 2)) == 1)
        left.append(q[hit])
        right.append(starts[child[hit]])
        shorter = np.minimum(s + (letter != last[item]) if t else np.full(len(q), 2, np.int8), e + 1)
        evener = np.minimum(e + ((letter != own[item]) | (t >= size)), shorter + 1)
        alive = ~over & (np.minimum(evener, shorter) <= 1)
        query, length, at, even, short, ranges = q[alive], size[alive], child[alive], evener[alive].astype(np.int8), shorter[alive].astype(np.int8), starts
        if not len(query):
            break
    return np.concatenate(left), np.concatenate(right)


def best_near(table: pa.Table) -> pa.RecordBatch:
    """(word, n_near, form, form_n) of the words of whole groups (key, word, n, size, prefix, suffix) that have near words in them."""
    letters, length = letters_of(table["word"].combine_chunks())
    base, head, tail, n = (table[c].to_numpy().astype(np.int64) for c in ("size", "prefix", "suffix", "n"))
    group = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    size = length - head - tail
    width = int(size.max(initial=0)) + 1
    spots = np.arange(width)
    rest = np.where(spots < size[:, None], letters[np.arange(len(letters))[:, None], np.minimum(head[:, None] + spots, letters.shape[1] - 1)], 0).astype(np.uint8)
    order = np.lexsort([*rest.T[::-1], group])
    own = (base - head - tail)[order]
    query = np.flatnonzero(size[order] == own)
    left, right = pairs_within(rest[order], group[order], query, own[query])
    left, right = order[left], order[right]
    # a pair whose difference could stand in several halves belongs to that of its first difference
    differ = (letters[left] != letters[right]).argmax(1)
    keep = (tail[left] == 0) | (differ < base[left] - tail[left])
    left, right = left[keep], right[keep]
    longer = length[right] > length[left]
    me, other = np.concatenate([left, right[longer]]), np.concatenate([right, left[longer]])
    words = table["word"].combine_chunks()
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort([*letters.T[::-1]])] = np.arange(len(n))
    order = np.lexsort([rank[other], -n[other], me])
    me, other = me[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], me[1:] != me[:-1]])) if len(me) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_pydict({"word": words.take(pa.array(me[first])), "n_near": pa.array(np.diff(np.append(first, len(me)))),
                                       "form": words.take(pa.array(other[first])), "form_n": pa.array(n[other[first]])})


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups, sorted by key, in blocks of whole groups."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        keys = table["key"].combine_chunks()
        whole = pc.index(keys, keys[-1]).as_py()
        if whole:
            yield best_near(table.slice(0, whole))
        held, rows = table.slice(whole).to_batches(), len(table) - whole
    if rows:
        yield best_near(pa.Table.from_batches(held))


def halves(rows: DataFrame) -> DataFrame:
    """Every (word, n, size, prefix, suffix) twice: its rest less its first, and less its second half. ``size`` is the length of the shorter words of the group."""
    rest = F.col("size") - F.col("prefix") - F.col("suffix")
    first = F.floor(rest / 2).cast("int")
    split = rows.select("word", "n", "size", F.inline(F.array(F.struct((F.col("prefix") + first).alias("prefix"), F.col("suffix")), F.struct(F.col("prefix"), (F.col("suffix") + rest - first).alias("suffix")))))
    key = F.concat_ws(":", "size", "prefix", "suffix", F.substring(F.col("word"), F.lit(1), F.col("prefix")), F.expr("right(word, suffix)"))
    return split.withColumn("key", key)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near ones: their number, and the near word of largest count, first in order among equals.

    Words are distinct, of two letters or more, of code points 1-255.
    """
    length = F.length("word")
    rows = halves(words.select("word", "n", F.inline(F.array(*[F.struct((length - less).cast("int").alias("size"), F.lit(0).alias("prefix"), F.lit(0).alias("suffix")) for less in (0, 1)]))))
    parts = []
    while True:
        rows = written(rows, "halves")
        crowded = written(rows.where("size - prefix - suffix > 1").groupBy("key").count().where(F.col("count") > GROUP).select("key"), "crowded")
        if crowded.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(crowded, "key", "left_anti"))
        rows = halves(rows.join(crowded, "key", "left_semi").drop("key"))
    groups = parts[0]
    for part in parts[1:]:
        groups = groups.unionByName(part)
    found = groups.select("key", "word", "n", "size", "prefix", "suffix").repartition("key").sortWithinPartitions("key").mapInArrow(searched, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: how often it occurs, how many words are one inserted, deleted or replaced letter away, which of them
    is its form, and where following forms ends.

    A word is a run of letters ``A-Z``, ``a-z`` and U+00C0 to U+00FF with ``A-Z`` lowered; where ``DROP`` divides the crc32 of ``id:run``, the run loses the letter at that
    number modulo its length. A null id stands as the empty string there; null texts have no words. Repeated rows count each. The form is the near word of largest count, first in code-point
    order among equals, if its count is at least ``RATIO`` times the word's own. No texts: no rows.
    """
    words = written(vocabulary(docs, id_column, text_column), "words")
    near = near_words(words)
    form = F.col("form_n") >= RATIO * F.col("n")
    table = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(form, F.col("form")).alias("form"), F.when(form, F.col("form_n")).alias("form_n")), "forms")
    # counts grow by RATIO with each step, so the largest one bounds the steps; a round doubles those taken
    most = table.agg(F.max("n")).first()[0] or 1
    roots, steps = table.where("form is not null").select("word", F.col("form").alias("root")), 1
    while TIMES * RATIO**steps <= most:
        roots = written(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots, steps = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), 2 * steps
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
