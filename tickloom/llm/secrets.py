"""Secrets in texts, with DataFrame functions only.

Three kinds are patterns: ``assign`` (a key word, a sign and a value of 8+), ``access`` (AKIA..., 16+) and ``hex`` (32+ digits). A fourth, ``random``, is
what a battery of randomness tests finds among long runs of key characters. An alphabet is inferred for a run (hex, base 32, base 62 or 64),
and three statistics are tested against uniform drawing from it: chi-squared of the character counts, runs above and below the middle of the
alphabet, and correlation of neighbours. Fisher's sum joins the three p-values into one. For drawn strings it is uniform, for words it
is near 0, so in each class of encoding and length the p-values above one half tell how many strings are drawn; the cut of the class is the
lowest at which no more than ``FDR`` of the accepted are estimated to be words (counts within two standard errors pass). A class with fewer than
``FEW`` strings above one half is too small to tell; its cut is not below ``SMALL_CUT``. Each distinct string counts once, however often it
stands in the texts. Cuts come from a histogram of at most a few thousand cells over the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import small, written

# Fixed values of the patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run that begins with AKIA holds no longer one, so this is the + form without its failing matches
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"

FDR, BINS = 0.01, 50
FEW, SMALL_CUT = 10, 0.02
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def _matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Each match with the length of what lies between it and the one before; (kind, place, gap, size, kept, run)."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def entry(x: Column, i: Column) -> Column:
        kept = F.length(x["part"]) >= 8 if group else F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), kept.alias("kept"),
                        (x["whole"] if kind == 3 else F.lit(None).cast("string")).alias("run"))

    found = F.filter(F.transform(parts, entry), lambda x: x["size"].isNotNull())  # after the last gap there is no match
    return F.when(text.rlike(pattern), found)


def _tail(z: Column) -> Column:
    """Chance of a standard normal value above z (logistic form, within 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def randomness(runs: DataFrame) -> DataFrame:
    """``runs`` (with a string column ``run``) with encoding, n and p: the chance of tests at least as bad for a string drawn from the encoding."""
    core = F.regexp_replace("run", "=+$", "")
    encoding = (F.when(F.col("core").rlike(r"^[0-9a-f]+$|^[0-9A-F]+$"), "hex").when(F.col("core").rlike("^[A-Z2-7]+$"), "base32")
                .when(F.col("core").rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64"))
    alphabet = F.when(F.col("encoding") == "hex", ALPHABETS["hex"]).when(F.col("encoding") == "base32", ALPHABETS["base32"]).when(
        F.col("encoding") == "base62", ALPHABETS["base62"]).otherwise(ALPHABETS["base64"])
    plain = F.when(F.col("encoding") == "hex", F.lower("core")).otherwise(F.translate("core", "-_", "+/"))
    got = runs.withColumn("core", core).withColumn("encoding", encoding).withColumn("alphabet", alphabet).withColumn("core", plain)
    got = got.withColumn("n", F.length("core").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda s, c: s + F.pow(F.col("n") - F.length(F.replace(F.col("core"), c, F.lit(""))), 2))
    got = got.withColumn("chi", F.col("k") / F.col("n") * squares - F.col("n"))
    df = F.col("k") - 1
    got = got.withColumn("p_chi", _tail((F.pow(F.greatest(F.col("chi"), F.lit(1e-9)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))))
    # One pass over the characters: how many are high, how often that changes, and the sums of the neighbours' correlation.
    zero = F.struct(F.lit(-1.0).alias("last"), *(F.lit(0.0).alias(c) for c in ("high", "turns", "sum", "squares", "products")))

    def step(s: Column, c: Column) -> Column:
        x = F.instr(F.col("alphabet"), c).cast("double") - 1
        half, begun = F.col("k") / 2, s["last"] >= 0
        turn = F.when(begun & ((x >= half) != (s["last"] >= half)), 1.0).otherwise(0.0)
        return F.struct(x.alias("last"), (s["high"] + F.when(x >= half, 1.0).otherwise(0.0)).alias("high"), (s["turns"] + turn).alias("turns"),
                        (s["sum"] + x).alias("sum"), (s["squares"] + x * x).alias("squares"), (s["products"] + F.when(begun, x * s["last"]).otherwise(0.0)).alias("products"))

    got = got.withColumn("s", F.aggregate(F.split("core", ""), zero, step))
    n, high, mean = F.col("n"), F.col("s.high"), F.col("s.sum") / F.col("n")
    low = n - high
    expected = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    got = got.withColumn("p_runs", F.when((high == 0) | (low == 0), F.lit(1e-6)).otherwise(2 * _tail(F.abs(F.col("s.turns") + 1 - expected) / spread)))
    variance = F.greatest(F.col("s.squares") - n * mean * mean, F.lit(1e-9))
    serial = (F.col("s.products") - (n - 1) * mean * mean) / variance
    got = got.withColumn("p_serial", 2 * _tail(F.abs(serial) * F.sqrt(n)))
    half = -sum((F.log(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(1e-12))) for c in ("p_chi", "p_runs", "p_serial")), F.lit(0.0))
    return got.withColumn("p", F.exp(-half) * (1 + half + half * half / 2)).drop("core", "alphabet", "k", "chi", "s", "p_chi", "p_runs", "p_serial")


def _length_class() -> Column:
    return F.floor(2 * F.log2("n")).cast("int")


def cuts(tested: DataFrame) -> DataFrame:
    """(encoding, class, cut) from the histogram of the p of distinct strings in each class of encoding and length."""
    from pyspark.sql import Window

    cell = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    distinct = tested.groupBy(F.xxhash64("run").alias("run"), "encoding", _length_class().alias("class")).agg(F.max("p").alias("p"))  # p is the same for equal strings
    cells = distinct.groupBy("encoding", "class", cell.alias("cell")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy("encoding", "class")
    above = whole.orderBy(F.desc("cell"))
    cells = cells.withColumn("drawn", 2 * F.sum(F.when(F.col("cell") >= BINS // 2, F.col("c")).otherwise(0)).over(whole)).withColumn("accepted", F.sum("c").over(above))
    words = F.col("accepted") - F.col("drawn") * (1 - F.col("cell") / BINS)
    fine = words <= FDR * F.col("accepted") + 2 * F.sqrt("accepted")
    cells = cells.withColumn("broken", F.max(F.when(~fine, F.col("cell")).otherwise(-1)).over(above))
    least = F.when(F.max("drawn") < 2 * FEW, F.lit(SMALL_CUT)).otherwise(F.lit(0.0))
    return cells.where("broken < cell").groupBy("encoding", "class").agg(F.greatest(F.min("cell") / BINS, least).alias("cut"))


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, found) for every row: ``found`` is an array of (start, kind, end, name) by start and then kind; code points, end exclusive.

    ``row`` numbers the rows, so repeated or null ids keep apart. A null or empty text has an empty array. Matches of one kind do not
    overlap; different kinds may. Other columns are not read. Matches, not texts, are shuffled: a row's matches meet in one task.
    """
    from pyspark.sql import Window

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,kept:boolean,run:string>>")
    parts = [_matches(F.col("text"), 0, ASSIGN, 2), _matches(F.col("text"), 1, ACCESS), _matches(F.col("text"), 2, HEX), _matches(F.col("text"), 3, RUN)]
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    every = rows.select("row", "id", F.explode_outer(F.concat(*(F.coalesce(p, none) for p in parts))).alias("m")).select("row", "id", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("place")
    placed = every.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    placed = written(placed.select("row", "id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "kept", "run"), "matches")
    tested = written(randomness(placed.where("kind = 3").select("row", "start", "run")), "tested")
    limit = F.broadcast(cuts(tested).withColumnRenamed("encoding", "of"))  # a few classes of encoding and length
    drawn = tested.join(limit, (F.col("encoding") == F.col("of")) & (_length_class() == F.col("class")) & (F.col("p") >= F.col("cut"))).select("row", "start")
    drawn = drawn.withColumn("kind", F.lit(3)).withColumn("drawn", F.lit(True))
    chosen = placed.drop("run").join(drawn, ["row", "kind", "start"], "left").withColumn("kept", F.when(F.col("kind") == 3, F.coalesce("drawn", F.lit(False))).otherwise(F.col("kept")))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    entry = F.when(F.col("kept"), F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("kind"), F.col("end").cast("long").alias("end"), name.alias("name")))
    return chosen.groupBy("row", "id").agg(F.array_sort(F.collect_list(entry)).alias("found"))


def _text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row, from ``spans``."""
    got = spans(docs, id_column, text_column)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = _text(F.filter("found", lambda x: x["kind"] < 3))
    return got.select(F.col("id").alias(id_column), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(base, 256).alias("base_sha256"), _text(F.col("found")).alias("spans"), count(3).alias("n_random"))


def redacted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every stretch covered by spans replaced by ``MASK``; other rows and all columns as they were.

    Spans of the rows that have any are written and joined back by id and text hash, broadcast if they are few.
    """
    text, key = F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.xxhash64(F.col(text_column).cast("string"))
    named = docs.select(F.struct(F.col(id_column).alias("id"), key.alias("hash")).alias("_key"), text.alias("_text"))
    found = spans(named, "_key", "_text").where("size(found) > 0")

    def merged(s: Column, x: Column) -> Column:
        """(ranges so far, last range): overlapping and touching spans become one range."""
        joins = x["start"] <= s["last"]["end"]
        last = F.struct(F.when(joins, s["last"]["start"]).otherwise(x["start"]).alias("start"), F.when(joins, F.greatest(s["last"]["end"], x["end"])).otherwise(x["end"]).alias("end"))
        return F.struct(F.when(joins, s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))).alias("done"), last.alias("last"))

    pair = "struct<start:bigint,end:bigint>"
    zero = F.struct(F.array().cast(f"array<{pair}>").alias("done"), F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).alias("last"))
    ranges = F.aggregate("found", zero, merged, lambda s: F.concat(s["done"], F.array(s["last"])))
    found = small(written(found.select(F.col("id.id").alias("_secret_id"), F.col("id.hash").alias("_secret_hash"), ranges.alias("_ranges")).dropDuplicates(["_secret_id", "_secret_hash"]), "ranges"), 50_000)
    pieces = F.transform("_ranges", lambda r, i: F.concat(
        F.when(r["end"] > r["start"], F.lit(MASK)).otherwise(F.lit("")),
        F.col(text_column).substr((r["end"] + 1).cast("int"), (F.coalesce(F.get("_ranges", i + 1)["start"], F.length(text_column).cast("long")) - r["end"]).cast("int"))))
    joined = docs.join(found, docs[id_column].eqNullSafe(F.col("_secret_id")) & (key == F.col("_secret_hash")), "left")
    changed = F.when(F.col("_ranges").isNotNull(), F.array_join(pieces, "")).otherwise(F.col(text_column))
    return joined.select(*(changed.alias(c) if c == text_column else docs[c] for c in docs.columns))
