"""Registered queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


@query
def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.lm_score import lm_scores

    held_out = "crc32(cast(doc_id as string)) % 5 = 1"
    got = lm_scores(table(spark, sf_dir, "documents"), f"not ({held_out})", public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", F.expr(held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.passages import repeated

    return repeated(table(spark, sf_dir, "documents"))


TRAINING = "crc32(cast(doc_id as string)) % 5 <> 0"


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.toxicity import toxicity_scores

    got = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training=TRAINING)
    return got.select("doc_id", (~F.expr(TRAINING)).alias("held_out"), "score", "predicted")


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.quality import quality_scores

    got = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training=TRAINING, threshold=0.3)
    return got.select("doc_id", (~F.expr(TRAINING)).alias("held_out"), "score", "predicted")


@query
def op9_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


_SQL["op9_setsketch_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SQL["op11_filter_audit"] = r"""
WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f)
  JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
y AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN min(w.doc_id) OVER (PARTITION BY t) < w.doc_id THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN y ON y.doc_id = w.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM e GROUP BY 1, 2),
s AS (SELECT o.o AS filter_order, i AS step, substr(o.o, i, 1) AS f, substr(o.o, 1, i - 1) AS done FROM o, range(1, 6) r(i)),
g AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN translate(fails, done || f, '') = fails THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN contains(fails, f) AND translate(fails, done, '') = fails THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(fails, f) AND translate(fails, done, '') <> fails THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN contains(fails, f) AND translate(fails, done, '') = fails THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN contains(fails, f) AND translate(fails, done, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


@query
def op12_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.langid import predicted_languages

    held_out = "crc32(cast(doc_id as string)) % 3 = 1"
    got = predicted_languages(table(spark, sf_dir, "documents"), f"not ({held_out})")
    return got.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


_CRC_STEP = "list_transform({}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC_TABLE = "range(256)"
for _ in range(8):
    _CRC_TABLE = _CRC_STEP.format(_CRC_TABLE)
_SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE k AS (SELECT {_CRC_TABLE} AS k),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
p AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM p),
h AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, k),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT x.word AS a, y.word AS b, y.n FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.less UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less),
f AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS n FROM e GROUP BY a),
t AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 10 * w.n THEN f.b END AS form, CASE WHEN f.n >= 10 * w.n THEN f.n END AS form_n FROM w LEFT JOIN f ON f.a = w.word),
q AS (SELECT word, word AS root, form AS onward FROM t UNION ALL SELECT q.word, t.word, t.form FROM q JOIN t ON t.word = q.onward)
SELECT t.word, t.form, q.root, t.n, t.n_near, t.form_n FROM t JOIN q ON q.word = t.word WHERE q.onward IS NULL"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
