"""The pipeline against a brute-force version of its stages, and its stages' contracts."""

import hashlib
import random

import public_tokenizers
from conftest import SF, text_of
from pyspark.sql import functions as F
from test_setsketch import brute
from tokenizers import Tokenizer

import corpus_pipeline as C
from tickloom.llm import secrets
from tickloom.llm.decontaminate import normal
from tickloom.llm.toxicity import toxicity_scores


def test_run_equals_brute_force(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "documents":  # one with a secret that no earlier stage takes
            table = table.union(spark.createDataFrame([(10**9, "see token = abcdefgh12345 in this text", "en", "src0", 38)], table.schema))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    texts = {i: r.text for i, r in rows.items() if i not in toxic}
    texts = {i: texts[i] for i, (_, component) in brute(texts, C.SHINGLE_WORDS, C.SIMILAR_PERCENT).items() if i == component}
    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(x in normal(t or "") for x in items)}  # planted items are whole
    kept = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    masked = {r.doc_id: r.text for r in secrets.redacted(kept).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) and len(texts) < len(rows)
    for i, r in got.items():
        assert r.ids == library.encode(masked[i] or "", add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256((masked[i] or "").encode()).hexdigest()
    assert masked[10**9] == f"see {secrets.MASK} in this text"


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(C.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_verdicts_stay_with_their_rows(spark, tmp_path):
    rng = random.Random(41)
    item, twin, clean = text_of(rng, 40), text_of(rng, 90), [text_of(rng, 60) for _ in range(4)]
    leak = text_of(rng, 20) + " " + item + " " + text_of(rng, 20)
    rows = [(1, twin), (None, twin), (None, leak), (None, clean[0]), (None, None), (7, twin), (7, leak), (7, clean[1]), (8, clean[2]), (None, clean[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = C.decontaminate(spark, C.near_dedup(spark, docs, str(tmp_path)), str(tmp_path))
    want = [(1, twin), (None, clean[0]), (None, None), (7, clean[1]), (8, clean[2]), (None, clean[3])]
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, text string").collect())
    alone = C.decontaminate(spark, docs, str(tmp_path)).collect()
    assert len(alone) == 8 and all(r.text != leak for r in alone)
    scores = toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"), text_hash=True)
    gone = scores.join(docs.where(F.col("text") == clean[0]).select(F.xxhash64("text").alias("text_hash")), "text_hash")
    assert gone.count() == 1 and C.without(docs, gone).count() == 9
