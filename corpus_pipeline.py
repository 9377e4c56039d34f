"""Documents to training ids: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. A stage looks at all rows: null and empty texts pass every filter, and are
encoded as no tokens; repeated rows and rows of one id, or of none, are judged each by its own text and stay or go together with equal ones; other columns stay up to the last stage.
Stages bound the batches of the session's Python workers, since executors keep what one stage has used while the next one runs.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bpe import encode_decode
from tickloom.llm.decontaminate import decontaminated
from tickloom.llm.scratch import bounded_batches, small, written
from tickloom.llm.secrets import redacted
from tickloom.llm.setsketch import near_duplicates
from tickloom.llm.toxicity import toxicity_scores

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id and hash of the text are in ``rows`` (written, and broadcast if they are few): a null or repeated id
    does not spread a verdict to other texts."""
    gone = small(written(rows.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct(), "rejected"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone")) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col("_hash")), "left_anti")


def stage(fn):
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labelled ones, does not call toxic."""
    scores = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), text_hash=True)
    return without(docs, scores.where("predicted = 1"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; empty texts are in no group and stay."""
    return without(docs, near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT, text_hash=True).where("not kept"))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted again."""
    masked = redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]
# A trained classifier, a sketch and a tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
