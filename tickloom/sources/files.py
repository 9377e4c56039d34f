"""File scans and sinks: CSV ticks, Parquet/JSON tables, partition pruning, dataset summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.cleaning import where_all

SUFFIXES = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def format_of(path: str) -> str:
    """Format by suffix; a folder without one is Parquet."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, fmt in SUFFIXES.items():
        if name.endswith(suffix):
            return fmt
    return "parquet"


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def scan_csv_ticks(spark: SparkSession, path: str, *, symbol: str | None = None, venue: str | None = None, ts: str = "ts",
                   price: str = "price", volume: str = "volume", keep: Sequence[str] = ()) -> DataFrame:
    """Ticks from CSV with a header: epoch-second times, blank volume is 0.

    Rows that cannot be read have ``bad = true`` and keep their text in ``raw``; see ``good_rows``/``dead_rows``.
    """
    text = require(spark.read.option("header", True).csv(path), [ts, price])
    at = F.col(ts).try_cast("double")
    value = F.col(price).try_cast("double")
    if volume in text.columns:
        blank = F.coalesce(F.trim(volume), F.lit("")) == ""
        size = F.when(blank, F.lit(0.0)).otherwise(F.col(volume).try_cast("double"))
    else:
        size = F.lit(0.0)
    names = {"symbol": symbol, "venue": venue}
    ids = [F.lit(v).alias(k) if v is not None else F.col(k) for k, v in names.items() if v is not None or k in text.columns]
    return text.select(
        *ids, *[c for c in keep if c not in names], F.timestamp_micros(F.round(at * 1e6).cast("long")).alias("ts"),
        value.alias("price"), size.alias("volume"), F.to_json(F.struct(*text.columns)).alias("raw")).withColumn(
        "bad", F.col("ts").isNull() | F.col("price").isNull() | F.col("volume").isNull()
        | F.isnan("price") | F.isnan("volume"))


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("bad")).drop("bad", "raw")


def dead_rows(df: DataFrame, reason: str = "unreadable") -> DataFrame:
    return df.filter("bad").select("raw", F.lit(reason).alias("reason"))


def scan(spark: SparkSession, path: str, *, columns: Sequence[str] | None = None, predicates: Sequence[Column] = (),
         partitions: Mapping[str, Sequence] | None = None, fmt: str | None = None, schema: T.StructType | None = None,
         row_count: str | None = None) -> DataFrame:
    """Lazy scan with projection, predicates and partition filters, all of which reach the file source.

    ``row_count`` adds the row's position in its Parquet file (a global count would need one task).
    """
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if row_count:
        if fmt != "parquet":
            raise ValueError("row positions are read from Parquet only")
        df = df.withColumn(row_count, F.col("_metadata.row_index"))
    for key, values in (partitions or {}).items():
        require(df, [key])
        df = df.filter(F.col(key).isin(list(values)))
    df = where_all(df, predicates)
    if columns is not None:
        extra = [row_count] if row_count and row_count not in columns else []
        df = require(df, columns).select(*columns, *extra)
    if partitions and not df.inputFiles():
        raise FileNotFoundError(f"no partition of {path} matches {dict(partitions)}")
    return df


def dataset_summary(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes of each file, with the schema as text."""
    df = spark.read.parquet(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy(
        "file", "bytes").agg(F.count(F.lit(1)).alias("rows")).withColumn("schema", F.lit(df.schema.simpleString()))


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_table(spark: SparkSession, path: str, *, fmt: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Read what ``write_table`` wrote; Delta and Iceberg need their packages on the cluster."""
    return scan(spark, path, fmt=fmt, schema=schema)


def insert_rows(df: DataFrame, columns: Sequence[str], *, url: str | None = None, table: str | None = None,
                path: str | None = None, batch: int = 10_000, properties: Mapping[str, str] | None = None) -> None:
    """Bulk insert in column order, to a database by JDBC or to a Parquet table."""
    ordered = require(df, columns).select(*columns)
    if url:
        ordered.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=dict(properties or {}))
    else:
        ordered.write.mode("append").parquet(path)


def sync_view(df: DataFrame, path: str, *, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Write a feature view; an append must have the same columns and types as what is stored."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is append or overwrite")
    if mode == "append":
        try:
            stored = df.sparkSession.read.parquet(path).schema
        except Exception as exc:  # no stored view yet
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
            stored = None
        if stored is not None:
            have = {f.name: f.dataType for f in df.schema}
            want = {f.name: f.dataType for f in stored}
            if have != want:
                raise ValueError(f"append changes the columns: stored {sorted(want)}, new {sorted(have)}")
            df = df.select(*[f.name for f in stored])
    write_table(df, path, mode=mode, partition_by=partition_by)
