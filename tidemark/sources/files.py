"""Sources and sinks: tables, JSON lines, whole texts, logs of what was written."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION = (
    "cache_key string, chunk_id string, source_type string, model string, prompt_version string, "
    "output struct<sentiment: string, sentiment_score: double, topics: array<string>, key_quote: string>, date string, fiscal_quarter string, "
    "td_fiscal_quarter_hint string, section string, speaker struct<name: string, role: string, affiliation: string>, token_count int, created_at string"
)
CHUNK = (
    "chunk_id string, source_type string, doc_id string, date string, fiscal_quarter string, section string, text string, token_count int, "
    "speaker struct<name: string, role: string, affiliation: string>, url string, headline string, td_fiscal_quarter_hint string, report_type string"
)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, or a ValueError that names what it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a declared schema; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_json(df: DataFrame, column: str, schema: str, name: str = "parsed") -> DataFrame:
    """``column``'s JSON as a struct; rows whose JSON doesn't parse are dropped, NULL ones too."""
    kind = T._parse_datatype_string(f"{schema}, __bad string")
    x = df.withColumn(name, F.from_json(column, kind, {"columnNameOfCorruptRecord": "__bad"}))
    return x.where(F.col(name).isNotNull() & F.col(f"{name}.__bad").isNull()).withColumn(name, F.col(name).dropFields("__bad"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines, created_at set where it is missing."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    had = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("string")
    df.withColumn("created_at", F.coalesce(had, now)).write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def manifest(spark: SparkSession, path: str, source: str, kind: str) -> DataFrame:
    """One row per file under ``path``: source, kind, path, size, sha256 of its bytes, when it was last written. Empty files are passed over, as by all of Spark's file sources."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.lit(source).alias("source"), F.lit(kind).alias("artifact_type"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("written_at"))


def append_manifest(rows: DataFrame, log: str) -> None:
    rows.write.mode("append").option("header", True).csv(log)


def write_document(spark: SparkSession, path: str, document: Mapping[str, object]) -> None:
    """A nested document as one JSON file in a folder, through Spark, so that any file system will do."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def latest(paths: DataFrame, column: str) -> DataFrame:
    """The row whose name sorts last."""
    return paths.orderBy(F.col(column).desc()).limit(1)


def new_only(landed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet; rows without a key are always new."""
    return landed.join(done.select(key).where(F.col(key).isNotNull()), on=key, how="left_anti")


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "_src") -> DataFrame:
    """All rows of the parts with the part's name; columns that a part lacks are NULL."""
    out = None
    for name, p in parts.items():
        x = p.withColumn(tag, F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def observations(pages: DataFrame, column: str, series: str) -> DataFrame:
    """date, series, value out of a time-series service's JSON, {"observations": [{"d": day, series: {"v": text}}]}; what isn't a number is skipped."""
    x = pages.select(F.explode(F.from_json(column, f"observations array<struct<d: string, `{series}`: struct<v: string>>>")["observations"]).alias("o"))
    v = F.col("o")[series]["v"].try_cast("double")
    return x.select(F.col("o.d").try_cast("date").alias("date"), F.lit(series).alias("series"), v.alias("value")).where("date is not null and value is not null and not isnan(value)")


def bars_from(raw: DataFrame, ticker: Column, names: Mapping[str, str] | None = None) -> DataFrame:
    """A market-data download as date, ticker, open, high, low, close, adj_close, volume; names that a download spells with blanks are mapped."""
    usual = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
    x = raw.withColumnsRenamed({**usual, **(names or {})})
    require_columns(x, ["date", "open", "high", "low", "close", "adj_close", "volume"])
    return x.select(F.col("date").cast("date").alias("date"), ticker.alias("ticker"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "adj_close")], F.col("volume").cast("long").alias("volume"))
