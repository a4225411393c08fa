"""Sinks: file records, chunk tables, reports. A job writes whole outputs or none (the commit protocol of writers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.rag import violations
from .parsers import extension_of


def stored_files(files: DataFrame, max_bytes: int = 52_428_800, allowed: tuple[str, ...] = (".md", ".txt", ".pdf", ".docx", ".html")) -> DataFrame:
    """Records of uploads (filename, content, mime_type): checked, with checksum and a name made of it."""
    extension = extension_of(F.col("filename"))
    checksum = F.sha2("content", 256)
    return files.select(
        F.regexp_replace("filename", r"[^A-Za-z0-9._-]+", "_").alias("original_filename"),
        F.concat(F.substring(checksum, 1, 32), extension).alias("stored_filename"),
        extension.alias("file_extension"),
        "mime_type",
        F.length("content").cast("long").alias("file_size"),
        checksum.alias("checksum"),
        violations(
            ("INVALID_FILE", F.coalesce(F.length("content"), F.lit(0)) == 0),
            ("FILE_TOO_LARGE", F.length("content") > max_bytes),
            ("UNSUPPORTED_FILE_TYPE", ~extension.isin(*allowed)),
        ).alias("error_codes"),
    )


def append(df: DataFrame, table: str) -> int:
    """Rows appended to a managed table, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").saveAsTable(table)
    return seen.get["n"]


def replace_without(df: DataFrame, gone: Column, path: str) -> None:
    """Write the rows that stay to a new path: files are never changed in place, nor is a path read while written."""
    df.where(~F.coalesce(gone, F.lit(False))).write.mode("errorifexists").parquet(path)


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"cannot export {kind}")
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else getattr(writer, kind)(path)


def _hadoop(spark: SparkSession, path: str):
    """Path and file system of a name in any store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _hadoop(spark, path)
    return store.exists(at)


def delete_file(spark: SparkSession, path: str) -> bool:
    """Whether there was a file to delete."""
    at, store = _hadoop(spark, path)
    return store.exists(at) and store.delete(at, False)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of stored files, read by the executors."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")
