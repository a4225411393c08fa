"""Relational tables over JDBC, and evaluation datasets from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An item of an evaluation dataset.
EVALUATION = "question_id string, question string, expected_answer string, relevant_ids array<string>, tags array<string>"


def jdbc_options(url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, fetch_size: int = 10_000, **more: str) -> dict[str, str]:
    """Options of a JDBC read; with a column and its bounds the table is read in parallel ranges."""
    out = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownPredicate": "true", **more}
    if partition_column is not None:
        if bounds is None or partitions < 1:
            raise ValueError("a partition column needs bounds and a number of partitions")
        out |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def read_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def read_dataset(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """An evaluation dataset with a fixed schema; a record that is not one is an error, not a row of nulls."""
    if kind not in ("json", "parquet"):
        raise ValueError(f"cannot read {kind}")
    reader = spark.read.schema(EVALUATION)
    return reader.option("mode", "FAILFAST").json(path) if kind == "json" else reader.parquet(path)


def build_dataset(questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """Items from questions (question_id, question, expected_answer, tags) and relevant pairs (question_id, id)."""
    ids = relevant.groupBy("question_id").agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("relevant_ids"))
    none = F.array().cast("array<string>")
    return questions.join(ids, "question_id", "left").select("question_id", "question", "expected_answer", F.coalesce("relevant_ids", none).alias("relevant_ids"), F.coalesce("tags", none).alias("tags"))
