"""The session that the library's functions assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "tomewright", **more: str) -> SparkSession:
    out = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        out = out.config(k, v)
    return out.getOrCreate()
