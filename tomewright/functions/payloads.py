"""Payloads of mixed shape as VARIANT: parsed once, read by path and type, and described by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, into: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``rows`` with the JSON text of ``column`` as VARIANT, and those whose text is none, with their code. A null stays a null."""
    made = rows.withColumn(into, F.try_parse_json(column))
    bad = F.col(column).isNotNull() & F.col(into).isNull()
    return made.where(~bad), made.where(bad).drop(into).withColumn("error_code", F.lit("MALFORMED_PAYLOAD"))


def value(payload: Column | str, path: str, kind: str, default: object = None) -> Column:
    """What is at ``path`` (as in ``$.a.b[0]``) as ``kind``; where there is nothing, or nothing of the kind, the default."""
    found = F.try_variant_get(F.col(payload) if isinstance(payload, str) else payload, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def kind_of(payload: Column | str) -> Column:
    """The shape of one payload."""
    return F.schema_of_variant(payload)


def schema(rows: DataFrame, payload: str = "payload", *by: str) -> DataFrame:
    """The one shape that all payloads (of a group) fit, and how many there are."""
    return rows.groupBy(*by).agg(F.count(payload).alias("n_payloads"), F.schema_of_variant_agg(payload).alias("shape"))


def text_or_null(payload: Column | str) -> Column:
    """The payload written as JSON again."""
    return F.to_json(payload)
