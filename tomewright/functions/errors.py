"""Error codes with their status, as they stand in reject tables and in what is raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes by family, with the status that clients see.
CODES: dict[str, dict[str, int]] = {
    "base": {"INTERNAL_SERVER_ERROR": 500},
    "domain": {
        "DOMAIN_RULE_VIOLATION": 400, "RESOURCE_NOT_FOUND": 404, "RESOURCE_CONFLICT": 409, "VALIDATION_ERROR": 422, "AUTHENTICATION_REQUIRED": 401, "PERMISSION_DENIED": 403, "RATE_LIMIT_EXCEEDED": 429,
        "SERVICE_UNAVAILABLE": 503, "DATABASE_ERROR": 500,
    },
    "documents": {"UNSUPPORTED_DOCUMENT_FORMAT": 422, "CORRUPTED_DOCUMENT": 422, "EMPTY_DOCUMENT": 422},
    "chunking": {"EMPTY_DOCUMENT_TEXT": 422, "INVALID_CHUNK_CONFIG": 422},
    "embedding": {"EMBEDDING_MODEL_LOAD_FAILED": 500, "EMBEDDING_INFERENCE_FAILED": 500, "EMPTY_EMBEDDING_INPUT": 422, "EMBEDDING_DIMENSION_MISMATCH": 500, "EMBEDDING_PROVIDER_NOT_CONFIGURED": 500},
    "etl": {
        "ETL_ERROR": 500, "ETL_VALIDATION_ERROR": 422, "ETL_LOADER_ERROR": 502, "ETL_DISCOVERY_ERROR": 502, "ETL_LOAD_ERROR": 502, "ETL_PIPELINE_ERROR": 500, "ETL_JOB_NOT_FOUND": 404, "ETL_JOB_CANCELLED": 409,
        "ETL_JOB_EXECUTION_ERROR": 500, "ETL_UNSUPPORTED_SOURCE": 400,
    },
    "retrieval": {
        "INVALID_SEARCH_QUERY": 400, "DENSE_RETRIEVAL_ERROR": 500, "SPARSE_RETRIEVAL_ERROR": 500, "FUSION_ERROR": 500, "STRATEGY_NOT_FOUND": 400, "FUSION_STRATEGY_NOT_FOUND": 400, "RETRIEVAL_TIMEOUT": 504,
        "RETRIEVAL_CANCELLED": 499,
    },
    "storage": {"INVALID_FILE": 400, "FILE_TOO_LARGE": 413, "UNSUPPORTED_FILE_TYPE": 415, "STORAGE_FILE_NOT_FOUND": 404},
}
STATUS = {code: status for family in CODES.values() for code, status in family.items()}


class EngineError(ValueError):
    """An error with a code; the message is for people, details are for logs."""

    def __init__(self, code: str, message: str, **details: object) -> None:
        if code not in STATUS:
            raise KeyError(f"no such code: {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.status, self.details = code, STATUS[code], details


def family_of(code: str) -> str:
    return next(f for f, codes in CODES.items() if code in codes)


def codes(spark: SparkSession) -> DataFrame:
    """(code, family, status): the whole table, to join reject rows with."""
    return spark.createDataFrame([(c, f, s) for f, own in CODES.items() for c, s in own.items()], "code string, family string, status int")


def status_of(code: Column) -> Column:
    """The status of a code; what is not on the list is an internal error."""
    return F.coalesce(F.element_at(F.create_map(*[x for c, s in STATUS.items() for x in (F.lit(c), F.lit(s))]), code), F.lit(500))


def failed(code: str, message: str) -> Column:
    """An error that stops the job from within a column."""
    if code not in STATUS:
        raise KeyError(f"no such code: {code}")
    return F.raise_error(F.lit(f"{code}: {message}"))


def code_in(message: str, default: str = "INTERNAL_SERVER_ERROR") -> str:
    """The first code that an error's text names, whatever wraps it."""
    found = [(message.find(c), -len(c), c) for c in STATUS if c in message]
    return min(found)[2] if found else default
