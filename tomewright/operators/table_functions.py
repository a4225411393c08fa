"""Table functions for SQL: a text's chunks as rows of a lateral join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import chunking

CHUNK = StructType([StructField(n, IntegerType()) for n in ("chunk_index", "start_offset", "end_offset")] + [StructField("text", StringType())])


def windows(value: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of ``size`` characters every ``size - overlap``; the last one ends the text."""
    at = 0
    while at == 0 or at + overlap < len(value):
        yield at, min(at + size, len(value))
        at += size - overlap


class Chunk:
    """``chunk(text, strategy, size [, overlap])``: chunks of a text by a registered strategy, or in windows ('fixed').

    Arguments but the text are constants, checked before anything runs. A null or empty text has no rows.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("INVALID_CHUNK_CONFIG: chunk takes a text")
        for name, given, kind in (("strategy", strategy, StringType), ("size", size, IntegerType), ("overlap", overlap, IntegerType)):
            if given is not None and (not given.isConstantExpression or not isinstance(given.dataType, kind)):
                raise ValueError(f"INVALID_CHUNK_CONFIG: {name} must be a constant {kind().simpleString()}")
        if strategy.value != "fixed" and strategy.value not in chunking.SPLITTERS:
            raise ValueError(f"INVALID_CHUNK_CONFIG: no strategy {strategy.value}")
        if overlap is not None and overlap.value and strategy.value != "fixed":
            raise ValueError(f"INVALID_CHUNK_CONFIG: {strategy.value} has no overlap")
        if size.value < 1 or not 0 <= (overlap.value if overlap is not None else 0) < size.value:
            raise ValueError("INVALID_CHUNK_CONFIG: sizes are positive and above the overlap")
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, strategy: str, size: int, overlap: int = 0) -> Iterator[tuple]:
        if not text:
            return
        if strategy == "fixed":
            for i, (a, b) in enumerate(windows(text, size, overlap)):
                yield i, a, b, text[a:b]
        else:
            for i, span in enumerate(chunking._stripped(text, chunking.SPLITTERS[strategy](text, size))):
                yield i, span["start"], span["end"], span["text"]


def register(spark: SparkSession, name: str = "chunk") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, udtf(Chunk, useArrow=False))
