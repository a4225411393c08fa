"""Corpus data sources: files of a folder with all names, and the connectors that need a network.

File sources of the engine leave out names with a leading underscore or dot, so a folder that all machines mount
is listed by our own reader: the driver lists, partitions are groups of files, executors read the bytes, and only
where the content column is asked for. The same source is a stream of what appears in the folder: each listing adds the
files that it finds new, or written anew, to a log of numbered files, offsets are places in that log, and a batch takes a
limited number of files, so each file comes once, whatever times the files bear. ``shared`` reads a folder of any store that Spark reads, by the engine's own
file source, which lists in parallel; names with a leading underscore or dot are then left out. ``shared_stream`` is its stream.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamReader

from .filters import SourceConfig, accepted, validate

SCHEMA = "source_uri string, path string, filename string, extension string, size long, content binary"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


def _listed(root: str) -> Iterator[tuple[str, int, int]]:
    """Path, size and time of change of each file, in the order of folders and names; one that goes meanwhile is left out."""
    for folder, _, names in sorted(os.walk(root)):
        for name in sorted(names):
            full = os.path.join(folder, name)
            try:
                found = os.stat(full)
            except FileNotFoundError:
                continue
            yield full, found.st_size, found.st_mtime_ns


def _grouped(files: Iterator[tuple[str, int]], most: int) -> list[InputPartition]:
    out, own, size = [], [], 0
    for full, n in files:
        if own and size + n > most:
            out.append(_Files(own))
            own, size = [], 0
        own.append((full, n))
        size += n
    return [*out, _Files(own)] if own else out


def _rows(root: str, files: list[tuple[str, int]], with_content: bool) -> Iterator[tuple]:
    for full, n in files:
        name = os.path.basename(full)
        dot = name.rfind(".")
        content = None
        if with_content:
            with open(full, "rb") as f:
                content = f.read()
        yield f"file://{full}", os.path.relpath(full, root), name, name[dot:].lower() if 0 < dot < len(name) - 1 else "", n, content


class _FolderOptions:
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://")
        self.bytes_per_partition = int(options.get("bytesPerPartition", 64 << 20))
        self.with_content = str(options.get("withContent", "true")).lower() == "true"


class _FolderReader(_FolderOptions, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _grouped(((full, n) for full, n, _ in _listed(self.root)), self.bytes_per_partition) or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.root, partition.files, self.with_content)


class _FolderStream(_FolderOptions, DataSourceStreamReader):
    """Offsets count the files of the log in the folder ``log``, which belongs to one stream as its checkpoint does."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        if "log" not in options:
            raise ValueError("ETL_VALIDATION_ERROR: a stream of a folder needs the option log")
        self.log, self.max_files = options["log"].removeprefix("file://"), int(options.get("maxFiles", 1000))
        os.makedirs(self.log, exist_ok=True)
        self.files: list[tuple[str, int, int]] = []
        for name in sorted(n for n in os.listdir(self.log) if n.endswith(".jsonl")):
            with open(os.path.join(self.log, name)) as f:
                self.files += [tuple(json.loads(line)) for line in f]
        self.known = {full: (n, at) for full, n, at in self.files}

    def _write(self, name: str, text: str) -> None:
        tmp = os.path.join(self.log, f".{name}.tmp")
        with open(tmp, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, os.path.join(self.log, name))

    def _planned(self) -> int:
        try:
            with open(os.path.join(self.log, "planned")) as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        new = [x for x in _listed(self.root) if self.known.get(x[0]) != x[1:]]
        if new:
            self._write(f"{len(self.files):012d}.jsonl", "".join(json.dumps(x) + "\n" for x in new))
            self.files += new
            self.known |= {full: (n, at) for full, n, at in new}
        return {"files": min(len(self.files), self._planned() + self.max_files)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # What has been planned is planned again after a fault, before there is a further offset.
        if end["files"] > self._planned():
            self._write("planned", str(end["files"]))
        return _grouped(((full, n) for full, n, _ in self.files[start["files"] : end["files"]]), self.bytes_per_partition)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        there = [(full, n) for full, n in partition.files if os.path.exists(full)]
        return _rows(self.root, there, self.with_content)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FolderStream(self.options)


def _remote(kind: str) -> type[DataSource]:
    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"corpus_{kind}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            raise NotImplementedError(f"the {kind} connector is a placeholder")

    Remote.__name__ = f"Corpus{kind.title()}"
    return Remote


#: Source types; all but the first are placeholders.
SOURCE_TYPES = ("filesystem", "github", "website", "api", "sharepoint", "gdrive", "notion", "confluence")
_SOURCES: dict[str, type[DataSource]] = {"filesystem": FolderSource} | {k: _remote(k) for k in SOURCE_TYPES[1:]}


def register(source_type: str, source: type[DataSource]) -> None:
    _SOURCES[source_type] = source


def supported() -> list[str]:
    return sorted(_SOURCES)


def supports(source_type: str, asked: str) -> bool:
    return asked.lower() == source_type


def source(source_type: str) -> type[DataSource]:
    if source_type not in _SOURCES:
        raise ValueError(f"UNSUPPORTED_SOURCE: {source_type}")
    return _SOURCES[source_type]


def discover(spark: SparkSession, config: SourceConfig, source_type: str = "filesystem") -> DataFrame:
    """Accepted files without their bytes."""
    return _scan(spark, config, source_type, False).drop("content")


def load(spark: SparkSession, config: SourceConfig, source_type: str = "filesystem") -> DataFrame:
    return _scan(spark, config, source_type, True)


def _scan(spark: SparkSession, config: SourceConfig, source_type: str, content: bool) -> DataFrame:
    validate(config)
    kind = source(source_type)
    spark.dataSource.register(kind)
    rows = spark.read.format(kind.name()).option("withContent", str(content).lower()).load(config.source_path_or_uri)
    return rows.where(accepted(F.col("path"), config))


def stream(spark: SparkSession, config: SourceConfig, log: str, max_files: int = 1000, content: bool = True) -> DataFrame:
    """A stream of accepted files as they appear in a mounted folder, ``max_files`` a batch; ``log`` is the folder of its listings."""
    validate(config)
    spark.dataSource.register(FolderSource)
    reader = spark.readStream.format(FolderSource.name()).option("withContent", str(content).lower()).option("log", log).option("maxFiles", max_files)
    return reader.load(config.source_path_or_uri).where(accepted(F.col("path"), config))


def drain(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Run a stream of files until all that there is has been given to ``sink``, batch by batch; how many batches had rows."""
    batches = 0
    while True:
        query = files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        some = sum(1 for p in query.recentProgress if p.numInputRows)
        if not some:
            return batches
        batches += some


def shared(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """Accepted files of a folder in a shared store; the bytes are read only where the content column is asked for."""
    return _shared(spark, config, spark.read.format("binaryFile"))


def shared_stream(spark: SparkSession, config: SourceConfig, max_files: int = 1000) -> DataFrame:
    """The same as a stream of files as they appear, listed by the engine."""
    schema = spark.read.format("binaryFile").load(config.source_path_or_uri).schema
    return _shared(spark, config, spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files))


def _shared(spark: SparkSession, config: SourceConfig, reader: DataFrameReader | DataStreamReader) -> DataFrame:
    validate(config)
    at = spark._jvm.org.apache.hadoop.fs.Path(config.source_path_or_uri)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    files = reader.option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select(
        F.col("path").alias("source_uri"), F.substring(F.col("path"), len(root) + 2, 1 << 20).alias("path"), name.alias("filename"), F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).alias("extension"),
        F.col("length").alias("size"), "content",
    )
    return rows.where(accepted(F.col("path"), config))


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1").first()[0] == 1
