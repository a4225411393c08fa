"""Several tables under one manifest: a unit of work changes all of them or none, and rewrites only the buckets it touches.

A version is a manifest, a small file that names the folders of each table. Data files are written first and never
changed; the new manifest is then moved to its number, which fails where another writer was faster. So readers, who take
the newest manifest once, see all tables of one unit or none of it, a unit that fails leaves nothing that is read, and
a conflict shows before anything is lost. Tables may be dealt to buckets by a hash of their key; a patch or an upsert
then reads and replaces the buckets of its keys, and the files of all others stay as they are.

The file system must not move a file over another one; the shared stores that Spark writes to keep to that.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket_"


class Conflict(RuntimeError):
    """Another unit has changed a table that this one has read or written."""

    code = "CONFLICT"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a single machine one of our own where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/tomewright-checkpoints"
    return found.rstrip("/")


def fingerprint(df: DataFrame) -> str:
    """What a table is read from: its files with their sizes and times, and its plan's columns."""
    spark = df.sparkSession
    seen = [str(df.schema.simpleString())]
    for name in sorted(df.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class Store:
    """Named tables in one folder. ``begin`` opens a unit; ``read`` gives a table as of one version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(self._path(self.path)).toString()

    def _manifest_path(self, version: int):
        return self._path(f"{self.path}/versions/{version:012d}.json")

    def version(self) -> int:
        """The newest version; 0 where there is none yet."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._manifest_path(version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, table: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version), table, buckets)

    def _read(self, manifest: dict, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        entry = manifest["tables"].get(table)
        if entry is None:
            raise KeyError(f"TABLE_NOT_FOUND: {table}")
        wanted = None if buckets is None else set(buckets)
        folders = [p["folder"] for p in entry["parts"] if wanted is None or p["bucket"] in wanted]
        if not folders:
            return self.spark.createDataFrame([], entry["schema"])
        reader = self.spark.read.schema(entry["schema"])
        return reader.parquet(*[f"{self.path}/{f}" for f in folders])

    def begin(self) -> Unit:
        return Unit(self)

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions before the last ``keep``, and data that no version left names (of failed units too). Run it while no unit is open."""
        newest = self.version()
        kept = [v for v in range(max(1, newest - keep + 1), newest + 1)]
        named = {p["folder"].split("/")[1] for v in kept for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        gone = 0
        data = self._path(f"{self.path}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in named:
                gone += bool(self._fs.delete(status.getPath(), True))
        for status in self._fs.listStatus(self._path(f"{self.path}/versions")) if newest else []:
            name = status.getPath().getName().removesuffix(".json")
            if name.isdigit() and int(name) not in kept:
                self._fs.delete(status.getPath(), False)
        return gone


class Unit:
    """Changes of several tables that become visible together when the block ends, or never when it raises."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.base = store.manifest()
        self.tables: dict[str, dict] = json.loads(json.dumps(self.base["tables"]))
        self.changed: set[str] = set()
        self.seen: set[str] = set()
        self._written: list[str] = []
        self.version: int | None = None

    def __enter__(self) -> Unit:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table with this unit's own changes; another unit's change of it then counts as a conflict."""
        self.seen.add(table)
        return self.store._read({"tables": self.tables}, table, buckets)

    def has(self, table: str) -> bool:
        return table in self.tables

    def _write(self, table: str, df: DataFrame, keys: list[str] | None, n_buckets: int) -> list[dict]:
        name = f"data/{table}-{uuid.uuid4().hex}"
        self._written.append(name)
        path = f"{self.store.path}/{name}"
        if not keys:
            df.write.option("compression", "zstd").parquet(path)
            return [{"folder": name, "bucket": None}]
        # A hot bucket's rows are written by several tasks.
        dealt = df.withColumn(BUCKET, bucket_of(keys, n_buckets)).repartition(F.col(BUCKET), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not _is_map(df, c)]), F.lit(4)))
        dealt.write.option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        found = [s.getPath().getName() for s in self.store._fs.listStatus(self.store._path(path)) if s.isDirectory()]
        return [{"folder": f"{name}/{f}", "bucket": int(f.rpartition("=")[2])} for f in sorted(found)]

    def _entry(self, table: str, df: DataFrame, keys: list[str] | None, n_buckets: int) -> dict:
        if table in self.tables:
            return self.tables[table]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        self.tables[table] = {"schema": ddl, "keys": keys, "n_buckets": n_buckets if keys else 0, "parts": []}
        return self.tables[table]

    def append(self, table: str, df: DataFrame, keys: list[str] | None = None, n_buckets: int = 16) -> DataFrame:
        """More rows; ``keys`` deal the table to buckets when it is new. What was written is given back as a table."""
        entry = self._entry(table, df, keys, n_buckets)
        self.changed.add(table)
        parts = self._write(table, _fitted(df, entry["schema"]), entry["keys"], entry["n_buckets"])
        entry["parts"] = entry["parts"] + parts
        return self.store._read({"tables": {table: entry | {"parts": parts}}}, table)

    def replace(self, table: str, df: DataFrame, keys: list[str] | None = None, n_buckets: int = 16) -> None:
        """All rows anew."""
        old = self.tables.pop(table, None)
        keys, n_buckets = (keys, n_buckets) if keys or old is None else (old["keys"], old["n_buckets"])
        self.changed.add(table)
        self._entry(table, df, keys, n_buckets)["parts"] = self._write(table, df, keys, n_buckets)

    def drop(self, table: str) -> None:
        self.changed.add(table)
        self.tables.pop(table, None)

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """Buckets that hold any of ``keys``: at most as many numbers as the table has buckets."""
        entry = self.tables[table]
        if not entry["keys"]:
            raise ValueError(f"{table} is not dealt by a key")
        return sorted(r.b for r in keys.select(bucket_of(entry["keys"], entry["n_buckets"]).alias("b")).distinct().collect())

    def rewrite(self, table: str, buckets: list[int], rows: DataFrame) -> None:
        """``rows`` in place of all rows of some buckets; files of the others are not touched."""
        entry = self.tables[table]
        self.changed.add(table)
        stay = [p for p in entry["parts"] if p["bucket"] not in set(buckets)]
        entry["parts"] = stay + self._write(table, _fitted(rows, entry["schema"]), entry["keys"], entry["n_buckets"])

    def patch(self, table: str, changes: DataFrame, columns: list[str]) -> None:
        """Set ``columns`` of the rows whose key ``changes`` (key columns, columns; a key once) has. Other rows stay, and so do unknown keys out."""
        keys = self.tables[table]["keys"]
        buckets = self.touched(table, changes)
        if not buckets:
            return
        old = self.read(table, buckets)
        new = changes.select(*keys, F.struct(*columns).alias("_new"))
        patched = old.join(new, keys, "left")
        self.rewrite(table, buckets, patched.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]))

    def upsert(self, table: str, rows: DataFrame, order: list[Column] | None = None) -> None:
        """``rows`` replace those of their keys and add the others; of several with one key the last by ``order`` (else by a hash)."""
        keys = self.tables[table]["keys"]
        buckets = self.touched(table, rows)
        if not buckets:
            return
        old = self.read(table, buckets)
        last = order or [F.desc(F.xxhash64(*old.columns))]
        one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*last))).where("_n = 1").select(*old.columns)
        self.rewrite(table, buckets, old.join(one.select(*keys), keys, "left_anti").select(*old.columns).unionByName(one))

    def delete(self, table: str, keys: DataFrame) -> int:
        """Take out the rows of some keys; how many there were. Where there are none no file is written."""
        on = self.tables[table]["keys"]
        buckets = self.touched(table, keys)
        if not buckets or not self.tables[table]["parts"]:
            return 0
        old, gone = self.read(table, buckets), keys.select(*on).distinct()
        n = old.join(gone, on, "left_semi").count()
        if n:
            self.rewrite(table, buckets, old.join(gone, on, "left_anti").select(*old.columns))
        return n

    def commit(self) -> int:
        """Make the changes visible. A newer version is followed if it changed none of this unit's tables, else Conflict."""
        store = self.store
        if not self.changed:
            return self.base["version"]
        while True:
            newest = store.manifest()
            tables = dict(newest["tables"])
            for t in self.changed | self.seen:
                if newest["tables"].get(t) != self.base["tables"].get(t):
                    self.rollback()
                    raise Conflict(f"CONFLICT: {t} was changed by version {newest['version']}")
            for t in self.changed:
                tables.pop(t, None)
                if t in self.tables:
                    tables[t] = self.tables[t]
            version = newest["version"] + 1
            if self._publish(version, {"version": version, "tables": tables}):
                self.version = version
                return version

    def _publish(self, version: int, manifest: dict) -> bool:
        """Whether the version's number was still free."""
        store, jvm = self.store, self.store.spark._jvm
        tmp = store._path(f"{store.path}/versions/tmp-{uuid.uuid4().hex}")
        out = store._fs.create(tmp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), store.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = store.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(tmp, store._manifest_path(version), options)
            return True
        except Exception as e:  # noqa: BLE001 - the bridge has one kind of exception for all
            store._fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def rollback(self) -> None:
        """Delete what was written; nothing names it."""
        for name in self._written:
            self.store._fs.delete(self.store._path(f"{self.store.path}/{name}"), True)
        self._written = []


def _fitted(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a table's definition in its order and types; one that is missing is an error."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()
