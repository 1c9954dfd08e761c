"""Tables in shared storage: intermediate ones, and versions of a table that numbered pointers name."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without it (as in tests); there a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="fairground-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives executors."""
    path = table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nothing reads any more."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        files, path = _path(df.sparkSession, name)
        files.delete(path, True)


class Scratch:
    """Intermediate tables of one operator, in a folder of their own; close() deletes those that its result does not read."""

    def __init__(self, spark: SparkSession, label: str, compression: str = "snappy") -> None:
        self.spark, self.folder, self.paths, self.made, self.compression = spark, table_path(spark, label), {}, 0, compression

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """df, written and read back as by materialize()."""
        path = f"{self.folder}/{label}-{self.made}"
        self.made += 1
        df.write.parquet(path, compression=self.compression)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = found
        return found

    def drop(self, *gone: DataFrame | None) -> None:
        for name, df in list(self.paths.items()):
            if any(df is g for g in gone):
                files, path = _path(self.spark, name)
                files.delete(path, True)
                del self.paths[name]

    def close(self, *read: DataFrame) -> None:
        self.drop(*[df for df in self.paths.values() if not any(df is r for r in read)])


def write_bytes(spark: SparkSession, name: str, data: bytes, replace: bool = True) -> None:
    """Write a file through the file system that Spark knows by its name. What is there is replaced, or an error."""
    files, path = _path(spark, name)
    out = files.create(path, replace)
    out.write(bytearray(data))
    out.close()


class Snapshots:
    """Versions of one table in a folder, by buckets of a key; numbered pointers say of which files each consists.

    Parquet has no MERGE and must not be overwritten while it is read. So a change writes files of its own,
    for the buckets that it touches only, and then one new pointer, which takes the other buckets' files from
    the one before. A pointer is never changed: the newest whole one is current, one that a crash left
    unfinished does not count, and of two writers of one number the later fails. A version stays readable until
    KEPT newer ones exist; then its pointer goes, and the files that no pointer names any more.

    Appended parts of a bucket have levels: FANOUT parts of one level become one part of the next, so a row is
    written again once a level, and a pointer names fewer than FANOUT parts for each level of a bucket: a number
    that grows with the logarithm of the batches. Data is always written before the pointer that names it, so a
    crash at any step leaves the version before; what it wrote is swept once it is older than GRACE seconds.

    Two writers of one number: the create call of the pointer decides where the file system makes it exclusive
    (HDFS, local disks). Object stores do not: there, let one writer at a time change a table.

    by: columns whose hash picks a row's bucket (none: the table is one bucket)."""

    BUCKETS, KEPT, END, FANOUT, GRACE = 64, 2, "\n", 8, 86_400

    def __init__(self, spark: SparkSession, folder: str, by: list[str] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.by, self.buckets = spark, folder.rstrip("/"), by or [], buckets if by else 1
        self.wrote: set[str] = set()  # folders of the change that is being made

    def _pointers(self) -> list[str]:
        """Names of all pointers, the newest first."""
        files, folder = _path(self.spark, self.folder)
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted((n for n in names if n.startswith("version-")), reverse=True)

    def _version(self, name: str) -> dict | None:
        files, path = _path(self.spark, f"{self.folder}/{name}")
        stream = files.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text.endswith(self.END) else None

    def _current(self) -> dict | None:
        return next((v for v in map(self._version, self._pointers()) if v is not None), None)

    def current(self) -> int | None:
        """The number of the current version."""
        version = self._current()
        return None if version is None else version["number"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int") if self.by else F.lit(0)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that have rows here: `buckets` numbers at most."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("bucket")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The current table, or these buckets of it; None before the first version."""
        version = self._current()
        if version is None:
            return None
        schema = T.StructType.fromJson(version["schema"])
        return self._parts(schema, [p for b, parts in version["files"].items() if buckets is None or int(b) in buckets for p, _ in parts])

    def write(self, table: DataFrame) -> DataFrame:
        """Make table the current version."""
        return self._put(table, {})

    def replace(self, table: DataFrame, buckets: list[int]) -> DataFrame:
        """Make a version in which table's rows stand instead of those of these buckets; it has no rows of others."""
        version = self._current()
        return self._put(table, {b: p for b, p in (version["files"] if version else {}).items() if int(b) not in buckets})

    def append(self, table: DataFrame) -> DataFrame:
        """Make a version that has table's rows besides."""
        version = self._current()
        return self._put(table, version["files"] if version else {})

    def _parts(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _written(self, table: DataFrame) -> dict[str, str]:
        """Write a table's rows by bucket; the path of each bucket that has some."""
        data, column = f"data-{uuid.uuid4().hex}", "bucket"
        self.wrote.add(data)
        while column in table.columns:
            column = f"_{column}"
        table.withColumn(column, self._bucket()).write.partitionBy(column).parquet(f"{self.folder}/{data}")
        files, folder = _path(self.spark, f"{self.folder}/{data}")
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return {n.rpartition("=")[2]: f"{data}/{n}" for n in names if n.startswith(f"{column}=")}

    def _levelled(self, schema: T.StructType, parts: dict[str, list]) -> dict[str, list]:
        """parts (bucket: [path, level]) after FANOUT of a level have become one of the next, level by level."""
        level = 0
        while level <= max((at for of in parts.values() for _, at in of), default=-1):
            full = {b: [p for p, at in of if at == level] for b, of in parts.items()}
            full = {b: paths for b, paths in full.items() if len(paths) >= self.FANOUT}
            if full:
                merged = self._written(self._parts(schema, [p for paths in full.values() for p in paths]))
                parts = {b: [[p, at] for p, at in of if b not in full or at != level] + ([[merged[b], level + 1]] if b in full and b in merged else []) for b, of in parts.items()}
            level += 1
        return parts

    def _put(self, table: DataFrame, others: dict[str, list]) -> DataFrame:
        pointers = self._pointers()
        number = 1 + (int(pointers[0].rpartition("-")[2]) if pointers else 0)
        parts, self.wrote = {b: [list(p) for p in of] for b, of in others.items()}, set()
        for b, path in self._written(table).items():
            parts.setdefault(b, []).append([path, 0])
        parts = self._levelled(table.schema, parts)
        version = {"number": number, "schema": table.schema.jsonValue(), "files": parts}
        write_bytes(self.spark, f"{self.folder}/version-{number:012d}", (json.dumps(version) + self.END).encode(), replace=False)
        self._forget([n for n in pointers if self._version(n) is not None][self.KEPT :])
        return self.read()

    def _forget(self, old: list[str]) -> None:
        """Delete these pointers, then the data that no pointer names: at once what only they named, else after GRACE."""
        files, folder = _path(self.spark, self.folder)
        named = lambda names: {p for n in names for of in (self._version(n) or {"files": {}})["files"].values() for p, _ in of}
        gone = named(old)
        for name in old:
            files.delete(_path(self.spark, f"{self.folder}/{name}")[1], False)
        held = named(self._pointers())
        for p in gone - held:
            files.delete(_path(self.spark, f"{self.folder}/{p}")[1], True)
        used = {p.partition("/")[0] for p in held}
        emptied, before = {p.partition("/")[0] for p in gone} | self.wrote, time.time() - self.GRACE
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in used and (name in emptied or status.getModificationTime() / 1000 < before):
                files.delete(status.getPath(), True)
