"""Manifests, updates, reuse, snapshots and status."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content_hash") -> DataFrame:
    """(key, change: added, deleted, changed or unchanged)."""
    a, b = old.select(key, F.col(content).alias("old")), new.select(key, F.col(content).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def apply_updates(stored: DataFrame, fresh: DataFrame, diff: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows of files that are neither changed nor deleted, and the fresh rows of those changed or added."""
    gone = diff.filter(F.col("change").isin("changed", "deleted")).select(key)
    come = diff.filter(F.col("change").isin("changed", "added")).select(key)
    return stored.join(gone, key, "left_anti").unionByName(fresh.join(come, key, "left_semi"))


def without_failed(diff: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    """A file that couldn't be read or parsed keeps its former rows: its change isn't applied."""
    return diff.join(failed.select(key), key, "left_anti")


def reuse_vectors(chunks: DataFrame, known: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """``chunks`` (content_hash, text, ...) with vector and reused: the first known vector of a hash, else a new one."""
    first = known.groupBy("content_hash").agg(F.min_by("vector", "chunk_id").alias("known"))
    joined = chunks.join(first, "content_hash", "left")
    return joined.withColumn("reused", F.col("known").isNotNull()).withColumn("vector", F.coalesce("known", embed(F.col("text")))).drop("known")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of every table, in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest(rows: DataFrame, by: str, timestamp: str, key: str) -> DataFrame:
    """The newest row of each group, ties to the larger key."""
    w = Window.partitionBy(by).orderBy(F.desc(timestamp), F.desc(key))
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def vector_summary(vectors: DataFrame, vector: str) -> DataFrame:
    """(n, bytes, dimensions, least_norm, greatest_norm, bad): what has to hold before vectors are searched."""
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    unit = (square >= 1 - 1e-5) & (square <= 1 + 1e-5)
    rows = vectors.select(F.size(vector).alias("d"), square.alias("s"), unit.alias("u"))
    return rows.agg(F.count("*").alias("n"), F.sum(4 * F.col("d")).alias("bytes"), F.count_distinct("d").alias("dimensions"), F.round(F.min("s"), 6).alias("least_norm"), F.round(F.max("s"), 6).alias("greatest_norm"), F.count_if(~F.coalesce("u", F.lit(False))).alias("bad"))


class Snapshots:
    """Immutable versions of a set of tables in a folder; CURRENT names the live one and is replaced in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        context = spark.sparkContext
        self.jvm = context._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(context._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        at = self.path(f"{self.root}/CURRENT")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no index in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def write(self, tables: dict[str, DataFrame], note: dict | None = None) -> str:
        """Write all tables as a new version, then make it the live one; nothing changes if a write fails."""
        version = f"v-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{version}/{name}")
            self._put(f"{self.root}/{version}/NOTE", json.dumps(note or {}))
        except BaseException:
            self.fs.delete(self.path(f"{self.root}/{version}"), True)
            raise
        self._put(f"{self.root}/CURRENT.next", version)
        live, nxt = self.path(f"{self.root}/CURRENT"), self.path(f"{self.root}/CURRENT.next")
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(live.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(nxt), self.fs.makeQualified(live), options)
        return version

    def note(self) -> dict:
        stream = self.fs.open(self.path(f"{self.root}/{self.current()}/NOTE"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def backup(self, target: str) -> None:
        """A copy of the live version elsewhere."""
        version, conf = self.current(), self.spark.sparkContext._jsc.hadoopConfiguration()
        util = self.jvm.org.apache.hadoop.fs.FileUtil
        util.copy(self.fs, self.path(f"{self.root}/{version}"), self.path(target).getFileSystem(conf), self.path(f"{target}/{version}"), False, conf)
        Snapshots(self.spark, target)._put(f"{target}/CURRENT", version)

    def prune(self) -> None:
        """Drop all versions but the live one."""
        for status in self.fs.listStatus(self.path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v-") and name != self.current():
                self.fs.delete(status.getPath(), True)

    def _put(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


class Busy(RuntimeError):
    """Another writer holds the lease."""


class Lease:
    """The one writer of an index: a file that only one can create. Readers need none, as versions never change.

    A lease older than ``stale`` seconds by the folder's own clock is taken over; its writer is taken for lost.
    """

    def __init__(self, snapshots: Snapshots, stale: float = 6 * 3600):
        self.snapshots, self.stale, self.held = snapshots, stale, False
        self.at = snapshots.path(f"{snapshots.root}/WRITER")

    def __enter__(self) -> Lease:
        s = self.snapshots
        s.fs.mkdirs(s.path(s.root))
        if s.fs.exists(self.at):
            probe = s.path(f"{s.root}/.clock-{uuid.uuid4().hex}")
            s.fs.create(probe, True).close()
            age = s.fs.getFileStatus(probe).getModificationTime() - s.fs.getFileStatus(self.at).getModificationTime()
            s.fs.delete(probe, False)
            if age <= 1000 * self.stale:
                raise Busy(f"{s.root} is being written")
            s.fs.delete(self.at, False)
        try:
            s.fs.create(self.at, False).close()
        except Exception as error:
            raise Busy(f"{s.root} is being written") from error
        self.held = True
        return self

    def __exit__(self, *_) -> None:
        if self.held:
            self.snapshots.fs.delete(self.at, False)


def writing(snapshots: Snapshots) -> bool:
    return snapshots.fs.exists(snapshots.path(f"{snapshots.root}/WRITER"))


def available(spark: SparkSession, folder: str) -> list[dict]:
    """The newest live index of each repository in a folder, as (place, note); those being written are left out.

    In the order of the repositories' names and paths, without regard to case.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    newest: dict[str, dict] = {}
    for status in fs.listStatus(path(folder)) if fs.exists(path(folder)) else []:
        snapshots = Snapshots(spark, f"{folder}/{status.getPath().getName()}")
        if not status.isDirectory() or snapshots.current() is None or writing(snapshots):
            continue
        note = snapshots.note()
        root, found = note.get("root", ""), {"place": snapshots.root, **note}
        key = lambda n: (n.get("timestamp", 0), n.get("repository", ""))
        if root not in newest or key(found) > key(newest[root]):
            newest[root] = found
    return [newest[r] for r in sorted(newest, key=lambda r: (r.rstrip("/").rsplit("/", 1)[-1].casefold(), r.casefold()))]


def removed(snapshots: Snapshots) -> bool:
    """Delete an index and all its versions; whether there was one."""
    return snapshots.fs.delete(snapshots.path(snapshots.root), True)
