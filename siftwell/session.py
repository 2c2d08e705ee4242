"""What every operator needs of the session: tables, the shared folder, and code on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: Rows go to Python in batches of at most this many bytes: 10,000 rows, Spark's own bound, say nothing of whole texts.
BATCH_BYTES = 4_000_000
#: Rows of a task that sorts: left alone, Spark makes about as many tasks as there are cores, whose memory follows the input.
TASK_ROWS = 500_000
_shipped: set[str] = set()
_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and bound the session's Arrow batches, unless it has its own bound."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="siftwell-"), "siftwell_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, f"siftwell/{p.relative_to(PACKAGE)}")
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of this machine only where none is named and Spark is local."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write narrow rows to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write wide rows as Parquet in the shared folder and read them again. The application's files go when its driver ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/siftwell-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _folders.add(folder)
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where the input has fewer partitions than there are cores, as a small file has.

    Only plans that read and project are looked at; one that shuffles, and any input that is large enough, stays as it is.
    """
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan" or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def parted(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` hashed into tasks of about ``TASK_ROWS``, given how many rows it has; one of no more than that for each core is left to Spark."""
    tasks = -(-rows // TASK_ROWS)
    return df if tasks <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(tasks, *by)


def size_in_bytes(df: DataFrame, text: str = "text") -> int:
    """The optimiser's estimate of a plan's bytes; where it has none, the bytes of its texts."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
