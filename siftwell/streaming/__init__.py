"""An extension beyond the batch operators: a file stream of manifests applied to stored tables by foreachBatch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, compact_every: int = 16):
    """Apply Parquet files that arrive in ``folder`` to the table in ``target``: rows of a key that came last win.

    Each micro-batch writes its own rows alone, as a delta named by its number, so a batch that is run again after a
    failure replaces its own delta and nothing is applied twice. Every ``compact_every`` batches the whole table is
    written instead, which bounds what a reader puts together. Of rows with an equal key in one batch the greatest stays.
    """

    def apply(batch: DataFrame, number: int) -> None:
        new = prepare(batch)
        whole = F.struct(*[F.col(c) for c in new.columns])
        new = new.groupBy(*key).agg(F.max(whole).alias("row")).select("row.*").select(*new.columns)
        if number % compact_every == compact_every - 1 and (old := current(spark, target, number)) is not None:
            old.join(new.select(*key), key, "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{target}/kind=whole/batch={number:020d}")
        else:
            new.write.mode("overwrite").parquet(f"{target}/kind=delta/batch={number:020d}")

    _note(spark, f"{target}/KEY", json.dumps(key))
    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The table after the last whole batch (before ``before``): its last full state and the deltas since."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)

    def done(kind: str) -> dict[int, str]:
        at = f"{target}/kind={kind}"
        names = [s.getPath().getName() for s in fs.listStatus(path(at))] if fs.exists(path(at)) else []
        found = {int(n[6:]): f"{at}/{n}" for n in names if n.startswith("batch=") and fs.exists(path(f"{at}/{n}/_SUCCESS"))}
        return {n: p for n, p in found.items() if before is None or n < before}

    whole, deltas = done("whole"), done("delta")
    last = max(whole, default=-1)
    paths = ([whole[last]] if whole else []) + [p for n, p in sorted(deltas.items()) if n > last]
    if not paths:
        return None
    rows = spark.read.option("basePath", target).parquet(*paths)
    names = [c for c in rows.columns if c not in ("kind", "batch")]
    stream = fs.open(path(f"{target}/KEY"))
    try:
        key = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.col("batch").cast("long")).alias("row"))
    return latest.select("row.*").select(*names)


def _note(spark: SparkSession, at: str, text: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
