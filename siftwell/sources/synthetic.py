"""Deterministic inputs for measurements, and what measurements say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import hashed_vector

SEED = 20_260_816
SPECIAL = ["loadValue", "load_value", "loadValueLater", "preloadValues", "lodaValue", "value", "run-task", "unrelated"]


def token(seed: int, number: Column) -> Column:
    """Eight letters from a 32-bit multiplicative mix of seed and number, least digit in base 26 first."""
    value = (F.lit(seed).cast("decimal(38,0)") + number.cast("decimal(38,0)") * F.lit(2_654_435_761)) % F.lit(1 << 32)
    digits = [(F.floor(value / F.lit(26**i)) % 26).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), d + 1, F.lit(1)) for d in digits])


def case_seed(seed: int, rows: int, dimension: int) -> int:
    return (seed * 1_000_003 + rows * 101 + dimension) % (1 << 63)


def vectors(spark: SparkSession, rows: int, dimension: int, seed: int = SEED) -> DataFrame:
    """(vec_id, embedding): unit vectors from hashes; row 0 is the query of ``query_vector``."""
    own = case_seed(seed, rows, dimension)
    return spark.range(rows).select(F.col("id").alias("vec_id"), hashed_vector(F.concat(F.lit(f"{own}:"), F.col("id").cast("string")), dimension).alias("embedding"))


def names(spark: SparkSession, rows: int, seed: int = SEED) -> DataFrame:
    """(id, name, qualified_name): a few names near ``loadValue`` and fillers."""
    number = F.col("id").cast("int")
    name = F.when(F.col("id") < len(SPECIAL), F.get(F.array(*map(F.lit, SPECIAL)), number)).otherwise(token(seed, F.col("id")))
    return spark.range(rows).select("id", name.alias("name"), F.concat(F.lit("package."), name).alias("qualified_name"))


def exact_names(spark: SparkSession, rows: int, seed: int = SEED) -> DataFrame:
    """(id, name, qualified_name) with one short and one qualified hit for ``target``."""
    short = F.when(F.col("id") == rows // 2, "target").otherwise(token(seed, F.col("id")))
    whole = F.when(F.col("id") == rows - 1, "target").otherwise(F.concat(F.lit("package."), token(seed + 1, F.col("id"))))
    return spark.range(rows).select("id", short.alias("name"), whole.alias("qualified_name"))


def throughput(median_ms: Column, rows: Column) -> tuple[Column, Column]:
    """(calls, rows) a second; null where the median is 0 or less."""
    calls = F.when(median_ms > 0, 1000.0 / median_ms)
    return calls, calls * rows


def speed_up(reference_ms: Column, median_ms: Column) -> Column:
    return F.when(median_ms > 0, reference_ms / median_ms)
