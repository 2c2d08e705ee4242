"""Sections, windows, spans, chunks and lexical documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import identifier_terms, lines
from siftwell.session import parted

HEADING, UNDERLINE = r"^#{1,6}\s+", r"^[^\w\s]{3,}\s*$"


def sections(docs: DataFrame, key: str, text: Column, starts=None) -> DataFrame:
    """(key, section from 1, start_line, end_line, text) of documentation; blank sections are left out.

    A section starts at line 1, at a heading, and at the line above an underline. A text's lines are one array, numbered
    by a running fold inside the row, so no text is shuffled. ``starts(line, next_line)`` replaces the rule.
    """
    rule = starts or (lambda line, after: line.rlike(HEADING) | F.coalesce(after.rlike(UNDERLINE), F.lit(False)))
    rows = docs.select(key, lines(text).alias("l")).filter(F.size("l") > 0)
    numbers = F.sequence(F.lit(1), F.size("l"))
    at = F.filter(numbers, lambda i: (i == 1) | rule(F.get("l", i - 1), F.get("l", i)))
    rows = rows.select(key, "l", at.alias("at"))
    cut = rows.select(key, "l", F.posexplode(F.arrays_zip(F.col("at").alias("a"), F.concat(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.array(F.size("l") + 1)).alias("b"))).alias("n", "s"))
    out = cut.select(key, (F.col("n") + 1).cast("long").alias("section"), F.col("s.a").cast("long").alias("start_line"), (F.col("s.b") - 1).cast("long").alias("end_line"), F.array_join(F.slice("l", F.col("s.a"), F.col("s.b") - F.col("s.a")), "\n").alias("text"))
    return out.filter(F.col("text").rlike(r"\S"))


def windows(start: Column, end: Column, most: int = 100, overlap: int = 20) -> Column:
    """Array of (start, end): windows of at most ``most`` lines, each ``overlap`` lines into the one before."""
    step, n = most - overlap, end - start + 1
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((start + i * step).cast("long").alias("start"), F.least(start + i * step + most - 1, end).cast("long").alias("end")))


def islands(rows: DataFrame, by: list[str], gap: int = 2, kind: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """``rows`` (start, end, ...) with ``island``: consecutive ones of a kind no more than ``gap`` lines apart; ``ties`` order equal spans."""
    w = Window.partitionBy(*by).orderBy("start", "end", *(ties or []))
    far = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
    if kind:
        far = far | F.coalesce(F.col(kind) != F.lag(kind).over(w), F.lit(True))
    return rows.withColumn("new", far.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("new")


def merged_spans(spans: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """(by, start, end) of overlapping or adjacent spans put together; ``rows`` is their number, which is counted if not given."""
    spans = parted(spans, spans.count() if rows is None else rows, *by)
    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    grouped = flagged.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def span_gaps(owners: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): what of each owner's [low, high] no span covers."""
    rows = spans.count()
    inside = merged_spans(spans.join(owners, by).filter("end >= low and start <= high").select(*by, F.greatest("start", "low").alias("start"), F.least("end", "high").alias("end")), by, rows)
    edges = inside.unionByName(owners.select(*by, (F.col("high") + 1).alias("start"), (F.col("high") + 1).alias("end")))
    w, edges = Window.partitionBy(*by).orderBy("start", "end"), parted(edges, rows, *by)
    gaps = edges.withColumn("last", F.lag("end").over(w)).join(owners, by)
    return gaps.select(*by, F.coalesce(F.col("last") + 1, F.col("low")).alias("a"), (F.col("start") - 1).alias("b")).filter("a <= b").select(*by, F.col("a").alias("start"), F.col("b").alias("end"))


def distinct_units(units: DataFrame) -> DataFrame:
    """Units once per (path, kind, start, end, text), the first by ordinal; blank ones dropped; by start, end, kind."""
    keep = units.filter(F.col("text").rlike(r"\S")).withColumn("nth", F.row_number().over(Window.partitionBy("path", "kind", "start_line", "end_line", "text").orderBy("ordinal")))
    return keep.filter("nth = 1").drop("nth").orderBy("path", "start_line", "end_line", "kind")


def chunks(units: DataFrame, sources: DataFrame, most: int = 100, overlap: int = 20, most_per_file: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(chunks: path, kind, start, end, symbol, text; paths with more than ``most_per_file``, which have none).

    units: path, kind, start_line, end_line, symbol. sources: path, text.
    """
    w = units.select("path", "kind", "symbol", F.explode(windows(F.col("start_line"), F.col("end_line"), most, overlap)).alias("w"))
    cut = w.join(sources.select("path", lines(F.col("text")).alias("l")), "path")
    cut = cut.select("path", "kind", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "symbol", F.array_join(F.slice("l", F.col("w.start").cast("int"), (F.col("w.end") - F.col("w.start") + 1).cast("int")), "\n").alias("text"))
    cut = cut.filter(F.col("text").rlike(r"\S")).dropDuplicates(["path", "kind", "start", "end", "symbol", "text"])
    over = cut.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > most_per_file).select("path")
    return cut.join(over, "path", "left_anti"), over


def lexical_documents(symbols: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """One row per symbol and per chunk, chunks with the names of their symbol if they have one."""
    terms = lambda: F.array_join(identifier_terms(F.col("name"), F.col("qualified_name"), F.col("path")), " ").alias("identifier_terms")
    s = symbols.select(F.concat(F.lit("symbol:"), F.col("id").cast("string")).alias("document_id"), F.lit("symbol").alias("result_type"), F.col("id").cast("string").alias("record_id"), "path", "name", "qualified_name", terms())
    owner = symbols.select(F.col("id").alias("symbol_id"), "name", "qualified_name")
    c = chunk_rows.join(owner, "symbol_id", "left")
    c = c.select(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")).alias("document_id"), F.lit("chunk").alias("result_type"), F.col("chunk_id").cast("string").alias("record_id"), "path", "name", "qualified_name", terms())
    return s.unionByName(c)


def attach_comments(comments: DataFrame, symbols: DataFrame) -> DataFrame:
    """Comment spans with their symbol: one that starts within 2 lines after, else the smallest that contains them, else none."""
    joined = comments.join(symbols.select("path", F.col("id").alias("symbol_id"), F.col("start_line").alias("a"), F.col("end_line").alias("b")), "path", "left")
    after = F.col("a").between(F.col("end") + 1, F.col("end") + 2)
    holds = (F.col("a") <= F.col("start")) & (F.col("b") >= F.col("end"))
    scored = joined.withColumn("o", F.when(after, F.struct(F.lit(0).alias("p"), (F.col("a") - F.col("end")).alias("q"), "symbol_id")).when(holds, F.struct(F.lit(1).alias("p"), (F.col("b") - F.col("a")).alias("q"), "symbol_id")))
    return scored.groupBy("path", "start", "end").agg(F.min("o").alias("o")).select("path", "start", "end", F.col("o.symbol_id").alias("symbol_id"))
