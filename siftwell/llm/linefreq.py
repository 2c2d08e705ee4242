"""Site-relative line deduplication.

For each site and line: the share of the site's pages that contain the line. A line whose share exceeds ``ratio`` is
boilerplate and dropped from every page of the site. Sites of any size are judged; ``least_holders`` pages must hold the
line (at 1, the ratio alone decides, and a site of one page keeps nothing).

A line counts once a page however often it stands there; lines are compared without outer blanks, by two 64-bit hashes.
Blank lines are never dropped. Pages' lines are counted by (site, line) with partial sums, so no site is ever gathered;
what remains, at most (lines a page / ratio) lines of a site, is one row per site. It is joined back broadcast if its
measured size is small, else by (site, salt) with a salt of the row's place, so that a site with a third of all pages is
spread over ``salts`` tasks, equal pages too.

The site of a web page is the host of its URL (``host_of``); its lines (``page_lines``) end at line ends and at the tags
of blocks, which are no part of them. The pipeline's documents have no URL; their site is the column ``source``.

Cases: null text isn't a page and stays null; empty text is a page without lines; pages of a null site are left alone;
repeated rows are pages of their own; a page of which all lines go is left with empty text. Very long texts are taken
whole. An empty table gives no rows. The columns of docs stay in one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import cut

RATIO, LEAST_HOLDERS, SALTS, BROADCAST_BYTES = 0.1, 3, 64, 8_000_000
BLOCK_TAG = r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|script|section|style|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>"
BLANKS = " \t\r\v\f"


def host_of(url: str) -> Column:
    """The host of a URL, in lower case, without user and port; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def page_lines(html: str) -> Column:
    """The lines of a web page, one after another: the tags of blocks become line ends."""
    return F.regexp_replace(html, "(?i)" + BLOCK_TAG, "\n")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def key(line: Column) -> Column:
    t = trimmed(line)
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))


def boilerplate(docs: DataFrame, site: str, ratio: float = RATIO, least_holders: int = LEAST_HOLDERS) -> DataFrame:
    """(site, lines: array of keys) of the sites that have boilerplate."""
    pages = docs.filter(F.col("text").isNotNull() & F.col(site).isNotNull()).select(F.col(site).alias("site"), "text")
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: trimmed(x) != ""), key))
    counted = pages.select("site", F.explode(lines).alias("line")).groupBy("site", "line.a", "line.b").agg(F.count("*").alias("n"))
    # one row per site on the other side
    often = counted.filter(F.col("n") >= least_holders).join(totals, "site").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("site").agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def stripped(docs: DataFrame, site: str, ratio: float = RATIO, least_holders: int = LEAST_HOLDERS, salts: int = SALTS) -> DataFrame:
    """(row: the columns of docs, n_lines, n_dropped, kept: the text left)."""
    found = cut(boilerplate(docs, site, ratio, least_holders))
    size = found.agg(F.sum(F.size("lines") * 32 + F.octet_length("site") + 32)).first()[0] or 0
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), F.col(f"row.`{site}`") == F.col("site"), "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("own", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        joined = rows.join(salted, (F.col(f"row.`{site}`") == F.col("site")) & (F.col("own") == F.col("salt")), "left")
    text = F.col("row.text")
    split = F.split(text, "\n", -1)
    left = F.when(F.col("lines").isNull(), split).otherwise(F.filter(split, lambda x: (trimmed(x) == "") | ~F.array_contains(F.col("lines"), key(x))))
    out = joined.select("row", F.size(split).cast("long").alias("n_lines"), left.alias("left"))
    return out.select("row", F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.coalesce(F.col("n_lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join("left", "\n").alias("kept"))


def without_boilerplate(docs: DataFrame, site: str, **parameters) -> DataFrame:
    """``docs`` with boilerplate lines cut out of text, and n_chars counted anew, if there; other columns as they are."""
    out = stripped(docs, site, **parameters)
    changed = {"text": F.col("kept")} | ({"n_chars": F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])
