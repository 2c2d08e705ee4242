"""Repository sources: walk, ignore rules, bounded reads, manifest, and a Spark data source.

Listing is driver-side, as a directory tree is one file system's; reading, checking and hashing files are tasks.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = {".py": "python", ".md": "documentation", ".markdown": "documentation", ".rst": "documentation"}
SKIPPED = {"__pycache__", "build", "dist", "node_modules", "venv", ".venv", ".git"}
SKIPPED_AT_ROOT = {"data"}
MOST_RULES, RULES_BYTES, FILE_BYTES, MOST_FILES, MOST_ENTRIES, SNIFFED = 512, 1_000_000, 1_000_000, 10_000, 100_000, 8192
FILE_SCHEMA = "relative_path string, language string, modified_time_ns long, size_bytes long, content binary"


class Cancelled(Exception):
    """The caller asked to stop."""


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False
    anchored: bool = False
    directories: bool = False

    def regex(self) -> str:
        """Matches the paths of files that the rule covers; a star also crosses slashes."""
        body = translate(self.pattern)
        body = re.sub(r"\\[zZ]$", "", body.removeprefix("(?s:").replace("(?>.*?", "(?:.*?"))
        body = body.removesuffix(")") if body.endswith(")") and body.count("(") < body.count(")") else body
        inside = "/" in self.pattern
        if self.directories:
            # some directory above the file; with a slash inside, its own parent
            front = "" if self.anchored else "(?:.*/)?"
            return f"(?s:^{front}{body}/[^/]+$)" if inside and not self.anchored else f"(?s:^{front}{body}/.+$)" if self.anchored else f"(?s:^(?:[^/]+/)*{self._part()}/.+$)"
        if self.anchored:
            return f"(?s:^{body}$)"
        return f"(?s:^(?:.*/)?{body}$)" if inside else f"(?s:^(?:.*/)?{self._part()}(?:/.*)?$)"

    def _part(self) -> str:
        out = ""
        for piece in re.findall(r"\*|\?|\[[^\]]*\]|[^*?\[]+|\[", self.pattern):
            out += "[^/]*" if piece == "*" else "[^/]" if piece == "?" else piece.replace("[!", "[^") if piece.startswith("[") and piece.endswith("]") and len(piece) > 2 else re.escape(piece)
        return out


def parse_rules(text: str, most: int = MOST_RULES) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        body = line.strip()
        if not body or body[0] == "#":
            continue
        negated = body.startswith("!")
        body = body[negated:]
        anchored = body.startswith("/")
        body = body[anchored:]
        directories = body.endswith("/")
        body = body.rstrip("/") if directories else body
        if body:
            rules.append(Rule(body, negated, anchored, directories))
    if len(rules) > most:
        raise ValueError(f"more than {most} ignore rules")
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches a file's path isn't a negation."""
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(rule.regex()), F.lit(not rule.negated)).otherwise(out)
    return out


def is_ignored(path: str, directory: bool, rules: list[Rule]) -> bool:
    out = False
    for rule in rules:
        if re.search(rule.regex(), path + "/x" if directory and rule.directories else path):
            out = not rule.negated
    return out


def read_bounded(path: str, limit: int) -> tuple[os.stat_result, bytes]:
    """At most ``limit`` bytes of a regular file that isn't a link."""
    handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_CLOEXEC", 0))
    with os.fdopen(handle, "rb") as f:
        status = os.fstat(f.fileno())
        if not stat.S_ISREG(status.st_mode):
            raise OSError(f"not a regular file: {path}")
        return status, f.read(limit)


def is_binary(sample: bytes) -> bool:
    return b"\0" in sample[:SNIFFED]


def walk(root: str, skipped: set[str] = frozenset(), file_bytes: int | None = FILE_BYTES, most_files: int | None = MOST_FILES, most_entries: int | None = MOST_ENTRIES, check: Callable[[], None] = lambda: None) -> list[str]:
    """Paths of the supported text files below ``root``, in order. Links aren't followed.

    More files or entries than allowed are an error, larger files are left out; None takes a limit away.
    """
    root = os.path.realpath(os.path.expanduser(root))
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    rules, rule_file = [], os.path.join(root, ".gitignore")
    if os.path.lexists(rule_file) and not os.path.islink(rule_file):
        raw = read_bounded(rule_file, RULES_BYTES + 1)[1]
        if len(raw) > RULES_BYTES:
            raise ValueError(".gitignore is too large")
        rules = parse_rules(raw.decode())
    names, found, seen, todo = SKIPPED | set(skipped), [], 0, [""]
    while todo:
        at = todo.pop()
        below = []
        try:
            entries = os.scandir(os.path.join(root, at))
        except OSError:
            continue
        with entries:
            for e in entries:
                check()
                seen += 1
                if most_entries is not None and seen > most_entries:
                    raise ValueError(f"more than {most_entries} entries")
                path = f"{at}/{e.name}" if at else e.name
                if e.is_symlink() or e.name in names or path.split("/")[0] in SKIPPED_AT_ROOT:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if not is_ignored(path, True, rules):
                        below.append(path)
                elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1].lower() in SUFFIXES and not is_ignored(path, False, rules):
                    try:
                        if file_bytes is not None and e.stat(follow_symlinks=False).st_size > file_bytes or is_binary(read_bounded(e.path, SNIFFED)[1]):
                            continue
                    except OSError:
                        continue
                    found.append(path)
                    if most_files is not None and len(found) > most_files:
                        raise ValueError(f"more than {most_files} files")
        todo.extend(sorted(below, reverse=True))
    return sorted(found)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.bytes = int(options.get("file_bytes", FILE_BYTES))
        self.size = int(options.get("files_per_partition", 200))

    def partitions(self) -> list[Files]:
        paths = walk(self.root, file_bytes=self.bytes)
        return [Files(tuple(paths[i : i + self.size])) for i in range(0, len(paths), self.size)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths:
            try:
                status, raw = read_bounded(os.path.join(self.root, p), self.bytes + 1)
            except OSError:
                yield p, SUFFIXES[os.path.splitext(p)[1].lower()], None, None, None
                continue
            yield p, SUFFIXES[os.path.splitext(p)[1].lower()], status.st_mtime_ns, len(raw), raw


class RepositorySource(DataSource):
    """``spark.read.format("siftwell_repository").load(path)``: also files whose names start with _ or a dot."""

    @classmethod
    def name(cls) -> str:
        return "siftwell_repository"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(dict(self.options))


def files(spark: SparkSession, root: str) -> DataFrame:
    from siftwell.session import ship

    ship(spark)
    spark.dataSource.register(RepositorySource)
    return spark.read.format("siftwell_repository").option("path", root).load()


def manifest(raw: DataFrame) -> DataFrame:
    """(path, modified_time_ns, size_bytes, content_hash, language, source_text, line_count, error) of raw files."""
    from siftwell.functions.text import line_count

    valid = F.is_valid_utf8(F.col("content"))
    text = F.when(valid, F.decode("content", "UTF-8"))
    return raw.select(
        F.col("relative_path").alias("path"), "modified_time_ns", "size_bytes", F.sha2("content", 256).alias("content_hash"), "language",
        text.alias("source_text"), line_count(text).alias("line_count"), F.when(F.col("content").isNull(), "read: not readable").when(~valid, "read: not UTF-8").alias("error"),
    )


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$")


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
