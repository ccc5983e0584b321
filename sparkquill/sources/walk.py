"""A tree of files as a data source: folders that rules leave out are never entered, and files they leave out never opened.

The tree must be mounted at the same place on every machine, as a shared file system is. Planning walks only the first levels,
until there is enough to deal out; each task then walks its subtrees. Limits over the whole tree are applied to the rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from . import files

# What the plainest walk leaves out (folders, extensions, names taken as sensitive), and the languages it knows.
FLOOR = [
    ".git/", ".hg/", ".svn/", "node_modules/", ".venv/", "venv/", "dist/", "build/", "target/", "coverage/", ".next/", ".cache/", "vendor/", "__pycache__/",
    "*.map", "*.lock", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.pdf", "*.exe", "*.dll", "*.so", "*.class", "*.jar", "*.zip", "*.tar", "*.gz",
    ".env*", "*.env", "*.pem", "*.key", "*.p12", "*.jks", "*id_rsa",
]
FLOOR_LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "ts": "typescript", "json": "json", "yaml": "yaml", "yml": "yaml", "sql": "sql", "md": "markdown", "plsql": "plsql", "pks": "plsql", "pkb": "plsql"}
SCHEMA = "path string, size long, content_hash string, head binary, error string"
#: Default limits: bytes of a file, of all files, files, seconds that a task may walk; and bytes of a file's beginning that are kept.
MOST_FILE, MOST_BYTES, MOST_FILES, MOST_SECONDS, HEAD = 2 << 20, 1 << 30, 20_000, 900.0, 8192


def canonical(path: str) -> str:
    """The absolute path with links and ``..`` resolved."""
    return os.path.realpath(os.path.abspath(os.path.expanduser(path)))


def is_allowed(path: str, roots: list[str]) -> bool:
    """Whether an absolute path lies under one of ``roots`` or is one, after links are resolved on both sides."""
    if not path or not os.path.isabs(path):
        return False
    return any(canonical(path) == (top := canonical(root)) or canonical(path).startswith(top.rstrip("/") + "/") for root in filter(None, roots))


def _rules(layers: list[list[str]], first: list[str] = files.IGNORED) -> list[list[tuple[bool, re.Pattern]]]:
    return [[(verdict, re.compile(pattern)) for verdict, pattern in filter(None, map(files.rule, lines))] for lines in (first, *layers)]


def _left_out(path: str, rules: list[list[tuple[bool, re.Pattern]]], folder: bool = False) -> bool:
    """As ``files.ignored``: the last rule of a layer that fits decides, the first layer with a verdict wins.

    Only rules for folders, whose patterns end with a slash, see the slash behind a folder's name.
    """
    for layer in rules:
        for verdict, pattern in reversed(layer):
            if pattern.search(f"{path}/" if folder and pattern.pattern.endswith("/") else path):
                return verdict
    return False


class _Subtrees(InputPartition):
    def __init__(self, folders: list[str], names: list[str]):
        self.folders, self.names = folders, names


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.layers = json.loads(options.get("layers", "[]"))
        self.plainest = options.get("plainest", "false") == "true"
        self.most_file, self.most_seconds = int(options.get("most_file", MOST_FILE)), float(options.get("most_seconds", MOST_SECONDS))
        self.tasks = int(options.get("tasks", 16))

    def _listed(self, folder: str, rules) -> tuple[list[str], list[str]]:
        """Folders and files right under ``folder``, in order, without links and what the rules leave out."""
        folders, names = [], []
        with os.scandir(os.path.join(self.root, folder)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_symlink():
                    continue
                if e.is_dir() and not _left_out(path, rules, True):
                    folders.append(path)
                elif e.is_file() and not _left_out(path, rules) and not self.sensitive.search(e.name):
                    names.append(path)
        return folders, names

    @property
    def rules(self) -> list[list[tuple[bool, re.Pattern]]]:
        return _rules(self.layers, FLOOR if self.plainest else files.IGNORED)

    @property
    def sensitive(self) -> re.Pattern:
        return re.compile("^$") if self.plainest else re.compile("|".join(f"^{files._glob(p)}$" for p in files.SENSITIVE))

    def partitions(self) -> list[_Subtrees]:
        rules, level, names = self.rules, [""], []
        while level and len(level) < self.tasks:
            below = []
            for folder in level:
                folders, here = self._listed(folder, rules)
                below += folders
                names += here
            level = below
        n = max(1, min(self.tasks, len(level) + len(names)))
        return [_Subtrees(level[i::n], names[i::n]) for i in range(n)]

    def read(self, partition: _Subtrees) -> Iterator[tuple]:
        rules, ends, open_ = self.rules, time.monotonic() + self.most_seconds, list(reversed(partition.folders))
        yield from map(self._row, partition.names)
        while open_:
            folder = open_.pop()
            if time.monotonic() > ends:
                yield folder, None, None, None, "scan_timeout"
                return
            try:
                folders, names = self._listed(folder, rules)
            except OSError as e:
                yield folder, None, None, None, f"{type(e).__name__}"
                continue
            open_ += reversed(folders)
            yield from map(self._row, names)

    def _row(self, path: str) -> tuple:
        full = os.path.join(self.root, path)
        try:
            size = os.path.getsize(full)
            if size > self.most_file:
                return path, size, None, None, "file_too_large"
            digest, head = hashlib.sha256(), b""
            with open(full, "rb") as f:
                while block := f.read(1 << 20):
                    head = head or block[:HEAD]
                    digest.update(block)
            return path, size, digest.hexdigest(), head, None
        except OSError as e:
            return path, None, None, None, type(e).__name__


class WalkSource(DataSource):
    """``spark.read.format("walk").load(folder)``: SCHEMA. Options: layers (JSON, lists of ignore lines), most_file, most_seconds, tasks, plainest."""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def walk(spark: SparkSession, folder: str, *layers: list[str], roots: list[str] | None = None, **limits) -> DataFrame:
    """path, size, content_hash, language, is_binary, is_generated, error of the files under ``folder``, sorted by path.

    ``roots``: where a folder may lie; another one is refused. A file over ``most_file`` bytes, or one that can't be read, has an
    error and no hash; a folder that a task had no time for is a row with an error. Links are not followed.
    """
    if roots is not None and not is_allowed(folder, roots):
        raise PermissionError(f"{folder} lies outside the allowed roots")
    spark.dataSource.register(WalkSource)
    reader = spark.read.format("walk").option("layers", json.dumps(layers))
    for name, value in limits.items():
        reader = reader.option(name, str(value))
    rows = reader.load(folder)
    known = F.col("content_hash").isNotNull()
    binary = F.when(known, files.is_binary(F.col("head")))
    return rows.select("path", "size", "content_hash", T.language(F.col("path")).alias("language"), binary.alias("is_binary"), T.is_generated(F.col("path")).alias("is_generated"), "error").orderBy("path")


def walk_plain(spark: SparkSession, folder: str, most_file: int = MOST_FILE) -> DataFrame:
    """path, size, content_hash, language of the text files under ``folder`` by the rules of FLOOR alone; what can't be read, is too large or no text is left out."""
    spark.dataSource.register(WalkSource)
    rows = spark.read.format("walk").option("plainest", "true").option("most_file", str(most_file)).load(folder)
    kept = rows.where(F.col("content_hash").isNotNull() & ~files.is_binary(F.col("head")))
    extension = F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in FLOOR_LANGUAGES.items() for x in pair])
    return kept.select("path", "size", "content_hash", F.try_element_at(known, extension).alias("language")).orderBy("path")


def scan(spark: SparkSession, roots: dict[str, str], alias: str, relative: str = "", *layers: list[str], **limits) -> DataFrame:
    """``walk`` of a relative folder under the root that ``alias`` names."""
    if alias not in roots:
        raise ValueError(f"unknown root: {alias}")
    if os.path.isabs(relative):
        raise ValueError("only relative paths are taken")
    folder = os.path.join(canonical(roots[alias]), relative) if relative else canonical(roots[alias])
    if is_allowed(folder, list(roots.values())) and not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    return walk(spark, folder, *layers, roots=list(roots.values()), **limits)


def within(found: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``found`` (path, size, ...) in the order of paths up to ``most_files`` files, and while their sizes stay within ``most_bytes``; with truncated.

    Paths are dealt to ranges; a range's files follow those of the ranges before, whose totals are a row each.
    """
    rows = found.repartitionByRange("path").withColumn("_range", F.spark_partition_id())
    totals = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("b"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_range").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"_i": F.count(F.lit(1)).over(inside), "_s": F.sum(F.coalesce("size", F.lit(0))).over(inside)}).join(F.broadcast(starts), "_range")
    kept = placed.withColumn("_fits", (F.col("_n") + F.col("_i") <= most_files) & (F.col("_b") + F.col("_s") <= most_bytes))
    total = totals.agg(F.sum("n").alias("_all"), F.sum("b").alias("_size"))
    whole = (F.col("_all") <= most_files) & (F.col("_size") <= most_bytes)
    return kept.crossJoin(F.broadcast(total)).where("_fits").select(*found.columns, (~whole).alias("truncated"))
