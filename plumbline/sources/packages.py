"""Folders of packages as tables: every file below a root, and which of them are text to scan."""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# --- fixed values: what a scan leaves out, and the files that a content hash covers ---
SKIPPED_DIRS = [".git", "__pycache__", ".venv", "venv", "node_modules", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox"]
TEXT_SUFFIXES = [".md", ".py", ".json", ".toml", ".yaml", ".yml", ".txt", ".cfg", ".ini", ".sh", ".bash", ".zsh", ".js", ".mjs", ".ts", ".lock", ".env"]
MAX_FILE_BYTES = 512 * 1024
SURFACE = r"^(?:SKILL\.md|references/[^/]*\.md|scripts/[^/]*\.py|evals/evals\.json)$"
# --- end of fixed values ---

SCHEMA = "pkg_id string, path string, n_bytes long, content binary, type string, target string, escapes boolean"
#: Files beyond this are listed without their content.
MAX_READ_BYTES = 2 << 20
#: What an entry that is no folder, file or link may be, by the type bits of its mode.
_KINDS = {stat.S_IFIFO: "fifo", stat.S_IFSOCK: "socket", stat.S_IFCHR: "character-device", stat.S_IFBLK: "block-device"}


class _Slice(InputPartition):
    """The packages whose name falls on one number."""


class _Reader(DataSourceReader):
    def __init__(self, root: str, slices: int, max_bytes: int) -> None:
        self.root, self.slices, self.max_bytes = root, slices, max_bytes

    def partitions(self) -> list[InputPartition]:
        return [_Slice(i) for i in range(self.slices)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with os.scandir(self.root) as entries:
            names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
        for name in names:
            if zlib.crc32(os.fsencode(name)) % self.slices == partition.value:
                yield from self._package(name)

    def _package(self, name: str) -> Iterator[tuple]:
        """Every entry below a package; links are recorded, never followed, and nothing but regular files is opened."""
        top = os.path.join(self.root, name)
        inside = os.path.realpath(top)
        waiting = [""]
        while waiting:
            below = waiting.pop()
            with os.scandir(os.path.join(top, below)) as entries:
                for e in entries:
                    path = f"{below}/{e.name}" if below else e.name
                    kind = stat.S_IFMT(e.stat(follow_symlinks=False).st_mode)
                    size = content = target = escapes = None
                    if kind == stat.S_IFLNK:
                        target = os.readlink(e.path)
                        leads = os.path.realpath(os.path.join(os.path.dirname(e.path), target))
                        escapes = leads != inside and not leads.startswith(inside + os.sep)
                    elif kind == stat.S_IFDIR:
                        waiting.append(path)
                    elif kind == stat.S_IFREG:
                        size = e.stat(follow_symlinks=False).st_size
                        if size <= self.max_bytes:
                            with open(e.path, "rb") as f:
                                content = f.read()
                    word = {stat.S_IFLNK: "symlink", stat.S_IFDIR: "dir", stat.S_IFREG: "file"}.get(kind) or _KINDS.get(kind, "unknown")
                    yield name, path, size, content, word, target, escapes


class PackageFiles(DataSource):
    """All entries of the packages (the folders) below a root, hidden ones too, as they lie on a mounted file system.

    Options: path; slices, the number of tasks; maxBytes, beyond which content is null.
    Tasks list the root themselves and take packages by name, so nothing is listed on the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "package_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("slices", 64)), int(self.options.get("maxBytes", MAX_READ_BYTES)))


def read_packages(spark: SparkSession, root: str, slices: int = 64) -> DataFrame:
    """Entries of all packages below root: pkg_id, path, n_bytes, content (null beyond 2 MiB), type, and for links target and escapes.

    type is file, dir, symlink, or that of a special file; escapes tells of a link that leads
    out of its package. Only files have n_bytes and content.
    """
    spark.dataSource.register(PackageFiles)
    return spark.read.format("package_files").option("slices", slices).load(root)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, empty for names that only begin with dots."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^\.*[^.].*?(\.[^.]+)$", 1))


def regular(entries: DataFrame) -> DataFrame:
    """The files among entries; a table without types has only files."""
    return entries.where("type = 'file'") if "type" in entries.columns else entries


def scan(files: DataFrame) -> DataFrame:
    """Text files and skipped ones of files(pkg_id, path, n_bytes, content, and type if it has one): pkg_id, path, text, skip_reason.

    One of text and skip_reason is null. Files below (or named as) a skipped folder have no
    row. Line ends become line feeds. A null path has no row; null content counts as too large.
    """
    files = regular(files)
    text = F.col("content").cast("string")
    reason = (
        F.when(~suffix(F.col("path")).isin(TEXT_SUFFIXES), "non-text suffix")
        .when(F.col("content").isNull() | (F.col("n_bytes") > MAX_FILE_BYTES), f"> {MAX_FILE_BYTES} bytes")
        .when(~F.is_valid_utf8(text), "not valid UTF-8")
    )
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_DIRS)))).withColumn("skip_reason", reason)
    whole = F.when(F.col("skip_reason").isNull(), F.regexp_replace(text, r"\r\n?", "\n"))
    return kept.select("pkg_id", "path", whole.alias("text"), "skip_reason")


def surface(scanned: DataFrame) -> DataFrame:
    """The text files that a package ships by contract and its content hash covers."""
    return scanned.where(F.col("text").isNotNull() & F.col("path").rlike(SURFACE))
