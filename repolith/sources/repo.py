"""A source tree as a Spark data source: ``spark.read.format("repo").option("path", ...)``.

The driver lists the upper folders, tasks the others; files are read in partitions of bounded bytes, and those that a filter on
path, name, extension or size leaves out are never opened. Symbolic links and paths that leave the
root are left out; texts are UTF-8 with replacement. ``root`` must be on storage that all executors see.
"""

from __future__ import annotations

import operator
import os
from collections import deque
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    Not, StringContains, StringEndsWith, StringStartsWith,
)

SCHEMA = "file_ord bigint, path string, name string, extension string, size_bytes bigint, content string, read_error string"
#: Candidates for the read-me, in order.
README_NAMES = ("README.md", "README", "readme.md", "README.txt")


class _Files(InputPartition):
    """Files (number, path, size) and folders (number, path with a last slash, None), which the task lists itself."""

    def __init__(self, root: str, entries: list[tuple[int, str, int | None]]):
        super().__init__(len(entries))
        self.root, self.entries = root, entries


def inside(base: str, target: str) -> bool:
    base, target = os.path.realpath(base), os.path.realpath(target)
    return target == base or target.startswith(base.rstrip(os.sep) + os.sep)


def _skipped(path: str, name: str, patterns: list[str]) -> bool:
    segments = path.split("/")
    return any(fnmatchcase(path, p) or fnmatchcase(name, p) or (p.endswith("/") and path.startswith(p[:-1])) or p.rstrip("/") in segments for p in patterns)


#: Numbers of files that a folder listed in a task keeps free.
FOLDER_NUMBERS = 1 << 32


def _scanned(root: str, prefix: str, patterns: list[str]) -> list[tuple[str, int | None]]:
    """What is right in the folder ``prefix`` by name: files with their size, folders with a last slash and None. Unreadable folders
    are empty; what matches an exclude pattern, links and paths outside the root are left out."""
    try:
        entries = sorted(os.scandir(os.path.join(root, prefix)), key=lambda e: e.name)
    except OSError:
        return []
    out: list[tuple[str, int | None]] = []
    for entry in entries:
        path = prefix + entry.name
        if entry.is_symlink() or _skipped(path, entry.name, patterns) or not inside(root, entry.path):
            continue
        if entry.is_dir(follow_symlinks=False):
            out.append((path + "/", None))
        elif entry.is_file(follow_symlinks=False):
            out.append((path, entry.stat(follow_symlinks=False).st_size))
    return out


def _walked(root: str, prefix: str, patterns: list[str], most_folders: int | None = None) -> Iterator[tuple[str, int | None]]:
    """All below ``prefix`` in path order. With ``most_folders``, only so many folders are opened, those nearest to it first; the others
    stand for what is in them."""
    opened: dict[str, list] | None = None
    if most_folders is not None:
        opened, waiting = {}, deque([prefix])
        while waiting and len(opened) < most_folders:
            folder = waiting.popleft()
            opened[folder] = _scanned(root, folder, patterns)
            waiting.extend(path for path, size in opened[folder] if size is None)
    stack = [iter(_scanned(root, prefix, patterns) if opened is None else opened[prefix])]
    while stack:
        path, size = next(stack[-1], (None, None))
        if path is None:
            stack.pop()
        elif size is None and (opened is None or path in opened):
            stack.append(iter(_scanned(root, path, patterns) if opened is None else opened[path]))
        else:
            yield path, size


_COMPARED = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: What is known of a file before it is opened; no column of these is ever null.
_KNOWN = ("path", "name", "extension", "size_bytes")


def _test(f: Filter) -> Callable[[dict], bool] | None:
    """The filter as a test of a file's known columns; None if it asks for others or is of another kind."""
    if isinstance(f, Not):
        child = _test(f.child)
        return child and (lambda x: not child(x))
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in _KNOWN:
        return None
    column = f.attribute[0]
    if isinstance(f, IsNotNull):
        return lambda x: True
    if getattr(f, "value", None) is None or isinstance(f, In) and None in f.value:
        return None
    value = f.value
    if isinstance(f, EqualTo):
        return lambda x: x[column] == value
    if isinstance(f, In):
        return lambda x: x[column] in value
    if isinstance(f, StringStartsWith):
        return lambda x: x[column].startswith(value)
    if isinstance(f, StringEndsWith):
        return lambda x: x[column].endswith(value)
    if isinstance(f, StringContains):
        return lambda x: value in x[column]
    compare = _COMPARED.get(type(f))
    return compare and (lambda x: compare(x[column], value))


class _Reader(DataSourceReader):
    """``partitions`` opens at most ``driverFolders`` folders on the driver; tasks list what is below. Numbers follow path order, without
    gaps unless a task lists. Filters on what the listing knows are applied before a file is opened, those on where a path starts before
    a task lists a folder; what the driver opens doesn't depend on filters, as numbers don't."""

    def __init__(self, options):
        self.root = options["path"]
        self.bytes = int(options.get("partitionBytes", 32 << 20))
        self.folders = int(options.get("driverFolders", 1000))
        self.patterns = [p for p in options.get("exclude", "").split("\n") if p]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def _entered(self, folder: str) -> bool:
        """Whether files below ``folder`` can pass the filters on where a path starts."""
        starts = [(f.value,) for f in self.filters if isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",)]
        starts += [f.value for f in self.filters if isinstance(f, In) and f.attribute == ("path",)]
        return all(any(x.startswith(folder) or folder.startswith(x) for x in one) for one in starts)

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"{self.root} is no folder")
        tests = [_test(f) for f in self.filters]
        parts, entries, size, number = [], [], 0, 0
        for path, n in _walked(self.root, "", self.patterns, self.folders):
            at, number = number, number + (FOLDER_NUMBERS if n is None else 1)
            if not (self._entered(path) if n is None else self._passes(tests, path, n)):
                continue
            if entries and (n is None or entries[-1][2] is None or size + n > self.bytes):
                parts.append(_Files(self.root, entries))
                entries, size = [], 0
            entries.append((at, path, n))
            size += n or 0
        return [*parts, _Files(self.root, entries)] if entries or not parts else parts

    @staticmethod
    def _passes(tests: list[Callable[[dict], bool]], path: str, size: int) -> bool:
        name = path.rpartition("/")[2]
        known = {"path": path, "name": name, "extension": os.path.splitext(name)[1].lower(), "size_bytes": size}
        return all(test(known) for test in tests)

    def read(self, partition: _Files) -> Iterator[tuple]:
        tests = [_test(f) for f in self.filters]
        for at, entry, n in partition.entries:
            below = [(entry, n)] if n is not None else _walked(partition.root, entry, self.patterns)
            for i, (path, size) in enumerate(below):
                if self._passes(tests, path, size):
                    yield self._row(partition.root, at + i, path, size)

    @staticmethod
    def _row(root: str, number: int, path: str, size: int) -> tuple:
        name = path.rpartition("/")[2]
        content = error = None
        full = os.path.join(root, path)
        try:
            if not inside(root, full):
                raise PermissionError("outside the root")
            with open(os.open(full, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
                content = f.read().decode("utf-8", "replace")
        except OSError as e:
            error = type(e).__name__
        return number, path, name, os.path.splitext(name)[1].lower(), size, content, error


class RepoDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), driver_folders: int = 1000) -> DataFrame:
    """The files below ``root``. Sets the session to push filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoDataSource)
    return spark.read.format("repo").option("path", root).option("exclude", "\n".join(exclude)).option("driverFolders", driver_folders).load()


def with_extensions(files: DataFrame, extensions: tuple[str, ...] | None = None, folder: str = "", recursive: bool = True) -> DataFrame:
    """``files`` (path, name) below ``folder``, or right in it, whose extension is one of these, case and all; None takes all. A
    leading dot alone makes no extension. Where ``files`` has the lower-case ``extension``, a filter on it comes first, which a source
    can apply."""
    inside = F.col("path").startswith(f"{folder}/") if folder else F.lit(True)
    rest = F.substring("path", len(folder) + 2 if folder else 1, 1 << 30)
    suffix = F.regexp_extract("name", r"(?s)^.*[^.].*?(\.[^./]+)$", 1)
    kept = inside if recursive else inside & ~F.contains(rest, F.lit("/"))
    if extensions is None:
        return files.filter(kept)
    if "extension" in files.columns and "" not in extensions:
        kept = kept & F.col("extension").isin(*{x.lower() for x in extensions})
    return files.filter(kept & suffix.isin(*extensions))


def readme(files: DataFrame) -> DataFrame:
    """The content of the first of the read-me names at the root; null where that one can't be read."""
    names = F.array(*map(F.lit, README_NAMES))
    return files.filter(F.col("path").isin(*README_NAMES)).agg(F.min_by("content", F.array_position(names, F.col("path"))).alias("readme"))
