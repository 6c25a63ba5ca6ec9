"""Git worktrees as a data source, read at once or as a stream of ticks.

The names of a tree come from git; they are cut into ranges, and tasks look up sizes, times
and, where asked for, contents. Predicates on `path` reach the list of names before there are
tasks. A file that is gone, no regular one, behind a link or larger than MOST_BYTES has a row
without size; one that changes while it is read has no content.

    spark.read.format("worktree").option("root", root).option("content", "true")
    spark.readStream.format("worktree_ticks").option("root", root).option("content_ms", "30000")

Every trigger of the stream is a tick: a row for each file, and one row without a path that
says that the tick is whole. A tick whose list of names can't be had is empty, without that
row, so that a tree that is away for a while doesn't look deleted. Hashes are looked up every
content_ms milliseconds only.
"""

from __future__ import annotations

import hashlib
import os
import stat
import subprocess
import time
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from hayrick.errors import HayrickError
from hayrick.functions.roles import LANGUAGES

MOST_BYTES = 1_000_000
RANGE = 2_000  # names of a task


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30)
    if done.returncode:
        raise HayrickError("REPOSITORY_NOT_FOUND", done.stderr.strip() or f"git {args[0]} failed in {root}")
    return done.stdout


def names(root: str) -> list[str]:
    """Tracked and new files that aren't ignored, each once, of known languages."""
    listed = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0")
    return [name for name in dict.fromkeys(listed) if Path(name).suffix in LANGUAGES]


def open_inside(root: str, name: str) -> int:
    """A descriptor of a file under root, each folder on the way opened in the one before and no link followed."""
    *folders, last = Path(name).parts
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    for part, flags in [*((f, os.O_DIRECTORY) for f in folders), (last, 0)]:
        try:
            if part == "..":
                raise OSError("the path leaves its root")
            inner = os.open(part, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | flags, dir_fd=at)
        finally:
            os.close(at)
        at = inner
    return at


def looked_up(root: str, name: str, content: bool) -> tuple[int | None, int | None, bytes | None]:
    """mtime_ns, size and content of a file as it is now; None for what can't be had."""
    try:
        with os.fdopen(open_inside(root, name), "rb") as f:
            before = os.fstat(f.fileno())
            if not stat.S_ISREG(before.st_mode) or before.st_size > MOST_BYTES:
                return None, None, None
            data = f.read() if content else None
            after = os.fstat(f.fileno())
    except OSError:
        return None, None, None
    whole = (before.st_mtime_ns, before.st_size) == (after.st_mtime_ns, after.st_size) and (data is None or len(data) == before.st_size)
    return before.st_mtime_ns, before.st_size, data if whole else None


class _Range(InputPartition):
    def __init__(self, names: list[str], tick: int = 0, content: bool = False, whole: bool = False):
        self.names, self.tick, self.content, self.whole = names, tick, content, whole


def _ranges(found: list[str], **about: object) -> list[_Range]:
    return [_Range(found[at : at + RANGE], **about) for at in range(0, len(found), RANGE)]


class _Reader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content, self.wanted = root, content, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the path, all of which hold, thin out the names; the others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value)}
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        return _ranges([n for n in names(self.root) if self._keeps(n)], content=self.content) or [_Range([])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for name in partition.names:
            when, size, data = looked_up(self.root, name, partition.content)
            yield self.root, name, when, size, None if data is None else hashlib.sha256(data).hexdigest(), data


class _Ticks(DataSourceStreamReader):
    def __init__(self, root: str, content_ms: int):
        self.root, self.content_ms = root, content_ms

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        try:
            found = names(self.root)
        except (HayrickError, OSError, subprocess.SubprocessError):
            return [_Range([], end["ms"])]
        # The first tick takes the tree's state over from what is published, without contents.
        content = bool(start["ms"]) and start["ms"] // self.content_ms < end["ms"] // self.content_ms
        return [*_ranges(found, tick=end["ms"], content=content), _Range([], end["ms"], whole=True)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for name in partition.names:
            when, size, data = looked_up(self.root, name, partition.content)
            if size is not None:
                yield self.root, name, when, size, None if data is None else hashlib.sha256(data).hexdigest(), partition.tick
        if partition.whole:
            yield self.root, None, None, None, None, partition.tick


class Worktree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return "repo string, path string, mtime_ns bigint, size bigint, hash string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["root"], self.options.get("content", "false").lower() == "true")


class WorktreeTicks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worktree_ticks"

    def schema(self) -> str:
        return "repo string, path string, mtime_ns bigint, size bigint, hash string, tick bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Ticks(self.options["root"], int(self.options.get("content_ms", "30000")))


def register(spark: SparkSession) -> None:
    """Make both sources known to a session; predicates reach them only where the session lets them."""
    spark.dataSource.register(Worktree)
    spark.dataSource.register(WorktreeTicks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
