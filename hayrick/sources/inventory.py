"""Files of a git worktree as DataFrames, from the data source in worktree.py."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.errors import HayrickError
from hayrick.functions.roles import language_of
from hayrick.sources import worktree
from hayrick.sources.worktree import MOST_BYTES, git


def root_of(path: str) -> str:
    return os.path.realpath(git(path, "rev-parse", "--show-toplevel").strip())


def head(root: str) -> tuple[str | None, bool]:
    """Commit (None before the first one) and whether the tree differs from it."""
    try:
        commit = git(root, "rev-parse", "HEAD").strip()
    except HayrickError:
        commit = None
    return commit, bool(git(root, "status", "--porcelain").strip())


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """repo, path, mtime_ns and size of the tree's files, looked up in tasks; names that are gone meanwhile have no row."""
    worktree.register(spark)
    found = spark.read.format("worktree").option("root", root).load()
    return found.where(F.col("size").isNotNull()).select("repo", "path", "mtime_ns", "size")


def scoped(inventory_: DataFrame, root: str, paths: list[str]) -> DataFrame:
    """Rows of the requested paths; those outside of the root are dropped."""
    inside = []
    for p in paths:
        rel = os.path.relpath(os.path.join(root, p), root)
        if not rel.startswith("..") and not os.path.isabs(rel):
            inside.append((rel,))
    return inventory_.join(F.broadcast(inventory_.sparkSession.createDataFrame(inside, "path string")), "path", "left_semi")  # as many rows as the call named


def capture(files: DataFrame, root: str) -> DataFrame:
    """path, content, hash and size of files as they are now; null content if a file is gone, behind a link, or changed while it was read."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for name in batch["path"]:
                _, size, content = worktree.looked_up(root, name, True)
                rows.append((name, content, "" if content is None else hashlib.sha256(content).hexdigest(), None if content is None else size))
            yield pd.DataFrame(rows, columns=["path", "content", "hash", "size"]).astype({"size": "Int64"})

    return files.select("path").mapInPandas(read, "path string, content binary, hash string, size bigint")


def capture_binary(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The same from a folder in any store that Spark reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    inside = F.regexp_replace("path", r"^.*?" + folder.rstrip("/").replace(".", r"\.").rsplit(":", 1)[-1] + "/", "")
    return found.where(F.col("length") <= MOST_BYTES).select(inside.alias("path"), "content", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), (F.col("modificationTime").cast("double") * 1e9).cast("bigint").alias("mtime_ns"))


def languages(files: DataFrame) -> DataFrame:
    return files.select(language_of(F.col("path")).alias("language")).where(F.col("language").isNotNull()).distinct().orderBy("language")
