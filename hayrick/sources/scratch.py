"""Tables written once into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_stored: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a single machine runs all of Spark and none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hayrick-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, by: str | tuple[str, ...] | None = None) -> DataFrame:
    """df as Parquet, read back; sorted by columns, its files tell which of its values they hold."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name, by))


def _write(df: DataFrame, name: str, by: str | tuple[str, ...] | None) -> str:
    path = f"{shared_folder(df.sparkSession)}/hayrick/{name}-{uuid.uuid4().hex}"
    if by:
        by = (by,) if isinstance(by, str) else by
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    df.write.parquet(path)
    return path


def fingerprint(spark: SparkSession, source: str) -> str:
    """Which files a table has, with their sizes and times: one row, and no content is read. A source without files is always the same."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    except AnalysisException:
        return "none"
    found = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("x")).first()
    return f"{found['n']}:{found['x']}"


def once(spark: SparkSession, name: str, source: str, make, by: str | tuple[str, ...] | None = None) -> DataFrame:
    """A table derived from the table at `source`, written at its first use in this application, and again if the files of `source` are others or it was cleared away."""
    key, df = (spark.sparkContext.applicationId, name, f"{source} {fingerprint(spark, source)}"), make()
    for _ in range(2):
        if key not in _stored:
            _stored[key] = _write(df, name, by)
        try:
            return spark.read.schema(df.schema).parquet(_stored[key])
        except AnalysisException:
            del _stored[key]
    raise FileNotFoundError(f"{name} can't be kept in {shared_folder(spark)}")
