"""Golden suites and saved pools as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.errors import HayrickError

SUITE = "name string, revision string, cases array<struct<id:string,query:string,expected:struct<path:string,qualname:string>,rationale:string>>"
POOL = "redacted boolean, cases array<struct<id:string,query:string,pool:array<struct<path:string,name:string,qualname:string,kind:string,lang:string,line:int,end_line:int,signature:string,full_signature:string,docstring:string,body:string,source_role:string,score:double>>>>"


def suite(spark: SparkSession, path: str) -> DataFrame:
    """One row a case, with the suite's name and revision."""
    rows = spark.read.schema(SUITE).option("multiLine", True).json(path)
    cases = rows.where(F.col("revision").isNotNull()).select("name", "revision", F.explode("cases").alias("c"))
    if cases.isEmpty():
        raise HayrickError("INVALID_ARGUMENT", "a suite needs a revision and cases")
    return cases.select("name", "revision", "c.id", "c.query", F.col("c.expected.path").alias("gold_path"), F.col("c.expected.qualname").alias("gold_qualname"))


def saved_pools(spark: SparkSession, path: str) -> DataFrame:
    """One row a candidate, with its rank from 1; redacted or empty pools are refused."""
    rows = spark.read.schema(POOL).option("multiLine", True).json(path)
    bad = rows.where(F.coalesce("redacted", F.lit(False)) | F.exists(F.coalesce("cases", F.array()), lambda c: F.coalesce(F.size(c["pool"]), F.lit(0)) < 1) | (F.coalesce(F.size("cases"), F.lit(0)) < 1))
    if not bad.isEmpty():
        raise HayrickError("INVALID_ARGUMENT", "pools that are redacted or empty can't be replayed")
    each = rows.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("qid"), F.col("c.query").alias("query"), F.posexplode("c.pool").alias("at", "p"))
    return each.select("qid", "query", (F.col("at") + 1).alias("rank"), "p.*")
