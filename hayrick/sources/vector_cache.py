"""Vectors by the hash of what they were made from: an append-only table that all indexes under a folder share."""

from __future__ import annotations

import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "space_id string, role string, input_hash string, dim int, vector array<float>, created_at double"
DOCUMENT, QUERY = "document", "query"


class VectorCache:
    """space: the model, dimension and input format that vectors come from; vectors of others don't count."""

    def __init__(self, base: str, space: str, dim: int):
        self.path, self.space, self.dim = f"{base.rstrip('/')}/vectors", space, dim

    def read(self, spark: SparkSession, role: str, hashes: Iterable[str] | None = None) -> DataFrame:
        """input_hash, dim and vector, the latest of each hash, of a few hashes if they are given: those reach the scan, where row groups' Bloom filters and bounds leave most of the files out. Damaged files and vectors of another length are passed over, and so made and stored again."""
        if not Path(self.path).is_dir():
            return spark.createDataFrame([], CACHE).select("input_hash", "dim", "vector")
        rows = spark.read.schema(CACHE).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(self.path)
        mine = rows.where((F.col("space_id") == self.space) & (F.col("role") == role) & (F.col("dim") == self.dim) & (F.size("vector") == self.dim))
        if hashes is not None:
            mine = mine.where(F.col("input_hash").isin(sorted(hashes)))
        return mine.groupBy("input_hash").agg(F.max_by(F.struct("dim", "vector"), F.struct("created_at", "vector")).alias("v")).select("input_hash", "v.*")

    def store(self, found: DataFrame, role: str) -> None:
        """found: input_hash, dim and vector."""
        rows = found.select(F.lit(self.space).alias("space_id"), F.lit(role).alias("role"), "input_hash", F.col("dim").cast("int"), F.col("vector").cast("array<float>"), F.lit(time.time()).alias("created_at"))
        rows = rows.sortWithinPartitions("space_id", "role", "input_hash")
        rows.write.mode("append").option("parquet.bloom.filter.enabled#input_hash", "true").partitionBy("space_id", "role").parquet(self.path)

    def of_queries(self, spark: SparkSession, texts: list[str], embed, batch: int = 32) -> tuple[list[list[float]] | None, str | None]:
        """Vectors of a call's query texts, in their order, and a warning; those the cache lacks are made in batches. The first batch that fails ends it: then there are none."""
        import hashlib

        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        known = {r["input_hash"]: list(r["vector"]) for r in self.read(spark, QUERY, set(hashes)).collect()}  # a handful
        lacking = [(h, t) for h, t in dict(zip(hashes, texts, strict=True)).items() if h not in known]
        made, warning = [], None
        for at in range(0, len(lacking), batch):
            some = lacking[at : at + batch]
            vectors, warning = embed([t for _, t in some], True)
            if vectors is None:
                break
            made += [(h, len(v), [float(x) for x in v]) for (h, _), v in zip(some, vectors, strict=True)]
        if made:
            self.store(spark.createDataFrame(made, "input_hash string, dim int, vector array<double>"), QUERY)
            known |= {h: v for h, _, v in made}
        whole = [known.get(h) for h in hashes]
        return (None, warning) if any(v is None for v in whole) else (whole, warning)
