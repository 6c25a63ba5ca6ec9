"""Lookups of a few hashes reach the scan of the cache of vectors."""

import re

from hayrick.sources.vector_cache import DOCUMENT, QUERY, VectorCache


def test_hashes_reach_the_scan(spark, tmp_path):
    cache = VectorCache(str(tmp_path), "space", 1)
    assert cache.read(spark, QUERY, ["a"]).isEmpty()
    rows = spark.range(5000).selectExpr("sha2(cast(id as string), 256) as input_hash", "1 as dim", "array(cast(id as float)) as vector")
    cache.store(rows, QUERY)
    cache.store(rows.limit(10), DOCUMENT)
    hashes = [r["input_hash"] for r in rows.where("id in (7, 4321)").collect()]
    found = cache.read(spark, QUERY, [*hashes, "absent"])
    assert {r["input_hash"]: r["vector"] for r in found.collect()} == dict(zip(hashes, ([7.0], [4321.0]), strict=True))
    assert cache.read(spark, QUERY, []).isEmpty()
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(input_hash", plan) and re.search(r"PartitionFilters: \[[^\]]*role", plan)
