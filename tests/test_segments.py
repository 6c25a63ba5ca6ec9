"""Segments with tombstones against a plain list of rows, and what a publication writes."""

import random
import shutil

import pytest

from hayrick.operators import maintenance
from hayrick.plans import catalogue
from hayrick.sources import scratch
from hayrick.sources.segments import Segments, Table


def test_publications_against_a_plain_list(spark, tmp_path):
    """Additions, replacements, removals and returns of keys, repeated keys, null keys; every earlier state stays readable."""
    kept = Segments("id bigint, name string, note struct<a:int,b:array<string>>", "id", ("name",), fan=3, smallest=4)
    rnd, table, plain, states = random.Random(4), Table(), [], []
    for seq in range(1, 11):
        keys = [rnd.randrange(40) for _ in range(rnd.randrange(1, 6))] + ([None] if seq == 4 else [])
        gone = {rnd.randrange(40) for _ in range(3)} | ({k for k in keys if k is not None} if seq % 2 else set())
        rows = [(k, f"n{seq}", (seq, [str(k)])) for k in keys]
        plain = [r for r in plain if r[0] not in gone] + rows
        over = spark.createDataFrame([(k,) for k in gone], "id bigint")
        table = kept.publish(spark, table, str(tmp_path), seq, spark.createDataFrame(rows, kept.schema), over)
        assert table == Table.of(table.state())
        states.append((table, sorted(map(repr, plain))))
    for then, wanted in states:
        assert sorted(repr((r["id"], r["name"], (r["note"]["a"], r["note"]["b"]))) for r in kept.read(spark, then).collect()) == wanted
    assert len(table.rows) < 6 and len({s.place for s in table.rows}) == len(table.rows)


def test_a_change_writes_what_it_changes(spark, tmp_path):
    kept = Segments("id bigint, body string", "id", ("id",), fan=4, smallest=8)
    many = spark.range(10_000).selectExpr("id", "concat('text ', id) body")
    table = kept.publish(spark, Table(), str(tmp_path), 1, many)
    for seq in range(2, 14):
        kept.written.clear()
        one = spark.createDataFrame([(seq, f"new {seq}")], kept.schema)
        table = kept.publish(spark, table, str(tmp_path), seq, one, one.select("id"))
        assert sum(kept.written) <= 30  # the row, its tombstone, and now and then a merge of small segments
    assert len(table.rows) <= 6 and max(s.rows for s in table.rows) == 10_000
    found = kept.read(spark, table)
    assert found.count() == 10_000 and {r["body"] for r in found.where("id < 15").collect()} == {f"text {i}" for i in (0, 1, 14)} | {f"new {i}" for i in range(2, 14)}


def test_tombstones_go_when_they_have_been_applied(spark, tmp_path):
    kept = Segments("id bigint", "id", fan=2, smallest=10)
    table = kept.publish(spark, Table(), str(tmp_path), 1, spark.range(100))
    table = kept.publish(spark, table, str(tmp_path), 2, over=spark.range(60))  # more than half is over: all is rewritten
    assert not table.dead and [s.rows for s in table.rows] == [40]
    table = kept.publish(spark, table, str(tmp_path), 3, over=spark.range(60, 100))
    assert kept.read(spark, table).count() == 0
    assert kept.read(spark, kept.publish(spark, table, str(tmp_path), 4, spark.range(5))).count() == 5


def test_merging_gives_what_a_rebuild_gives(spark, tmp_path):
    """The same publications with many merges, without any, and as anti joins and unions."""
    often, never = (Segments("path string, v int", "path", fan=f, smallest=n) for f, n in ((2, 1), (10**6, 10**6)))
    a = b = Table()
    plain = spark.createDataFrame([], "path string, v int")
    for seq in range(1, 6):
        rows = spark.createDataFrame([(f"p{(seq * k) % 7}", seq) for k in range(3)], plain.schema).distinct()
        a = often.publish(spark, a, f"{tmp_path}/a", seq, rows, rows.select("path"))
        b = never.publish(spark, b, f"{tmp_path}/b", seq, rows, rows.select("path"))
        plain = maintenance.upsert(plain, rows, ["path"])
    wanted = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, often.read(spark, a).collect())) == sorted(map(tuple, never.read(spark, b).collect())) == wanted
    assert len(a.rows) < len(b.rows) == 5


LEXICAL = ("bm25_topk", "bm25_multi_query", "rrf_fuse", "hybrid_search", "pool_expansion", "fallback_rank", "production_prior", "rerank_apply", "porter_bm25")


@pytest.mark.parametrize("name", LEXICAL)
def test_queries_see_the_table_as_it_is(spark, tmp_path, name):
    """A table that is overwritten between two calls: no row of the old one is left."""
    folder = str(tmp_path / name)
    shutil.copytree("/root/testdata/sf0.001", folder)
    ids = [c for c in ("id", "doc_id") if c in catalogue.QUERIES[name](spark, folder).columns]
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    before = {r[0] for r in catalogue.QUERIES[name](spark, folder).select(ids[0]).distinct().collect()}
    documents.withColumn("doc_id", documents["doc_id"] + 100_000).coalesce(1).write.parquet(f"{folder}/next")
    shutil.rmtree(f"{folder}/documents.parquet") if (tmp_path / name / "documents.parquet").is_dir() else (tmp_path / name / "documents.parquet").unlink()
    shutil.move(f"{folder}/next", f"{folder}/documents.parquet")
    spark.catalog.refreshByPath(f"{folder}/documents.parquet")
    after = {r[0] for r in catalogue.QUERIES[name](spark, folder).select(ids[0]).distinct().collect()}
    dense = {r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()} if name == "rrf_fuse" else set()  # which it ranks too
    assert before and after - dense and min(after - dense) >= 100_000 > max(before)


def test_fingerprints_follow_files(spark, tmp_path):
    place = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(place)
    first = scratch.fingerprint(spark, place)
    assert first == scratch.fingerprint(spark, place)
    spark.range(4).write.mode("append").parquet(place)
    assert scratch.fingerprint(spark, place) != first
