import datetime

import pytest
from pyspark.sql import functions as F

from hayrick.operators import dense, evaluate, fusion, lexical, maintenance


def rank(rows):
    return [r["id"] for r in sorted(rows.collect(), key=lambda r: r["rank"])]


def test_fusion_keeps_first_appearance_on_ties(spark):
    lists = spark.createDataFrame([(0, n, r, i) for n, ids in enumerate([[1, 5], [1, 9]]) for r, i in enumerate(ids, 1)], "qid int, list_no int, rank int, id int")
    fused = fusion.fuse(lists)
    assert rank(fused) == [1, 5, 9]
    scores = {r["id"]: r["score"] for r in fused.collect()}
    assert scores[1] == pytest.approx(2 / 61) and scores[5] == scores[9] == pytest.approx(1 / 62)


def test_pool_expansion_quota_cap_and_order(spark):
    symbols = spark.createDataFrame([(f * 10 + k, f"f{f}", k % 3, k / 10) for f in range(20) for k in range(6)], "id int, path string, hits int, cosine double")
    pool = spark.createDataFrame([(0, f * 10, f"f{f}", 1.0 / (f + 1), f + 1) for f in range(20)], "qid int, id int, path string, score double, rank int")
    rows = sorted(fusion.expand_pool(pool, symbols).collect(), key=lambda r: r["position"])
    assert len(rows) == 50 and len({r["path"] for r in rows}) == 17
    assert [r["id"] for r in rows[:3]] == [5, 2, 4] and rows[-1]["path"] == "f16"
    unscored = pool.withColumn("score", F.lit(0.0))
    assert fusion.expand_pool(unscored, symbols).count() == 0


def test_replies_of_a_reranker(spark):
    sizes = spark.createDataFrame([(q, 2) for q in range(6)], "qid int, size int")
    replies = [(0, 1, 0.5, 0), (0, 0, 0.9, 1), (1, 0, 1.0, 0), (2, 0, 1.0, 0), (2, 0, 1.0, 1), (3, 0, float("nan"), 0), (3, 1, 1.0, 1), (4, 0, 1.0, 0), (4, 2, 1.0, 1)]
    valid = fusion.valid_orders(spark.createDataFrame(replies, "qid int, idx int, score double, response_pos int"), sizes)
    assert {r["qid"]: r["valid"] for r in valid.collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}


def test_ties_of_a_reply_keep_its_order(spark):
    pool = spark.createDataFrame([(0, 1, 10, 0.3), (0, 2, 20, 0.2), (0, 3, 30, 0.1)], "qid int, rank int, id int, score double")
    replies = spark.createDataFrame([(0, 2, 0.5, 0), (0, 0, 0.5, 1), (0, 1, 0.7, 2)], "qid int, idx int, score double, response_pos int")
    ok = spark.createDataFrame([(0, True)], "qid int, valid boolean")
    found = fusion.apply_rerank(pool, replies, ok, F.col("score")).orderBy("new_rank").collect()
    assert [r["id"] for r in found] == [20, 30, 10]


def test_production_is_preferred_only_when_nearly_equal(spark):
    rows = spark.createDataFrame([(0, 1, 0.5, "test", 1), (0, 2, 0.495, "production", 2), (0, 3, 0.4, "production", 3)], "qid int, id int, score double, source_role string, rank int")
    assert [r["id"] for r in fusion.prefer_production(rows).orderBy("new_rank").collect()] == [2, 1, 3]


def test_bm25_against_sqlite(spark):
    import sqlite3

    texts = ["red fox jumps", "red red wine and fox", "the quick brown fox", "wine list", "nothing here", "foxes and red foxes red", "brown wine", "x y z"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    expected = {r[0]: -r[1] for r in db.execute("select rowid, bm25(t) from t where t match 'red OR wine OR wine'")}
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string")
    queries = spark.createDataFrame([(0, "red"), (0, "wine"), (0, "wine")], "qid int, term string")
    found = {r["id"]: r["score"] for r in lexical.bm25(queries, lexical.frequencies(docs), lexical.lengths(docs)).collect()}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k], abs=1e-6) for k in found)


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "foo_bar baz foo bar"), (2, "bar foo"), (3, "foo foo bar")], "doc_id int, text string")
    assert {r["id"]: r["tf"] for r in lexical.phrase_counts(lexical.postings(docs), ["foo", "bar"]).collect()} == {1: 2, 3: 1}


def test_neighbours_in_blocks(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)] + [(99, None)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(4)
    queries = table.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "qid")
    found = {}
    for r in dense.knn(queries, table, 5, block=3).collect():
        found.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for q in range(0, 60, 10):
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(rows[q][1], v)) ** 0.5, 9), i) for i, v in rows if v)
        assert [i for _, i in sorted(found[q])] == [i for _, i in d[:5]]


def test_incremental_diff(spark):
    schema = "path string, mtime_ns bigint, size bigint"
    known = spark.createDataFrame([("same", 1, 1), ("changed", 1, 1), ("gone", 1, 1)], schema)
    here = spark.createDataFrame([("same", 1, 1), ("changed", 2, 1), ("new", 1, 1)], schema)
    got = lambda **k: dict(map(tuple, maintenance.diff(here, known, **k).collect()))
    assert got() == {"same": "same", "changed": "changed", "new": "new", "gone": "removed"}
    assert got(scoped=spark.createDataFrame([("same",)], "path string")) == {"same": "changed", "gone": "removed"}
    assert got(rebuild=True)["same"] == "changed"
    assert maintenance.drift(here, known).first().asDict() == {"gone": 1, "new": 1, "changed": 1}


def test_publication_keeps_what_could_not_be_parsed(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "path string, v int")
    staged = spark.createDataFrame([("a", 2), ("b", 2)], "path string, v int")
    states = spark.createDataFrame([("a", "ok"), ("b", "error"), ("d", "empty")], "path string, status string")
    removed = spark.createDataFrame([("c",)], "path string")
    assert sorted(map(tuple, maintenance.publish(old, staged, states, removed).collect())) == [("a", 2), ("b", 1)]


def test_latest_reconcile_and_cache(spark):
    events = spark.createDataFrame([("j1", 1, "queued"), ("j1", 2, "running"), ("j2", 1, "completed")], "job_id string, n int, state string")
    last = maintenance.latest(events, "job_id", F.col("n"))
    assert {r["job_id"]: r["state"] for r in maintenance.reconcile(last, F.lit("none")).collect()} == {"j1": "interrupted", "j2": "completed"}
    assert {r["job_id"]: r["state"] for r in maintenance.reconcile(last, F.lit("j1")).collect()} == {"j1": "running", "j2": "completed"}
    inputs = maintenance.distinct_inputs(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id int, text string"))
    assert {r["text"]: r["n_rows"] for r in inputs.collect()} == {"x": 2, "y": 1}
    keys = {r["text"]: r["embed_key"] for r in inputs.collect()}
    cache = spark.createDataFrame([(keys["x"], 2, [1.0, 2.0]), (keys["y"], 2, [1.0])], "input_hash string, dim int, vector array<double>")
    assert {r["text"]: r["hit"] for r in maintenance.cache_split(inputs, cache, 2).collect()} == {"x": True, "y": False}


def test_sessions_and_backoff(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t + datetime.timedelta(seconds=s)) for s in (0, 5, 15, 26)] + [(2, t)]
    found = maintenance.sessions(spark.createDataFrame(rows, "k int, ts timestamp"), 10, ["k"]).collect()
    assert sorted((r["k"], r["n"]) for r in found) == [(1, 1), (1, 1), (1, 2), (2, 1)]
    waits = spark.range(10).select(maintenance.backoff(F.col("id"))).collect()
    assert [r[0] for r in waits] == [min(2.0 * 2**n, 300.0) for n in range(10)]


def test_summary(spark):
    cases = spark.createDataFrame([("a", 2, 1, 1.0, []), ("b", 12, 3, 3.0, ["slow"])], "qid string, rank int, path_rank int, latency double, warnings array<string>")
    r = evaluate.summary(cases, 10).first()
    assert (r["recall"], r["mrr"], r["file_presence"], r["p50"], r["p95"], r["total_seconds"], r["with_warnings"]) == (0.5, 0.25, 1.0, 1.0, 3.0, 4.0, 1)


def test_loss_stages(spark):
    rows = spark.createDataFrame([(1, True, True), (12, True, True), (None, True, False), (None, False, True), (None, False, False)], "rank int, pool boolean, lists boolean")
    found = [r[0] for r in rows.select(evaluate.loss_stage(F.col("rank"), F.col("pool"), F.col("lists"), 10)).collect()]
    assert found == [None, "ranked_deep", "not_fetched", "pool_cutoff", "not_retrieved"]


def test_yes_no_scores(spark):
    def score(*entries):
        df = spark.createDataFrame([([*entries],)], "e array<struct<token:string,logprob:double>>")
        return df.select(evaluate.yes_no_score(F.col("e"))).first()[0]

    assert score(("yes", -0.01), ("no", -5.0)) > 0.97 and score(("no", -0.01), ("yes", -5.0)) < 0.03
    assert score(("yes", -0.1), ("maybe", -6.0)) > 0.97
    assert score(("maybe", -1.0)) is None and score() is None


def test_rerank_items(spark):
    reply = '{"results": [{"index": 1, "relevance_score": 0.4}, {"index": 0, "score": 0.2}, {"index": 2}]}'
    df = spark.createDataFrame([(reply,), ("nonsense",)], "r string").select(evaluate.rerank_items(F.col("r")).alias("x")).collect()
    assert [tuple(i) for i in df[0]["x"]] == [(1, 0.4), (0, 0.2)] and df[1]["x"] is None


def test_percentiles_and_ranks_over_ranges(spark):
    """Without a group in one array: ranks are found in ranges of values, whatever their number."""
    import inspect
    import math
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), rnd.choice([None, float(rnd.randrange(9)), rnd.random()])) for _ in range(700)] + [("c", None), (None, 2.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for each in (20, 1_000_000):
        found = {r["g"]: (r["p50"], r["p95"]) for r in evaluate.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, each).collect()}
        for g in ("a", "b", "c", None):
            values = sorted(v for h, v in rows if h == g and v is not None)
            assert found[g] == tuple(values[max(1, math.ceil(len(values) * f)) - 1] if values else None for f in (0.5, 0.95))
        ids = spark.createDataFrame([(i % 3 // 2, i) for i in range(200)], "g int, id bigint")
        ranked = sorted((r["g"], r["id"], r["rank"]) for r in evaluate.row_ranks(ids, ["g"], "id", each).collect())
        assert [x for _, _, x in ranked] == [*range(1, 135), *range(1, 67)]
    assert "collect_list" not in inspect.getsource(evaluate)


def test_tables_that_were_cleared_away_are_written_again(spark, tmp_path, monkeypatch):
    import shutil

    from hayrick.sources import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda spark: f"file://{tmp_path}")
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert scratch.once(spark, "t", "somewhere", make).count() == 5
    folders = list((tmp_path / "hayrick").iterdir())
    assert len(folders) == 1
    shutil.rmtree(folders[0])
    assert scratch.once(spark, "t", "somewhere", make).count() == 5


def test_neighbours_of_many_queries_in_cells(spark, monkeypatch):
    """Groups of queries and slabs of rows give what one broadcast gives."""
    import random

    from hayrick.operators import dense

    rnd = random.Random(3)
    rows = spark.createDataFrame([(i, [rnd.choice((0.0, 0.5, 1.0)) for _ in range(4)] if i % 50 else None) for i in range(400)], "vec_id bigint, embedding array<double>")
    queries = rows.where("vec_id < 60").withColumnRenamed("vec_id", "qid")
    monkeypatch.setattr(dense, "SLAB", 70)
    few, many = (sorted((r["qid"], r["rank"], r["id"], round(r["distance"], 9)) for r in dense.knn(queries, rows, 7, block=b).collect()) for b in (4096, 9))
    assert few == many and len(few) == 58 * 7
    assert dense.knn(queries.where("false"), rows, 7).count() == 0
