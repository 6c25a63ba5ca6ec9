"""Queries that are sent to the documents: the rows of the joins, and no shuffle of queries times documents."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hayrick.functions.porter import stem
from hayrick.operators import lexical
from hayrick.plans import catalogue


def found(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    words = ["red", "wine", "wines", "glass", "of", "the", "table", "tables", "Öl"]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice((0, 2, 9, 40))))) for i in range(300)]
    # rows that share an id, copies, texts of nothing, no id
    rows += [(5, "red wine of the table"), (5, "red"), (5, None), (7, ""), (400, "glass of wine"), (401, "glass of wine"), (402, None), (None, "red red wine"), (None, "the")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


QUERIES = [(0, "red"), (0, "wine"), (0, "wine"), (1, "of"), (1, "the"), (2, "nowhere"), (3, "öl"), (3, "nowhere"), (None, "glass")]


@pytest.mark.parametrize("cells", [1 << 21, 40])
@pytest.mark.parametrize("most", [1 << 16, 2])
def test_words(spark, docs, cells, most, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "MOST", most)
    queries = spark.createDataFrame(QUERIES, "qid int, term string")
    for k in (3, 1000):
        wanted = lexical.top_k(lexical.bm25(queries, lexical.frequencies(docs), lexical.lengths(docs)), k)
        assert found(lexical.search(queries.where("qid IS NOT NULL"), lexical.counted(docs), k)) == found(wanted.where("qid IS NOT NULL"))


def test_stems_and_no_query(spark, docs):
    queries = spark.createDataFrame([(0, "wine"), (0, "tabl")], "qid int, term string")
    stems = lexical.search(queries, lexical.counted(docs), 50, tokens=stem)
    tokens = stem(lexical.index_tokens(F.col("text")))
    assert found(stems) == found(lexical.top_k(lexical.bm25(queries, lexical.frequencies(docs, tokens=tokens), lexical.lengths(docs)), 50))
    assert lexical.search(queries.where("false"), lexical.counted(docs), 5).isEmpty()
    assert lexical.search(queries, lexical.counted(docs.where("false")), 5).isEmpty()


@pytest.mark.parametrize("most", [1 << 16, 2])
def test_phrases(spark, docs, most, monkeypatch):
    monkeypatch.setattr(lexical, "MOST", most)
    docs = docs.where("doc_id NOT IN (5, 7)")  # stored positions of rows that share an id run into each other
    phrases = [(0, "red wine"), (0, "red wine"), (0, "of"), (1, "of the table"), (1, "of the"), (2, "red red"), (3, "not there")]
    asked = spark.createDataFrame([(q, p, p.split()) for q, p in phrases], "qid int, term string, words array<string>")
    freqs = lexical.asked_frequencies(lexical.postings(docs), asked.select("term", "words").distinct())
    wanted = lexical.top_k(lexical.bm25(asked.select("qid", "term"), freqs, lexical.lengths(docs)), 30)
    assert found(lexical.search_phrases(asked, docs, 30)) == found(wanted)


def test_counted_rows_give_frequencies(spark, docs):
    plain = lambda df: sorted(map(repr, ((r["term"], r["id"], r["tf"]) for r in df.collect())))
    assert plain(lexical.counted_frequencies(lexical.counted(docs))) == plain(lexical.frequencies(docs))


def test_only_the_best_of_each_task_are_dealt(spark):
    """Before, a row for each query and document was shuffled."""
    texts = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("red wine "), F.col("id")).alias("text"))
    queries = spark.createDataFrame([(q, t) for q in range(20) for t in ("red", "wine")], "qid int, term string")
    plan = lexical.search(queries, lexical.counted(texts), 3)._jdf.queryExecution().executedPlan()
    assert "HashAggregate" not in plan.toString() and "Join" not in plan.toString()


def test_postings_are_made_where_texts_were_dealt(spark, docs):
    """One exchange, of texts."""
    plan = lexical.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_phrases_of_rows_that_share_an_id(spark):
    """Counted row by row and added up, as in the SQL."""
    docs = spark.createDataFrame([(1, "red wine"), (1, "red wine red wine"), (2, "wine red")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, "red wine", ["red", "wine"])], "qid int, term string, words array<string>")
    avgdl = 8 / 3
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5))  # one id of three rows
    wanted = sum(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * dl / avgdl)) for dl in (2, 4))
    (row,) = lexical.search_phrases(asked, docs, 5).collect()
    assert row["id"] == 1 and row["rank"] == 1 and row["score"] == pytest.approx(wanted, rel=1e-9)


def test_a_batch_is_counted_in_stretches(monkeypatch):
    """Before, the tokens of all rows of a batch were counted together, however many they were."""
    texts = [["a", "b", "a"], None, [], ["c"] * 9, ["a"], ["b", "b"], ["d", "a", "d"], ["e"] * 4, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], ["id", "t"])
    rows = lambda parts: [(r["id"], r["dl"], dict(zip(r["terms"], r["tfs"], strict=True))) for p in parts for r in p.to_pylist()]
    wanted = [(i, None if t is None else len(t), {x: t.count(x) for x in t or ()}) for i, t in enumerate(texts)]
    assert rows(lexical._count_terms([batch])) == wanted
    monkeypatch.setattr(lexical, "TOKENS", 5, raising=False)
    parts = list(lexical._count_terms([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)]))
    assert rows(parts) == wanted
    assert [p.num_rows for p in parts] == [3, 1, 2, 1, 2]  # 9 tokens of one row are counted alone


@pytest.mark.parametrize("tokens", [1, 7])
def test_stretches_give_the_rows_of_the_joins(spark, docs, tokens, monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS", tokens, raising=False)
    queries = spark.createDataFrame([q for q in QUERIES if q[0] is not None], "qid int, term string")
    wanted = found(lexical.top_k(lexical.bm25(queries, lexical.frequencies(docs), lexical.lengths(docs)), 20))
    assert found(lexical.search(queries, lexical.counted(docs), 20)) == wanted
    phrases = queries.withColumn("words", F.array("term"))
    assert found(lexical.search_phrases(phrases, docs, 20)) == wanted


@pytest.mark.parametrize("name", ["rerank_apply", "fallback_rank", "hybrid_search", "bm25_topk", "production_prior"])
def test_queries_join_no_postings(spark, name, monkeypatch):
    """Before, these queries joined postings with terms of queries, and shuffled a row for each query and document."""
    monkeypatch.setattr(lexical, "bm25", None)
    assert not catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
