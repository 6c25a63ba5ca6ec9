"""Blocks of impacts: same rows as scoring every posting, and fewer postings taken up."""

import random

import pytest
from pyspark.sql import functions as F

from hayrick.operators import impact, lexical


def corpus(spark, n=3000, seed=7):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.choice((3, 10, 60)))) + (" common" if i % 3 else " common common")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def rows(df):
    return {(r["qid"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect()}


@pytest.mark.parametrize("block", [impact.BLOCK, 50])
def test_same_rows_with_fewer_postings(spark, block):
    docs = corpus(spark)
    freqs, lengths = lexical.frequencies(docs).cache(), lexical.lengths(docs).cache()
    asked = [(0, "w250 w3 common"), (1, "common"), (2, "w1 w2 w5 w120 w120"), (3, "w9 nowhere"), (4, "nowhere"), (5, "w299 w0 w1 w2 common common")]
    queries = spark.createDataFrame([(q, t) for q, terms in asked for t in terms.split()], "qid bigint, term string")
    index = impact.impacts(freqs, lengths, block).cache()
    heads = impact.heads(index).cache()
    found = impact.search(queries, index, heads, lexical.corpus_stats(lengths), 10)
    assert rows(found.best) == rows(lexical.top_k(lexical.bm25(queries, freqs, lengths), 10))
    work = {r["qid"]: r for r in found.work.collect()}
    assert 4 not in work and all(r["taken"] <= r["postings"] for r in work.values())
    for q in (0, 5):  # the frequent terms can't lift a row that lacks the rare one
        assert work[q]["taken"] < 0.5 * work[q]["postings"] and work[q]["scored"] < 0.5 * work[q]["candidates"] + 100
    # A query of one term reads its best band only.
    assert work[1]["taken"] < work[1]["postings"]
    if block == 50:  # no block of a frequent term grows with it
        assert heads.agg(F.max("n")).first()[0] <= 100
        assert heads.where("term = 'common'").count() > impact.BANDS


def test_few_rows_ties_and_nothing(spark):
    docs = spark.createDataFrame([(3, "red wine"), (1, "red wine"), (2, "red"), (4, None), (5, "")], "doc_id bigint, text string")
    freqs, lengths = lexical.frequencies(docs), lexical.lengths(docs)
    index = impact.impacts(freqs, lengths)
    queries = spark.createDataFrame([(0, "red"), (0, "wine")], "qid bigint, term string")
    for k in (1, 2, 10):
        found = impact.search(queries, index, impact.heads(index), lexical.corpus_stats(lengths), k).best
        assert rows(found) == rows(lexical.top_k(lexical.bm25(queries, freqs, lengths), k))
    none = impact.search(queries.where("false"), index, impact.heads(index), lexical.corpus_stats(lengths), 5)
    assert none.best.isEmpty() and none.work.isEmpty()
    bare = impact.impacts(freqs.where("false"), lengths.where("false"))
    assert impact.search(queries, bare, impact.heads(bare), lexical.corpus_stats(lengths.where("false")), 5).best.isEmpty()


@pytest.mark.parametrize("most", [1 << 16, 2])
def test_rows_that_share_an_id_or_have_none(spark, most, monkeypatch):
    """A term's weight counts an id once, as in the SQL, and one without an id; before, each of its rows counted."""
    monkeypatch.setattr(lexical, "MOST", most)
    monkeypatch.setattr(impact, "ROWS", 3)  # several shards
    draw = random.Random(5)
    rows_ = [(i, " ".join(draw.choices(["red", "wine", "glass", "of", "the"], k=draw.choice((0, 2, 9))))) for i in range(40)]
    rows_ += [(5, "red wine of the table"), (5, "red"), (5, None), (7, ""), (None, "red red wine"), (None, "the")]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string").repartition(3)
    freqs, lengths = lexical.frequencies(docs), lexical.lengths(docs)
    queries = spark.createDataFrame([(0, "red"), (0, "wine"), (0, "wine"), (1, "of"), (1, "the"), (2, "nowhere")], "qid int, term string")
    wanted = lexical.bm25(queries, freqs, lengths).where("id IS NOT NULL")
    for index in (impact.impacts_of_counted(lexical.counted(docs), 4), impact.impacts(freqs, lengths, 4)):
        assert index.where("term IS NOT NULL").agg(F.sum("n")).first()[0] == freqs.count()
        for k in (3, 1000):
            found = impact.search(queries, index, impact.heads(index), lexical.corpus_stats(lengths), k)
            assert rows(found.best) == rows(lexical.top_k(wanted, k))


def test_blocks_are_dealt_once(spark):
    """Before, each step wrote a table and joined it with the postings: nine tables a search, and a row for each query and posting dealt."""
    docs, written = corpus(spark, 500), []
    index = impact.impacts_of_counted(lexical.counted(docs)).cache()
    queries = spark.createDataFrame([(q, t) for q in range(20) for t in ("w1", "w9", "common")], "qid bigint, term string")
    impact.search(queries, index, impact.heads(index), lexical.corpus_stats(lexical.lengths(docs)), 3, keep=lambda df, name: written.append(df) or df)
    assert len(written) == 1
    plan = written[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
