"""Phrases in ranking against SQLite's full-text index with its Porter tokenizer."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from hayrick.functions import text
from hayrick.functions.porter import stem
from hayrick.operators import lexical
from hayrick.plans import search

QUERIES = ["foo_bar", "parse_config of widgets", "the_the", "a_b_c", "render page render_page", "nothing_here page", "_", "ranking", "über_größe page", "parse_config_file parse_config"]


@pytest.fixture(scope="module")
def bodies():
    rnd = random.Random(8)
    words = ["foo", "bar", "parse", "config", "file", "widget", "widgets", "the", "render", "rendering", "page", "pages", "a", "b", "c", "ranking", "ranked", "Über", "Größe"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    return [*out, "foo bar foo bar foo", "foo_bar fooBar foo.bar", "bar foo", "the the the the", "a b c a b", "", "parsed configs of a file"]


def by_sqlite(bodies, query):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this SQLite")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(bodies))
    terms = re.findall(r"\w{2,}", query)
    match = " OR ".join(f'"{t}"' for t in terms)
    return {i: -score for i, score in db.execute("select rowid, bm25(t) from t where t match ?", (match,))} if terms else {}


def test_scores_are_those_of_sqlite(spark, bodies):
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string")
    tokens = stem(text.index_tokens(F.col("text")))
    index, lengths = lexical.postings(docs, tokens=tokens), lexical.lengths(docs, tokens=tokens)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")
    terms = queries.select("qid", F.explode(search.phrases_of(F.col("query"))).alias("words")).select("qid", stem(F.col("words")).alias("words")).withColumn("term", F.array_join("words", " "))
    found = {}
    for r in lexical.bm25(terms.select("qid", "term"), lexical.asked_frequencies(index, terms.select("term", "words").distinct()), lengths).collect():
        found.setdefault(r["qid"], {})[r["id"]] = r["score"]
    for k, query in enumerate(QUERIES):
        wanted = by_sqlite(bodies, query)
        assert found.get(k, {}).keys() == wanted.keys(), query
        assert all(abs(found[k][i] - s) < 1e-9 for i, s in wanted.items()), query


def test_rankings_of_a_call(spark, bodies):
    """The call's own path: words and phrases in one ranking, from stored postings."""
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string")
    tokens = stem(text.index_tokens(F.col("text")))
    queries = spark.createDataFrame([(k, 0, q) for k, q in enumerate(QUERIES)], "qid int, list_no int, query string")
    found = {}
    for r in search.lexical_lists(lexical.postings(docs, tokens=tokens), lexical.lengths(docs, tokens=tokens), queries, 500).collect():
        found.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for k, query in enumerate(QUERIES):
        wanted = sorted((-round(s, 9), i) for i, s in by_sqlite(bodies, query).items())
        assert [i for _, i in sorted(found.get(k, []))] == [i for _, i in wanted], query


def test_beginnings_of_phrases(spark):
    docs = spark.createDataFrame([(1, "a a a b a a"), (2, "a b"), (3, "b a"), (4, None)], "doc_id bigint, text string")
    phrases = spark.createDataFrame([("a a", ["a", "a"]), ("a b", ["a", "b"]), ("b a a", ["b", "a", "a"])], "term string, words array<string>")
    found = {(r["term"], r["id"]): r["tf"] for r in lexical.phrase_frequencies(lexical.postings(docs), phrases).collect()}
    assert found == {("a a", 1): 3, ("a b", 1): 1, ("a b", 2): 1, ("b a a", 1): 1}
