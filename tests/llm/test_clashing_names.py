"""Tables whose extra columns have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hayrick.llm import common, decontamination, licenses, packing, secrets, toxicity
from hayrick.llm.tokens import tokenizer_path
from tests.llm.conftest import prose

NAMES = ("hit_items", "hit_overlap", "hit_doc", "hit_mark", "row_key", "Row_Key_", "spare__doc_id", "spare__mark", "spare__times", "toxicity__score", "decontamination__items", "decontamination__overlap", "block", "words", "d", "m", "mark", "times", "bucket", "rank", "known")


@pytest.fixture(scope="module")
def wide(spark):
    item = prose(1, 30)
    texts = [prose(10 + i, 60) for i in range(12)] + [f"{prose(40, 20)} {item} {prose(41, 20)}", prose(10, 60), None, "", "password = hunter22secret"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.select("*", *(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in NAMES))
    return docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")


def kept(found):
    return all(r[name] == f"{name}{r['doc_id']}" for r in found for name in NAMES)


def test_names_unlike_those_taken():
    assert common.unlike(["A", "a_"], "a", "b", "b") == ["a__", "b", "b_"]


def test_decontamination_keeps_them(wide):
    docs, items = wide
    found = decontamination.contaminated(docs, items).collect()
    assert kept(found) and {r["doc_id"]: r["items"] for r in found if r["items"]} == {12: [1]}
    assert len(found) == docs.count()


def test_licences_keep_them(wide):
    docs, _ = wide
    notice = licenses.NOTICES["MIT"][0]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit(notice)).otherwise(F.col("text")))
    found = licenses.scan(docs, licenses.train(docs.select("doc_id", "text"))).collect()
    assert kept(found) and len(found) == docs.count()
    assert {r["doc_id"] for r in found if r["licences"]} == {3}


def test_toxicity_and_secrets_keep_them(spark, wide):
    docs, _ = wide
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert kept(toxicity.score(docs, model).collect())
    clean = {r["doc_id"]: r for r in secrets.redact(docs, secrets.train(docs)).collect()}
    assert kept(clean.values()) and "hunter22secret" not in clean[16]["text"]


def test_stages_keep_them(spark, wide, tmp_path):
    docs, items = wide
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = common.materialize(stage(spark, left, str(tmp_path)), f"clash-{name.replace(' ', '-')}")
        assert left.columns == docs.columns and kept(left.collect())
    assert sorted(r["doc_id"] for r in left.collect()) == [0, *range(1, 12), 14, 15, 16]


def test_short_documents_fill_sequences(spark):
    """8,192 documents of one word are packed by their tokens; no number of documents stops a sequence."""
    docs = spark.range(8192).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    found = packing.pack(docs, tokenizer_path()).agg(F.sum("length"), F.countDistinct("sequence_id"), F.count(F.lit(1))).first()
    assert found[2] == 8192 and found[1] <= -(-found[0] // 2048) + 1
