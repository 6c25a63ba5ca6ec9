"""Exchanges in one and in two steps, and their size against the text's."""

import numpy as np
from pyspark.sql import functions as F

from hayrick.llm import jaccard_join, language_model, parcels
from tests.llm.conftest import prose


def test_cut_and_opened_round_trip():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    values = rng.integers(0, 70_000, len(keys))
    who = rng.integers(0, 4, len(keys))
    rows = list(parcels.cut((keys >> np.uint64(37)).astype(np.int64), 9, keys, [values], who))
    assert [r[0] for r in rows] == sorted(set((keys >> np.uint64(37)).tolist()))
    found, senders, (counts,) = parcels.opened(parcels.table(rows), 2)
    assert np.array_equal(found, keys) and np.array_equal(senders, 9 * 4 + who) and np.array_equal(counts, values)
    assert parcels.address_bits(5, 13) == (5, 0) and parcels.address_bits(15, 13) == (15, 2) and parcels.address_bits(40, 13) == (26, 13)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_two_steps_give_what_one_gives(docs):
    one, two = (jaccard_join.shingle_sets(docs, block_bytes=8_000, bucket_bytes=8_000, fan=fan).drop("shingles") for fan in (13, 3))
    assert rows_of(one) == rows_of(two)
    one, two = (language_model.score_texts(docs, block_bytes=20_000, bucket_bytes=10_000, fan=fan).toPandas().sort_values(["doc_id", "n_tokens"]) for fan in (13, 3))
    for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens"):
        assert one[c].tolist()[:-1] == two[c].tolist()[:-1]
    assert np.allclose(one[["base_score", "score"]], two[["base_score", "score"]], rtol=1e-6)


def test_parcels_stay_in_proportion_to_the_text(spark):
    """Many times the blocks and buckets, as many bytes and rows for a byte of text."""

    def share(documents):
        docs = spark.createDataFrame([(i, prose(i, 300)) for i in range(documents)], "doc_id bigint, text string")
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        _, exchanges, _ = jaccard_join.counted(docs, block_bytes=16_000, bucket_bytes=11_000, fan=4)
        held = F.length("keys") + F.length("who") + F.aggregate("values", F.lit(0), lambda a, b: a + F.length(b)) + 32
        return sum(e.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0] for e in exchanges) / size

    few, many = share(150), share(1200)
    assert many < 1.35 * few
