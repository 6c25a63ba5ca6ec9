import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from hayrick.llm import common, language_model, parcels


def words(text):
    return [*(text or "").encode().lower().split(), b"\0end"]


def test_word_hashes_follow_the_token_rule(texts):
    import pyarrow as pa

    rows = [t or "" for _, t in texts] + ["a\x0bB\x0cc\rd\x85e f", "É é", "x" * 100]
    seen = {}
    for a, b, data, offsets in common.text_slices(pa.array(rows), 1000):
        hashes, at = common.hash_words(data, offsets)
        for k in range(b - a):
            expected = rows[a + k].encode().lower().split()
            assert at[k + 1] - at[k] == len(expected)
            for w, h in zip(expected, hashes[at[k] : at[k + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_scores_against_brute_force(docs, texts, empty):
    found = language_model.score_texts(docs, block_bytes=20_000, bucket_bytes=10_000).toPandas()
    rest = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else -1
    train = [(i, words(t)) for i, t in texts if rest(i) != 2]
    counts = Counter(w for _, ws in train for w in ws)
    pairs = Counter((a, b) for _, ws in train for a, b in zip([b"\0start", *ws], ws))
    n, v = sum(counts.values()), len(counts)
    counts_of_context = counts | Counter({b"\0start": len(train)})
    # the learned weights by running the model's own last step on brute-force estimates
    deleted = [ws for i, ws in train if rest(i) == 3]
    less_words = counts - Counter(w for ws in deleted for w in ws)
    less_pairs = pairs - Counter((a, b) for ws in deleted for a, b in zip([b"\0start", *ws], ws))
    n_less = sum(less_words.values())
    less_context = less_words | Counter({b"\0start": less_words[b"\0end"]})
    rows = []
    for ws in deleted:
        for a, b in zip([b"\0start", *ws], ws):
            c = less_context[a]
            two, one = (less_pairs[a, b] / c if c else 0.0), less_words[b] / n_less
            rows.append((int(language_model.context_bucket(np.array([c]))[0]), int(language_model.level(np.array([two]))[0]), int(language_model.level(np.array([one]))[0]), 1.0, math.log(max(two, 1e-300)), math.log(max(one, 1e-300))))
    gathered = pd.DataFrame(rows, columns=["bucket", "two", "one", "tokens", "log_two", "log_one"]).groupby(["bucket", "two", "one"], as_index=False).sum()
    weights = language_model.mixture_weights(gathered, 1 / (v + 1))

    def score(ws):
        total = 0.0
        for a, b in zip([b"\0start", *ws], ws):
            c = counts_of_context[a]
            w = weights[int(language_model.context_bucket(np.array([c]))[0])]
            total += math.log10(w[0] * (pairs[a, b] / c if c else 0) + w[1] * counts[b] / n + w[2] / (v + 1))
        return total

    assert len(found) == len(texts)
    by_id = {}
    for r in found.itertuples():
        by_id.setdefault(None if pd.isna(r.doc_id) else int(r.doc_id), []).append(r)
    for i, t in texts:
        ws, r = words(t), by_id[i][0]
        assert r.held_out == (rest(i) == 2) and r.n_tokens == len(ws) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, score(ws), rel_tol=1e-6)
    assert language_model.score_texts(empty).collect() == []


def test_packed_keys_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert np.array_equal(parcels.unpack_keys(parcels.pack_keys(keys)), keys)
    for top in (1, 300, 1 << 20, 1 << 40):
        counts = np.array([1, top])
        assert np.array_equal(parcels.unpack_counts(parcels.pack_counts(counts)), counts)


def test_held_out_texts_are_likelier_than_by_the_base(docs):
    found = language_model.score_texts(docs).toPandas()
    held = found[found["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_weights_by_expectation_maximisation_token_by_token():
    """The binned EM against one over single tokens in plain Python, and against changed weights."""
    rng = np.random.default_rng(11)
    tokens = []
    for _ in range(3000):
        b = int(rng.integers(0, 5))
        two = float(rng.choice([0.0, *rng.uniform(0.01, 1, 3)])) if b else 0.0
        tokens.append((b, two, float(rng.choice([0.0, *rng.uniform(1e-4, 0.1, 5)]))))
    uniform = 1 / 5000
    rows = [(b, int(language_model.level(np.array([t]))[0]), int(language_model.level(np.array([o]))[0]), 1.0, math.log(max(t, 1e-300)), math.log(max(o, 1e-300))) for b, t, o in tokens]
    gathered = pd.DataFrame(rows, columns=["bucket", "two", "one", "tokens", "log_two", "log_one"]).groupby(["bucket", "two", "one"], as_index=False).sum()
    weights = language_model.mixture_weights(gathered, uniform)

    def likelihood(some, w):
        return sum(math.log(w[0] * t + w[1] * o + w[2] * uniform) for _, t, o in some)

    for b in range(5):
        some = [x for x in tokens if x[0] == b]
        w = [1 / 3] * 3 if b else [0.0, 0.5, 0.5]
        for _ in range(60):
            shares = [1.0 if x else 0.0 for x in w]
            for _, t, o in some:
                parts = [w[0] * t, w[1] * o, w[2] * uniform]
                shares = [s + p / sum(parts) for s, p in zip(shares, parts)]
            w = [s / sum(shares) for s in shares]
        assert np.allclose(w, weights[b], atol=0.02)
        best = likelihood(some, weights[b])
        for _ in range(5):
            other = np.clip(weights[b] + 0.15 * rng.normal(size=3), 1e-3, None) * (weights[b] > 0)
            assert likelihood(some, other / other.sum()) < best + 1
    assert np.allclose(weights[:5].sum(1), 1) and weights[0, 0] == 0
