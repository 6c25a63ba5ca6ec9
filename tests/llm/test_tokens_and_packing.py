import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hayrick.llm import common, packing, token_codes
from hayrick.llm.tokens import Encoder, tokenizer_path

PATH = tokenizer_path()


def ids_of(text, end):
    return [*Encoder.of(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_the_library():
    rnd, alphabet = random.Random(1), " \n\tab'é1! 　\x85\x1c日"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    texts += ["", " ", "  a", "tail ", "x <|endoftext|> y", "don't stop 123", "a\x00 b"]
    ids, at = Encoder.of(PATH).encode(pa.array(texts), 2)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(t, 2), t


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip_and_random_access(bits, n):
    rnd = np.random.default_rng(n)
    ids = np.where(rnd.random(n) < 0.5, rnd.integers(0, 256, n), rnd.integers(0, 1 << 32, n)).astype(np.uint32)
    codes = token_codes.DirectCodes.from_bytes(token_codes.DirectCodes.build(ids, bits).to_bytes())
    assert np.array_equal(codes.all(), ids)
    places = rnd.permutation(n)
    assert np.array_equal(codes.get(places), ids[places])


def test_token_files(docs, texts, empty):
    found = token_codes.read_codes(token_codes.write_codes(docs, PATH, segment_ids=5000, part_bytes=1 << 16)).collect()
    expected, start = [], 0
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(ids_of(t, 2), "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids), 2))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert token_codes.read_codes(token_codes.write_codes(empty, PATH)).collect() == []


def test_packing_is_a_partition_of_the_ids(docs, texts, empty):
    found = packing.pack(docs, PATH, group_rows=40).collect()
    ids = {(i, t): ids_of(t, 0) for i, t in texts}
    assert Counter(r["doc_id"] for r in found if r["piece"] == 0) == Counter(i for i, _ in texts)
    for (i, _), all_ids in ids.items():
        mine = [r for r in found if r["doc_id"] == i]
        if len({t for j, t in texts if j == i}) > 1:
            continue
        for r in mine:
            part = np.array(all_ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part) == r["ids_crc32"]
            assert r["length"] == 2048 or r["piece"] == 0
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(empty, PATH).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 60, 800)
    bins, offsets = packing.vector_best_fit(lengths, 100, 5, 4000, rule=rule)
    for b in set(bins):
        some = lengths[bins == b]
        assert some.sum() <= 100 and len(some) <= 5 and (some**2).sum() <= 4000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum([0, *some[np.argsort(offsets[bins == b])][:-1]]))


def test_best_fit_is_close_to_the_bound():
    lengths = np.random.default_rng(4).integers(1, 2048, 5000)
    bins, _ = packing.vector_best_fit(lengths, 2048, 2048, 2048 * 2048)
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 2048)
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([90]), 100, 5, 4000)


def test_document_and_attention_capacities_bind_alone():
    """Where all lengths are equal the fewest sequences are known for each constraint."""
    slots, _ = packing.vector_best_fit(np.full(60, 2), 100, 5, 100 * 100)
    assert np.bincount(slots).tolist() == [5] * 12
    attention, _ = packing.vector_best_fit(np.full(60, 10), 100, 100, 3 * 100)
    assert np.bincount(attention).tolist() == [3] * 20


def plain_best_fit(lengths, capacity, documents, attention, rule, weights):
    """Bin by bin in plain Python: of the open bins in which a piece fits, the best by the rule's own formula."""
    bins, where = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for k, left in enumerate(bins):
            if all(n <= x for n, x in zip(need, left)):
                parts = zip(weights, need, left, (capacity, documents, attention))
                score = sum(w * ((x - n) / c) ** 2 for w, n, x, c in parts) if rule == "norm" else -sum(w * n * x / c**2 for w, n, x, c in parts)
                if best is None or score < best[0] - 1e-12:
                    best = (score, k)
        if best is None:
            bins.append([capacity, documents, attention])
            best = (0, len(bins) - 1)
        where[i] = best[1]
        bins[best[1]] = [x - n for n, x in zip(need, bins[best[1]])]
    return where, len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "attention"), [(64, 100**2), (3, 100**2), (64, 2600), (4, 3000)])
def test_vector_best_fit_against_plain_python(rule, documents, attention):
    """Capacities that bind: slots, attention cost, and both."""
    rng = np.random.default_rng(documents + attention)
    lengths = rng.integers(1, 50, 300)
    bins, offsets = packing.vector_best_fit(lengths, 100, documents, attention, rule=rule)
    _, count = plain_best_fit(lengths.tolist(), 100, documents, attention, rule, packing.WEIGHTS)
    found = int(bins.max()) + 1
    assert abs(found - count) <= 1  # equal scores may be settled otherwise
    for b in range(found):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= documents and (mine**2).sum() <= attention
        assert sorted(offsets[bins == b].tolist()) == np.concatenate([[0], np.cumsum(mine[np.argsort(offsets[bins == b])])[:-1]]).tolist()
    loose = int(packing.vector_best_fit(lengths, 100, 1000, 100**2)[0].max()) + 1
    assert found >= loose and ((documents, attention) == (64, 100**2) or found > loose)


def thue_morse(letters, size):
    out = letters[0]
    other = str.maketrans(letters, letters[::-1])
    while len(out) < size:
        out += out.translate(other)
    return out


def test_stretches_of_mirrored_repeats_are_told_apart():
    """Texts whose polynomial hashes cancel out keep their own ids, words their own hashes."""
    encoder = Encoder.of(PATH)
    for size in (32, 64, 1024, 2048):
        pair = [thue_morse("ab", size), thue_morse("ba", size)]
        ids, at = encoder.encode(pa.array(pair), 0)
        for k, t in enumerate(pair):
            assert ids[at[k] : at[k + 1]].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        data = np.frombuffer(" ".join(pair).encode(), np.uint8)
        hashes, _ = common.hash_words(data, np.array([0, len(data)]))
        assert len(set(hashes.tolist())) == 2
