"""The registered queries on the smallest tables, column by column against plain Python."""

import hashlib
import io
import re
import wave
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from hayrick.llm import media, packing, queries, secrets, token_codes
from hayrick.llm.tokens import tokenizer_path
from tests.llm.test_decontamination import brute_force as decontaminated
from tests.llm.test_media_and_secrets import slow_base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def result(spark):
    def run(name):
        found = queries.QUERIES[name](spark, SF).collect()
        by_id = {r["doc_id"]: r for r in found}
        return found, by_id

    return run


@pytest.fixture(scope="module")
def library_ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows.items()}


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_op1(rows, result):
    found, by_id = result("op1_language_model")
    assert len(found) == len(rows) == len(by_id)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), None] for i, t in rows.items()}
    counts = Counter(w for i, ws in tokens.items() if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = by_id[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, len(ws))
        assert r["score"] < 0
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op2(rows, result, library_ids):
    _, by_id = result("op2_token_codes")
    start = 0
    for i in sorted(rows):
        ids = np.array([*library_ids[i], token_codes.END_ID], "<u4")
        r = by_id[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(by_id) == len(rows)


def test_op3(rows, result):
    found, by_id = result("op3_toxicity")
    assert len(found) == len(rows) == len(by_id)
    for i in rows:
        r = by_id[i]
        assert r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op5(rows, result, library_ids):
    found, _ = result("op5_best_fit_packing")
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i in rows:
        ids, at = np.array([*library_ids[i], packing.END_ID], "<u4"), 0
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        for k, r in enumerate(mine):
            assert r["piece"] == k and r["start"] == at and 1 <= r["length"] <= 2048
            assert k == 0 or r["length"] == 2048
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(mine) == -(-len(ids) // 2048)
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(x) + 1 for x in library_ids.values())
    assert len(sequences) <= 1.02 * -(-total // 2048) + 1


def test_op8(spark, rows, result):
    _, by_id = result("op8_decontamination")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = sorted(rows.items())
    for (i, _), expected in zip(texts, decontaminated(texts, items), strict=True):
        assert by_id[i]["items"] == expected and by_id[i]["contaminated"] == bool(expected) and by_id[i]["n_items"] == len(expected)


def slow_feature(data):
    """Log-mel frames and spans of 8-bit samples: the whole signal filtered, frame by frame, one threshold after the other."""
    x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    h = media.low_pass(media.UP, media.DOWN)
    full = np.zeros(len(x) * media.UP)
    full[:: media.UP] = x
    y = np.convolve(full, h)[len(h) // 2 :][: len(full)][:: media.DOWN]
    starts = [0]
    while starts[-1] + media.FRAME < len(y):
        starts.append(starts[-1] + media.HOP)
    y = np.concatenate([y, np.zeros(starts[-1] + media.FRAME - len(y))]) if starts[-1] + media.FRAME > len(y) else y
    filters = media.mel_filters(media.RATE * media.UP / media.DOWN, media.FRAME, media.MELS)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * k / media.FRAME) for k in range(media.FRAME)]
    mel = [np.log10(np.abs(np.fft.rfft(y[a : a + media.FRAME] * window)) ** 2 @ filters / media.FRAME + media.FLOOR) for a in starts]
    energy = [np.log10((y[a : a + media.FRAME] ** 2).mean() + media.FLOOR) for a in starts]
    top, middle = max(energy), float(np.median(energy))
    spans, on = [], None
    for k, e in enumerate(energy):
        if on is None and e >= top - 0.35 * (top - middle):
            on = k
        elif on is not None and e < top - 0.7 * (top - middle):
            spans.append((on, k))
            on = None
    if on is not None:
        spans.append((on, len(energy)))
    return np.array(mel), [] if top <= np.log10(media.FLOOR) + 1e-9 else spans


def test_op9(rows, result):
    _, by_id = result("op9_audio_features")
    seen = {}
    for i, t in rows.items():
        r, raw = by_id[i], t.encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        stored = media.wav(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(t, r["feature"]) == r["feature"]
    ms = media.HOP * 1000 * media.DOWN / (media.RATE * media.UP)
    for i in sorted(rows)[:12]:
        data = rows[i].encode()
        data += bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        with wave.open(io.BytesIO(media.wav(data))) as w:  # the standard library reads the file too
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())) == (1, 1, media.RATE, data)
        mel, spans = slow_feature(data)
        frames, digest, listed = by_id[i]["feature"].split(":")
        assert int(frames) == len(mel) == by_id[i]["n_frames"] and by_id[i]["n_segments"] == len(spans)
        assert listed == ",".join(f"{int(a * ms)}-{int(b * ms)}" for a, b in spans)
        own, _ = media.log_mel(media.resample((np.frombuffer(data, np.uint8).astype(float) - 128) / 128, media.UP, media.DOWN))
        assert np.allclose(own, mel, atol=1e-4) and hashlib.sha256(media.tensor_stream(own)).hexdigest() == digest


def test_op10(rows, result):
    _, by_id = result("op10_secrets")
    for i, t in rows.items():
        r, base = by_id[i], slow_base(t)
        for k, name in enumerate(secrets.KINDS[:3]):
            assert r[f"n_{name}"] == sum(kind == k for _, kind, _ in base)
        listed = ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("crf")] == [s for s in listed.split(",") if s]


@pytest.mark.parametrize("name", ["op4_licenses", "op6_jaccard_join", "op7_cotraining"])
def test_one_row_a_document(rows, result, name):
    found, by_id = result(name)
    assert len(found) == len(rows) == len(by_id)
    if name == "op7_cotraining":
        assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.5) for r in found)
