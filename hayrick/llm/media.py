"""Media columns: audio stored without loss and described by fixed-shape tensors.

The payload (bytes) becomes a WAV file of unsigned 8-bit mono samples in a binary column,
written to the shared folder. Reading it back, each recording is resampled by a polyphase
low-pass filter, cut into overlapped Hann frames, and turned into log-mel energies. Blocks
of `frames` frames make one fixed-shape Arrow tensor [frames, mels] each (the last one is
padded with the floor), stored with its time span as an Arrow stream in a binary column;
tensors() gives it back. Loud segments come from the frame energies by hysteresis: a
segment opens above the upper threshold and closes below the lower one.

Every recording is computed on its own, so equal payloads have equal values.

Defined cases: null and empty texts are 64 zero bytes; very long texts are one recording
of their length; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common

RATE, UP, DOWN, FRAME, HOP, MELS, FRAMES = 16000, 1, 2, 256, 128, 16, 32
HEADER = 44
FLOOR = 1e-6


def wav(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def wav_samples(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples; the chunks are walked, so other writers' files are read too."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono samples are read")
        elif name == b"data":
            return rate, np.frombuffer(data, np.uint8, size, at + 8)
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc for resampling by up / down."""
    widest = max(up, down)
    t = np.arange(-half * widest, half * widest + 1)
    h = np.sinc(t / widest) / widest * np.hanning(len(t) + 2)[1:-1]
    return h * (up / h.sum())


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase: of the upsampled signal only the samples that stay are computed, each from one phase of the filter."""
    h = low_pass(up, down)
    centre = len(h) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n)
    pad = len(h) // up + 2
    padded = np.concatenate([np.zeros(pad), x, np.zeros(pad)])
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        t = first * down + centre
        phase, base = t % up, t // up
        count = len(range(first, n, up))
        part = np.zeros(count)
        for k, tap in enumerate(h[phase::up]):
            begin = pad + base - k
            lo = max(0, -(-(0 - begin) // down))
            hi = min(count, max(lo, (len(padded) - 1 - begin) // down + 1))
            part[lo:hi] += tap * padded[begin + lo * down : begin + (hi - 1) * down + 1 : down] if hi > lo else 0
        out[first::up] = part
    return out


def mel_filters(rate: float, frame: int, mels: int) -> np.ndarray:
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_FILTERS = mel_filters(RATE * UP / DOWN, FRAME, MELS)
_WINDOW = np.hanning(FRAME + 1)[:-1]


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames x mels log energies, and each frame's log energy; a last frame is filled up with zeros."""
    count = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (count - 1) * HOP + FRAME - len(x)))])
    mel, energy = np.empty((count, MELS), np.float32), np.empty(count)
    for at in range(0, count, 4096):  # so that a long recording needs little memory
        end = min(count, at + 4096)
        frames = np.lib.stride_tricks.sliding_window_view(x[at * HOP : (end - 1) * HOP + FRAME], FRAME)[::HOP]
        energy[at:end] = np.log10((frames * frames).mean(1) + FLOOR)
        spectrum = np.fft.rfft(frames * _WINDOW, axis=1)
        mel[at:end] = np.log10((spectrum.real**2 + spectrum.imag**2) @ _FILTERS / FRAME + FLOOR)
    return mel, energy


def segments(energy: np.ndarray, gap: float = 0.35) -> list[tuple[int, int]]:
    """Runs of frames opened at `gap` below the peak's distance to the median and closed at twice that."""
    top, middle = float(energy.max()), float(np.median(energy))
    high, low = top - gap * (top - middle), top - min(1.0, 2 * gap) * (top - middle)
    if top <= np.log10(FLOOR) + 1e-9:
        return []
    state = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    change = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True)]


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
_TENSOR_SCHEMA = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mel", _TENSOR)])
_FRAME_MS = HOP * 1000 * DOWN / (RATE * UP)


def tensor_stream(mel: np.ndarray) -> bytes:
    blocks = -(-len(mel) // FRAMES)
    padded = np.full((blocks * FRAMES, MELS), np.log10(FLOOR), np.float32)
    padded[: len(mel)] = mel
    storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.reshape(-1)), FRAMES * MELS)
    starts = np.arange(blocks) * FRAMES
    ends = np.minimum(starts + FRAMES, len(mel))
    span = [pa.array((x * _FRAME_MS).astype(np.int64)) for x in (starts, ends)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TENSOR_SCHEMA) as out:
        out.write_batch(pa.RecordBatch.from_arrays([*span, pa.ExtensionArray.from_storage(_TENSOR, storage)], schema=_TENSOR_SCHEMA))
    return sink.getvalue().to_pybytes()


def tensors(data: bytes) -> pa.Table:
    """start_ms, end_ms and mel (a fixed-shape tensor column) of one recording."""
    return pa.ipc.open_stream(data).read_all()


def payload(column: Column) -> Column:
    """UTF-8 bytes filled up with bytes 0 to a positive multiple of 64."""
    raw = column.cast("binary")
    size = F.greatest(F.ceil(F.octet_length(raw) / 64) * 64, F.lit(64)).cast("int")
    return F.rpad(raw, size, F.lit(b"\x00"))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            data = batch.column(2)[row].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([wav(data)], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (WAV), written to the shared folder and read back."""
    text = common.whole_text()
    rows = docs.select(F.col("doc_id").cast("bigint"), F.octet_length(text).cast("bigint").alias("n_bytes"), payload(text).alias("payload"))
    return common.materialize(rows.mapInArrow(_store, "doc_id bigint, n_bytes bigint, media binary"), "media")


FEATURES = "doc_id bigint, n_bytes bigint, media binary, samples binary, n_frames bigint, spans array<struct<start_ms:bigint,end_ms:bigint>>, tensors binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])), pa.binary()]
    names = ["doc_id", "n_bytes", "media", "samples", "n_frames", "spans", "tensors"]
    for batch in batches:
        rows, size = [], 0
        for row in range(len(batch)):
            data = batch.column(2)[row].as_buffer().to_pybytes()
            _, samples = wav_samples(data)
            mel, energy = log_mel(resample((samples.astype(np.float64) - 128) / 128, UP, DOWN))
            spans = [{"start_ms": int(a * _FRAME_MS), "end_ms": int(b * _FRAME_MS)} for a, b in segments(energy)]
            rows.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), data, samples.tobytes(), len(mel), spans, tensor_stream(mel)))
            size += len(data)
            if size > 4 << 20 or row == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0


def audio_features(media: DataFrame) -> DataFrame:
    return media.mapInArrow(_describe, FEATURES)


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(store_media(common.table(spark, sf_dir, "documents")))
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start_ms"].cast("string"), s["end_ms"].cast("string"))))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames").cast("string"), F.sha2("tensors", 256), spans).alias("feature"),
        "n_frames",
        F.size("spans").cast("bigint").alias("n_segments"),
    )
