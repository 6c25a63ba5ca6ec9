"""Token ids in files of directly addressable codes.

Each id is cut into chunks of `bits` bits, lowest first. Level 0 holds the first chunk
of every id, level 1 the second chunk of those ids that have one, and so on. A bitmap
beside each level says which of its ids go on, and a rank directory counts the ones
before every 512 bits. Id i is found by reading its chunk, and while its bit is set,
going to place rank(i) of the next level: one chunk and one count a level, no decoding
of a block around it.

A file is a Parquet row group of segments: `part` and `segment` (their order), `before`
(ids of the same part before it), `doc_ids` and `lengths` of its documents, `codes` (the
bytes that `DirectCodes.to_bytes` makes). Parquet, so that any file system Spark writes
to will do; every segment holds about `segment_ids` ids and whole documents.

Defined cases: null text is the empty text (one id, the end); null doc_id sorts first;
repeated rows are kept, each with its own start, ordered by text; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common
from hayrick.llm.tokens import Encoder, tokenizer_path

END_ID = 2
_BLOCK = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class DirectCodes:
    """An immutable sequence of unsigned 32-bit ids with random access."""

    def __init__(self, bits: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.bits, self.levels = bits, levels

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 8) -> "DirectCodes":
        if bits not in (8, 16):
            raise ValueError("chunks are of 8 or 16 bits")
        rest, levels = np.asarray(ids, np.uint32), []
        while True:
            chunks = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8 if bits == 8 else np.uint16)
            rest = rest >> np.uint32(bits) if bits < 32 else rest * 0
            more = rest > 0
            bitmap = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(_ones(bitmap), np.arange(0, len(bitmap), _BLOCK // 8)) if len(bitmap) else np.zeros(0, np.int64)
            levels.append((chunks, bitmap, np.concatenate([[0], np.cumsum(ones)])[: max(len(ones), 1)].astype(np.uint32)))
            if not more.any():
                return cls(bits, levels)
            rest = rest[more]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, each found on its own."""
        at = np.asarray(places, np.int64)
        out, todo = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bitmap, directory) in enumerate(self.levels):
            out[todo] |= chunks[at].astype(np.uint32) << np.uint32(level * self.bits)
            on = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            todo, at = todo[on], at[on]
            if not len(todo):
                break
            # rank: ones before the block, in the block's whole bytes, and in the last byte
            byte, block = at >> 3, at // _BLOCK
            inside = np.zeros(len(at), np.int64)
            for k in range(_BLOCK // 8):
                here = block * (_BLOCK // 8) + k
                part = here < byte
                if not part.any():
                    break
                inside[part] += _ONES[bitmap[here[part]]]
            last = _ONES[bitmap[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
            at = directory[block].astype(np.int64) + inside + last
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, at = np.zeros(len(self), np.uint32), np.arange(len(self))
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(level * self.bits)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out

    def to_bytes(self) -> bytes:
        parts = [b"DAC1", struct.pack("<BB", self.bits, len(self.levels))]
        for chunks, bitmap, directory in self.levels:
            parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), directory.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> "DirectCodes":
        if data[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        (bits, count), at, levels = struct.unpack_from("<BB", data, 4), 6, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            level = []
            for kind, size in ((np.dtype(f"<u{bits // 8}"), n), (np.dtype("u1"), -(-n // 8)), (np.dtype("<u4"), max(-(-n // _BLOCK), 1))):
                level.append(np.frombuffer(data, kind, size, at))
                at += size * kind.itemsize
            levels.append(tuple(level))
        return cls(bits, levels)


def _ones(bitmap: np.ndarray) -> np.ndarray:
    return _ONES[bitmap].astype(np.int64)


#: Partitions written at most: beyond, they grow in length, and are still written segment by segment.
MOST_PARTS = 20_000
SEGMENTS = "part int, segment int, before bigint, doc_ids array<bigint>, lengths array<int>, codes binary"


def _segments(path: str, end: int, bits: int, segment_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        ids, doc_ids, lengths = [], [], []
        state = {"segment": 0, "before": 0, "size": 0}

        def flush() -> pa.RecordBatch:
            row = {"part": [part], "segment": [state["segment"]], "before": [state["before"]], "doc_ids": [list(doc_ids)], "lengths": [list(lengths)], "codes": [DirectCodes.build(np.concatenate(ids), bits).to_bytes()]}
            state.update(segment=state["segment"] + 1, before=state["before"] + state["size"], size=0)
            for x in (ids, doc_ids, lengths):
                x.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary())]))

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b, _, _ in common.text_slices(texts, 4 << 20):
                got, at = encoder.encode(texts.slice(a, b - a), end)
                sizes = np.diff(at)
                first = 0
                while first < b - a:
                    room = segment_ids - state["size"]
                    last = max(first + 1, int(np.searchsorted(at, at[first] + room, "right")) - 1)
                    ids.append(got[at[first] : at[last]])
                    doc_ids.extend(names[a + first : a + last])
                    lengths.extend(sizes[first:last].tolist())
                    state["size"] += int(at[last] - at[first])
                    first = last
                    if state["size"] >= segment_ids or first < b - a:
                        yield flush()
        if doc_ids:
            yield flush()

    return write


def write_codes(docs: DataFrame, path: str, *, end: int = END_ID, bits: int = 8, segment_ids: int = 1 << 18, part_bytes: int = 16 << 20) -> DataFrame:
    """Encode doc_id and text into segments in ascending doc_id order, written to the shared folder; returns them as read back."""
    _, size = common.text_size(docs)
    parts = max(1, min(MOST_PARTS, math.ceil(size / part_bytes)))
    rows = docs.select(F.col("doc_id").cast("bigint"), common.whole_text().alias("text"))
    # Texts with one id, or none, are dealt out too.
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return common.materialize(ordered.mapInArrow(_segments(path, end, bits, segment_ids), SEGMENTS), "token-codes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "last_id"]
    for batch in batches:
        for base, before, doc_ids, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("base", "before", "doc_ids", "lengths")), batch.column("codes"), strict=True):
            codes = DirectCodes.from_bytes(data.as_buffer())
            at = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
            ids = codes.all().astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + base + before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array(codes.get(at[1:] - 1).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_codes(segments: DataFrame) -> DataFrame:
    """Per document: its place among all ids, its length, the crc32 of its ids and its last id (by random access)."""
    ends = segments.groupBy("part").agg(F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("ids"))
    base, bases = 0, []
    for row in sorted(ends.collect()):  # one row for each written partition, at most MOST_PARTS
        bases.append((row["part"], base))
        base += row["ids"]
    offsets = segments.sparkSession.createDataFrame(bases, "part int, base bigint")
    return segments.join(F.broadcast(offsets), "part").mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, last_id bigint")


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_codes(write_codes(common.table(spark, sf_dir, "documents"), tokenizer_path()))
