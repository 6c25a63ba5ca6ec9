"""Helpers that the operators of this folder share: storage, folds and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch between Spark and Python, unless the session sets another number: rows hold whole texts.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a single machine runs all of Spark and none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hayrick-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def short_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    short_batches(spark)
    path = f"{shared_dir(spark)}/hayrick/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unlike(taken: list[str], *names: str) -> list[str]:
    """The names, carried on until none is among those taken, whatever their case."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as fold -1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus, F.lit(-1))


def whole_text(column: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text: one number each, whatever the input."""
    row = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("size")).first()
    return int(row["rows"]), int(row["size"] or 0)


# ---------------------------------------------------------------- words as 64-bit hashes

_rng = np.random.Generator(np.random.PCG64(20240607))
MIX = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the lowest k bytes
LONG = 64  # spans of more bytes are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """One 64-bit hash a seed of each span of bytes.

    Spans are read eight bytes at a time, each step mixed before the next is added, so that
    no arrangement of repeats cancels out as it can in a polynomial. Long spans go through
    xxh3. Two given spans share a hash with a chance of about 2**-64, and both of two with
    2**-128.
    """
    sizes = (ends - begins).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = [mix(sizes.astype(np.uint64) * MIX[14] + MIX[seed]) for seed in seeds]
    some, at, left = None, begins, np.minimum(sizes, LONG)
    while True:
        going = left > 0
        if not going.all():
            chosen = np.flatnonzero(going)
            some, at, left = chosen if some is None else some[chosen], at[chosen], left[chosen]
        if not len(at):
            break
        word = eight[at] & _KEEP[np.minimum(left, 8)]
        for h, seed in zip(out, seeds, strict=True):
            if some is None:
                h[:] = mix((h ^ word) * MIX[seed + 1])
            else:
                h[some] = mix((h[some] ^ word) * MIX[seed + 1])
        at, left = at + 8, left - 8
    for k in np.flatnonzero(sizes > LONG).tolist():
        digest = xxhash.xxh3_128_intdigest(data[begins[k] : ends[k]])
        for h, seed, half in zip(out, seeds, (digest & 0xFFFFFFFFFFFFFFFF, digest >> 64), strict=False):
            h[k] = mix(np.array([half], np.uint64) + MIX[seed])[0]
    return out


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 texts with A-Z lower-cased.

    data: the bytes of all texts; offsets: where each begins, and the end. Returns the
    hashes and for each text where its words begin among them (one more at the end).
    """
    offsets = offsets.astype(np.int64)
    data, offsets = _LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return hash_spans(data, starts, ends)[0], np.searchsorted(starts, offsets).astype(np.int64)


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column without nulls, cut at about `most` bytes between texts."""
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_string())
        if not len(chunk):
            continue
        buffers = chunk.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield base + at, base + end, data, offsets[at : end + 1]
            at = end
        base += len(chunk)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of `width` words; a shorter text is one shingle, one without words has none."""
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * MIX[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * MIX[: b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(short + MIX[14:15] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
