"""Packed exchanges of counts between blocks of documents and buckets of a key space.

A parcel is a row with many keys: sorted 64-bit keys and columns of small integers,
packed, from one sender to one address. Blocks send parcels to buckets, buckets send
parcels back. Both grow in number with the input, so a parcel for each pair of them would
shrink to nothing and the rows would grow with the square of the input. Therefore no task
cuts what it has into more than 2**`fan` parcels: an address of more bits is reached in two
steps. The first goes to the address's highest `fan` bits; there the parcels of 2**extra
neighbouring senders are put together and cut by the address's other `extra` bits. Who sent
a key is then a column of the parcel, `who`: the sender's lowest bits. Parcels keep the same
size that way, whatever the input: about the keys of a block divided by 2**`fan`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 13
PARCELS = "to bigint, sender bigint, keys binary, who binary, values array<binary>"
_NAMES = ["to", "sender", "keys", "who", "values"]
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, byte planes, compressed."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts with as many bytes as the largest needs."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or int(counts.max()) <= np.iinfo(k).max)
    return kind[2:].encode() + zstandard.compress(counts.astype(kind).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.int64)


Parcel = tuple[int, int, bytes, bytes, list[bytes]]


def cut(to: np.ndarray, sender: int, keys: np.ndarray, values: list[np.ndarray], who: np.ndarray | None = None) -> Iterator[Parcel]:
    """One parcel for each address; keys come sorted within an address."""
    if not len(to):
        return
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
        yield int(to[a]), sender, pack_keys(keys[a:b]), b"" if who is None else pack_counts(who[a:b]), [pack_counts(v[a:b]) for v in values]


def table(rows: list[Parcel]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def opened(parcels: pa.Table, extra: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All keys of some parcels, who sent each, and the columns of values."""
    keys = [unpack_keys(k.as_py()) for k in parcels.column("keys")]
    senders = []
    for s, w, k in zip(parcels.column("sender").to_pylist(), parcels.column("who").to_pylist(), keys, strict=True):
        senders.append(np.full(len(k), s, np.int64) if not w else (s << extra) + unpack_counts(w))
    columns = list(zip(*parcels.column("values").to_pylist(), strict=True))
    return np.concatenate(keys), np.concatenate(senders), [np.concatenate([unpack_counts(c) for c in v]) for v in columns]


def address_bits(buckets_bits: int, fan: int = FAN) -> tuple[int, int]:
    """Bits of bucket numbers (at most two steps of `fan`), and how many of them the second step cuts by."""
    bits = min(buckets_bits, 2 * fan)
    return bits, max(0, bits - fan)


def second_step(parcels: DataFrame, key_bits: int, bits: int, extra: int) -> DataFrame:
    """Parcels at buckets' highest bits go on to the buckets (bits of key_bits); nothing to do if those are all."""
    if not extra:
        return parcels

    def run(group: pa.Table) -> pa.Table:
        keys, senders, values = opened(group, 0)
        order = np.argsort(keys, kind="stable")
        keys, senders = keys[order], senders[order]
        to = (keys >> np.uint64(key_bits - bits)).astype(np.int64)
        first = int(senders[0]) >> extra
        return table(list(cut(to, first, keys, [v[order] for v in values], senders - (first << extra))))

    near = parcels.withColumn("near", F.shiftright("sender", extra))
    return near.groupBy("to", "near").applyInArrow(_without("near", run), PARCELS)


def send_back(bucket: int, keys: np.ndarray, senders: np.ndarray, values: list[np.ndarray], extra: int) -> Iterator[Parcel]:
    """Parcels of a bucket to the blocks of `senders`, or with two steps to 2**extra blocks at a time."""
    if not extra:
        order = np.lexsort((keys, senders))
        yield from cut(senders[order], bucket, keys[order], [v[order] for v in values])
        return
    order = np.lexsort((keys, senders >> extra))
    keys, senders = keys[order], senders[order]
    yield from cut(senders >> extra, bucket, keys, [v[order] for v in values], senders & ((1 << extra) - 1))


def last_step(parcels: DataFrame, extra: int) -> DataFrame:
    """Parcels at groups of 2**extra blocks go on to the blocks."""
    if not extra:
        return parcels

    def run(group: pa.Table) -> pa.Table:
        first, rows = group.column("to")[0].as_py() << extra, []
        keys = [unpack_keys(k.as_py()) for k in group.column("keys")]
        who = np.concatenate([unpack_counts(w) for w in group.column("who").to_pylist()])
        values = [np.concatenate([unpack_counts(c) for c in v]) for v in zip(*group.column("values").to_pylist(), strict=True)]
        keys = np.concatenate(keys)
        order = np.lexsort((keys, who))
        rows += cut(first + who[order], group.column("sender")[0].as_py() >> extra, keys[order], [v[order] for v in values])
        return table(rows)

    near = parcels.withColumn("near", F.shiftright("sender", extra))
    return near.groupBy("to", "near").applyInArrow(_without("near", run), PARCELS)


def _without(column: str, run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    return lambda group: run(group.drop_columns([column]))
