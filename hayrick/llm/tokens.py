"""Token ids by the tokenizers library, with repeated stretches encoded once.

A byte-level BPE never joins across a boundary of its own pre-tokenizer, and a single
space between two characters that aren't white space always is such a boundary. So a
text is cut before those spaces, each distinct stretch is encoded by the library, and the
ids are put together again; the result equals encoding the text at once (tests compare
the two). Stretches are told apart by 128 bits of hash, and a worker remembers the ids of
those it met last.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pandas as pd
import pyarrow as pa

from hayrick.llm import common

#: Distinct stretches that a worker keeps; those not met for longest are encoded anew.
REMEMBERED = 600_000
_loaded: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin, and for each text the number of the first of its stretches (one more at the end).

    No cut is made beside a control character or what may be a part of a non-ASCII white
    space, which is stricter than need be and always right. Empty texts have no stretch.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = data == 32
    plain = data > 32
    cut[1:] &= plain[:-1]
    cut[:1] = cut[-1:] = False
    cut[:-1] &= plain[1:]
    cut &= ~(edge[:-1] | edge[1:])  # a space at either end of a text
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        lead, second, third = padded[wide], padded[wide + 1], padded[wide + 2]
        two = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
        three = (lead >= 0xE1) & (lead <= 0xE3) & ((second == 0x9A) | (second == 0x80) | (second == 0x81)) & (third >= 0x80)
        for found, size in ((wide[two], 2), (wide[three], 3)):
            cut[np.maximum(found - 1, 0)] = False
            cut[np.minimum(found + size, n - 1)] = False
    cut |= edge[:-1]
    begins = np.flatnonzero(cut)
    return begins, np.searchsorted(begins, offsets)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clock = 0
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # sorted by key
        self.places, self.sizes, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each worker and file."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _forget(self) -> None:
        """Keep the half met last."""
        keep = np.sort(np.argsort(self.met, kind="stable")[-(REMEMBERED // 2) :])
        self.keys, self.checks, places, self.sizes, self.met = (x[keep] for x in (self.keys, self.checks, self.places, self.sizes, self.met))
        self.ids = self.ids[_ranges(places, self.sizes)]
        self.places = np.cumsum(self.sizes) - self.sizes

    def _look_up(self, keys: np.ndarray, checks: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.ids the ids of each of these distinct stretches are, and how many."""
        self.clock += 1
        if len(self.keys) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        there = (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        places, sizes = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        places[there], sizes[there] = self.places[at[there]], self.sizes[at[there]]
        self.met[at[there]] = self.clock
        new = np.flatnonzero(~there)
        if len(new):
            lists = []
            for a in range(0, len(new), 4096):
                lists += [e.ids for e in self.tokenizer.encode_batch_fast(text_of(new[a : a + 4096]), add_special_tokens=False)]
            sizes[new] = np.fromiter(map(len, lists), np.int64, len(lists))
            places[new] = len(self.ids) + np.cumsum(sizes[new]) - sizes[new]
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes[new].sum()))])
            # a key that is there with another check stays as it was
            fresh = new[np.argsort(keys[new], kind="stable")]
            if len(self.keys):
                fresh = fresh[self.keys[at[fresh]] != keys[fresh]]
            spot = np.searchsorted(self.keys, keys[fresh])
            self.keys, self.checks, self.places, self.sizes, self.met = (
                np.insert(x, spot, y) for x, y in ((self.keys, keys[fresh]), (self.checks, checks[fresh]), (self.places, places[fresh]), (self.sizes, sizes[fresh]), (self.met, np.full(len(fresh), self.clock)))
            )
        return places, sizes

    def encode_buffer(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), of UTF-8 bytes and offsets."""
        data, offsets = data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
        begins, unit_of = stretches(data, offsets)
        ends = np.append(begins[1:], len(data))
        keys, checks = common.hash_spans(data, begins, ends, (0, 2))
        codes, distinct = pd.factorize(keys)
        first = np.full(len(distinct), len(keys), np.int64)
        np.minimum.at(first, codes, np.arange(len(codes))) if len(codes) < 1000 else first.__setitem__(codes[::-1], np.arange(len(codes))[::-1])
        blob = data.tobytes()
        places, sizes = self._look_up(distinct, checks[first], lambda some: [blob[begins[k] : ends[k]].decode("utf-8") for k in first[some].tolist()])
        lengths = sizes[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        out_at = total[unit_of] + np.arange(len(offsets))
        out = np.full(int(out_at[-1]), end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[out_at[1:] - 1] = False
        out[inner] = self.ids[_ranges(places[codes], lengths)]
        return out, out_at

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with `end` after each, and where each text's ids begin (one more at the end)."""
        parts, at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in common.text_slices(texts):
            ids, begins = self.encode_buffer(data, offsets, end)
            parts.append(ids)
            at.append(begins[1:] + at[-1][-1])
        return np.concatenate(parts), np.concatenate(at)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, and so on."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
