"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates: of a word after the one before it, of the
word alone, and of any of V + 1 words alike. The weights of the mixture depend on how
often the context was seen (one set for each power of two), and are learned by
expectation-maximisation on counts held out of the training texts: one fold of them, whose
own counts are deleted from all counts before its words are predicted.

How it runs. Documents are dealt by hash into blocks of about `block_bytes`, each of one
fold. A task counts the distinct words and word pairs of its block (as hashes) and sends
them, sorted and packed, to buckets of the hash space. A task for each bucket adds the
counts up and sends back to each block the totals of its keys that it can't know by itself:
those that other blocks have too (parcels.py keeps both exchanges in proportion to the
input). Then each block's documents meet the totals and are scored. Nothing is broadcast but
a few numbers and at most 32 sets of weights; blocks and buckets grow in number with the
input, not in size. Two given words share a 64-bit hash with a chance of about 2**-64, so
counts of words are exact but for that. Hashes of pairs have 56 bits at every size of input:
a pair shares its hash with another one of 2**38 pairs with a chance of 2**-18, and then is
taken for seen more often than it was.

Words: runs of bytes other than white space, with A-Z in lower case; each text ends with
an end token, and begins after a start that is only a context.

Defined cases: null and empty texts are the end token alone; very long texts are scored
whole; repeated rows count and are scored each; a null doc_id is training text; an empty
table gives no rows; without training text all but the uniform part is 0 and N and V are
0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common, parcels
from hayrick.llm.common import MIX, mix
from hayrick.llm.parcels import pack_counts, unpack_counts

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
TRAIN, DELETED, HELD = 0, 1, 2
BUCKETS = 32  # context-frequency buckets of the mixture
PAIR_MASK = np.uint64((1 << 64) - (1 << 8))  # pairs have 56 bits: shorter keys pack into less
LEVELS = 64  # half powers of two that probabilities are gathered by for the weights


class Block:
    """The words of a block's documents, as numbers of their distinct keys."""

    def __init__(self, texts: pa.ChunkedArray):
        tokens, ends = [], [0]
        for _, _, data, offsets in common.text_slices(texts):
            words, at = common.hash_words(data, offsets)
            out = np.full(len(words) + len(at) - 1, END, np.uint64)
            inner = np.ones(len(out), bool)
            inner[at[1:] + np.arange(len(at) - 1)] = False
            out[inner] = words
            tokens.append(out)
            ends.extend((at[1:] + np.arange(1, len(at)) + ends[-1]).tolist())
        self.ends = np.array(ends[1:], np.int64)
        self.begins = np.array(ends[:-1], np.int64)
        words = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.begins] = START
        codes, keys = pd.factorize(words)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word_keys, self.word = keys[order], place[codes]
        codes, keys = pd.factorize(mix(before * MIX[0] + words * MIX[1]) & PAIR_MASK)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_keys, self.pair = keys[order], place[codes]
        self.context = np.empty_like(self.word)  # the word before, -1 at a text's start
        self.context[1:] = self.word[:-1]
        self.context[self.begins] = -1
        self.end_word = int(np.searchsorted(self.word_keys, END))

    def keys(self, order: int) -> np.ndarray:
        return self.word_keys if order == 1 else self.pair_keys

    def counts(self, order: int) -> np.ndarray:
        return np.bincount(self.word if order == 1 else self.pair, minlength=len(self.keys(order)))


def _send(shift: int) -> Callable[[pa.Table], pa.Table]:
    """Each distinct key of a block with its count, to the bucket of the key's highest bits: even addresses take words, odd ones pairs."""

    def run(table: pa.Table) -> pa.Table:
        seen, rows = Block(table.column("text")), []
        for order in (1, 2):
            keys = seen.keys(order)
            bucket = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
            rows += [(2 * to + order - 1, *rest) for to, *rest in parcels.cut(bucket, table.column("block")[0].as_py(), keys, [seen.counts(order)])]
        return parcels.table(rows)

    return run


def _add_up(first: list[int], extra: int) -> Callable[[pa.Table], pa.Table]:
    """Totals over training texts of all keys of a bucket, to the blocks that need them; and the bucket's sums, addressed to -1."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("to")[0].as_py()
        keys, senders, (counts,) = parcels.opened(table, extra)
        fold = np.searchsorted(first, senders, "right") - 1
        codes, distinct = pd.factorize(keys)
        total = np.bincount(codes, np.where(fold == HELD, 0, counts), len(distinct)).astype(np.int64)
        deleted = np.bincount(codes, np.where(fold == DELETED, counts, 0), len(distinct)).astype(np.int64)
        some = np.bincount(codes, minlength=len(distinct))[codes] > 1  # other blocks have the key too
        mine, fold = codes[some], fold[some]
        # Only blocks of the deleted fold ask what was deleted.
        rows = list(parcels.send_back(bucket, keys[some], senders[some], [total[mine], np.where(fold == DELETED, deleted[mine], 0)], extra))
        if bucket % 2 == 0:
            sums = np.array([total.sum(), (total > 0).sum(), deleted.sum()], np.int64)
            rows.append((-1, bucket, b"", b"", [pack_counts(sums)]))
        return parcels.table(rows)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = np.array([unpack_counts(v[0]) for v in batch.column(0).to_pylist()]).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in sums.T], ["n", "v", "deleted"])


def _totals(seen: Block, fold: int, back: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all training texts, and over the deleted fold, of a block's keys."""
    keys, own = seen.keys(order), seen.counts(order)
    total = own.copy() if fold != HELD else np.zeros_like(own)  # right for keys that only this block has
    deleted = own.copy() if fold == DELETED else np.zeros_like(own)
    some = back.filter(pc.equal(pc.bit_wise_and(back.column("sender"), 1), order - 1)) if len(back) else back
    if len(some):
        sent, _, (totals, gone) = parcels.opened(some, 0)
        at = np.searchsorted(keys, sent)
        total[at], deleted[at] = totals, gone
    return total, deleted


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return np.where(counts > 0, np.minimum(np.frexp(np.maximum(counts, 1).astype(float))[1], BUCKETS - 1), 0)


def _parts(seen: Block, words: np.ndarray, pairs: np.ndarray, n: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: its context's bucket and the two maximum-likelihood estimates."""
    context = np.where(seen.context >= 0, words[seen.context], ends)  # every text has one start and one end
    two = np.where(context > 0, pairs[seen.pair] / np.maximum(context, 1), 0.0)
    return context_bucket(context), two, words[seen.word] / max(n, 1)


def level(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else by half powers of two."""
    return np.where(p > 0, np.clip(LEVELS - 1 + np.round(2 * np.log2(np.maximum(p, 1e-300))), 1, LEVELS - 1), 0).astype(np.int64)


GATHERED = "bucket int, two int, one int, tokens double, log_two double, log_one double"


def _gather(numbers: dict) -> Callable:
    """Of a block of the deleted fold: tokens by context bucket and levels of their estimates."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({c: pa.array([], t) for c, t in (("bucket", pa.int32()), ("two", pa.int32()), ("one", pa.int32()), ("tokens", pa.float64()), ("log_two", pa.float64()), ("log_one", pa.float64()))})
        seen = Block(docs.column("text"))
        word_total, word_deleted = _totals(seen, DELETED, back, 1)
        pair_total, pair_deleted = _totals(seen, DELETED, back, 2)
        words, pairs = word_total - word_deleted, pair_total - pair_deleted
        bucket, two, one = _parts(seen, words, pairs, numbers["n"] - numbers["deleted"], int(words[seen.end_word]))
        key = (bucket * LEVELS + level(two)) * LEVELS + level(one)
        codes, distinct = pd.factorize(key)
        n = np.bincount(codes)
        logs = [np.bincount(codes, np.log(np.maximum(p, 1e-300))) for p in (two, one)]
        columns = [distinct // LEVELS**2, distinct // LEVELS % LEVELS, distinct % LEVELS]
        return pa.Table.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(n.astype(float)), *map(pa.array, logs)], ["bucket", "two", "one", "tokens", "log_two", "log_one"])

    return run


def mixture_weights(gathered: pd.DataFrame, uniform: float, *, rounds: int = 60, prior: float = 1.0) -> np.ndarray:
    """Per context bucket the weights of pair, word and uniform estimate, by expectation-maximisation.

    gathered has a row for each bucket and pair of levels, so at most BUCKETS * LEVELS**2 in
    all. `prior` tokens for each part keep buckets without held-out tokens defined.
    """
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)
    for b in range(BUCKETS):
        rows = gathered[gathered["bucket"] == b]
        n = rows["tokens"].to_numpy(float)
        p = np.column_stack([np.where(rows[c] > 0, np.exp(rows[f"log_{c}"] / np.maximum(n, 1)), 0.0) for c in ("two", "one")] + [np.full(len(rows), uniform)])
        w = out[b]
        for _ in range(rounds):
            mixed = p * w
            share = (n / np.maximum(mixed.sum(1), 1e-300)) @ mixed + prior * (w > 0)
            w = share / share.sum()
        out[b] = w
    return out


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(numbers: dict, weights: np.ndarray) -> Callable:
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not len(docs):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        fold, seen = docs.column("fold")[0].as_py(), Block(docs.column("text"))
        words, _ = _totals(seen, fold, back, 1)
        pairs, _ = _totals(seen, fold, back, 2)
        n, v = numbers["n"], numbers["v"]
        counts = words[seen.word]
        base = np.log10((counts + 1) / (n + v + 1))
        bucket, two, one = _parts(seen, words, pairs, n, numbers["ends"])
        w = weights[bucket]
        score = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1))
        per = lambda x: np.add.reduceat(x, seen.begins)  # noqa: E731  every text has a token
        return pa.Table.from_arrays([docs.column("doc_id"), pa.array(np.full(len(docs), fold == HELD)), pa.array(seen.ends - seen.begins), pa.array(per((counts > 0).astype(np.int64))), pa.array(per(base)), pa.array(per(score))], names)

    return run


def score_texts(docs: DataFrame, *, modulus: int = 7, held: int = 2, deleted: int = 3, block_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20, fan: int = parcels.FAN) -> DataFrame:
    """One row a document: fold, tokens, known tokens, add-one unigram score and model score (log10)."""
    rows, size = common.text_size(docs)
    size += rows  # the end tokens
    blocks = math.ceil(size / block_bytes)
    remainder = common.fold("doc_id", modulus)
    fold = F.when(remainder == held, HELD).when(remainder == deleted, DELETED).otherwise(TRAIN)
    parts = [max(1, math.ceil(blocks * k / modulus)) for k in (modulus - 2, 1, 1)]
    first = [0, parts[0], parts[0] + parts[1]]
    # Texts are part of the hash, so that rows with one id don't all meet in one block.
    hashed = F.xxhash64("doc_id", "text")
    block = F.element_at(F.array(*[F.pmod(hashed, F.lit(n)) + F.lit(a) for n, a in zip(parts, first, strict=True)]), F.col("fold") + 1)
    texts = docs.select(F.col("doc_id").cast("bigint"), common.whole_text().alias("text")).withColumn("fold", fold).withColumn("block", block.cast("bigint"))
    bits, extra = parcels.address_bits(max(0, math.ceil(math.log2(max(1, size / bucket_bytes)))), fan)
    sent = texts.groupBy("block").applyInArrow(_send(64 - bits + extra), parcels.PARCELS)
    if extra:
        # The second step cuts by bits of keys; words and pairs take it apart from each other.
        kinds = [sent.where(F.col("to") % 2 == k) for k in (0, 1)]
        steps = [parcels.second_step(part, 64, bits, extra).withColumn("to", 2 * F.col("to") + k) for k, part in enumerate(kinds)]
        sent = steps[0].unionByName(steps[1])
    added = sent.groupBy("to").applyInArrow(_add_up(first, extra), parcels.PARCELS)
    totals = common.materialize(added, "totals")
    sums = totals.where("to = -1").select("values").mapInArrow(_sums, "n bigint, v bigint, deleted bigint")
    row = sums.agg(*(F.sum(c).alias(c) for c in ("n", "v", "deleted"))).first()
    numbers = {k: int(v or 0) for k, v in row.asDict().items()}
    numbers["ends"] = texts.where(F.col("fold") != HELD).count()
    back = totals.where("to >= 0")
    if extra:
        # Senders keep their lowest bit, words or pairs, through the last step.
        kinds = [back.where(F.col("sender") % 2 == k).withColumn("sender", F.shiftright("sender", 1)) for k in (0, 1)]
        steps = [parcels.last_step(part, extra).withColumn("sender", 2 * F.col("sender") + k) for k, part in enumerate(kinds)]
        back = common.materialize(steps[0].unionByName(steps[1]), "totals")
    back = back.withColumnRenamed("to", "block")
    some = texts.where(F.col("fold") == DELETED).groupBy("block").cogroup(back.where(F.col("block").between(first[1], first[2] - 1)).groupBy("block")).applyInArrow(_gather(numbers), GATHERED)
    gathered = some.groupBy("bucket", "two", "one").agg(*(F.sum(c).alias(c) for c in ("tokens", "log_two", "log_one"))).toPandas()
    weights = mixture_weights(gathered, 1 / (numbers["v"] + 1))
    scored = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(numbers, weights), SCORED)
    return scored.withColumn("train_tokens", F.lit(numbers["n"]).cast("bigint"))


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.table(spark, sf_dir, "documents"))
