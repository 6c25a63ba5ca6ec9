"""Top k by BM25 over postings whose impacts are stored in blocks.

The impact of a posting is its BM25 score without the term's weight. Rows are dealt by id into
shards of ROWS or so. A block holds postings of one term, shard and band of impacts, BLOCK of
them at most, sorted by row; it tells how many they are and which impact is the largest. Blocks
of the terms asked for meet in a task a shard, with all queries, which does for each query:

1. The rows of its rarest terms are scored in full; the k-th best score is a threshold that the
   shard's answer can't fall below.
2. Terms are lined up from the most frequent on. As long as the largest scores of those passed
   so far, with the block's own, stay below the threshold, a row that has nothing but such
   blocks can't be in the answer: they aren't taken up. The others are, and give candidates.
3. More blocks are taken up in steps, for candidates only: at first those that could lift a row to
   a half of the threshold, then to a quarter. After each step the threshold is raised to the
   k-th best sum so far, and candidates go whose sums, with all that the blocks left out could
   add, stay below it. Those that are left are scored in full.

The k best of each shard are ranked, so what is dealt is the blocks asked for and k rows a query
and shard, not a row for each query and posting. The rows are those of lexical.top_k over
lexical.bm25, also where rows share an id or have none. A task holds one shard at a time. More
than MOST terms of queries take joins instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hayrick.operators import lexical
from hayrick.operators.lexical import B, K1, corpus_stats, idf, top_k
from hayrick.sources import scratch

BANDS, BLOCK = 16, 65_536
#: Rows of a shard, on average.
ROWS = 1 << 12
#: Rows of the rarest terms that are scored first, in multiples of k.
AHEAD = 4
#: Shares of the threshold at which blocks are taken up, step by step.
STEPS = (1.0, 0.5, 0.25)
#: Scores are sums in any order: what is this near to the threshold is kept.
NEAR = 1e-9

_BLOCKS = "shard bigint, term string, band int, block bigint, n bigint, top double, rows array<int>, impacts array<double>, ids array<bigint>"
_COUNTS = ["postings", "taken", "met", "candidates", "scored"]


def _begins(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)]))


def _impacts_of(rows: np.ndarray, tfs: np.ndarray, of: np.ndarray, dls: np.ndarray, n_rows: int, avgdl: float) -> np.ndarray:
    """Impacts of postings, added up over the lengths that their row has; of: the row of each length."""
    order = np.argsort(of, kind="stable")
    offsets = np.searchsorted(of[order], np.arange(n_rows + 1))
    dls, many, sums = dls[order], np.diff(offsets), np.zeros(len(rows))
    left = np.flatnonzero(many[rows] > 0)
    for k in range(int(many.max(initial=0))):
        left = left[many[rows[left]] > k]
        tf = tfs[left]
        sums[left] += tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls[offsets[rows[left]] + k] / avgdl))
    return sums


def impacts_of_counted(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """The index of counted rows (lexical.counted); rows with one id are put together."""
    return _index(counted, counted, block)


def impacts(freqs: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The index of postings and lengths: shard, term, band (0: the largest impacts), block, n, top, rows (numbers within the shard) and impacts; a shard's ids are in a row without a term."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    each = lengths.select("id", F.col("dl").cast("bigint").alias("dl"), none("string").alias("terms"), none("int").alias("tfs"))
    each = each.unionByName(freqs.select("id", F.lit(None).cast("bigint").alias("dl"), F.array("term").alias("terms"), F.array(F.col("tf").cast("int")).alias("tfs")))
    return _index(each, lengths, block)


def _blocks(shard: int, part: pa.Table, block: int, avgdl: float) -> pa.Table:
    """Counted rows of a shard as its blocks."""
    part = part.combine_chunks()
    column = lambda name: part.column(name).combine_chunks()
    known = column("id").dictionary_encode("encode")
    ids, row_of = known.dictionary, known.indices.to_numpy().astype(np.int64)
    n_rows, has_id = len(ids), ids.is_valid().to_numpy(zero_copy_only=False)
    terms, places = lexical._places(column("terms"))
    terms = terms.dictionary_encode()
    codes, rows, tfs = terms.indices.to_numpy().astype(np.int64), row_of[places], column("tfs").flatten().to_numpy()
    if n_rows < part.num_rows:  # rows that share an id
        keys, back = np.unique(codes * n_rows + rows, return_inverse=True)
        codes, rows, tfs = keys // n_rows, keys % n_rows, np.bincount(back, tfs, len(keys))
    there = column("dl").is_valid().to_numpy(zero_copy_only=False) & has_id[row_of]  # without an id a row counts, and is never found
    impact = _impacts_of(rows, tfs, row_of[there], column("dl").fill_null(0).to_numpy()[there], n_rows, avgdl)
    band = np.maximum(0, BANDS - 1 - np.floor(impact * BANDS / (K1 + 1)).astype(np.int64))
    order = np.argsort((codes * BANDS + band) * n_rows + rows)
    codes, band, rows, impact = codes[order], band[order], rows[order], impact[order]
    first = _begins(codes, band)
    number = (np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))) // block
    first = _begins(codes, band, number)
    ends = np.append(first, len(codes))
    n = len(first)
    more = lambda values, kind, last: pa.concat_arrays([pa.array(values, kind), pa.array([last], kind)])
    lists = lambda values, kind: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind)), pa.array([[]], pa.list_(kind))])
    columns = {
        "shard": pa.array(np.full(n + 1, shard), pa.int64()),
        "term": pa.concat_arrays([terms.dictionary.take(pa.array(codes[first])), pa.nulls(1, pa.string())]),
        "band": more(band[first], pa.int32(), 0),
        "block": more(number[first], pa.int64(), 0),
        "n": more(np.diff(ends), pa.int64(), 0),
        "top": more(np.maximum.reduceat(impact, first) if n else [], pa.float64(), 0.0),
        "rows": lists(rows.astype(np.int32), pa.int32()),
        "impacts": lists(impact, pa.float64()),
        "ids": pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, n_rows], pa.int32()), ids)]),
    }
    return pa.table(columns)


def _index(counted: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    ndocs, avgdl = corpus_stats(lengths).first()
    dealt = counted.select(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-ndocs // ROWS)))).alias("shard"), F.col("id").cast("bigint").alias("id"), "dl", "terms", "tfs")
    return dealt.groupBy("shard").applyInArrow(lambda key, part: _blocks(key[0].as_py(), part, block, avgdl or 1.0), _BLOCKS)


def heads(index: DataFrame) -> DataFrame:
    """shard, term, band, block, n and top of each block."""
    return index.where("term IS NOT NULL").select("shard", "term", "band", "block", "n", "top")


@dataclass
class Found:
    best: DataFrame  # qid, id, score, rank
    work: DataFrame  # qid, postings (of all its terms), taken (in the first step), met (in all steps), candidates, scored (in full)


class _Shard:
    """Blocks of a shard, by term."""

    def __init__(self, part: pa.Table):
        part = part.combine_chunks()
        owner = part.filter(pc.is_null(part.column("term")))
        blocks = part.filter(pc.is_valid(part.column("term"))).sort_by("term").combine_chunks()
        self.ids = owner.column("ids").combine_chunks().flatten()
        self.n, self.top = blocks.column("n").to_numpy(), blocks.column("top").to_numpy()
        self.ends = np.append(0, np.cumsum(self.n))
        flat = lambda name, kind: blocks.column(name).combine_chunks().flatten().to_numpy() if len(self.n) else np.zeros(0, kind)
        self.rows, self.impacts = flat("rows", np.int32), flat("impacts", np.float64)
        begins, self.of = {}, {}
        for k, term in enumerate(blocks.column("term").to_pylist()):
            begins.setdefault(term, k)
            self.of[term] = range(begins[term], k + 1)
        # Postings by the first block of their term, and row.
        keys = np.repeat([k for r in self.of.values() for k in [r.start] * len(r)], self.n) * len(self.ids) + self.rows
        order = np.argsort(keys)
        self.keys, self.by_key = keys[order], self.impacts[order]

    def postings(self, blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and weighed impacts of some blocks."""
        n = self.n[blocks]
        at = np.repeat(self.ends[blocks] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.rows[at], self.impacts[at] * np.repeat(weights, n)

    def full(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of some rows; terms: by their first blocks."""
        sums, some = [np.zeros(0)], max(1, lexical.CELLS // len(terms))
        for k in range(0, len(rows), some):
            asked = terms[:, None] * len(self.ids) + rows[k : k + some]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            sums.append(weights @ np.where(self.keys[at] == asked, self.by_key[at], 0.0))
        return np.concatenate(sums)

    def best(self, asked: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
        """Rows, their scores, and counts. asked: terms and weights, from the most frequent on."""
        terms = [x for x in asked if x[0] in self.of]
        if not terms:
            return None
        blocks = np.concatenate([np.arange(r.start, r.stop) for r in (self.of[t] for t, _ in terms)])
        which = np.repeat(np.arange(len(terms)), [len(self.of[t]) for t, _ in terms])
        weights = np.array([w for _, w in terms])
        most = weights[which] * self.top[blocks]
        first = _begins(which)
        tops = np.maximum.reduceat(most, first)
        reach = (np.cumsum(tops) - tops)[which] + most
        own = np.add.reduceat(self.n[blocks], first)  # rows of each term here
        rare = (np.cumsum(own[::-1]) - own[::-1])[::-1] < AHEAD * k
        ahead = np.unique(self.postings(blocks[rare[which]], weights[which[rare[which]]])[0])
        kth = lambda scores: float(np.partition(scores, -k)[-k]) if len(scores) >= k else 0.0
        theta = kth(self.full(ahead, blocks[first], weights))
        step = sum((reach < theta * share - NEAR).astype(int) for share in STEPS)
        sums, alive, candidates = np.zeros(len(self.ids)), None, 0
        for s in range(len(STEPS)):
            rows, scores = self.postings(blocks[step == s], weights[which[step == s]])
            sums += np.bincount(rows, scores, len(sums))
            alive = sums > 0 if alive is None else alive
            candidates = candidates or int(alive.sum())
            # What a row can have in blocks left out: of each term one block at most.
            rest = np.maximum.reduceat(np.where(step > s, most, 0.0), first).sum()
            theta = max(theta, kth(sums[alive]))
            alive &= sums + rest >= theta - NEAR
        rows = np.flatnonzero(alive)
        n = self.n[blocks]
        return rows, self.full(rows, blocks[first], weights), [int(n.sum()), int(n[step == 0].sum()), int(n[step < len(STEPS)].sum()), candidates, len(rows)]


def _in_shards(index: DataFrame, asked: list, qid_type, k: int) -> DataFrame:
    """qid, id and score of the k best rows of each shard, and a row without an id for what it took."""
    plan: dict = {}
    for r in sorted(asked, key=lambda r: (-r["df"], r["term"])):
        plan.setdefault(r["qid"], []).append((r["term"], r["weight"]))
    spark, arrow_type = index.sparkSession, to_arrow_type(qid_type)
    shared = spark.sparkContext.broadcast((list(plan), list(plan.values())))
    terms = spark.createDataFrame([(t,) for t in sorted({r["term"] for r in asked})], "term string")
    wanted = index.join(F.broadcast(terms), "term", "left_semi").unionByName(index.where("term IS NULL"))  # no more than MOST

    def search(part: pa.Table) -> pa.Table:
        shard, (names, plan) = _Shard(part), shared.value
        who, ids, scores, counts = [], [], [], []
        for q, terms in enumerate(plan):
            found = shard.best(terms, k)
            if found is None:
                continue
            rows, some, work = found
            own = shard.ids.take(pa.array(rows)).to_numpy(zero_copy_only=False)
            order = np.lexsort((own, -np.round(some, 9)))[:k]
            who += [q] * (len(order) + 1)
            ids += [None, *own[order].tolist()]
            scores += [None, *some[order].tolist()]
            counts += [work] + [[None] * len(work)] * len(order)
        numbers = [pa.array([c[j] for c in counts], pa.int64()) for j in range(len(_COUNTS))]
        return pa.table([pa.array(names, arrow_type).take(pa.array(who, pa.int64())), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), *numbers], ["qid", "id", "score", *_COUNTS])

    return wanted.select("shard", "term", "n", "top", "rows", "impacts", "ids").groupBy("shard").applyInArrow(search, f"qid {qid_type.simpleString()}, id bigint, score double, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def _by_joins(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The same of all rows, each posting of each query taken up."""
    each = index.where("term IS NOT NULL").select("shard", "term", F.explode(F.arrays_zip("rows", "impacts")).alias("z"))
    ids = index.where("term IS NULL").select("shard", F.posexplode("ids").alias("row", "id")).where("id IS NOT NULL")
    scores = asked.join(each, "term").groupBy("qid", "shard", F.col("z.rows").alias("row")).agg(F.sum(F.col("weight") * F.col("z.impacts")).alias("score"))
    none = [F.lit(None).cast("bigint").alias(c) for c in _COUNTS]
    found = top_k(scores.where("score > 0").join(ids, ["shard", "row"]), k).select("qid", "id", "score", *none)
    all_of = asked.groupBy("qid").agg(F.sum("df").alias("n")).join(scores.groupBy("qid").agg(F.count(F.lit(1)).alias("rows")), "qid")
    return found.unionByName(all_of.select("qid", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("score"), *(F.col("n" if c in _COUNTS[:3] else "rows").alias(c) for c in _COUNTS)))


def search(queries: DataFrame, index: DataFrame, heads: DataFrame, ndocs: DataFrame, k: int, keep=scratch.written) -> Found:
    """queries: qid and term, a repeated term counts each time; ndocs: one row. keep(df, name) writes what is found, as its best rows and its work are read from it."""
    wanted = queries.where("term IS NOT NULL").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = heads.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    asked = wanted.join(terms, "term").crossJoin(F.broadcast(ndocs.select("ndocs")))
    asked = asked.select("qid", "term", "df", (F.col("times") * idf(F.col("df"), F.col("ndocs"))).alias("weight"))
    some = asked.limit(lexical.MOST + 1).collect()
    found = _by_joins(index, asked, k) if len(some) > lexical.MOST else _in_shards(index, some, queries.schema["qid"].dataType, k)
    found = keep(found, "found")
    best = top_k(found.where("id IS NOT NULL").select("qid", "id", "score"), k)
    return Found(best, found.where("id IS NULL").groupBy("qid").agg(*(F.sum(c).alias(c) for c in _COUNTS)))
