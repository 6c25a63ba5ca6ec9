"""Exact Jaccard join of documents' word shingles, down to connected components.

A document's set is its distinct shingles. Two sets link if their Jaccard similarity is
at least `percent` / 100. Equal sets are one node. The steps:

1. Documents are dealt into blocks of bounded size. Shingles are counted over all
   documents, as keys cut from their hashes, packed and sent to buckets of the key space;
   each block gets back the counts of its keys that occur more than once (parcels.py keeps
   those exchanges in proportion to the input). Keys are shorter than hashes; two shingles
   with one key only look more frequent than they are. That changes the order of step 2,
   for all alike, and loses nothing.
2. Shingles are ordered by count, rarest first. Two similar sets share one within the
   first n - ceil(p n) + 1 of either: the prefix. Shingles that occur once are in no other
   set, so only the others in prefixes become entries of the index lists.
3. Index lists bring candidates together, but not all pairs of a list. First each node is
   compared with one other, the pivot it meets in most lists: a list's pivot is its set
   with the smallest share of shingles that are its own, in a group of copies the one most
   like all. These answers give components.
4. Only lists that still hold several components are searched, each member outside of its
   list's largest component against the others. Blocks of a list are skipped by position
   and size; pairs are skipped by answers already computed: of two sets with one pivot
   whose distances to it differ by more than 1 - p none can link (the Jaccard distance is a
   metric), and pairs of one component need no link. Pairs that share too few entries of
   their prefixes are dropped, the others compared in full.

Nothing is sampled or capped: every pair with the similarity ends up in one component.
Comparisons run in groups of bounded size: those of one pivot are cut into chunks.
Hashes have 64 bits: two given shingles or sets are confused with a chance of about 2**-64.

Defined cases: null and empty texts, and texts without words, have no shingle and link
with nothing; texts shorter than a shingle are one shingle; very long texts are read
whole; repeated rows are one node; a null doc_id is kept and, in a component, counts
only if all are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common, parcels
from hayrick.llm.components import components

SHINGLE, PERCENT = 5, 80
SETS = "doc_id bigint, mark bigint, n int, node bigint, own int, entries array<bigint>, shingles binary"


def _count(width: int, key_bits: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """Counts of a block's shingle keys, in parcels to buckets."""

    def run(docs: pa.Table) -> pa.Table:
        found = [np.concatenate(common.shingle_hashes(*common.hash_words(data, offsets), width)) >> np.uint64(64 - key_bits) for _, _, data, offsets in common.text_slices(docs.column("text"))]
        keys = np.sort(np.concatenate(found))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        return parcels.table(list(parcels.cut((keys >> np.uint64(key_bits - bits)).astype(np.int64), docs.column("block")[0].as_py(), keys, [counts])))

    return run


def _frequent(extra: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's keys those that occur more than once, to each block that has them."""

    def run(group: pa.Table) -> pa.Table:
        keys, senders, (counts,) = parcels.opened(group, extra)
        codes, distinct = pd.factorize(keys)
        total = np.bincount(codes, counts, len(distinct)).astype(np.int64)[codes]
        some = total > 1
        return parcels.table(list(parcels.send_back(group.column("to")[0].as_py(), keys[some], senders[some], [total[some]], extra)))

    return run


def _sets(width: int, key_bits: int, percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sets of a block's documents, with their entries: frequent shingles of the prefix, rarest first."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if len(back):
            known, _, (counts,) = parcels.opened(back, 0)
            order = np.argsort(known)
            known, counts = known[order], counts[order]
        else:
            known, counts = np.zeros(1, np.uint64), np.ones(1, np.int64)
        rows, seen = [], set()
        names, marks = (docs.column(c).to_pylist() if len(docs) else [] for c in ("doc_id", "mark"))
        for first, _, data, offsets in common.text_slices(docs.column("text")) if len(docs) else ():
            sets = common.shingle_hashes(*common.hash_words(data, offsets), width)
            keys = np.concatenate(sets) >> np.uint64(64 - key_bits)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            often = np.where(known[at] == keys, counts[at], 1)
            place = 0
            for k, s in enumerate(sets):
                n, mine = len(s), often[place : place + len(s)]
                place += n
                if not n:
                    rows.append((names[first + k], marks[first + k], 0, None, 0, [], None))
                    continue
                node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                own = int((mine == 1).sum())
                prefix = n - -(-percent * n // 100) + 1
                entries, data_ = [], None
                if own < prefix:
                    shared = np.flatnonzero(mine > 1)
                    order = shared[np.lexsort((s[shared], mine[shared]))][: prefix - own]
                    entries = s[order].astype(np.int64).tolist()
                    if node not in seen:
                        seen.add(node)
                        data_ = s.tobytes()
                rows.append((names[first + k], marks[first + k], n, node, own, entries, data_))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "mark", "n", "node", "own", "entries", "shingles"])

    return run


def mark() -> F.Column:
    """Tells rows with one doc_id but other texts apart."""
    return F.xxhash64("text")


def counted(docs: DataFrame, *, width: int = SHINGLE, block_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20, fan: int = parcels.FAN) -> tuple[DataFrame, list[DataFrame], int]:
    """Step 1: the texts with their blocks, the parcels of each exchange (the last ones hold frequent keys, for the blocks), and the bits of a key."""
    rows, size = common.text_size(docs)
    blocks = max(1, math.ceil(size / block_bytes))
    bits, extra = parcels.address_bits(max(0, math.ceil(math.log2(max(1, size / bucket_bytes)))), fan)
    # 13 bits more than shingles can have: one key in thousands is shared by chance
    key_bits = min(63, max(bits + 8, math.ceil(math.log2(size / 2 + 2)) + 13))
    texts = docs.select(F.col("doc_id").cast("bigint"), mark().alias("mark"), common.whole_text().alias("text"))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("bigint"))
    sent = texts.groupBy("block").applyInArrow(_count(width, key_bits, bits - extra), parcels.PARCELS)
    exchanges = [sent, parcels.second_step(sent, key_bits, bits, extra)] if extra else [sent]
    exchanges.append(exchanges[-1].groupBy("to").applyInArrow(_frequent(extra), parcels.PARCELS))
    exchanges += [parcels.last_step(exchanges[-1], extra)] if extra else []
    return texts, exchanges, key_bits


def shingle_sets(docs: DataFrame, *, width: int = SHINGLE, percent: int = PERCENT, **sizes: int) -> DataFrame:
    """Steps 1 and 2: doc_id, mark, n, node, own, entries, and the sets of nodes with entries."""
    texts, exchanges, key_bits = counted(docs, width=width, **sizes)
    both = texts.groupBy("block").cogroup(exchanges[-1].withColumnRenamed("to", "block").groupBy("block"))
    return common.materialize(both.applyInArrow(_sets(width, key_bits, percent), SETS), "sets")


COMPARED = "a bigint, b bigint, shared int, na int, nb int, gone0 bigint, gone1 bigint"


def _compare(table: pa.Table) -> pa.Table:
    """Intersection sizes of members with their pivots, and which of 128 bits the pivot's shingles that a member lacks set."""
    pivots = {b: np.frombuffer(s, np.uint64) for a, b, s in zip(*(table.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True) if a == b}
    rows = set()
    for a, b, s in zip(*(table.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
        if a != b and b in pivots:
            x, y = np.frombuffer(s, np.uint64), pivots[b]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = y[at] == x
            lacking = np.ones(len(y), bool)
            lacking[at[both]] = False
            spots = y[lacking] & np.uint64(127)
            gone = [int(np.bitwise_or.reduce(np.uint64(1) << (spots[spots >> np.uint64(6) == k] & np.uint64(63)), initial=np.uint64(0)).view(np.int64)) for k in (0, 1)]
            rows.add((a, b, int(both.sum()), len(x), len(y), *gone))
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "shared", "na", "nb", "gone0", "gone1"])


def compare(pairs: DataFrame, sets: DataFrame, *, chunk: int = 1 << 19) -> DataFrame:
    """Intersection sizes of distinct pairs (a, b, n: shingles of a); sets has one row a node.

    A group's sets hold about `chunk` shingles, or twice that, and those of its pivots: a b
    whose partners hold more is copied to chunks of them.
    """
    sizes = pairs.groupBy("b").agg(F.sum("n").alias("weight"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    small = F.col("weight") <= chunk
    # Pivots whose partners are small share a group, others have groups of their own.
    group = F.when(small, F.pmod(F.xxhash64("b"), F.lit(max(1, total // (2 * chunk)))).cast("bigint")).otherwise(F.col("b"))
    chunks = F.when(small, F.lit(0)).otherwise(F.ceil(F.col("weight") / chunk).cast("int"))
    sized = pairs.join(sizes, "b").select("a", "b", group.alias("g"), F.when(small, F.lit(-1)).otherwise(F.pmod(F.xxhash64("a"), chunks)).alias("c"))
    pivots = sizes.select(F.col("b").alias("a"), "b", group.alias("g"), F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), chunks - 1))).alias("c"))
    wanted = sized.unionByName(pivots).withColumnRenamed("a", "node")
    with_sets = wanted.join(sets.select("node", "shingles"), "node").withColumnRenamed("node", "a")
    return common.materialize(with_sets.groupBy("g", "c").applyInArrow(_compare, COMPARED), "compared")


def linked(percent: int) -> F.Column:
    return F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("shared"))


def search_list(node: np.ndarray, n: np.ndarray, at: np.ndarray, own: np.ndarray, root: np.ndarray, pivot: np.ndarray, far: np.ndarray, met: np.ndarray, size: np.ndarray, gone0: np.ndarray, gone1: np.ndarray, percent: int, block: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one index list that may link and are of different components."""
    order = np.lexsort((at, n))
    node, n, at, own, root, pivot, far, met, size, gone0, gone1 = (x[order] for x in (node, n, at, own, root, pivot, far, met, size, gone0, gone1))
    roots, sizes = np.unique(root, return_counts=True)
    outside = np.flatnonzero(root != roots[sizes.argmax()])
    edges = np.arange(0, len(n), block)
    before = at - own  # of the shingles before this entry those that other sets may have
    low, high = np.minimum.reduceat(at, edges), np.maximum.reduceat(before, edges)
    small, large = np.minimum.reduceat(n, edges), np.maximum.reduceat(n, edges)
    rank = np.full(len(n), -1)
    rank[outside] = np.arange(len(outside))
    out = []
    for i in outside:
        # Of sizes n and m, positions i and j: of the shingles before the entry at most as many
        # are shared as either set has that aren't its own, of the others min(n - i, m - j).
        need = lambda m: -(-percent * (n[i] + m) // (100 + percent))
        fits = (large * 100 >= percent * n[i]) & (small * percent <= 100 * n[i])
        fits &= np.minimum(before[i], high) + np.minimum(n[i] - at[i], large - low) >= need(small)
        some = np.concatenate([np.arange(e, min(e + block, len(n))) for e in edges[fits]]) if fits.any() else np.zeros(0, np.int64)
        m, j = n[some], at[some]
        good = (root[some] != root[i]) & (rank[some] < rank[i]) & (np.minimum(n[i], m) * 100 >= percent * np.maximum(n[i], m))
        good &= np.minimum(before[i], before[some]) + np.minimum(n[i] - at[i], m - j) >= need(m)
        # Of what a common pivot has, two sets share no more than either shares with it, and
        # nothing that either lacks; of the rest, no more than either has besides its own shingles.
        lacked = np.bitwise_count(gone0[some] | gone0[i]).astype(np.int64) + np.bitwise_count(gone1[some] | gone1[i])
        most = np.minimum(np.minimum(met[i], met[some]), size[some] - lacked) + np.minimum(n[i] - met[i] - own[i], m - met[some] - own[some])
        good &= (pivot[some] != pivot[i]) | (np.abs(far[some] - far[i]) <= 1 - percent / 100 + 1e-9) & (most >= need(m))
        if good.any():
            out.append((np.full(int(good.sum()), node[i]), node[some[good]]))
    return out


def _search(percent: int) -> Callable:
    """Rows of a partition come sorted by entry; a list that goes on in the next batch waits for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pd.DataFrame] = []

        def pairs(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            entry = rows["entry"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            columns = [rows[c].to_numpy() for c in ("node", "n", "at", "own", "root", "pivot", "far", "met", "size")] + [rows[c].to_numpy().view(np.uint64) for c in ("gone0", "gone1")]
            found = []
            for a, b in zip(cuts, [*cuts[1:], len(entry)], strict=True):
                found += search_list(*(c[a:b] for c in columns), percent)
            if found:
                x, y = (np.concatenate(z) for z in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for batch in batches:
            rows = batch.to_pandas()
            if not len(rows):
                continue
            waiting.append(rows)
            last = rows["entry"].iloc[-1]
            if rows["entry"].iloc[0] == last:
                continue
            rows = pd.concat(waiting)
            going = (rows["entry"] == last).to_numpy()
            yield from pairs(rows[~going])
            waiting = [rows[going]]
        if waiting:
            yield from pairs(pd.concat(waiting))

    return run


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's set, and node and root of the nodes that have a link."""
    rows = shingle_sets(docs, width=width, percent=percent)
    held = rows.where(F.col("shingles").isNotNull())
    # Equal sets have equal columns; one row of each is taken by the smallest doc_id.
    one = held.groupBy("node").agg(F.min(F.struct("doc_id", "n", "own", "entries")).alias("r"))
    nodes = one.select("node", "r.doc_id", "r.n", "r.own", "r.entries")
    entries = nodes.select("node", "n", "own", F.posexplode("entries").alias("at", "entry")).withColumn("at", F.col("at") + F.col("own"))
    lists = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.col("own") / F.col("n"), "node")).alias("p"))
    index = entries.join(lists.where("members > 1").select("entry", F.col("p.node").alias("list_pivot")), "entry")
    index = common.materialize(index.select("entry", "node", "n", "at", "own", "list_pivot"), "index")
    met = index.where("node != list_pivot").groupBy("node", "n", "list_pivot").agg(F.count(F.lit(1)).alias("times"))
    first = met.groupBy("node", "n").agg(F.max(F.struct("times", F.col("list_pivot").alias("pivot"))).alias("m"))
    pairs = common.materialize(first.select(F.col("node").alias("a"), F.col("m.pivot").alias("b"), "n"), "pairs")
    # One row a node; a row's key is never null, as its doc_id may be.
    keyed = held.withColumn("key", F.xxhash64("doc_id", "mark"))
    sets = keyed.groupBy("node").agg(F.min("key").alias("key")).join(keyed.select("node", "key", "shingles"), ["node", "key"])
    answers = compare(pairs, sets)
    links = answers.where(linked(percent)).select("a", "b")
    roots = components(links)
    far = 1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    known = answers.select(F.col("a").alias("node"), F.col("b").alias("pivot"), far.alias("far"), F.col("shared").alias("met"), F.col("nb").alias("size"), "gone0", "gone1")
    # A pivot is at distance 0 of itself, unless it was compared with another.
    known = known.unionByName(known.select("pivot").distinct().join(known.select(F.col("node").alias("pivot")), "pivot", "left_anti").select(F.col("pivot").alias("node"), "pivot", F.lit(0.0).alias("far"), *(F.lit(None).cast(t).alias(c) for c, t in (("met", "int"), ("size", "int"), ("gone0", "bigint"), ("gone1", "bigint")))))
    state = index.select("node").distinct().join(roots, "node", "left").join(known, "node", "left")
    state = state.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("pivot", "node").alias("pivot"), F.coalesce("far", F.lit(0.0)).alias("far"), "met", "size", F.coalesce("gone0", F.lit(0)).alias("gone0"), F.coalesce("gone1", F.lit(0)).alias("gone1"))
    # A pivot shares with itself all but, in the bound, its own shingles.
    full = index.select("entry", "node", "n", "at", "own").join(state, "node").withColumns({"met": F.coalesce("met", F.col("n") - F.col("own")), "size": F.coalesce("size", "n")})
    several = full.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("entry")
    unsettled = full.join(several, "entry").repartition("entry").sortWithinPartitions("entry")
    found = unsettled.select("entry", "node", "n", "at", "own", "root", "pivot", "far", "met", "size", "gone0", "gone1").mapInArrow(_search(percent), "a bigint, b bigint")
    counted = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    sized = counted.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    rest = lambda n: F.ceil(n * percent / 100) - 1  # noqa: E731  shingles behind the prefix
    possible = (F.col("common") + F.greatest(rest(F.col("na")), rest(F.col("nb")))) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    more = common.materialize(sized.where(possible).select("a", "b", F.col("na").alias("n")), "pairs")
    if not more.isEmpty():
        later = compare(more, sets).where(linked(percent)).select("a", "b")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(later))
    return rows, roots


def classes(docs: DataFrame, *, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, roots = _components(docs, width, percent)
    # The smallest doc_id of each node, then of each component
    least = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(component, "root").select("node", "component_id")
    out = rows.select("doc_id", "n", "node").join(by_node, "node", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def spare(docs: DataFrame, *, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id and mark of the rows beside which their component has another to stay, and `times`: 0.

    Of a component the row stays that has the smallest doc_id (a null one only if all are),
    of rows with one doc_id the one with the smallest mark. Where several rows have the
    doc_id and the mark of one that stays, `times` is their number.
    """
    rows, roots = _components(docs, width, percent)
    linked_ = rows.where(F.col("node").isNotNull()).groupBy("node", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    least = linked_.groupBy("node").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("different"), F.max("times").alias("times"))
    named = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = named.groupBy("root").agg(F.min("o").alias("stays"), F.count(F.lit(1)).alias("nodes"), F.max("different").alias("different"), F.max("times").alias("times"))
    # Most rows are alone in their component; only the others go through the joins.
    several = component.where("nodes > 1 or different > 1 or times > 1").select("root", "stays")
    of_node = named.join(several, "root").select("node", "stays")
    state = linked_.join(of_node, "node").withColumn("times", F.when(order.eqNullSafe(F.col("stays")), F.col("times")).otherwise(F.lit(0)))
    return state.where("times != 1").select("doc_id", "mark", "times")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


#: The same by brute force; words joined by blanks stand for shingles.
OP6_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
e as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join s a on a.doc_id = x join s b on b.doc_id = y where 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
both_ways as (select x, y from l union all select y, x from l),
r(doc_id, reached) as (select doc_id, doc_id from documents union select b.y, r.reached from r join both_ways b on b.x = r.doc_id)
select s.doc_id, len(s.s) as n_shingles, c.component_id from s join (select doc_id, min(reached) as component_id from r group by 1) c using (doc_id)"""
