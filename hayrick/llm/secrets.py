"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags tokens as begin, inside or outside of a secret. A token is seen by its
shape (length, digits, case, hexadecimal, entropy), by its neighbours (key words, signs
of assignment, quotes) and by features of its file; Viterbi decoding finds the best tags
of all tokens of a text. Most tokens can't be in a secret whatever their neighbours: what a
stretch around them gains at best over being outside is bounded by sums of their scores, so
the tags are worked out only where that bound is above zero, with the same result.

Weights are learned by maximum likelihood from the patterns' own finds and from changed
copies of them: the key word replaced by an ordinary word, the assignment left out, the
value replaced by random ones of other shapes and alphabets. Windows of prose, and key words
before prose, are what isn't a secret. So the field also finds values that no pattern
describes. Its finds are added as kind "crf" where they touch no pattern's find; those
always stay.

Training is bounded: the `most` documents that may have finds and the `most` documents of
all that have the smallest hash of their id; each gives up to `EACH` windows of a few dozen
tokens, cut out where the texts are. The patterns, the decoding and the redaction read all
texts whole.

Positions are code points, ends exclusive.

Defined cases: null and empty texts have no spans; very long texts are scanned whole;
repeated rows give repeated results; an empty table gives no rows, and one without any
find in its sample adds no spans; other columns are kept, and a column named `spans` is
replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from hayrick.llm import common

# The patterns that the base finds come from.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

KEYWORD = re.compile(r"(?ai:pass(?:word|wd)|secret|token|api_?key)")
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[^\W\d_]+|[^\sA-Za-z0-9+/_.-]")
REACH, EACH = 64, 2
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end), ordered by start, then kind.

    Access and hex finds are maximal runs, so asking for the least length in the pattern
    drops just the matches that are too short. An assignment that is too short still hides
    what it covers, so its length is looked at afterwards.
    """
    out = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


SHAPE = 18


def shape(token: str) -> tuple[int, ...]:
    """Numbers of the binary features that a token has by itself."""
    n = len(token)
    word = token.isalpha()
    digits = 0 if word else sum(map(str.isdigit, token))
    letters = n if word else sum(map(str.isalpha, token))
    out = [0, 1 + (n > 3) + (n > 5) + (n > 9) + (n > 19) + (n > 31)]  # 1 to 6
    if digits:
        out.append(7)
        if digits * 10 >= n * 3:
            out.append(8)
        if letters:
            out.append(9)
            if re.fullmatch(r"[0-9a-f]+", token):
                out.append(10)
            if re.fullmatch(r"[0-9A-Z]+", token):
                out.append(11)
    if not token.islower() and re.search(r"[a-z][A-Z]", token):
        out.append(12)
    if not digits and not letters:
        out.append(13)
    if n >= 8 and len(set(token)) >= 8:  # fewer characters can't reach 3 bits
        entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
        if entropy >= 3:
            out.append(14)
        if entropy >= 3.6:
            out.append(15)
    if n > 9 and digits == n:
        out.append(16)
    if not word and re.search(r"[/.+]", token):
        out.append(17)
    return tuple(out)


def role(token: str) -> int:
    """1 a key word, 2 a sign of assignment, 3 a quote, 0 another."""
    if token in "=:":
        return 2
    if token in "\"'`":
        return 3
    return 1 if len(token) > 4 and KEYWORD.search(token) else 0


CONTEXT = ((-1, 1), (-1, 2), (-1, 3), (-2, 1), (-2, 2), (-3, 1), (0, 1), (1, 2), (1, 3))
FILE = SHAPE + len(CONTEXT)
FEATURES = FILE + 2


def features(tokens: list[str], file: tuple[int, ...]) -> np.ndarray:
    x = np.zeros((len(tokens), FEATURES))
    roles = [0, 0, 0, *map(role, tokens), 0]
    for i, t in enumerate(tokens):
        x[i, list(shape(t))] = 1
        for k, (by, what) in enumerate(CONTEXT):
            if roles[i + 3 + by] == what:
                x[i, SHAPE + k] = 1
    for k in file:
        x[:, FILE + k] = 1
    return x


def file_features(text: str) -> tuple[int, ...]:
    digits = sum(text.count(c) for c in "0123456789")
    return tuple(k for k, on in enumerate((digits * 50 > len(text), bool(KEYWORD.search(text)))) if on)


class Field:
    """Weights of features and transitions, for the tags outside, begin and inside."""

    def __init__(self, weights: np.ndarray | None, moves: np.ndarray | None):
        self.weights, self.moves = weights, moves  # moves[3] is how a text starts
        self.known: dict[str, int] = {}  # a worker's tokens, with their roles and scores by shape
        self.roles, self.scores = np.zeros(0, np.int8), np.zeros((0, 3))
        self.by_shape: dict[tuple[int, ...], np.ndarray] = {}

    def __getstate__(self) -> tuple:
        return self.weights, self.moves

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _ids(self, tokens: list[str], most: int = 100_000) -> np.ndarray:
        known = self.known
        if len(known) > most:
            known.clear()
            self.roles, self.scores = self.roles[:0], self.scores[:0]
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if new:
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            if first + len(new) > len(self.roles):
                size = 2 * (first + len(new))
                self.roles, self.scores = np.resize(self.roles, size), np.resize(self.scores, (size, 3))
            self.roles[first : first + len(new)] = [role(t) for t in new]
            self.scores[first : first + len(new)] = [self._score(shape(t)) for t in new]
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def _score(self, shape: tuple[int, ...]) -> np.ndarray:
        """There are far fewer shapes than tokens."""
        found = self.by_shape.get(shape)
        if found is None:
            found = self.by_shape[shape] = self.weights[:, list(shape)].sum(1)
        return found

    def emissions(self, tokens: list[str], file: tuple[int, ...]) -> np.ndarray:
        """As features(tokens, file) @ weights.T, by way of the tokens' own scores."""
        ids = self._ids(tokens)
        out, n = self.scores[ids] + self.weights[:, [FILE + k for k in file]].sum(1), len(ids)
        special = self.roles[ids]
        for k, (by, what) in enumerate(CONTEXT):
            spots = np.flatnonzero(special == what) - by
            spots = spots[(spots >= 0) & (spots < n)]
            out[spots] += self.weights[:, SHAPE + k]
        return out

    def viterbi(self, emit: np.ndarray, before: int = 3, ends: bool = True) -> np.ndarray:
        """The best tags; `before` is the tag before (3: none), and without `ends` an outside token follows."""
        best, back = emit[0] + self.moves[before], np.zeros((len(emit), 3), np.int8)
        for i in range(1, len(emit)):
            ways = best[:, None] + self.moves[:3]
            back[i] = ways.argmax(0)
            best = ways.max(0) + emit[i]
        tags = np.empty(len(emit), np.int8)
        tags[-1] = (best if ends else best + self.moves[:3, OUT]).argmax()
        for i in range(len(emit) - 1, 0, -1):
            tags[i - 1] = back[i, tags[i]]
        return tags

    def stretches(self, emit: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens outside of which every token's best tag is outside.

        A stretch of other tags gains at most the sum of its tokens' bounds, and the gain of
        leaving it, over being outside; a token counts if some stretch that holds it can gain.
        """
        moves = self.moves[:3] - self.moves[OUT, OUT]
        start = self.moves[3] - self.moves[3, OUT]
        begin = emit[:, BEGIN] - emit[:, OUT] + max(moves[:, BEGIN].max(), start[BEGIN])
        inside = emit[:, INSIDE] - emit[:, OUT] + moves[BEGIN:, INSIDE].max()
        bound = np.maximum(begin, inside)
        leave = max(0.0, moves[BEGIN, OUT], moves[INSIDE, OUT]) + 1e-6
        if bound.max() + leave <= 0 or np.maximum(bound, 0).sum() + leave <= 0:
            return []
        total = np.concatenate([[0.0], np.cumsum(bound)])
        from_left = total[1:] - np.minimum.accumulate(total[:-1])
        from_right = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        warm = from_left + from_right - bound + leave > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], warm.astype(np.int8), [0]])))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

    def tags(self, emit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(emit), np.int8)
        for a, b in self.stretches(emit):
            out[a:b] = self.viterbi(emit[a:b], OUT if a else 3, b == len(emit))
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        tokens = TOKEN.findall(text) if self.weights is not None else []
        if not tokens:
            return out
        tags = self.tags(self.emissions(tokens, file_features(text)))
        if not tags.any():
            return out
        for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
            if tag == BEGIN:
                out.append((m.start(), m.end()))
            elif tag == INSIDE and out:
                out[-1] = (out[-1][0], m.end())
        return out


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], *, steps: int = 60, rate: float = 0.2, ridge: float = 1e-3, longest: int = 64) -> Field:
    """Maximum likelihood by Adam; the sequences are cut at `longest` tokens and padded."""
    parts = [(x[a : a + longest], y[a : a + longest]) for x, y in sequences for a in range(0, len(y), longest)]
    if not any((y == BEGIN).any() for _, y in parts):
        return Field(None, None)
    s, length = len(parts), max(len(y) for _, y in parts)
    x, y, real = np.zeros((s, length, FEATURES)), np.zeros((s, length), int), np.zeros((s, length), bool)
    for i, (a, b) in enumerate(parts):
        x[i, : len(b)], y[i, : len(b)], real[i, : len(b)] = a, b, True
    one = np.eye(3)[y] * real[..., None]
    flat = x.reshape(-1, FEATURES)
    counts_w = one.reshape(-1, 3).T @ flat
    counts_m = np.zeros((4, 3))
    counts_m[:3] = np.einsum("slt,slu->tu", one[:, :-1], one[:, 1:])
    counts_m[3] = one[:, 0].sum(0)
    allowed = np.zeros((4, 3))
    allowed[[OUT, 3], INSIDE] = -50  # nothing inside without a begin
    w, m = np.zeros((3, FEATURES)), np.zeros((4, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    for step in range(1, steps + 1):
        emit, moves = (flat @ w.T).reshape(s, length, 3), m + allowed
        # Forward and backward with scaled probabilities; padding passes the last ones on.
        e = np.exp(emit - emit.max(2, keepdims=True))
        go, scale = np.exp(moves[:3]), np.ones((s, length, 1))
        ahead, behind = np.empty((s, length, 3)), np.ones((s, length, 3))
        now = np.exp(moves[3]) * e[:, 0]
        for i in range(length):
            if i:
                now = np.where(real[:, i, None], (ahead[:, i - 1] @ go) * e[:, i], ahead[:, i - 1])
            scale[:, i] = now.sum(1, keepdims=True)
            ahead[:, i] = now / scale[:, i]
        for i in range(length - 2, -1, -1):
            behind[:, i] = np.where(real[:, i + 1, None], (e[:, i + 1] * behind[:, i + 1]) @ go.T / scale[:, i + 1], 1)
        p = ahead * behind * real[..., None]
        pair = ahead[:, :-1, :, None] * go * (e * behind / scale)[:, 1:, None, :] * real[:, 1:, None, None]
        gw = counts_w - p.reshape(-1, 3).T @ flat - ridge * s * w
        gm = counts_m - np.concatenate([pair.sum((0, 1)), p[:, 0].sum(0)[None]]) - ridge * s * m
        for value, g, k in ((w, gw, 0), (m, gm, 2)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
            value += rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(w, m + allowed)


def sequence(text: str, values: list[tuple[int, int]], file: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of a window whose secret values are given."""
    found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    tags, last = [], None
    for a, b, _ in found:
        mine = next((v for v in values if a < v[1] and v[0] < b), None)
        tags.append(OUT if mine is None else INSIDE if mine == last else BEGIN)
        last = mine
    return features([t for _, _, t in found], file), np.array(tags, int)


def windows(text: str) -> list[tuple[str, int, int, int]]:
    """Up to EACH windows of finds and as many of prose: the text around, where the find and its value begin, and the value's end (-1 in prose)."""
    finds, out = [f for f in base_spans(text) if f[4] - f[3] <= 256], []
    finds = [finds[k * len(finds) // EACH] for k in range(EACH)] if len(finds) > EACH else finds
    for start, _, end, a, b in finds:
        lo, hi = max(0, start - REACH), min(len(text), end + REACH)
        lo = lo and (text.find(" ", lo, start) + 1 or start)
        out.append((text[lo:hi], start - lo, a - lo, b - lo))
    for k in range(EACH if len(text) > 3 * REACH else 1):
        lo = k * max(0, len(text) - 2 * REACH) // max(1, EACH - 1)
        lo = lo and (text.find(" ", lo, lo + REACH) + 1 or lo)
        if all(b < lo or lo + 2 * REACH < a for a, _, b, _, _ in base_spans(text[max(0, lo - 300) : lo + 2 * REACH + 300])):
            out.append((text[lo : lo + 2 * REACH], -1, -1, -1))
    return out


#: Alphabets of made-up values, and their shortest and longest.
MADE = (
    ("0123456789abcdef", 18, 64),
    ("0123456789ABCDEF", 18, 48),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 32),
    ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 48),
    ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 20, 64),
    ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", 20, 48),
)


def made_up(rng: np.random.Generator) -> str:
    letters, low, high = MADE[rng.integers(len(MADE))]
    while True:
        value = "".join(letters[k] for k in rng.integers(len(letters), size=rng.integers(low, high + 1)))
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            return value


def examples(window: tuple[str, int, int, int], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """A window of a find as it is and changed; of prose as it is, and with a key word in it."""
    text, start, a, b = window
    prose = [w for w in re.findall(r"[^\W\d_]{2,}", text) if not KEYWORD.search(w)]
    word = prose[rng.integers(len(prose))] if prose else "value"
    keys = ("token", "secret", "password", "api_key")
    files = [tuple(k for k in (0, 1) if rng.random() < 0.3) for _ in range(4)]
    if a < 0:
        at = text.find(" ", len(text) // 2) + 1
        return [sequence(text, [], files[0]), sequence(f"{text[:at]}{keys[rng.integers(4)]} {text[at:]}", [], files[1])]
    head, key, value, tail = text[:start], text[start:a], text[a:b], text[b:]
    out = [sequence(text, [(a, b)], file_features(text))]
    unnamed = re.sub(KEYWORD, word, key)
    for k, (before, inner) in enumerate(((key, made_up(rng)), (unnamed, made_up(rng)), ("", made_up(rng)))):
        at = len(head) + len(before)
        out.append(sequence(head + before + inner + (tail if before else re.sub(r"^[\"']", "", tail)), [(at, at + len(inner))], files[k + 1]))
    if len(value) >= 16:
        out.append(sequence(head + unnamed + value + tail, [(len(head) + len(unnamed), len(head) + len(unnamed) + len(value))], files[0]))
    return out


def suspects(text: Column) -> Column:
    """Texts in which a pattern may find something (a filter for the training sample only)."""
    return text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]") | text.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [w for t in batch.column(0).to_pylist() for w in windows(t)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["text", "start", "a", "b"])


def train(docs: DataFrame, *, most: int = 300) -> Field:
    """Learn from windows of at most `most` documents that may have finds and as many of all."""
    text = common.whole_text()
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    # Only ids are sorted and sent; at most twice `most` of them are broadcast to fetch windows.
    found = docs.where(suspects(text)).select("doc_id").orderBy(rank, "doc_id").limit(most)
    others = docs.select("doc_id").orderBy(rank, "doc_id").limit(most)
    ids = F.broadcast(found.union(others).distinct())
    drawn = docs.select("doc_id", text.alias("text")).join(ids, "doc_id").select("text")
    rows = drawn.mapInArrow(_windows, "text string, start int, a int, b int").orderBy(F.xxhash64("text"), "text", "a").limit(4 * EACH * most).collect()
    rng, sequences = np.random.default_rng(1), []
    for r in rows:
        sequences += examples((r["text"], r["start"], r["a"], r["b"]), rng)
    return fit_field(sequences)


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def spans_of(text: str, field: Field) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    out = [(a, kind, b) for a, kind, b, _, _ in base]
    for a, b in field.spans(text):
        if all(b <= s or e <= a for s, _, e, _, _ in base):
            out.append((a, 3, b))
    return [(KINDS[kind], a, b) for a, kind, b in sorted(out)]


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """docs with `spans`: kind, start and end, ordered by start, then kind."""
    docs = docs.drop("spans")
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t.as_py() or "", field)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "spans"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("spans", SPANS)]))


def redact(docs: DataFrame, field: Field, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` replaced by `mark`; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        parts, at = [], 0
        for _, a, b in spans_of(text, shared.value):
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array((clean(t.as_py()) for t in batch.column(k)), batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf"))
