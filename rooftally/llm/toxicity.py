"""Toxicity by a convolutional classifier over hashed words, with a threshold for each language.

A word has four embedding numbers, from digests of itself, of its first four and five bytes
and of its last four: words that share one still differ, and inflected forms are alike.
Filters of one to three words are maximised over the whole text. On a part of the training
rows, a threshold is fitted for each language; a score is the distance to that threshold, so
that 0.5 decides alike in all languages. What language a text has, its own words show: of the
words that many training texts of a language have, those that are rare in the others are its marks.
The language column names the texts that marks are learned from and is never read in scoring.
Null and empty texts are texts without words.

Training takes every labelled row, whole. Rows are dealt into shards by their id. In each of some rounds all shards go on
from the same net, on their own, and the changes are averaged: a weight's over all shards, an embedding's over those that changed it. Changes are whole
numbers of 2 ** -32, so their sums don't depend on the order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.functions.session import drop
from rooftally.llm import convnet
from rooftally.llm.text import BROADCAST_KEYS, cut, lean

#: The net, the marks of each language and the thresholds: one a language and one for texts that show none.
Model = tuple[convnet.Net, list[frozenset[bytes]], np.ndarray]
NUMBERS = 1 << 15
WIDTHS = (1, 2, 3)
#: Labelled rows of a shard, about; rounds of training, and times that a shard goes through its rows in each.
SHARD, ROUNDS, EPOCHS = 2_000, 3, 2
#: Files that shards are written to, at most; parts that embeddings are summed in; margins of a whole number, as thresholds tell them apart.
FILES, PARTS, STEPS = 2_000, 16, 1_000
WORDS = 300_000
#: Marks of a language, at most; the least share of its training texts that has one; training texts that a language needs to have marks.
MARKS = 40
SPREAD = 0.15
LEAST_TEXTS = 20
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def marks(texts: list[set[bytes]], languages: list[str | None]) -> list[frozenset[bytes]]:
    """Language by language, in order of their names, the words that tell it: in many of its texts, in few of any other's."""
    of = {x: n for x, n in Counter(x for x in languages if x is not None).items() if n >= LEAST_TEXTS}
    held: dict[str, Counter] = {x: Counter() for x in of}
    for words, x in zip(texts, languages):
        if x in of:
            held[x].update(words)
    return marks_of(held, of)


def marks_of(held: dict[str, Counter], of: dict[str, int]) -> list[frozenset[bytes]]:
    """`marks` of counts. of: texts of each language; held: how many of them have a word."""
    out = []
    for x in sorted(of):
        told = []
        for w, n in held.get(x, {}).items():
            share = n / of[x]
            other = max((held[y][w] / of[y] for y in of if y != x and y in held), default=0.0)
            if share >= SPREAD and share > 3 * other:
                told.append((other - share, w))
        out.append(frozenset(w for _, w in sorted(told)[:MARKS]))
    return out


class Words:
    """Texts to embedding numbers, and the number of the language that their marks show; the number of languages if none does."""

    def __init__(self, marks: list[frozenset[bytes]]):
        self.memo: dict[bytes, int] = {}
        self.sets = marks

    def __call__(self, text: str | None) -> tuple[np.ndarray, int]:
        words = words_of(text)
        if len(self.memo) > WORDS:
            self.memo = {}
        memo, distinct = self.memo, set(words)
        for w in distinct.difference(memo):
            packed = 0
            for k, part in enumerate((w, w[:4], w[:5], w[-4:])):
                packed = packed << 15 | zlib.crc32(part, k) % NUMBERS
            memo[w] = packed
        packed = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        votes = [len(distinct & s) for s in self.sets]
        best = max(votes, default=0)
        return np.stack([packed >> k & NUMBERS - 1 for k in (45, 30, 15, 0)], axis=1).astype(np.int32), votes.index(best) if best else len(self.sets)


def margins(net: convnet.Net, texts: list[np.ndarray]) -> np.ndarray:
    """Logit of class 1 over class 0; long texts are cut into overlapping runs, whose maxima are joined."""
    out, held, size = [], [], 0
    widest, run = max(net.widths), 1 << 14

    def flush() -> None:
        parts, of = [], []
        for i, t in enumerate(held):
            for at in range(0, max(1, len(t)), run):
                parts.append(t[at : at + run + widest - 1])
                of.append(i)
        pooled = net.pooled(*convnet.layout(parts, widest, NUMBERS))
        first = np.flatnonzero(np.diff(of, prepend=-1))
        z = np.maximum.reduceat(pooled, first, axis=0) @ net.out + net.out_bias
        out.extend((z[:, 1] - z[:, 0]).tolist())
        held.clear()

    for t in texts:
        held.append(t)
        size += len(t)
        if size > run:
            flush()
            size = 0
    if held:
        flush()
    return np.array(out)


def thresholds(counted: list[tuple[int, float, int, int]], languages: int, least: int = 20) -> np.ndarray:
    """For each language number, of the cuts with the fewest errors the one nearest to the net's own 0.

    counted: (language number, margin, rows of class 0, rows of class 1). Where a class has under ``least`` rows in a language, the cut of all rows serves.
    """

    def cut(m: np.ndarray, zero: np.ndarray, one: np.ndarray) -> float:
        m, back = np.unique(m, return_inverse=True)
        zero, one = np.bincount(back, zero), np.bincount(back, one)
        errors = np.concatenate(([0], np.cumsum(one))) + np.concatenate((np.cumsum(zero[::-1])[::-1], [0]))
        low, high = np.concatenate(([m[0] - 2], m)), np.concatenate((m, [m[-1] + 2]))
        best = np.flatnonzero(errors == errors.min())
        nearest = np.clip(0.0, low[best] + (high - low)[best] / 4, high[best] - (high - low)[best] / 4)
        return float(nearest[np.abs(nearest).argmin()])

    if not counted:
        return np.zeros(languages)
    language, margin, zero, one = (np.array(c) for c in zip(*counted))
    if not zero.sum() or not one.sum():
        return np.zeros(languages)
    out = np.full(languages, cut(margin, zero, one))
    for k in range(languages):
        own = language == k
        if min(one[own].sum(), zero[own].sum()) >= least:
            out[k] = cut(margin[own], zero[own], one[own])
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, lang_col: str | None = None) -> Model:
    """The net, marks and thresholds from all rows of both classes for which ``usable`` (on ``_id``) holds, and their whole texts.

    Of documents with one id, the text of the smallest digest is taken; an id with both labels counts for each. A fifth of the rows, by a digest
    of the text, is kept from training for the thresholds. Without rows of both classes the net knows nothing and every score is below 0.5. Without ``lang_col`` all texts have one threshold.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(usable & F.col("_y").isin(0, 1)).distinct()
    rows = cut(rows)
    many = rows.count()
    language = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), language.alias("_l")).where(F.col("_t").isNotNull())
    one = texts.join(F.broadcast(rows) if many <= BROADCAST_KEYS else rows, "_id").groupBy("_id", "_y").agg(F.min_by(F.struct("_t", "_l"), F.struct(F.xxhash64("_t"), "_l")).alias("r"))
    shards = max(1, -(-many // SHARD))
    one = one.select(F.pmod(F.xxhash64("_id"), F.lit(shards)).alias("_s"), F.xxhash64("r._t").alias("_o"), "r._t", "_y", F.col("r._l").alias("_l"))
    # a shard is whole in one file, in order
    one = cut(one.repartition(min(shards, FILES), "_s").sortWithinPartitions("_s", "_o", "_y"))
    spark = docs.sparkSession
    held = _held(one)
    kinds = {r["_y"]: r["n"] for r in one.where(~held).groupBy("_y").agg(F.count("*").alias("n")).collect()}
    state, _ = convnet.begin(2, NUMBERS, WIDTHS)
    if len(kinds) < 2:
        drop(one, rows)
        net = state.net()
        return convnet.Net(np.zeros_like(net.table), net.bias, np.zeros_like(net.out), np.array([1.0, -1.0], np.float32), WIDTHS, net.filters), [], np.zeros(1)
    told = _learned_marks(one) if lang_col else []
    train = one.where(~held).select("_s", "_t", "_y")
    for k in range(ROUNDS):
        _round(spark, train, state, k)
    net = state.net()
    shared = spark.sparkContext.broadcast((net, told))

    def told_margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, told = shared.value
        words, counted = Words(told), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                coded = [words(t.as_py()) for t in some.column(0)]
                for m, (_, x), y in zip(np.round(margins(net, [c for c, _ in coded]) * STEPS).astype(np.int64).tolist(), coded, some.column(1).to_pylist()):
                    counted[x, m, y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*[(*key, n) for key, n in counted.items()]) if counted else [[]] * 4)], ["x", "m", "y", "n"])

    found = one.where(held).select("_t", "_y").mapInArrow(lean(told_margins), "x long, m long, y long, n long").groupBy("x", "m")
    counted = found.agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("zero"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("one")).collect()
    shared.unpersist()
    drop(one, rows)
    return net, told, thresholds([(r.x, r.m / STEPS, r.zero, r.one) for r in counted], len(told) + 1)


def _held(rows: DataFrame) -> Column:
    """Whether a row is for thresholds, not for training."""
    return F.crc32(F.col("_t").cast("binary")) % 5 == 0


def _learned_marks(rows: DataFrame) -> list[frozenset[bytes]]:
    """The marks of the languages of all rows. What is collected are words that a sixth of some language's texts has, so it doesn't grow with the rows."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([w for _, w in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["x", "w", "n"])

        for batch in batches:
            for t, x in zip(batch.column(0), batch.column(1).to_pylist()):
                held.update([(x, w) for w in set(words_of(t.as_py()))])
                if len(held) > WORDS:
                    yield told()
                    held.clear()
        yield told()

    of = {r["_l"]: r["n"] for r in rows.where("_l is not null").groupBy("_l").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS).collect()}
    if not of:
        return []
    named = rows.where(F.col("_l").isin(list(of))).select("_t", "_l")
    share = F.create_map(*[F.lit(v) for x, n in of.items() for v in (x, float(n))])
    words = named.mapInArrow(lean(counts), "x string, w binary, n long").groupBy("w", "x").agg(F.sum("n").alias("n")).groupBy("w")
    words = words.agg(F.max(F.col("n") / share[F.col("x")]).alias("most"), F.collect_list(F.struct("x", "n")).alias("of")).where(F.col("most") >= SPREAD)
    held: dict[str, Counter] = {}
    for r in words.collect():
        for x, n in r["of"]:
            held.setdefault(x, Counter())[bytes(r["w"])] = n
    return marks_of(held, of)


def _round(spark, rows: DataFrame, state: convnet.State, k: int) -> None:
    """All shards go on from ``state``, which then takes the average of their changes."""
    shared, unit = spark.sparkContext.broadcast(state), float(1 << 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, words = shared.value, Words([])
        size = sum(x.size for x in base.values[1:])
        emb, width = base.values[0], base.values[0].shape[1]
        sums, dense, touched, trained = np.zeros((len(emb), 2 * width), np.int64), np.zeros(2 * size, np.int64), np.zeros(len(emb), np.int64), 0

        def done(shard: int, held: list) -> None:
            nonlocal trained
            own = base.copy()
            convnet.go_on(own, [t for t, _ in held], np.array([y for _, y in held], np.int64), EPOCHS, np.random.default_rng([shard, k]))
            change = lambda a, b: np.round((a.astype(np.float64) - b) * unit).astype(np.int64)
            changed = np.flatnonzero((own.seen[0] != base.seen[0]).any(axis=1))
            sums[changed] += np.concatenate([change(own.values[0][changed], emb[changed]), change(own.seen[0][changed], base.seen[0][changed])], axis=1)
            touched[changed] += 1
            dense[:] += np.concatenate([change(a, b).ravel() for x, y in ((own.values, base.values), (own.seen, base.seen)) for a, b in zip(x[1:], y[1:])])
            trained += 1

        at, held = None, []
        for batch in batches:
            for s, t, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if s != at and held:
                    done(at, held)
                    held = []
                at = s
                held.append((words(t.as_py())[0], y))
        if held:
            done(at, held)
        if trained:
            for part in range(PARTS):
                u = np.flatnonzero(touched)
                u = u[u % PARTS == part]
                yield told(part, u, touched[u], sums[u])
            yield told(PARTS, np.zeros(1, np.int64), np.array([trained]), dense[None])

    def told(part: int, u: np.ndarray, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (u, n, v)]], ["part", "u", "n", "v"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, many = 0, {}, {}
        for batch in batches:
            for p, u, n, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part, u, n = p, np.frombuffer(u, np.int64), np.frombuffer(n, np.int64)
                for i, x, row in zip(u.tolist(), n.tolist(), np.frombuffer(v, np.int64).reshape(len(u), -1) if len(u) else ()):
                    sums[i] = sums[i] + row if i in sums else row
                    many[i] = many.get(i, 0) + x
        u = np.array(sorted(sums), np.int64)
        mean = [np.round(sums[i] / many[i]).astype(np.int64) for i in u.tolist()]
        yield told(part, u, np.array([many[i] for i in u.tolist()], np.int64), np.stack(mean) if mean else np.zeros(0, np.int64))

    changes = rows.mapInArrow(lean(run), "part int, u binary, n binary, v binary")
    found = changes.groupBy("part").applyInArrow(joined, changes.schema).collect()
    shared.unpersist()
    width = state.values[0].shape[1]
    for r in found:
        u, v = np.frombuffer(r["u"], np.int64), np.frombuffer(r["v"], np.int64) / unit
        if r["part"] < PARTS:
            v = v.reshape(len(u), 2 * width)
            state.values[0][u] += v[:, :width].astype(np.float32)
            state.seen[0][u] += v[:, width:].astype(np.float32)
            continue
        at = 0
        for x in (*state.values[1:], *state.seen[1:]):
            x += v[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size


def score(docs: DataFrame, text_col: str, model: Model, carry: list[str], name: str = "score") -> DataFrame:
    """``carry`` columns and the score (0 to 1) of each row, as ``name``; 0.5 or more means toxic.

    Rows are independent: repeated ones have equal scores, an empty table gives none. ``name`` must differ from the names in ``carry``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carry, *([] if text_col in carry else [text_col]))
    at_text = rows.columns.index(text_col)
    schema = docs.select(*carry).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, told, limits = shared.value
        words = Words(told)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                coded = [words(t.as_py()) for t in some.column(at_text)]
                z = margins(net, [c for c, _ in coded]) - limits[[k for _, k in coded]]
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(carry))), pa.array(scores, pa.float64())], [*carry, name])

    return rows.mapInArrow(lean(run), schema)
