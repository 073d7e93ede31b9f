"""SimHash near-duplicates: fingerprints of word shingles, bit-sliced comparison, components.

Two fingerprints of 64 bits that differ in at most r of them agree on m - r of m segments
at least, whatever the m. So each distinct fingerprint is listed under every choice of
m - r segments, and only fingerprints under the same entry are compared; m is the smallest
that leaves few strangers under an entry.

Entries are compared in sorted runs, bit-sliced: plane b holds bit b of all rows of a run,
64 rows to a word. For each distance d in the run, plane XOR plane-moved-by-d gives the
differing bits of all pairs (i, i + d) at once; they're added with carry-save counters, and
words of 64 pairs that are all above the radius are abandoned. Links leave a run as a
spanning forest, never as all pairs. Entries of more than ``2 * BLOCK`` fingerprints are cut
into blocks. First each block is compared with itself. An entry whose fingerprints are all in
one component by then has nothing to add, as in a large group of near copies; in the others
each two blocks meet in one task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rooftally.functions.session import cut
from rooftally.llm.text import BROADCAST_KEYS, fresh, join_skewed, without
from rooftally.operators.graph import components

#: Fingerprints of a block of a large entry.
BLOCK = 1024
#: Rows of the table of large entries up to which it is broadcast.
BROADCAST_ENTRIES = 20_000
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, k: int = 4) -> int:
    """Unsigned; 0 without words. Words are cut at ASCII white space, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    ids = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {ids}, fp bigint")


def segments_for(n: int, radius: int) -> int:
    """Segments so that an entry has some 32 of n random fingerprints at most."""
    m = radius + 2
    while m < 64 and n / 2 ** (64 * (m - radius) / m) > 32:
        m += 1
    return m


def masks(radius: int, m: int) -> list[int]:
    edges = [64 * i // m for i in range(m + 1)]
    parts = [sum(1 << b for b in range(i, j)) for i, j in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane b is bit b of row 64 * w + i; one spare word of zeros."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 8), np.uint8)
    bits[: len(fps)] = fps.view(np.uint8).reshape(-1, 8)
    flat = np.unpackbits(bits, axis=1, bitorder="little").T  # 64 x rows
    packed = np.ascontiguousarray(np.packbits(flat, axis=1, bitorder="little")).view(np.uint64)
    return np.concatenate([packed, np.zeros((64, 1), np.uint64)], axis=1)


def _moved(planes: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """The given words of each plane, taken d rows further on."""
    w, s = words + d // 64, np.uint64(d % 64)
    last = planes.shape[1] - 1
    low = planes[:, np.minimum(w, last)]
    return low if not s else (low >> s) | (planes[:, np.minimum(w + 1, last)] << (np.uint64(64) - s))


def links_of(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of pairs of the same group within the radius, by growing j - i. Rows of a group are neighbours."""
    n = len(fps)
    if n < 2:
        return
    planes = _planes(fps)
    size = np.bincount(group)[group]
    ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True])))
    left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(n)  # rows of the group after this one
    words = -(-n // 64)
    levels = radius.bit_length() + 1
    for d in range(1, int(size.max())):
        fits = np.zeros(words * 64, bool)
        fits[:n] = left >= d
        alive = np.packbits(fits, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        if not len(at):
            return
        alive = alive[at]
        # counters start so that passing the radius carries out of the top level
        start = (1 << levels) - 1 - radius
        count = [np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> j & 1 else np.uint64(0)) for j in range(levels)]
        for first in range(0, 64, 8):
            rows = planes[first : first + 8]
            differ = rows[:, at] ^ _moved(rows, at, d)
            for carry in differ:
                for j in range(levels):
                    count[j], carry = count[j] ^ carry, count[j] & carry
                alive = alive & ~carry
            keep = alive != 0
            if not keep.all():
                at, alive, count = at[keep], alive[keep], [c[keep] for c in count]
                if not len(at):
                    break
        if len(at):
            bits = np.unpackbits(np.ascontiguousarray(alive).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(bits)
            i = at[w] * 64 + b
            yield i, i + d


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest row that it reaches) of the rows that have a link. Pairs are folded in as they come."""
    label = np.arange(n)

    def fold(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                return
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    held, many = [], 0
    for i, j in pairs:
        held.append((i, j))
        many += len(i)
        if many > 1 << 18:
            fold(*map(np.concatenate, zip(*held)))
            held, many = [], 0
    if held:
        fold(*map(np.concatenate, zip(*held)))
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).any(axis=1))))  # a split entry is met under several keys
            rows, roots = forest(len(fps), links_of(fps.view(np.uint64), group, radius))
            return pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(fps[roots])], ["a", "b"])

        key, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            key, fps = np.concatenate([key, new]), np.concatenate([fps, batch.column(3).to_numpy()])
            last = np.flatnonzero((key != key[-1]).any(axis=1)) if len(key) else []
            if len(last) and len(fps) >= 1 << 16:  # whole entries; the one at the end may go on
                to = int(last[-1]) + 1
                yield done(key[:to], fps[:to])
                key, fps = key[to:], fps[to:]
        if len(fps):
            yield done(key, fps)

    return run


def links(fps: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """fps: distinct ``fp`` (long). (a, b): links that join all that are within the radius, as a forest per entry."""
    n = fps.count() if n is None else n
    every = masks(radius, segments_for(n, radius))
    listed = fps.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in every])).alias("t", "mask"))
    listed = listed.select(F.col("t").cast("long").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    large = listed.groupBy("t", "key").count().where(F.col("count") > 2 * BLOCK).select(F.col("t"), F.col("key"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")).persist()
    many = large.count()
    hint = F.broadcast if many <= BROADCAST_ENTRIES else lambda x: x
    dealt = listed.join(hint(large), ["t", "key"], "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))
    found = _compared(dealt.select("t", "key", F.coalesce(mine, F.lit(0)).cast("long").alias("meet"), "fp"), radius)
    if not many:
        return found
    found = cut(found)
    labels = components(found, "a", "b").withColumnRenamed("node", "fp")
    inside = listed.join(hint(large), ["t", "key"]).join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_ = inside.groupBy("t", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("t", "key").persist()
    hint = F.broadcast if open_.count() <= BROADCAST_ENTRIES else lambda x: x
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != mine)
    meets = F.transform(others, lambda o: F.least(o.cast("long"), mine) * F.col("blocks") + F.greatest(o.cast("long"), mine))
    left = inside.join(hint(open_), ["t", "key"], "left_semi").select("t", "key", F.explode(meets).alias("meet"), "fp")
    return found.unionByName(_compared(left, radius))


def _compared(dealt: DataFrame, radius: int) -> DataFrame:
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "t", "key", "meet").sortWithinPartitions("t", "key", "meet", "fp").mapInArrow(_compare(radius), "a bigint, b bigint")


def lowest_of(distinct: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """``distinct`` (fp, low, …) with the least ``low`` of the component in place of its own, under the names of ``low``'s fields, if it has any.

    labels: (node, label) of the fingerprints with a link; the others are on their own. A component of a third of
    all fingerprints is one row of what is joined: it is broadcast while counted short, else dealt out in copies by salt.
    """
    linked = cut(labels.withColumnRenamed("node", "fp").join(distinct, "fp"))
    least = linked.groupBy("label").agg(F.min("low").alias("least"))
    if least.count() <= BROADCAST_KEYS:
        told = linked.join(F.broadcast(least), "label")
    else:
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        told = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(32)).cast("int")).join(salted, ["label", "salt"])
    lone = distinct.join(labels, F.col("fp") == F.col("node"), "left_anti").withColumn("least", F.col("low"))
    rest = [c for c in distinct.columns if c not in ("fp", "low")]
    rows = told.select("fp", "least", *rest, F.lit(True).alias("linked")).unionByName(lone.select("fp", "least", *rest, F.lit(False).alias("linked")))
    return rows.select("fp", *([F.col("least").alias(names[0])] if len(names) == 1 else [F.col(f"least.{x}").alias(x) for x in names]), *rest, "linked")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Ids that are null never name a component unless no other id is in it. Copies and
    repeated rows have one fingerprint and so one component. Null, empty and blank texts
    have fingerprint 0, linked like any other. An empty table gives no rows. Only id and text
    are read, so other columns can't clash.
    """
    rows = fingerprints(df, id_col, text_col, k).persist()
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    labels = components(links(distinct.select("fp"), radius, distinct.count()), "a", "b")
    named = cut(lowest_of(distinct, labels, ["component_id"]).drop("linked"))
    return join_skewed(rows, named, "fp", "n").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(df: DataFrame, id_col: str, text_col: str, k: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with one row of each component, as `one_of_each` chooses it."""
    both = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    rows = cut(fingerprints(df.select(both.alias("both"), F.col(text_col).alias("text")), "both", "text", k).select("id.id", "id.text_hash", "fp"))
    distinct = cut(rows.select("fp").distinct())
    return one_of_each(df, rows, components(links(distinct, radius, distinct.count()), "a", "b"), id_col, text_col)


def one_of_each(df: DataFrame, rows: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with one row of each component: of those with the smallest id, the one of the smallest text hash.

    rows: (id, text_hash, fp) of each row of ``df``; labels: (node, label) of the fps with a link. A null id is
    larger than all others, so it stays only where a component has nothing else, once. A row is told by id and
    text, so a text stays though its id is met elsewhere with another one; rows that repeat both stay once.
    ``df`` may have any columns; an empty one gives no rows.
    """
    who = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("text_hash"))
    distinct = cut(rows.groupBy("fp").agg(F.min(who).alias("low"), F.count("*").alias("n")))
    named = lowest_of(distinct, labels, ["nameless", "id", "text_hash"]).where("n > 1 or linked")
    several = named.select("fp", F.col("id").alias("first_id"), F.col("text_hash").alias("first_hash"), "n")
    met = cut(join_skewed(rows, cut(several), "fp", "n").withColumn("stays", F.col("id").eqNullSafe(F.col("first_id")) & F.col("text_hash").eqNullSafe(F.col("first_hash"))))
    kept = without(df, met.where("not stays").select("id", "text_hash").distinct(), [df[id_col], F.xxhash64(df[text_col])])
    again = met.where("stays").groupBy("id", "text_hash").count().where("count > 1").select("id", "text_hash").persist()
    if again.isEmpty():
        return kept
    a, b = fresh(df.columns, "_id", "_hash")
    same = kept[id_col].eqNullSafe(F.col(a)) & F.xxhash64(kept[text_col]).eqNullSafe(F.col(b))
    keys = again.toDF(a, b)
    return without(kept, again, [kept[id_col], F.xxhash64(kept[text_col])]).unionByName(kept.join(keys, same, "left_semi").dropDuplicates([id_col, text_col]))
