import heapq
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rooftally.llm import mixing, sharding
from rooftally.llm.text import word_count

SCHEMA = "doc_id long, text string, source string, size string, target double, weight int"


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["b", "a", "a", "a", "é", None]), "x", 0.0, 1) for i in range(n)]
    return rows + [(n, None, "a", "x", 0.0, 1), (n + 1, "", "only empty", "x", 0.0, 1), (3, "w w", "a", "x", 0.0, 1), (3, "w w", "a", "x", 0.0, 1), (None, "w " * 300, "b", "x", 0.0, 1)]


def fill(sizes, weights, epochs):
    """Clamp, share again, until nobody is above."""
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(clamped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = {s: float(sizes[s] * epochs) for s in free if share[s] >= sizes[s] * epochs}
        if not above:
            return clamped | share
        clamped |= above


def test_mix(spark):
    rows = corpus()
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), "doc_id", "source", word_count(F.col("text"))).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    taken, largest = Counter(), Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.size * r.repeats and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_mix_agrees_with_itself_and_takes_empty(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    first = sorted(map(str, mixing.mix(df, "doc_id", "source", word_count(F.col("text"))).collect()))
    assert first == sorted(map(str, mixing.mix(df.repartition(7), "doc_id", "source", word_count(F.col("text"))).collect()))
    assert mixing.mix(df.limit(0), "doc_id", "source", word_count(F.col("text"))).count() == 0
    blank = spark.createDataFrame([(1, "", "a", "x", 0.0, 1)], SCHEMA)
    assert mixing.mix(blank, "doc_id", "source", word_count(F.col("text"))).first().taken == 0


def test_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    mixed = spark.createDataFrame([(1, 0), (2, 3), (3, 1)], "id long, repeats long")
    assert sorted(r.doc_id for r in mixing.repeated(df, mixed, "doc_id").collect()) == [2, 2, 2, 3]


def test_shard(spark):
    rows = corpus(600, 1) + [(2000 + i, "same text", "a", "x", 0.0, 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard(df, "doc_id", "text").collect()
    assert len(out) == len(rows)
    by_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in out:
        t = next(x for x in texts[r.id] if len((x or "").encode()) + 1 == r.size and zlib.crc32((x or "").encode()) == r.text_crc32)
        by_text[t].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) + 1 for _, t, *_ in rows) + 3000
    assert sharding.shard(df.limit(0), "doc_id", "text").count() == 0


def test_longest_first():
    rng = random.Random(2)
    items = [(rng.randrange(1, 50), str(i)) for i in range(100)]
    plan, loads = sharding.longest_first(items, 3), [(0, s) for s in range(3)]
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(loads)
        assert plan[name] == s
        heapq.heappush(loads, (load + size, s))
