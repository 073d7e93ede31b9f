"""SimHash against a brute-force version: pure Python fingerprints, all pairs, union-find."""

import random
import re

import numpy as np
import pytest
import xxhash

from rooftally.llm import simhash

SCHEMA = "doc_id long, text string, fp string, id string"


def brute(rows, k=4, radius=4):
    def fp(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not words:
            return 0
        shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            low[r] = min(doc, low.get(r, doc))
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in simhash.near_duplicates(df, "doc_id", "text", **kw).collect()), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Ärger", "of", "stone", "RIVER", "blue", "ñandú", "wind", "q"] + [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 40, 200]))))
    return out


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(150, 1)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "lone text of a null id"), (5, rows[5][1]), (5, rows[5][1]), (903, "a" * 200_000), (904, "long text " * 20_000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_large_entries_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        root[find(a)] = find(b)
    want = {f: f for f in signed}

    def seek(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                want[seek(a)] = seek(b)
    classes = lambda f: sorted(sorted(y for y in signed if f(y) == r) for r in {f(x) for x in signed})
    assert classes(find) == classes(seek)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(9)])
    group = np.sort(rng.integers(0, 3, len(fps)))
    found = {(int(i), int(j)) for a, b in simhash.links_of(fps, group, radius) for i, j in zip(a, b)}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert found == want


def test_masks_cover_every_pair():
    for radius, m in ((4, 6), (4, 7), (2, 4)):
        rng = random.Random(m)
        for _ in range(200):
            d = sum({1 << rng.randrange(64) for _ in range(radius)})
            assert any(d & mask == 0 for mask in simhash.masks(radius, m))
