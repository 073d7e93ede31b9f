"""The audit of sources against dense sums over all terms of hand-made rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from rooftally.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, P long"


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    found = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))) for text, lang, source in rows]
    docs = defaultdict(Counter)
    for lang, _, words in found:
        docs[lang].update(set(words))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        count = defaultdict(Counter)
        for _, source, words in (x for x in found if x[0] == lang):
            own = Counter(w for w in words if docs[lang][w] >= least)
            count[source].update(own)
            count[None].update(own)
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in count.items()}
        for s in count.keys() - {None}:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in count.keys() - {None, s}]
            term = [(t, p[s][t] - p[None][t]) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def made(seed, n=260, sources=9):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "É", "éa", "日本語", "日本", "x" * 70, "x" * 71, "Z", "zz", "zzzzz", "naïve", *[f"w{'q' * i}" for i in range(30)]]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "one"])
        text = rng.choice([" ", "-", "7", "_", "\n"]).join(rng.choice(words[rng.randrange(len(words)) :]) for _ in range(rng.randrange(12)))
        rows.append((None if i % 40 == 0 else text, lang, "only" if lang == "one" else rng.choice([None, "", *[f"s{k}" for k in range(sources)]])))
    return rows + rows[:5] + [("", "no terms", "a"), (None, "no terms", "b"), ("rare words here", "no terms", "c"), ("123", "de", "without terms")]


@pytest.mark.parametrize("limits", [{}, {"SOURCES": 3, "CELLS": 40, "BLOCKS": 2}, {"BROADCAST_KEYS": 0, "FIRST": 2, "HELD": 200}])
def test_equals_dense_sums(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rows = made(len(limits))
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in divergence.audit(df, "text", "lang", "source", 6, 5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, 6, 5)
    assert any(r[0] == "no terms" and r[4] == 0 for r in got) and any(r[2] == "term" and r[5] == 5 for r in got)


def test_no_rows_give_none(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA), "text", "lang", "source").count() == 0


def test_refinement_keeps_complete_terms_alone(spark):
    rows = [("abcdefgh abcdefghij", "x"), ("abcdefgh", "x"), ("abcdefghij abcdefgh abcdefgh", "x"), ("abcdefghkk", "x")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = divergence.frequent_terms(docs, "lang", 2)
    assert sorted((t, n) for _, t, n in got.select("lang", divergence.spelled(got.term), "n").collect()) == [("abcdefgh", 3), ("abcdefghij", 2)]
    huge = spark.createDataFrame([("y" * 300_000, "x"), ("y" * 300_000 + " z", "x")], "text string, lang string")
    assert [len(r.term) for r in divergence.frequent_terms(huge, "lang", 2).collect()] == [300_001]
