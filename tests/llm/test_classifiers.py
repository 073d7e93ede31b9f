"""Held-out accuracy and edge cases of the two classifiers, and the network against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from rooftally.llm import convnet, language, toxicity
from rooftally.llm.queries import id_crc

EDGES = [(9000, None), (9001, ""), (9002, " \n 12 !"), (9003, "word " * 40_000), (None, "an id that is null"), (9004, "same"), (9004, "same")]


def documents(n=700):
    rng = random.Random(1)
    syllables = {"en": ["th", "er", "ing", "on"], "de": ["sch", "ei", "ung", "ä"], "fr": ["eau", "oi", "é", "tion"]}
    rows, toxic = [], []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.4
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "Awful,", "nasty."]))
        rows.append((i, " ".join(words), lang))
        toxic.append((i, int(bad)))
    return rows, toxic


def test_toxicity(spark):
    rows, toxic = documents()
    docs = spark.createDataFrame([(*r, 0.1) for r in rows] + [(i, t, None, 0.1) for i, t in EDGES], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([*toxic, (9001, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", id_crc("_id", 5) != 0)
    out = toxicity.score(docs, "text", model, ["doc_id"]).withColumn("held", id_crc("doc_id", 5) == 0).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    truth = dict(toxic)
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in out if r.held and r.doc_id in truth]
    assert len(held) > 50 and np.mean(held) >= 0.95
    again = toxicity.score(docs.repartition(5), "text", toxicity.fit(docs.repartition(3), labels, "doc_id", "text", "toxic", id_crc("_id", 5) != 0), ["doc_id"]).collect()
    assert {r.doc_id: round(r.score, 5) for r in again} == {r.doc_id: round(r.score, 5) for r in out}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text", "toxic", F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(docs, "text", model, ["doc_id"]).collect())


def test_language(spark):
    rows, _ = documents()
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in EDGES], "doc_id long, text string, lang string")
    model = language.fit(docs, "text", "lang", "doc_id", id_crc("_id", 4) != 2)
    out = language.predict(docs, "text", model, ["doc_id"]).withColumn("held", id_crc("doc_id", 4) == 2).collect()
    truth = {i: x for i, _, x in rows}
    held = [r.lang_pred == truth[r.doc_id] for r in out if r.held and r.doc_id in truth]
    assert len(held) > 50 and np.mean(held) >= 0.95 and len(out) == docs.count()
    assert {r.lang_pred for r in out if r.doc_id in (9000, 9001, 9002)} == {"und"}
    none = language.fit(docs.where("lang is null"), "text", "lang", "doc_id", F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, "text", none, ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.limit(0), "text", model, ["doc_id"]).count() == 0


def random_net(numbers, widths, f, classes, seed=0):
    rng = np.random.default_rng(seed)
    table = rng.normal(size=(numbers + 1, f * sum(widths))).astype(np.float32)
    table[numbers] = 0
    return convnet.Net(table, rng.normal(size=f * len(widths)).astype(np.float32), rng.normal(size=(f * len(widths), classes)).astype(np.float32), rng.normal(size=classes).astype(np.float32), widths, f)


def test_pooling_equals_loops():
    net = random_net(50, (1, 3), 4, 2)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, (n, 2)).astype(np.int32) for n in (5, 1, 0, 30)]
    got = net.pooled(*convnet.layout(texts, 3, 50))
    for t, row in zip(texts, got):
        t = t if len(t) else np.full((1, 2), 50)
        z = np.concatenate([net.table[t].sum(axis=1), np.zeros((2, 16), np.float32)])
        one = (z[: len(t), :4] + net.bias[:4]).max(axis=0)
        three = np.max([z[i, 4:8] + z[i + 1, 8:12] + z[i + 2, 12:16] + net.bias[4:] for i in range(len(t))], axis=0)
        assert np.allclose(row, np.maximum(np.concatenate([one, three]), 0), atol=1e-4)


def test_long_texts_score_as_one():
    net = random_net(toxicity.NUMBERS, toxicity.WIDTHS, 8, 2, 3)
    rng = np.random.default_rng(2)
    t = rng.integers(0, toxicity.NUMBERS, (50_000, 4)).astype(np.int32)
    z = net.logits(*convnet.layout([t], 3, toxicity.NUMBERS))[0]
    assert abs(toxicity.margins(net, [t[:10], t])[1] - (z[1] - z[0])) < 1e-3


def test_byte_windows_equal_the_net():
    net = random_net(256, language.WIDTHS, language.FILTERS, 3, 5)
    net.table[0] = 0
    rng = np.random.default_rng(4)
    for n in (1, 7, 256, 700, 70_000):
        raw = rng.integers(1, 256, n).astype(np.uint8)
        padded = np.concatenate([raw, np.zeros(600, np.uint8)]).astype(int)
        total = 0.0
        for at in range(0, n, language.LENGTH):
            own = min(language.LENGTH, n - at)
            z = net.table[padded[at : at + own + 3]]
            f = net.filters
            two = max_over([z[j : own + j, j * f : (j + 1) * f] for j in range(2)]) + net.bias[:f]
            four = max_over([z[j : own + j, (2 + j) * f : (3 + j) * f] for j in range(4)]) + net.bias[f:]
            total = total + own * (np.maximum(np.concatenate([two, four]), 0) @ net.out + net.out_bias)
        assert np.allclose(language.Scorer(net).logits(raw), total / n, atol=1e-3)


def max_over(parts):
    return sum(parts).max(axis=0)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 60)
    rows, toxic = documents()
    # longer than 65,536 bytes, and the only ones that have the word
    rare = [(5000 + i, "calm " * 20_000 + ("dire " if i % 2 else "mild ") * 2 + "word " * i, "en") for i in range(24)]
    docs = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*toxic, *[(i, (i - 5000) % 2) for i, _, _ in rare]], "doc_id long, toxic int")
    seen = []
    round_, marks_ = toxicity._round, toxicity._learned_marks
    monkeypatch.setattr(toxicity, "_round", lambda spark, train, state, k: (seen.append(train.count()), round_(spark, train, state, k))[1])
    monkeypatch.setattr(toxicity, "_learned_marks", lambda one: (seen.append(one.count()), marks_(one))[1])
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", F.lit(True), "lang")
    held = docs.where(F.crc32(F.col("text").cast("binary")) % 5 == 0).count()
    assert seen == [724, *[724 - held] * toxicity.ROUNDS]
    truth = dict(toxic) | {i: (i - 5000) % 2 for i, _, _ in rare}
    out = toxicity.score(docs, "text", model, ["doc_id"]).collect()
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in out]) >= 0.95


def test_steps_in_runs_equal_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50, (n, 2)).astype(np.int32) for n in (5, 300, 0, 41, 7)]
    state, _ = convnet.begin(2, 50, (1, 2, 3))
    laid = convnet.layout(texts, 3, 50)
    pool, places = convnet._won(state, *laid)
    monkeypatch.setattr(convnet, "STEP_ROWS", 40)
    again, others = convnet._won(state, *laid)
    assert np.allclose(pool, again, atol=1e-6) and all((p == q)[pool[:, 8 * i : 8 * i + 8] > 0].all() for i, (p, q) in enumerate(zip(places, others)))
