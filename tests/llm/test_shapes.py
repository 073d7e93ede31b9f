"""Unlucky shapes: clashing names, ids met with several texts or none, hot keys, many matches in one text, many languages."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rooftally.llm import language, quality, secrets, sharding, simhash, similar, text, toxicity, unigram
from rooftally.llm import queries as llm_queries

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = "doc_id long, text string, lang string, source string, n_chars long, _id long, _n long, _k0 string, _k1 string, _score double, _hash long"


def odd(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, 5, 6, "x", "y", 0.5, 7) for d, t in rows], ODD)


def save(spark, folder, benchmark=(), labels=()):
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_with_names_of_their_own_helpers(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    save(spark, tmp_path, [(1, passage)], [(i, 1, i % 2) for i in range(6)])
    rows = [(i, f"some words of a text {i} " + " ".join(f"w{i * 50 + j}" for j in range(30))) for i in range(6)] + [(7, passage), (8, None), (8, ""), (None, passage), (None, None)]
    docs = odd(spark, rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert k == 4 or out.columns == docs.columns, name
        assert k == 4 or all(r["_n"] == 6 and r["_score"] == 0.5 for r in got), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {*range(6), 8, None}


@pytest.mark.parametrize("operator", [similar.distinct_documents, simhash.distinct_documents])
def test_a_text_stays_though_its_id_is_met_elsewhere(spark, operator):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    kept = lambda rows: Counter((r.doc_id, r.text) for r in operator(odd(spark, rows), "doc_id", "text").collect())
    assert kept([(5, a), (5, b), (3, b)]) == {(5, a): 1, (3, b): 1}
    assert kept([(None, b), (3, b), (None, a), (None, a), (None, c)]) == {(3, b): 1, (None, a): 1, (None, c): 1}
    assert kept([(1, a), (1, a), (1, b), (2, b), (2, b), (2, None), (4, ""), (None, " ")]) == {(1, a): 1, (1, b): 1, (2, None): 1}
    assert kept([(9, a)] * 3) == {(9, a): 1}


def test_hot_fingerprints_and_components(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(100 + i, f"lone text {i} " + " ".join(f"v{i}x{j}" for j in range(40))) for i in range(40)]
    want = sorted(map(str, simhash.near_duplicates(odd(spark, rows), "doc_id", "text").collect()))
    for name, value in (("HOT_ROWS", 20), ("BROADCAST_KEYS", 0)):
        monkeypatch.setattr(text, name, value)
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
        assert sorted(map(str, simhash.near_duplicates(odd(spark, rows).repartition(5), "doc_id", "text").collect())) == want


def test_slots_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]) or f"text {i}") for i in range(1500)] + [(None, "same")] * 1300 + [(7, "x"), (7, "x"), (7, "y")]
    df = odd(spark, rows)
    first = sharding.shard(df, "doc_id", "text", keep=("lang",)).collect()
    again = sharding.shard(df.repartition(7), "doc_id", "text", keep=("lang",)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(rows)
    for s in range(8):
        own = sorted(r.slot for r in first if r.shard == s)
        assert own == list(range(len(own)))


def test_many_matches_in_one_text(spark):
    n = 100_000
    many = "token=abcdef1 " * n
    began = time.time()
    (r,) = secrets.scan(odd(spark, [(1, many)]), "doc_id", "text").select(F.size("base").alias("n"), F.element_at("base", -1).alias("last"), F.size("spans").alias("m")).collect()
    assert (r.n, r.m, r.last.start, r.last.end) == (n, n, 14 * (n - 1), 14 * n - 1)
    assert time.time() - began < 60


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 100, 1000):
        values = [(i * 7) % 13 for i in range(n)]
        (r,) = spark.createDataFrame([(values,)], "v array<long>").select(text.running(F.col("v"), lambda a, x: a + x, F.lit(0).cast("long")).alias("s")).collect()
        assert r.s == [sum(values[:i]) for i in range(n)]


def test_entropy_inside_base_spans_and_the_allow_list(spark):
    key = "aB3xQ9zLmN7pR2tVwY5kD8"
    letters = "aGhXkLmQzRtVbNwPcYdJfS"
    texts = [f"AKIA{'ABCDEFGH0123' * 2}{key}", f"sample_key={key}", f"{letters} ok", "thisIsACamelCaseNameOfSomeMethod", "your_example_placeholder_key_1", "0123456789abcdef0123456789", f"token={key}", f"x {key} {key}"]
    got = [[(m.kind, m.start) for m in r.spans] for r in secrets.scan(odd(spark, list(enumerate(texts))), "doc_id", "text").orderBy("id").collect()]
    assert [k for k, _ in got[0]] == [1, 3]  # the candidate is longer than the key id
    assert [k for k, _ in got[1]] == [3] and [k for k, _ in got[2]] == [3] and got[3] == got[4] == []
    assert [k for k, _ in got[5]] == [2] and [k for k, _ in got[6]] == [0] and [k for k, _ in got[7]] == [3, 3]


def test_furniture_in_long_paragraphs(spark):
    filler = " ".join(f"Sentence s{i} says something t{i} of its u{i} own, as v{i} one would w{i} expect." for i in range(30))
    texts = [
        f"{filler} The catalog includes a blog in print, a dialog in three acts and the spread more of it. Please read more books.",
        f"{filler} A design upgrade will sign up new readers; privacy policy is a matter of law.\n{filler.replace('t', 'z')[:600]} and an end.",
        "\n".join(["Read more", "Cookies akzeptieren", "Tous droits réservés 2024"] * 9) + "\nshort.",
        " ".join(f"word{i}" for i in range(300)),
    ]
    rows = {r.id: r for r in quality.quality(odd(spark, list(enumerate(texts))), "doc_id", "text").collect()}
    assert rows[0].kept and rows[0].n_lines_removed == 0 and rows[1].kept and rows[1].n_lines_removed == 0
    assert rows[2].n_lines_removed >= 26 and not rows[2].kept
    assert rows[3].n_lines_removed == 1 and not rows[3].kept  # three hundred words without any punctuation


def test_six_hundred_languages_and_long_texts(spark):
    rng = random.Random(0)
    rows = [(i, chr(0x4E00 + i) * 300 if i % 2 else f"q{i} " * 20, f"l{i:03}", "s", 1) for i in range(600)]
    rows += [(1000 + i, "".join(rng.choice("ꙮ Ж") for _ in range(40_000)), "long", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    net, names = language.fit(docs, "text", "lang", "doc_id", F.lit(True))
    assert len(names) == 601 and net.out.shape[1] == 601
    again = language.fit(docs.repartition(5), "text", "lang", "doc_id", F.lit(True))
    assert again[1] == names and (again[0].table == net.table).all()
    long = language.predict(docs.where("lang = 'long'"), "text", (net, names), ["doc_id"]).collect()
    assert [r.lang_pred for r in long] == ["long"] * 5


def test_repeated_ids_do_not_enlarge_the_training_table(spark):
    rows = [(i % 40, f"good words number {i} of many" if i % 2 else f"vile words number {i} of many", "en", "s", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] * 3 + [(None, 1)], "doc_id long, toxic int")
    a = toxicity.fit(docs, labels, "doc_id", "text", "toxic", F.lit(True), "lang")
    b = toxicity.fit(docs.repartition(3), labels, "doc_id", "text", "toxic", F.lit(True), "lang")
    assert (a[0].table == b[0].table).all() and (a[2] == b[2]).all()


def test_marks_tell_languages_apart():
    sets = [{b"le", b"la", b"x%d" % i} for i in range(30)] + [{b"der", b"la", b"y%d" % i} for i in range(30)] + [{b"z"}] * 3
    told = toxicity.marks(sets, ["fr"] * 30 + ["de"] * 30 + ["it"] * 3)
    assert told == [frozenset({b"der"}), frozenset({b"le"})]
    words = toxicity.Words(told)
    assert [words(t)[1] for t in ("le la", "der la", "nothing", None)] == [1, 0, 2, 2]


def test_empty_tables(spark, tmp_path):
    none = odd(spark, [])
    save(spark, tmp_path)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert quality.quality(none, "doc_id", "text").count() == 0 and secrets.scan(none, "doc_id", "text").count() == 0
    assert unigram.count_tokens(none, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    for name, query in llm_queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_queries_take_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, ""), (None, None), (None, "a b c"), (2, "word " * 3000), (3, "same text"), (3, "same text"), (4, "same text"), (5, "token=abcdef123456"), (6, "\x00 ퟿ é")]
    save(spark, tmp_path, [(None, "word word word word word word word word word word word word word"), (1, None)], [(None, None, None), (1, 1, 1), (2, 0, 0)])
    odd(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for name, query in llm_queries.queries().items():
        assert query(spark, str(tmp_path)).count() == len(rows), name
    assert {r.source for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()} == {"s"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
