"""Fill-in-middle against a loop over tokens; piece encoding against the library."""

import hashlib
import random
import re

import pytest

from rooftally.llm import middle, pieces
from rooftally.llm.queries import op12_pieces, tokenizer_file

ODD = [
    None, "", " ", "\n\t", "a", "  a", "a  ", "one two  three\nfour\t", "x <P> y", "<S>", "a<M", "<", "P>", "é ß 😀😀  z", "nul\x00 in\x0b it", "$1 \\2 ${x}", "same same same", "same same same",
    "tail \x1c\x85 end", "<P<S>", "< P> <S", "\r\n", "word" * 300,
]


def brute(d, text, rate, spm, seed=42):
    text = text or ""
    t = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(t), "plain", text, None, None
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h4 % 100 < spm:
        return len(t), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(t), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50)])
def test_middle_equals_a_loop(spark, rate, spm):
    rng = random.Random(rate)
    rows = [(i, t) for i, t in enumerate(ODD * 4)] + [(None, "no id at all"), (7, "same id"), (7, "same id")]
    rows += [(100 + i, "".join(rng.choice(["ab", " ", "\n", "é", "<", "P", ">", "c d ", "😀"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, Form string, n string, id int")
    got = middle.transformed(df, "doc_id", "text", rate, spm)
    got = got.withColumn("back", middle.restored(got.output, got.form)).collect()
    want = [(d, t or "", *brute(d, t, rate, spm), t or "") for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert middle.transformed(df.limit(0), "doc_id", "text").count() == 0


def test_middle_of_a_very_long_text(spark):
    long = [(1, "word, " * 400_000), (2, "x" * 2_000_000), (3, " " * 500_000 + "end"), (4, "a " * 200_000 + " " * 300_000)]
    df = spark.createDataFrame(long, "doc_id long, text string")
    rows = middle.transformed(df, "doc_id", "text", 100)
    got = {r.id: r for r in rows.withColumn("back", middle.restored(rows.output, rows.form)).collect()}
    for d, t in long:
        assert (got[d].n, got[d].form, got[d].output, got[d].prefix_chars, got[d].middle_chars) == brute(d, t, 100, 80) and got[d].back == t


TEXTS = [
    *ODD, "a  b\n\tc▁d\x00e　f <0x0A> </s> é ﬁ ", "▁", " ▁ a", "<s><unk>", "aaaa" * 9 + "  " * 9, "\U0010ffff́", "   lead", "trail   ", "日本語のテキスト", "ﬁne‍👩‍🔬", "A" * 200 + " " + "A" * 200,
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 50)
    rng = random.Random(4)
    mixed = ["".join(rng.choice(["the ", "▁", " ", "ing", "\n", "é", "日", "\x00", "xq", "  ", "Zz9", "😀"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    rows = list(enumerate(TEXTS + mixed)) + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, ids int, Decoded string")
    got = [(r.id, r.ids, r.decoded) for r in pieces.encoded(df, "doc_id", "text", tokenizer_file("piece_bpe_32k.model"), decode=True).collect()]
    ids = [library.encode(t or "") for _, t in rows]
    assert sorted(got, key=repr) == sorted(((d, i, library.decode(i)) for (d, _), i in zip(rows, ids)), key=repr)
    empty = pieces.encoded(df.limit(0), "doc_id", "text", tokenizer_file("piece_bpe_32k.model"))
    assert empty.columns == ["id", "ids"] and empty.count() == 0


def test_query_equals_the_library_on_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {d: (len(i := library.encode(t or "")), sha(",".join(map(str, i))), sha(library.decode(i))) for d, t in docs}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_pieces(spark, "/root/testdata/sf0.001").collect()} == want


def test_one_word_of_a_megabyte_and_a_small_memory(library, monkeypatch):
    codec = pieces.Codec(tokenizer_file("piece_bpe_32k.model"))
    for text in ("abcab" * 100_000, "the " * 100_000, " " * 200_000, "xy\U0001f600" * 50_000):
        assert codec.encode(text) == library.encode(text)
    monkeypatch.setattr(pieces, "WORDS", 10)
    for k in range(5):
        assert codec.encode(text := f"some words number{k} or {k * 77} more words") == library.encode(text)
        codec.checked()
        assert not codec.new and len(codec.words) + len(codec.parts) <= 60


def test_a_difference_from_the_library_stops(library):
    codec = pieces.Codec(tokenizer_file("piece_bpe_32k.model"))
    codec.encode("  and a lone mark ")
    codec.checked()
    codec.scores = {p: -s for p, s in codec.scores.items()}
    codec.encode("understanding")
    with pytest.raises(RuntimeError, match="understanding"):
        codec.checked()
