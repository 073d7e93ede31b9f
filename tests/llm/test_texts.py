"""Quality, secrets, decontamination, token files and token counts against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rooftally.llm import decontamination, quality, secrets, token_files, unigram

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, id string, base string, w int, items string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, "z", 2) for d, t in rows], SCHEMA)


def prose(n, seed=0, extra=()):
    rng = random.Random(seed)
    words = ["the", "Öl", "éa", "stone", "River", "blue,", "wind.", "x#", "a|b", "12", "don't", *extra]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 15))) for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.3:
            lines += [rng.choice(lines)] * rng.randrange(1, 4)
        out.append((i, rng.choice(["\n", "\n\n", " \n\t"]).join(lines)))
    return out


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "word " * 30_000), (904, "y" * 100_000), (None, "null id has words"), (905, "same"), (905, "same")]


def test_quality_base(spark):
    rows = prose(150) + EDGES

    def want(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed

    got = quality.quality(frame(spark, rows), "doc_id", "text").collect()
    assert sorted(map(str, [(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got])) == sorted(map(str, [(d, *want(t)) for d, t in rows]))
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_lines(spark):
    good = "\n".join(f"Clean line {i} says a thing {i} that no other line {i} has said before {i}." for i in range(10))
    menu = "\n".join(f"Home {i} | About | News | Shop {i} | Contact" for i in range(30))
    noisy = "\n".join(f"bad*** words### here{i}%%% and&&& there{i}$$$ again{i}###" for i in range(30))
    texts = [good, good + "\nAll rights reserved.\nHome | News | Help | Shop", menu, noisy, menu + "\n" + good]
    rows = {r.id: r for r in quality.quality(frame(spark, list(enumerate(texts))), "doc_id", "text").collect()}
    assert [rows[i].kept for i in range(5)] == [True, True, False, False, False]
    assert rows[1].clean_text == good and rows[1].n_lines_removed == 2 and rows[0].n_lines_removed == 0


def entropy(value, width=secrets.RUN):
    wins = [value[i : i + width] for i in range(len(value) - width + 1)]
    return max((-sum(c / width * math.log2(c / width) for c in Counter(w).values()) for w in wins), default=0.0)


def spans_of(text):
    text = text or ""
    base = [(m.start(), m.end(), 0) for m in re.finditer(r"""((?i:secret|token|api_?key|password|passwd))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    base += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(secrets.CANDIDATE, text):
        limit = next(b for _, p, b in secrets.CLASSES if re.search(p, m[0]))
        inside = any(a <= m.start() and m.end() <= b for a, b, _ in base)
        if not inside and not any(re.search(p, m[0]) for p in secrets.ALLOWED) and entropy(m[0]) >= limit:
            more.append((m.start(), m.end(), 3))
    return sorted(base), sorted(base + more)


def test_secrets(spark):
    rng = random.Random(5)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, b64 = "0123456789abcdef", secrets.ALPHABET
    planted = ["token: token: abcdefgh", 'Password = "hunter22"', "api_key:abc", "apikey='" + some(b64, 30) + "'", "AKIA" + some("ABCDEFGH0123", 16), "AKIA" + some("ABC", 15),
        some(hexa, 40), some(hexa, 23), some(b64, 60), "Secret=ſ123456", "ſecret=abcdefgh", "a" * 40, "1" * 30, "0123456789abcdef0123456789", "123e4567-e89b-12d3-a456-426614174000", "path/to/some/long/file/name1"]
    rows = []
    for i in range(120):
        parts = [rng.choice(["Öl", "der", "x y", "\n", "词", "😀"]) for _ in range(rng.randrange(6))]
        parts += [rng.choice([*planted, some(b64, rng.randrange(18, 80)), some(hexa.upper(), 32)]) for _ in range(rng.randrange(4))]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += EDGES + [(990, some(b64, 4000))]
    got = secrets.scan(frame(spark, rows), "doc_id", "text").withColumn("joined", secrets.joined(F.col("spans"))).collect()
    plain = lambda s: [(m.start, m.end, m.kind) for m in s]
    assert sorted(str((r.id, plain(r.base), plain(r.spans))) for r in got) == sorted(str((d, *map(lambda x: [tuple(y) for y in x], spans_of(t)))) for d, t in rows)
    assert any(m.kind == 3 for r in got for m in r.spans)
    assert all(r.joined == ",".join(f"{secrets.KINDS[m.kind]}:{m.start}:{m.end}" for m in r.spans) for r in got)


def test_redacted(spark):
    df = frame(spark, [(1, "ok token: abcdefgh end"), (2, "nothing"), (3, None)])
    spans = secrets.scan(df, "doc_id", "text").select("id", "spans")
    out = secrets.redacted(df.drop("id").join(spans, F.col("doc_id") == F.col("id")), "text", "spans").collect()
    assert {r.doc_id: r.text for r in out} == {1: "ok [secret] end", 2: "nothing", 3: ""}


def contaminated(text, items, width=13):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        wins = {tuple(v[i : i + width]) for i in range(max(1, len(v) - width + 1))} if v else set()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [None, 0])
def test_contamination(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", limit)
    rng = random.Random(4)
    vocabulary = ["The", "of", "Éa", "éa", "x1", "stone", "b"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([13, 13, 20, 30, 14, 3, 4, 1, 5, 0])] + [(77, None), (78, "of of of of of of of of of of of of of of of"), (79, "unseen words only here")]
    items += [(100, items[2][1])]
    rows = []
    for i in range(100):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(3)
            parts += [" ".join(t[a:]), text(rng.randrange(20))]
        rows.append((i, rng.choice([". ", "! "]).join(parts)))
    rows += [r for r in EDGES if r[0] != 903] + [(906, "of " * 200), (3, rows[3][1])]
    table = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id int, text string, w string")
    got = decontamination.contamination(frame(spark, rows), "doc_id", "text", table, "item_id", "text").collect()
    assert sorted(str((r.id, r.n_words, r.n_hit, r.items, r.contaminated)) for r in got) == sorted(str((d, *contaminated(t, items))) for d, t in rows)
    none = decontamination.contamination(frame(spark, rows[:5]), "doc_id", "text", table.limit(0), "item_id", "text").collect()
    assert len(none) == 5 and not any(r.contaminated for r in none)
    assert decontamination.contamination(frame(spark, []), "doc_id", "text", table, "item_id", "text").count() == 0


ODD = ["a  b\n\n c", "\x1c!\x1c a", "  lead", "tail \n", "a　b \x85 c", "x<|endoftext|> y <|endoftext|>", "don't 'll \x00 z\x00 ", "a\t\tb", "\n", " ", "é  b", "a\x1fb \x1d c", "so. ,. x.. 'a. é. 9."]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = prose(200, 3) + [(300 + i, t) for i, t in enumerate(ODD)] + [(900, None), (901, ""), (903, "word " * 30_000), (5, "again")]
    token_files.write(frame(spark, rows), "doc_id", "text", path, str(tmp_path / "out"), parts=5)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digest(spark, str(tmp_path / "out")).collect())
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    one = token_files.look_up(spark, str(tmp_path / "out"), 7).collect()
    assert len(one) == 1 and list(one[0].ids) == [*tokenizer.encode(dict(rows)[7], add_special_tokens=False).ids, 0]
    token_files.write(frame(spark, []), "doc_id", "text", path, str(tmp_path / "none"))
    assert token_files.digest(spark, str(tmp_path / "none")).count() == 0


def test_encoder_forgets(spark):
    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), pieces=20)
    texts = [t for _, t in prose(60, 9)] + ODD
    for _ in range(3):
        for t in texts:
            assert np.frombuffer(e.texts([t])[0], e.type).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, unknown = unigram.vocabulary(path)
    reference = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=True))
    rows = prose(100, 8, extra=("日本", "😀😀", "▁x", "<0x0A>", "</s>")) + [(300 + i, t) for i, t in enumerate(ODD)] + EDGES[:4] + EDGES[5:]
    got = unigram.count_tokens(frame(spark, rows), "doc_id", "text", path).collect()
    count = lambda t: len(reference.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
    assert sorted(str((r.id, r.n_tokens)) for r in got) == sorted(str((d, count(t))) for d, t in rows)


def test_best_path_and_ties():
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -4.0), ("c", -2.0), ("bc", -3.0), ("▁", -5.0), ("x", -40.0)]
    counter = unigram.Counter(pieces)
    assert counter.best("abc") == (-4.0, 1)  # the longest piece is found first and only a better score replaces it
    assert counter.best("aé") == (-1.0 + counter.unknown, 3)
    assert counter.count("abc abc")[1] == 4
