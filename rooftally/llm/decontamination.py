"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are its runs of ``width`` words (the whole item if it is shorter). The
shingles of a window are its set; a document contains the window only if it has them all,
so one of them is enough to look the window up, and the rarest is the best. Rarity is
counted over all documents. A window with a shingle that no document has is dropped.

Each document word position is looked up with its shingle. A match gives the place of the
whole window by the shingle's offset; windows that would begin before the text or end
behind it are left out, and the words of the rest are compared one by one. All of this
happens beside the scan: only verified hits and one row per document are shuffled.

Windows are known by number while documents are met. Which items have them is joined at the end,
once for each set of windows that some document has: a template in a million items is one
window in what is broadcast, and its list of items is made once, not for each document. What is
used twice is written to the shared folder: cached frames would stay in the session, and each plan would carry the plans that made them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.functions.session import cut
from rooftally.llm.text import BROADCAST_KEYS, ascii_lower, bind, words_by

#: What is between words: ASCII but for digits and letters in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the window table, and bytes of its words, up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Places of a shingle in the documents from which on it is dealt out by salt in that shuffle, and the number of salts.
HOT_PLACES = 50_000
SALTS = 64


def item_words(text: Column) -> Column:
    return words_by(ascii_lower(F.coalesce(text, F.lit(""))), GAP)


def windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(win, no, item): a window of an item, with a number for equal windows (two digests), and the item's id as a string; each once."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    cuts = bind(F.col("w"), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.slice(w, i, width)))
    rows = rows.select("item", F.explode(cuts).alias("win"))
    return rows.select("win", F.struct(F.xxhash64("win").alias("a"), F.xxhash64(F.lit(1), "win").alias("b")).alias("no"), "item").distinct()


def _shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``pos`` and ``token``, the digest of the words from there, for each length; a row of pos -1 stands for the document."""
    out = docs.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)))
    if len(lengths) == 1:
        out = out.withColumn("k", F.lit(lengths[0]))
    else:
        every = F.array(*map(F.lit, lengths))
        out = out.withColumn("k", F.explode(F.when(F.col("pos") < 0, F.slice(every, 1, 1)).otherwise(every)))
    fits = (F.col("pos") >= 0) & (F.col("pos") + F.col("k") <= F.size("w"))
    return out.withColumn("token", F.when(fits, F.xxhash64(F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("k")))))


def contamination(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, width: int = 13, shingle: int = 5, percent: int = 5) -> DataFrame:
    """One row per document row: id, text_hash (xxhash64), n_words, n_hit, n_items, items (sorted strings), contaminated.

    A document is contaminated if it has a hit word and the hit words are ``percent`` of all
    at least. Null and empty texts have no words and aren't. Items without words have no
    window; a null item id is the id "". Rows with the same id and text are computed once and returned as often as they
    came; an empty table of documents gives no rows, an empty one of items no hits. Only ids and texts are read, so other columns can't clash.
    """
    named = cut(windows(items, item_id, item_text, width).select("win", "no", F.coalesce("item", F.lit("")).alias("item")))
    wins = named.select("win", "no").distinct().withColumn("k", F.least(F.size("win"), F.lit(shingle)))
    offsets = F.sequence(F.lit(0), F.size("win") - F.col("k"))
    wins = cut(wins.select("win", "no", "k", F.posexplode(F.transform(offsets, lambda o: F.xxhash64(F.slice("win", o + 1, F.col("k"))))).alias("offset", "token")))
    lengths = sorted(r[0] for r in wins.select("k").distinct().collect()) or [shingle]  # shingle of them at most
    small = wins.count() <= BROADCAST_WINDOWS * 10
    hint = F.broadcast if small else (lambda x: x)

    rows = docs.select(F.col(id_col).alias("id"), item_words(F.col(text_col)).alias("w"), F.xxhash64(text_col).alias("th"))
    tokens = wins.select("token", "k").distinct()
    seen = _shingles(rows.select("w"), lengths).join(hint(tokens), ["token", "k"]).groupBy("token", "k").count()
    rare = wins.join(seen, ["token", "k"], "left").groupBy("no").agg(
        F.count("count").alias("met"), F.count("*").alias("all"), F.first("win").alias("win"),
        F.min_by(F.struct("token", "offset", "k", "count"), F.struct(F.coalesce("count", F.lit(-1)), "offset")).alias("t"))
    prefix = cut(rare.where("met = all").select(F.col("t.token").alias("token"), F.col("t.k").alias("k"), F.col("t.offset").alias("offset"), F.col("t.count").alias("places"), "win", "no"))

    placed = _shingles(rows, lengths)
    many, size = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0))).first()
    begin = F.col("pos") - F.col("offset")
    span = F.struct(begin.alias("a"), (begin + F.size("win")).alias("b"))
    if many <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES:
        met = placed.join(F.broadcast(prefix.drop("places")), ["token", "k"], "left")
        inside = (begin >= 0) & (begin + F.size("win") <= F.size("w"))
        hit = inside & (F.slice("w", F.greatest(begin, F.lit(0)) + 1, F.size("win")) == F.col("win"))
        found = met.where((F.col("pos") == -1) | hit).select(
            "id", "th", F.size("w").alias("n"), (F.col("pos") == -1).alias("doc"),
            F.when(F.col("pos") >= 0, span).alias("span"), F.when(F.col("pos") >= 0, F.col("no")).alias("no"))
    else:
        # the words around a place travel with it, so that the window can still be compared
        lead = width - 1
        around = placed.where(F.col("pos") >= 0).select("id", "th", F.size("w").alias("n"), "pos", "token", "k", F.greatest(F.col("pos") - lead, F.lit(0)).alias("from"),
            F.slice("w", F.greatest(F.col("pos") - lead, F.lit(0)) + 1, 2 * width).alias("near"))
        hot = prefix.where(F.col("places") > HOT_PLACES).select("token", "k").distinct().withColumn("hot", F.lit(True))
        around = around.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, ["token", "k"], "left")
        around = around.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "th", "pos"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
        salts = F.when(F.col("places") > HOT_PLACES, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        near = around.join(prefix.withColumn("salt", F.explode(salts)), ["token", "k", "salt"])
        inside = (begin >= 0) & (begin + F.size("win") <= F.col("n"))
        near = near.where(inside & (F.slice("near", F.greatest(begin - F.col("from"), F.lit(0)) + 1, F.size("win")) == F.col("win")))
        near = near.select("id", "th", "n", F.lit(False).alias("doc"), span.alias("span"), "no")
        found = near.unionByName(rows.select("id", "th", F.size("w").alias("n"), F.lit(True).alias("doc"), F.lit(None).cast("struct<a:int,b:int>").alias("span"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("no")))
    docs_ = found.groupBy("id", "th", "n").agg(F.sum(F.col("doc").cast("int")).alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("no")).alias("nos"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["to"], x["b"]).alias("to"), (s["n"] + F.greatest(x["b"] - F.greatest(s["to"], x["a"]), F.lit(0))).alias("n")), lambda s: s["n"])
    docs_ = cut(docs_.select("id", F.col("th").alias("text_hash"), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "copies", "nos",
        F.when(F.size("nos") > 0, F.struct(F.xxhash64("nos").alias("a"), F.xxhash64(F.lit(1), "nos").alias("b"))).alias("which")))
    which = docs_.where("which is not null").groupBy("which").agg(F.first("nos").alias("nos")).select("which", F.explode("nos").alias("no"))
    lists = cut(which.join(named.select("no", "item"), "no").groupBy("which").agg(F.array_sort(F.collect_set("item")).alias("items")))
    sets, total = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    hit = docs_.where("which is not null").join(F.broadcast(lists) if max(sets, total) <= BROADCAST_KEYS else lists, "which")
    out = hit.unionByName(docs_.where("which is null").withColumn("items", F.array().cast("array<string>")))
    out = out.select("id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
    return out.drop("_").withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
