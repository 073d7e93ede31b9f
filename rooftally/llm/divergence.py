"""How sources of a language differ in their terms: smoothed shares of frequent terms, compared exactly.

Frequent terms are found by prefix refinement. A term is its bytes and an end mark, and level by level
documents are counted for each prefix of so many bytes. A prefix in too few documents is discarded with
all that begin with it, as none of them can be in more; one that holds the end mark is a complete term, and kept.
Prefixes that aren't complete are extended at the next level, until none are left. A document names each of its prefixes
once, so counts are sums: tasks add up some megabytes of text at a time and drop what was discarded before, and
Spark adds up the tasks. No list of all terms is ever made.

Shares are whole numbers of billionths. The sum over all terms for two sources is that of two sources without
terms, and for each term that one of them has, what it changes there. Terms are dealt out in blocks,
with sources in blocks too, and a task sums the differences of a block's matrix for all pairs at once; pairs never are rows before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rooftally.functions.session import cut
from rooftally.llm.text import BROADCAST_KEYS

#: What is between terms, once A to Z are lower-cased; what ends a term, which none holds.
GAP, END = "[^a-z\\x{80}-\\x{10FFFF}]+", b"\0"
#: Bytes of the prefixes of the first level; each further one has twice as many.
FIRST = 8
#: Bytes of texts that a task looks at together; one text may have more.
HELD = 1 << 23
#: Added to each count, and what a share of 1 is.
PLUS, WHOLE = 5, 1_000_000_000
#: Sources of a block of sources, cells of a block's matrix, least number of blocks of a language's terms.
SOURCES, CELLS, BLOCKS = 256, 1 << 18, 16


def spelled(term: Column) -> Column:
    """A complete term as text."""
    return F.decode(F.substring(term, F.lit(1), F.octet_length(term) - 1), "UTF-8")


def _complete(term: Column) -> Column:
    return F.substring(term, -1, 1) == F.lit(bytearray(END))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of some HELD bytes of text together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + HELD, "right")))
        yield batch.slice(at, to - at)
        at = to


def _added_up(docs: DataFrame, by: list[str], name: str, width: int | None = None, above: int = 0) -> DataFrame:
    """docs: ``by`` (texts, not null), text. (by, name, n), in part: a name may have several rows.

    Names are the terms with END and n their occurrences; with ``width`` the prefixes of so many bytes, and n the rows that have a term with it,
    terms of fewer than ``above`` bytes left out. Words are numbered, and numbers are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, len(by)):
                words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(some.column(len(by)), "")), GAP)
                every = words.flatten().dictionary_encode()
                terms = every.dictionary.cast(pa.binary())
                lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False)
                names = pc.binary_join_element_wise(terms, END, b"")
                if width is not None:
                    names = pc.binary_slice(names, 0, width)
                names = names.dictionary_encode()
                number = np.where((lengths > 0) & (lengths >= above), names.indices.to_numpy(zero_copy_only=False), -1).astype(np.int64)
                row, named = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64), number[every.indices.to_numpy(zero_copy_only=False)]
                row, named, many = row[named >= 0], named[named >= 0], len(names.dictionary)
                if width is not None:  # a row counts once for a name
                    once = np.sort(row * many + named)
                    row, named = np.divmod(once[np.concatenate(([True], once[1:] != once[:-1]))] if len(once) else once, max(many, 1))
                groups = pa.StructArray.from_arrays([some.column(i) for i in range(len(by))], by).to_pylist()
                place = {key: i for i, key in enumerate(dict.fromkeys(tuple(g.values()) for g in groups))}
                of = np.array([place[tuple(g.values())] for g in groups], np.int64)
                both, n = np.unique(of[row] * many + named, return_counts=True)
                group, named = np.divmod(both, max(many, 1))
                keys = [pa.array([k[i] for k in place], pa.string()).take(pa.array(group)) for i in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, names.dictionary.take(pa.array(named)), pa.array(n, pa.int64())], [*by, name, "n"])

    return docs.select(*by, "text").mapInArrow(run, ", ".join(f"{c} string" for c in by) + f", {name} binary, n bigint")


def _known(counts: DataFrame, keys: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """`_added_up` rows summed over tasks, of those whose ``on`` is in ``keys``: told to all tasks, and dropped before the shuffle, while counted short, else joined to the sums."""
    few = keys.count() <= BROADCAST_KEYS
    sums = (counts.join(F.broadcast(keys), on, "left_semi") if few else counts).groupBy(*by).agg(F.sum("n").alias("n"))
    return sums if few else sums.join(keys, on, "left_semi")


def frequent_terms(docs: DataFrame, group: str, least: int) -> DataFrame:
    """docs: group (text, not null), text. (group, term, n): terms in ``least`` rows of their group or more, by prefix refinement."""
    kept, alive, width = None, None, FIRST
    while alive is None or not alive.isEmpty():
        half = 0 if alive is None else width // 2  # what isn't longer was complete before
        counts = _added_up(docs, [group], "prefix", width, half)
        if alive is None:
            sums = counts.groupBy(group, "prefix").agg(F.sum("n").alias("n"))
        else:
            before = alive.select(group, F.col("prefix").alias("_before"))
            sums = _known(counts.withColumn("_before", F.substring("prefix", 1, half)), before, [group, "_before"], [group, "prefix", "_before"]).drop("_before")
        level = cut(sums.where(F.col("n") >= least))
        done = level.where(_complete(F.col("prefix"))).withColumnRenamed("prefix", "term")
        kept = done if kept is None else kept.unionByName(done)
        alive, width = level.where(~_complete(F.col("prefix"))), width * 2
    return kept


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of terms and two of sources, or one: what the terms change for each two sources of different blocks, or of the one."""
    alone = pdf["term"].isna()
    base, rows = pdf[alone], pdf[~alone]
    names, own = base["source"].to_numpy(), base["p"].to_numpy(np.int64)
    place = {s: i for i, s in enumerate(names)}
    column, terms_ = pd.factorize(rows["term"])
    p = np.repeat(own[:, None], len(terms_), axis=1)
    p[rows["source"].map(place).to_numpy(np.int64), column] = rows["p"].to_numpy(np.int64)
    left, right = (np.flatnonzero(base[side].to_numpy()) for side in ("left", "right"))
    out = []
    for i in left:
        others = right[names[right] > names[i]] if base["left"].all() and base["right"].all() else right
        changed = np.abs(p[others] - p[i]).sum(axis=1) - len(terms_) * np.abs(own[others] - own[i])
        out += [(*sorted((names[i], names[j])), c) for j, c in zip(others, changed.tolist())]
    return pd.DataFrame(out, columns=["a", "b", "changed"])


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language. shares: (lang, source, term, p); groups: (lang, source, v, sources, base)."""
    hint = F.broadcast if groups.count() <= BROADCAST_KEYS else lambda x: x
    parts = F.ceil(F.col("sources") / SOURCES).cast("int")
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("v") * F.least(F.col("sources"), F.lit(2 * SOURCES)) / CELLS)).cast("int")
    dealt = groups.select("lang", "source", "base", parts.alias("parts"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), parts).cast("int").alias("part"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("x"), F.greatest(o, F.col("part")).alias("y")))
    own = dealt.withColumns({"term": F.lit(None).cast("binary"), "p": F.col("base")}).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = shares.join(hint(dealt), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    met = own.unionByName(rest, allowMissingColumns=True).withColumn("meet", F.explode(meets))
    sides = [(F.col("meet.x") == F.col("part")).alias("left"), (F.col("meet.y") == F.col("part")).alias("right")]
    met = met.select("lang", "block", "meet.x", "meet.y", "source", "term", "p", *sides)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _summed(pdf).assign(lang=key[0])

    changed = met.groupBy("lang", "block", "x", "y").applyInPandas(run, "a string, b string, changed long, lang string")
    summed = changed.groupBy("lang", "a", "b").agg(F.sum("changed").alias("changed"))
    one = groups.select("lang", F.col("source").alias("a"), "v", F.col("base").alias("_a"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("_b"))
    value = F.col("changed") + F.col("v") * F.abs(F.col("_a") - F.col("_b"))
    return summed.join(hint(one), ["lang", "a"]).join(hint(two), ["lang", "b"]).select("lang", "a", "b", value.alias("value"))


def _smoothed(count: str, total: str, v: str) -> Column:
    """The share of ``count`` out of ``total``, in whole numbers of 38 digits; 0 for a language that keeps no term."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + ((CAST({count} AS DECIMAL(20,0)) + {PLUS}) * {WHOLE}) DIV (CAST({total} AS DECIMAL(20,0)) + {PLUS} * CAST({v} AS DECIMAL(20,0))) ELSE 0 END").cast("long")


def audit(df: DataFrame, text_col: str, lang_col: str, source_col: str, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how the terms of each (lang, source) group differ from other sources' and from its language's.

    Null texts, languages and sources are read as ''. A term is a run of letters A to Z and characters beyond ASCII, A to Z lower-cased; a language
    keeps its V terms that are in ``least`` of its rows or more, each of rows that repeat counted. A term with ``count`` occurrences in a group
    has p = 1 + floor(WHOLE * (count + PLUS) / (N + PLUS * V)), N being the group's occurrences of kept terms. Part ``pair``: each other source of
    the language, value the sum of the differences of p, 0 without kept terms. Part ``term``: of the terms that the group has, and has more of than
    its language, the ``top`` that differ most. Ranks go by value, falling, and equal values by the bytes of the item. Groups without any term have
    their pairs too. Texts are read whole, however long, and so are terms. Only the three columns are read, so others can't clash; an empty table gives no rows.
    """
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).alias("text"))
    kept = cut(frequent_terms(named, "lang", least).select("lang", "term"))
    counts = cut(_known(_added_up(named, ["lang", "source"], "term"), kept, ["lang", "term"], ["lang", "source", "term"]).withColumnRenamed("n", "count"))
    by_source = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    every = named.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(by_source, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    every = cut(every.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")))
    langs = every.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    groups = cut(every.join(langs, "lang").select("*", _smoothed("0", "total", "v").alias("base")))
    hint = F.broadcast if groups.count() <= BROADCAST_KEYS else lambda x: x
    shares = counts.join(hint(groups.select("lang", "source", "total", "v")), ["lang", "source"]).select("lang", "source", "term", "count", _smoothed("count", "total", "v").alias("p"))

    pairs = _pairs(shares.drop("count"), groups)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(first))

    whole = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    whole = whole.join(hint(groups.select("lang", "lang_total", "v").distinct()), "lang").select("lang", "term", _smoothed("count", "lang_total", "v").alias("q"))
    more = shares.join(whole, ["lang", "term"]).where(F.col("p") > F.col("q"))
    term = more.select("lang", "source", F.lit("term").alias("part"), spelled(F.col("term")).alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pair.unionByName(term.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top))
