"""Column helpers and session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftally.functions.session import cut, shared_dir  # noqa: F401

#: A word of most contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row.

    A lambda body that names a column has that column's whole expression pasted
    into it, so it would be computed again for each element. A lambda variable isn't.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_by(text: Column, gap: str) -> Column:
    """The pieces of ``text`` between matches of ``gap``, without empty ones; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def running(values: Column, op, start: Column) -> Column:
    """For each element of an array, ``start`` and all elements before it joined by ``op``.

    An array that grows by one element costs its whole length each time. So it grows inside
    blocks of about sqrt(n) elements, and once more over the blocks: n ** 1.5 copies, not n ** 2.
    """

    def grown(of: Column, first: Column) -> Column:
        return F.aggregate(of, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def two_levels(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        return bind(F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / side).cast("int") - 1), lambda k: F.slice(v, k * side + 1, side)), in_blocks)

    def in_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(F.slice(b, 2, F.size(b)), F.element_at(b, 1), op))
        offsets = bind(grown(whole, start), lambda o: F.slice(o, 1, F.size(blocks)))
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.slice(grown(b, o), 1, F.size(b))))

    return bind(values, lambda v: F.when(F.size(v) == 0, v).when(F.size(v) <= 64, F.slice(grown(v, start), 1, F.size(v))).otherwise(two_levels(v)))


def lean(run):
    """``run``, for ``mapInArrow``; once it is through, the worker, which stays for other tasks, gives back to the system what it has freed."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim is not None:
            trim(0)

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a list of keys up to which it is broadcast, some tens of MB.
BROADCAST_KEYS = 1_000_000
#: Rows of a key from which on it is hot: broadcast, not shuffled.
HOT_ROWS = 10_000


def without(df: DataFrame, keys: DataFrame, on: list[Column]) -> DataFrame:
    """The rows of ``df`` whose ``on`` isn't in ``keys``, column by column; null is a key like others. Short lists are broadcast.

    ``keys`` may have names that ``df`` has. Nothing to leave out gives all rows, an empty ``df`` none; repeated keys count once.
    """
    names = fresh(df.columns, *[f"_k{i}" for i in range(len(on))])
    keys = keys.toDF(*names).persist()
    same = F.lit(True)
    for name, c in zip(names, on):
        same = same & c.eqNullSafe(F.col(name))
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, same, "left_anti")


def join_skewed(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``n`` how many rows have it; ``n`` goes.

    Keys of over ``HOT_ROWS`` rows are broadcast: they are a ten thousandth of the rows at most, and counted. So
    no task of the shuffle meets more rows of one key. Where even they are too many, all are shuffled.
    """
    hot = table.where(F.col(n) > HOT_ROWS).drop(n).persist()
    many = hot.count()
    if not 0 < many <= BROADCAST_KEYS:
        return rows.join(table.drop(n), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(n) <= HOT_ROWS).drop(n), key)
    return rows.join(F.broadcast(hot), key).select(*cold.columns).unionByName(cold)
