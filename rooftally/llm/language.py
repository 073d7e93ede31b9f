"""Language identification by a byte convolutional network over fixed-length windows.

A text is cut into windows of ``LENGTH`` bytes that cover it whole. Filters of two and four
bytes are maximised over each window; softmax over the learned languages. A text's answer
is the mean of its windows' logits, by their bytes. In scoring, two neighbouring bytes
index one table, so a filter of four bytes is two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rooftally.llm import convnet

LENGTH = 256
WIDTHS = (2, 4)
FILTERS = 12
#: Documents that training takes over all languages, but LEAST of each language at least; windows cut from each.
TRAIN_DOCS = 3000
LEAST = 20
TRAIN_WINDOWS = 3
#: Languages up to which their table is broadcast.
BROADCAST_LANGUAGES = 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)


class Scorer:
    def __init__(self, net: convnet.Net):
        f, t = net.filters, net.table[:256].copy()
        t[0] = 0  # stands behind the end of a text, as the padding does in training
        two, four = slice(0, 2 * f), slice(2 * f, 6 * f)
        a, b = t[:256, two], t[:256, four]
        pair = lambda x, j: (x[:, None, j * f : (j + 1) * f] + x[None, :, (j + 1) * f : (j + 2) * f]).reshape(65536, f)
        self.first = np.ascontiguousarray(np.concatenate([pair(a, 0) + net.bias[:f], pair(b, 0) + net.bias[f:]], axis=1))
        self.second = np.ascontiguousarray(pair(b, 2))
        self.net = net

    def logits(self, raw: np.ndarray) -> np.ndarray:
        """Mean over the windows, each as heavy as its bytes."""
        n, total = len(raw), 0.0
        for at in range(0, n, 256 * LENGTH):
            part = raw[at : at + 256 * LENGTH + 3]
            own = min(n - at, 256 * LENGTH)
            windows = -(-own // LENGTH)
            padded = np.zeros(windows * LENGTH + 3, np.uint16)
            padded[: len(part)] = part
            pair = padded[:-1] * np.uint16(256) + padded[1:]
            z = self.first[pair[:-2]]
            f = self.net.filters
            z[:, f:] += self.second[pair[2:]]
            z[own:] = -np.inf
            pool = np.maximum(z.reshape(windows, LENGTH, 2 * f).max(axis=1), 0)
            weight = np.full(windows, LENGTH, np.float64)
            weight[-1] = own - (windows - 1) * LENGTH
            total = total + weight @ (pool @ self.net.out + self.net.out_bias)
        return total / max(1, n)


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, usable: Column) -> tuple[convnet.Net | None, list[str]]:
    """Net and languages from a seeded sample of the rows with a language for which ``usable`` (on ``_id``) holds.

    Every language that has such rows is learned: from all of them, or of more than TRAIN_DOCS / languages (LEAST at
    least) from those of the smallest digests. Long texts give windows like others. What comes
    to the driver is TRAIN_WINDOWS windows of LENGTH bytes a row. Empty texts are left out; rows of one id are rows of their own.
    """
    size = F.octet_length("_t")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).where(F.col("_l").isNotNull() & (size > 0) & usable)
    counts = rows.groupBy("_l").agg(F.count("*").alias("n")).persist()
    many = counts.count()
    if not many:
        return None, []
    each = max(LEAST, TRAIN_DOCS // many)
    digest = F.xxhash64("_id", "_t", F.lit(5))
    shares = counts.select("_l", F.least(F.lit(1.0), 2 * each / F.col("n")).alias("share"))
    drawn = rows.withColumn("_d", digest).join(F.broadcast(shares) if many <= BROADCAST_LANGUAGES else shares, "_l").where(F.pmod("_d", F.lit(1 << 20)) / (1 << 20) < F.col("share"))
    at = lambda k: (F.pmod(F.xxhash64("_d", F.lit(k)), F.greatest(size - LENGTH + 1, F.lit(1))) + 1).cast("int")
    starts = F.when(size > LENGTH, F.array_distinct(F.array(*[at(k) for k in range(TRAIN_WINDOWS)]))).otherwise(F.array(F.lit(1)))
    drawn = drawn.withColumn("_b", F.col("_t").cast("binary")).select("_l", "_d", F.transform(starts, lambda i: F.substr("_b", i, F.lit(LENGTH))).alias("_w"))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy("_d", "_w"))
    got = sorted((bytes(w), r[0]) for r in drawn.withColumn("_k", rank).where(F.col("_k") <= each).select("_l", "_w").collect() for w in r[1])
    languages = sorted({x for _, x in got})
    number = {x: i for i, x in enumerate(languages)}
    texts = [np.frombuffer(w.translate(_LOWER), np.uint8).astype(np.int32)[:, None] for w, _ in got]
    return convnet.train(texts, np.array([number[x] for _, x in got]), len(languages), 256, WIDTHS, FILTERS, epochs=4), languages


def predict(docs: DataFrame, text_col: str, model: tuple[convnet.Net | None, list[str]], carry: list[str]) -> DataFrame:
    """``carry`` columns, ``lang_pred`` and ``score`` of each row; ``und`` and 0 for a null text, one without a letter, or a model that learned nothing.

    Rows are independent: repeated ones give equal rows, an empty table none. ``carry`` may hold any columns but the two new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = shared.value
        scorer = Scorer(net) if net else None
        for batch in batches:
            names, scores = [], []
            for t in batch.column(len(carry)):
                text = t.as_py()
                if not text or scorer is None or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                z = scorer.logits(raw_bytes(text))
                p = np.exp(z - z.max())
                names.append(languages[int(z.argmax())])
                scores.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*carry, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
