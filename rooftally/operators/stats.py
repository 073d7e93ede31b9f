"""Accuracy, dispersion and agreement statistics over grouped rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rooftally.operators.matching import ratio


def with_area_errors(df: DataFrame) -> DataFrame:
    """R, P, F1, errors and ratio from gt_union, pred_union, inter_union (all exact)."""
    b, a, i = F.col("gt_union"), F.col("pred_union"), F.col("inter_union")
    return df.withColumns({
        "area_recall": F.coalesce(ratio(i, b), F.lit(0.0)),
        "area_precision": F.coalesce(ratio(i, a), F.lit(0.0)),
        "area_f1": F.coalesce(ratio(2 * i, a + b), F.lit(0.0)),
        "abs_error": F.abs(a - b),
        "abs_rel_error": F.abs(a - b) / F.greatest(b, F.lit(1)),
        "signed_rel_error": (a - b) / F.greatest(b, F.lit(1)),
        "pred_gt_ratio": a / F.greatest(b, F.lit(1)),
    })


def tier1_summary(df: DataFrame, keys: list[str], center: str = "unweighted") -> DataFrame:
    """Per key over the per-grid rows of ``with_area_errors``: aggregate and mean accuracy, errors, dispersion, regression.

    ``center``: the ratio around which the area-weighted dispersion is taken, the plain mean
    (unweighted) or bulk (weighted). One row has no deviations: those columns are null.
    """
    b, a, i, r = F.col("gt_union").cast("double"), F.col("pred_union").cast("double"), F.col("inter_union"), F.col("pred_gt_ratio")
    both = (F.col("gt_union") > 0) & (F.col("pred_union") > 0)
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n_grids"), F.sum("pred_union").alias("pred_total"), F.sum("gt_union").alias("gt_total"), F.sum(i).alias("inter_total"),
        F.avg("area_f1").alias("mean_f1"), F.avg("abs_error").alias("mae"), F.avg("abs_rel_error").alias("mre"), F.avg("signed_rel_error").alias("signed_mre"),
        F.avg(((r >= 0.8) & (r <= 1.2)).cast("double")).alias("within_20"), F.avg(r).alias("mean_ratio"), F.stddev_samp(r).alias("std_ratio"),
        F.stddev_samp(F.when(both, F.log(a / b))).alias("std_logratio"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"),
        F.sum(b * r).alias("_br"), F.sum(b * r * r).alias("_brr"), F.sum(b).alias("_b"),
        F.regr_slope(a, b).alias("ols_slope"), F.regr_intercept(a, b).alias("ols_intercept"), F.regr_r2(a, b).alias("ols_r2"),
        (F.sum(a * b) / F.when(F.sum(b * b) > 0, F.sum(b * b))).alias("thru0_slope"))
    bulk = ratio("pred_total", "gt_total")
    m = F.col("mean_ratio") if center == "unweighted" else F.col("_br") / F.col("_b")
    spread = F.when(F.col("_b") > 0, F.sqrt(F.greatest((F.col("_brr") - 2 * m * F.col("_br") + m * m * F.col("_b")) / F.col("_b"), F.lit(0.0))))
    rec, prec = ratio("inter_total", "gt_total"), ratio("inter_total", "pred_total")
    rounded = {
        "agg_recall": rec, "agg_precision": prec, "agg_f1": F.when(rec + prec > 0, 2 * rec * prec / (rec + prec)), "mean_f1": F.col("mean_f1"), "bulk": bulk,
        "mae": F.col("mae"), "mre": F.col("mre"), "signed_mre": F.col("signed_mre"), "within_20": F.col("within_20"), "mean_ratio": F.col("mean_ratio"), "std_ratio": F.col("std_ratio"),
        "std_ratio_bw": spread, "cv_ratio_bw": F.when(m != 0, spread / m), "std_logratio": F.col("std_logratio"), "rmse": F.col("rmse"),
        "ols_slope": F.col("ols_slope"), "ols_r2": F.col("ols_r2"), "thru0_slope": F.col("thru0_slope"),
    }
    return sums.select(*keys, "n_grids", "pred_total", "gt_total", "inter_total", *[F.round(c, 4).alias(n) for n, c in rounded.items()])


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


#: Keys whose sums a task of the resampling holds before it passes them on.
HELD = 512
#: Upper bounds, out of 2 ** 32, of a uniform number that counts 0, 1, 2, … times: the distribution of how often a row is drawn when n are drawn out of many.
DRAWN = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def bootstrap_ci(df: DataFrame, keys: list[str], order: str, value: str, stat: str = "mean", draws: int = 1000, seed: str = "42") -> DataFrame:
    """Percentile interval of ``stat`` (mean, std or rms) over resampled rows of each key; null for under three rows.

    A row is in each draw so many times, by a digest of seed, draw and the row's ``order``, which tells the rows of a key apart; times are independent, with
    mean 1. So a draw needs no other row: its sums are added up beside all others', and what is shuffled is a row for each key and draw from each task, however
    many rows a key has. Reruns and other engines agree. Null values are left out; a draw of no row has no part in the interval.
    """
    rows = df.select(*keys, F.col(order).alias("_id"), F.col(value).cast("double").alias("v")).where("v is not null")
    shift = F.lit(0.0)
    if stat == "std":  # squares around the mean don't cancel
        center = rows.groupBy(*keys).agg(F.avg("v").alias("_m")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_m")
        rows = rows.join(center, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).select(*keys, "_id", "v", "_m")
        shift = F.col("_m")
    # rows of one id meet in a task, so its digests are made once for all keys; the number is given, as so few bytes would be dealt to one task
    met = rows.select(*keys, F.col("_id").cast("string").alias("_id"), (F.col("v") - shift).alias("v")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id")
    schema = met.select(*keys).schema.add("draw", "integer").add("n", "long").add("_w", "long").add("_v", "double").add("_vv", "double")
    sums = met.mapInArrow(_drawn(len(keys), draws, seed, schema.names), schema).groupBy(*keys, "draw").agg(*[F.sum(c).alias(c) for c in ("n", "_w", "_v", "_vv")])
    w, v, vv = F.col("_w"), F.col("_v"), F.col("_vv")
    of = {"mean": F.when(w > 0, v / w), "std": F.when(w > 1, F.sqrt(F.greatest(vv - v * v / w, F.lit(0.0)) / (w - 1))), "rms": F.when(w > 0, F.sqrt(vv / w))}[stat]
    out = sums.withColumn("s", F.round(of, 9)).groupBy(*keys).agg(F.max("n").alias("n"), F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.975).alias("high"))
    return out.select(*keys, "n", *[F.round(F.when(F.col("n") >= 3, F.col(c)), 6).alias(f"ci_{c}") for c in ("low", "high")])


def times_drawn(ids: list[str | None], draws: int, seed: str) -> np.ndarray:
    """(ids, draws): how often each row is in each draw, from 1 on; a null id is left out of the digest."""
    starts = [f"{seed}:{k}".encode() for k in range(1, draws + 1)]
    ends = [b"" if i is None else b":" + i.encode("utf-8", "surrogatepass") for i in ids]
    digests = b"".join([md5(s + e).digest() for e in ends for s in starts])
    number = np.frombuffer(digests, ">u4")[::4].astype(np.int64)
    return np.searchsorted(np.array(DRAWN), number, "right").reshape(len(ids), draws)


def _drawn(keys: int, draws: int, seed: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told(types: list[pa.DataType]) -> pa.RecordBatch:
            every = list(held)
            columns = [pa.array([k[i] for k in every], t).take(pa.array(np.repeat(np.arange(len(every)), draws))) for i, t in enumerate(types)]
            n, w, v, vv = np.concatenate(list(held.values()), axis=1)
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(1, draws + 1, dtype=np.int32), len(every))), *[pa.array(c.astype(np.int64)) for c in (n, w)], pa.array(v), pa.array(vv)], names)

        types = []
        for batch in batches:
            types = [c.type for c in batch.columns[:keys]]
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids = some.column(keys).to_pylist()
                place = {i: k for k, i in enumerate(dict.fromkeys(ids))}
                times = times_drawn(list(place), draws, seed)
                of: dict[tuple, list[int]] = {}
                for row, key in enumerate(zip(*[c.to_pylist() for c in some.columns[:keys]]) if keys else [()] * len(ids)):
                    of.setdefault(key, []).append(row)
                value, drawn = some.column(keys + 1).to_numpy(zero_copy_only=False), np.array([place[i] for i in ids])
                for key, own in of.items():
                    w, v = times[drawn[own]], value[own]
                    sums = np.stack([np.full(draws, float(len(own))), w.sum(axis=0), v @ w, (v * v) @ w])
                    held[key] = held[key] + sums if key in held else sums
                if len(held) > HELD:
                    yield told(types)
                    held.clear()
        if held:
            yield told(types)

    return run


def kappa(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Two-class agreement of raters ``a`` and ``b`` (booleans; rows with a null abstain)."""
    both = a.isNotNull() & b.isNotNull()
    count = lambda x, y: F.count_if(both & (a == x) & (b == y))
    t = df.groupBy(*keys).agg(count(True, True).alias("tt"), count(True, False).alias("tf"), count(False, True).alias("ft"), count(False, False).alias("ff"), F.count_if(~both).alias("n_abstain"))
    n = F.col("tt") + F.col("tf") + F.col("ft") + F.col("ff")
    po = (F.col("tt") + F.col("ff")) / n
    pe = ((F.col("tt") + F.col("tf")) * (F.col("tt") + F.col("ft")) + (F.col("ft") + F.col("ff")) * (F.col("tf") + F.col("ff"))) / (n * n)
    rec, spec = ratio(F.col("tt"), F.col("tt") + F.col("tf")), ratio(F.col("ff"), F.col("ft") + F.col("ff"))
    return t.withColumns({
        "n": n, "accuracy": F.round(F.when(n > 0, po), 6), "kappa": F.round(F.when((n > 0) & (pe != 1), (po - pe) / (1 - pe)), 6),
        "recall_true": F.round(rec, 6), "recall_false": F.round(spec, 6), "balanced": F.round((rec + spec) / 2, 6),
    })


def through_thresholds(df: DataFrame, thresholds: list[float], score: str, name: str = "threshold") -> DataFrame:
    """Each row once for each threshold that its score reaches: a sweep in one pass."""
    return df.withColumn(name, F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) >= t)))


def paired_ci(df: DataFrame, keys: list[str], order: str, a: str, b: str, draws: int = 1000, seed: str = "42") -> DataFrame:
    """Interval of the mean of ``a`` - ``b`` over resampled rows, which keep their two values together."""
    return bootstrap_ci(df.withColumn("delta", F.col(a) - F.col(b)), keys, order, "delta", "mean", draws, seed)


def against_base(df: DataFrame, keys: list[str], variant: str, is_base: Column, rules: list[tuple[str, Column]], score: str) -> DataFrame:
    """Rows with ``reasons`` (names of the rules that hold against the base row of their keys, whose columns are ``b_…``) and ``place`` by falling score among those without any."""
    base = df.where(is_base).select(*keys, *[F.col(c).alias(f"b_{c}") for c in df.columns if c not in keys])
    rows = df.join(base, keys).withColumn("reasons", F.concat_ws(",", *[F.when(rule, F.lit(name)) for name, rule in rules]))
    clean = F.col("reasons") == ""
    place = F.row_number().over(Window.partitionBy(*keys, clean).orderBy(F.desc(F.round(score, 6)), variant))
    return rows.withColumn("place", F.when(clean, place)).select(*df.columns, "reasons", "place")


def lock_validate(df: DataFrame, keys: list[str], suite: str, chosen_on: str, threshold: str, score: str, gap: float, leaks: DataFrame) -> DataFrame:
    """The threshold that is best on one suite (the smallest among equals), its score on each suite beside the best there, and a verdict: leak, gap or ok.

    leaks: keys and ``n_leaks``, cells of the suite chosen on that a test suite has as well.
    """
    locked = df.where(F.col(suite) == chosen_on).groupBy(*keys).agg(F.min(F.struct(-F.round(score, 9), F.col(threshold).alias("t"))).alias("m")).select(*keys, F.col("m.t").alias("locked"))
    best = df.groupBy(*keys, suite).agg(F.max(score).alias("best"))
    rows = df.join(locked, keys).where(F.col(threshold) == F.col("locked")).join(best, [*keys, suite]).join(leaks, keys, "left").withColumn("n_leaks", F.coalesce("n_leaks", F.lit(0)))
    apart = F.col("best") - F.col(score)
    verdict = F.when((F.col(suite) == chosen_on) & (F.col("n_leaks") > 0), "leak").when(apart > gap, "gap").otherwise("ok")
    return rows.select(*keys, suite, "locked", F.round(score, 6).alias(score), F.round("best", 6).alias(f"best_{score}"), F.round(apart, 6).alias("gap"), verdict.alias("verdict"), "n_leaks")
