"""Review decisions: rules that fail closed, agreement of two reviewers, what a pool takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.operators import columns


def review_action(present: Column) -> Column:
    """``review`` without a verdict, ``keep`` of what is there, else ``drop``."""
    return columns.first_match([(present.isNull(), "review"), (present, "keep")], "drop")


def fail_closed_reasons(action: Column, auto_drop: Column, present: Column) -> Column:
    """Names of the rules that a decision breaks, in their order; none if it may stand. A null ``present`` is no verdict; a null flag is none."""
    auto = F.coalesce(auto_drop, F.lit(False))
    rules = [
        (auto & (action != "drop"), "auto_drop_without_drop"), (auto & ~present.eqNullSafe(False), "auto_drop_of_pv"),
        ((action == "drop") & ~auto, "drop_without_auto"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def agreement(decisions: DataFrame, keys: list[str], second: Column, present: Column) -> DataFrame:
    """keys, outcome. Both reviewers (``second`` tells whose row it is) must say no in all their rows; no verdict is a veto.

    ``one_reviewer`` where either has no row, ``disagree`` where one says no, ``positive`` where neither does. Null keys are a key; no rows give none.
    """
    no = ~F.coalesce(present, F.lit(True))
    says = decisions.groupBy(*keys).agg(F.every(F.when(~second, no)).alias("_a"), F.every(F.when(second, no)).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    outcome = columns.first_match([(a.isNull() | b.isNull(), "one_reviewer"), (a & b, "admit"), (a | b, "disagree")], "positive")
    return says.select(*keys, outcome.alias("outcome"))


def unseen(new: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``pool``. Null keys are never in it."""
    return new.join(pool.select(*keys), keys, "left_anti")


#: Distance in the plane's units up to which a true panel, and a missed one, is near.
NEAR_TRUE, NEAR_MISSED = 60, 30


def fp_bucket(status: Column, seg_error: Column, outside: Column, at_edge: Column, confidence: Column, sure: float = 0.85) -> Column:
    """What kind of false positive a reviewed detection is. Null flags don't hold; a null confidence is a sure one."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    deleted = status == "delete"
    unsure = flag(at_edge) & (F.coalesce(confidence, F.lit(1.0)) < sure)
    return columns.first_match([
        (status == "correct", "not_fp"), (flag(seg_error), "segmentation_error"), (status == "edit", "boundary_editable"), (deleted & (flag(outside) | unsure), "uncertain_postproc"),
    ], "true_fp")


def hn_safety(status: Column, bucket: Column, outside: Column, true_dist2: Column, large_tile: Column, missed_near: Column, edited_tile: Column, near: int = NEAR_TRUE) -> Column:
    """Whether a deleted detection may be trained on as a negative, or the first reason why not. No distance is a far one."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return columns.first_match([
        (~status.eqNullSafe("delete"), "not_applicable"), (bucket == "segmentation_error", "exclude_seg_error"), (flag(outside), "exclude_postproc_artifact"),
        (flag(true_dist2 <= near * near), "exclude_near_true_panel"), (flag(large_tile), "exclude_large_array_context"), (flag(missed_near) | flag(edited_tile), "exclude_near_true_panel"),
    ], "safe_true_fp")


def rater_overlap(a: DataFrame, b: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """keys, bucket (shared, only_a, only_b), a_label, b_label of two raters, who have a row a key at most. Null keys meet each other."""
    left = a.select(*keys, F.col(label).alias("a_label"), F.lit(True).alias("_a"))
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(label).alias("b_label"), F.lit(True).alias("_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = left.join(right, same, "full_outer")
    bucket = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("shared")
    return met.select(*[F.when(F.col("_a"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], bucket.alias("bucket"), "a_label", "b_label")


def label_tables(met: DataFrame) -> DataFrame:
    """bucket, side, a_label, b_label, n of `rater_overlap`: ``agreement``, the matrix of shared keys; ``a`` and ``b``, each rater's labels by bucket; ``all``, keys by bucket."""
    shared = met.where("bucket = 'shared'").groupBy("bucket", "a_label", "b_label").agg(F.count("*").alias("n")).withColumn("side", F.lit("agreement"))
    none = F.lit(None).cast("string")
    one = met.where("bucket != 'only_b'").groupBy("bucket", "a_label").agg(F.count("*").alias("n")).withColumns({"side": F.lit("a"), "b_label": none})
    two = met.where("bucket != 'only_a'").groupBy("bucket", "b_label").agg(F.count("*").alias("n")).withColumns({"side": F.lit("b"), "a_label": none})
    whole = met.groupBy("bucket").agg(F.count("*").alias("n")).withColumns({"side": F.lit("all"), "a_label": none, "b_label": none})
    return shared.unionByName(one).unionByName(two).unionByName(whole).select("bucket", "side", "a_label", "b_label", "n")


def weak_label(present: Column, confidence: Column, quality: Column, positive: float = 0.3, negative: float = 0.2) -> Column:
    """What an unsure decision is good for; ``quality`` tells decisions that rest on a bad image."""
    return columns.first_match([
        (F.coalesce(quality, F.lit(False)), "skip_quality_shadow"), (confidence.isNull(), "skip_missing_confidence"), (present & (confidence >= positive), "weak_positive"), (present, "skip_low_conf_positive"),
        (~present & (confidence >= negative), "hard_negative_candidate"), (~present, "skip_low_conf_negative"),
    ], "skip_null_presence")


def truth_audit(triage: Column, truth_share: Column, has_truth: Column, most: float = 0.1, include_unaudited: bool = False) -> Column:
    """``triage`` after the look at ground truth: a hard negative goes if more than ``most`` of it is covered by one, and where its cell has none to look at."""
    hard = triage == "hard_negative_candidate"
    unaudited = F.lit(False) if include_unaudited else hard & ~F.coalesce(has_truth, F.lit(False))
    return F.when(hard & (F.coalesce(truth_share, F.lit(0.0)) > most), "drop_hn_gt_overlap").when(unaudited, "skip_hn_no_gt_available").otherwise(triage)
