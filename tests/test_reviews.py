"""Review rules, raters, names, windows and masks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from rooftally.operators import decisions, names, windows


def test_fp_buckets_and_safety(spark):
    rows = [
        ("correct", True, True, True, 0.1, 0, True, True, True, "not_fp", "not_applicable"), ("delete", True, False, False, 0.9, None, None, None, None, "segmentation_error", "exclude_seg_error"),
        ("edit", False, True, True, 0.1, None, False, False, False, "boundary_editable", "not_applicable"), ("delete", False, True, None, None, None, None, None, None, "uncertain_postproc", "exclude_postproc_artifact"),
        ("delete", None, None, True, 0.84, 3600, False, False, False, "uncertain_postproc", "exclude_near_true_panel"), ("delete", None, None, True, None, 3601, True, True, False, "true_fp", "exclude_large_array_context"),
        ("delete", False, False, False, 0.1, None, False, True, False, "true_fp", "exclude_near_true_panel"), ("delete", False, False, False, 0.1, None, None, None, True, "true_fp", "exclude_near_true_panel"),
        ("delete", False, False, True, 0.85, 10_000, False, False, False, "true_fp", "safe_true_fp"), (None, None, None, None, None, None, None, None, None, "true_fp", "not_applicable"),
    ]
    df = spark.createDataFrame(rows, "s string, seg boolean, o boolean, e boolean, c double, d long, l boolean, m boolean, t boolean, bucket string, safety string")
    c = F.col
    got = df.withColumn("b", decisions.fp_bucket(c("s"), c("seg"), c("o"), c("e"), c("c"))).withColumn("h", decisions.hn_safety(c("s"), c("b"), c("o"), c("d"), c("l"), c("m"), c("t")))
    assert [(r.b, r.h) for r in got.collect()] == [r[-2:] for r in rows]


def test_raters(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (None, "x")], "k int, label string")
    b = spark.createDataFrame([(1, "x"), (2, "x"), (4, "z"), (None, "y")], "k int, label string")
    met = decisions.rater_overlap(a, b, ["k"])
    assert sorted(map(tuple, met.collect()), key=str) == sorted([(1, "shared", "x", "x"), (2, "shared", "y", "x"), (3, "only_a", None, None), (4, "only_b", None, "z"), (None, "shared", "x", "y")], key=str)
    told = {(r.bucket, r.side, r.a_label, r.b_label): r.n for r in decisions.label_tables(met).collect()}
    assert told[("shared", "all", None, None)] == 3 and told[("shared", "agreement", "y", "x")] == 1 and told[("shared", "a", "x", None)] == 2 and told[("only_b", "b", None, "z")] == 1
    assert decisions.label_tables(decisions.rater_overlap(a.limit(0), b.limit(0), ["k"])).count() == 0


def test_weak_labels_and_the_look_at_truth(spark):
    rows = [(True, 0.3, False, "weak_positive"), (True, 0.29, None, "skip_low_conf_positive"), (False, 0.2, False, "hard_negative_candidate"), (False, 0.1, False, "skip_low_conf_negative"), (None, 0.9, False, "skip_null_presence"), (True, None, False, "skip_missing_confidence"), (True, 0.9, True, "skip_quality_shadow")]
    df = spark.createDataFrame(rows, "p boolean, c double, q boolean, want string")
    assert df.where(decisions.weak_label(F.col("p"), F.col("c"), F.col("q")) != F.col("want")).count() == 0
    audit = spark.createDataFrame([("hard_negative_candidate", 0.11, True, "drop_hn_gt_overlap"), ("hard_negative_candidate", 0.1, True, "hard_negative_candidate"), ("hard_negative_candidate", None, None, "skip_hn_no_gt_available"), ("weak_positive", 0.9, None, "weak_positive")], "t string, s double, h boolean, want string")
    assert audit.where(decisions.truth_audit(F.col("t"), F.col("s"), F.col("h")) != F.col("want")).count() == 0
    assert audit.select(decisions.truth_audit(F.col("t"), F.col("s"), F.col("h"), include_unaudited=True).alias("r")).collect()[2].r == "hard_negative_candidate"


def test_names(spark):
    df = spark.createDataFrame([("a/b/G1238_SAM2_260320.gpkg",), ("JHB01.gpkg",), ("x_G1238.gpkg",), ("",), (None,), ("noext",), ("dir/v1.2/",)], "p string")
    stem = names.file_stem(F.col("p"))
    got = [tuple(r) for r in df.select(stem.alias("s"), names.part(stem, "(JHB[0-9]{2}|G[0-9]{4})", whole=True).alias("g"), names.part(stem, "_([0-9]{6})$").alias("v")).collect()]
    assert got == [("G1238_SAM2_260320", "G1238", "260320"), ("JHB01", "JHB01", None), ("x_G1238", None, None), ("", None, None), (None, None, None), ("noext", None, None), ("v1", None, None)]
    runs = spark.createDataFrame([("New4_aerial/benchmark_x_OLD", None), ("new4", "ck"), (None, "CK-new4"), ("plain", ""), ("benchmark_x_unknown_tag", "new4")], "r string, c string")
    family = names.family(F.col("r"), F.col("c"), [("new4", "new"), ("old", "old")], tagged="benchmark_", tags={"old": "tagged old"})
    assert [r[0] for r in runs.select(family).collect()] == ["tagged old", "new", "new", "other", "new"]


@pytest.mark.parametrize("mode", windows.MODES)
def test_windows(spark, mode):
    widths = [0, 1, 63, 64, 100, 127, 128, 129, 192, 224, 225, 320, 1000, None]

    def want(n, size=128, step=96):
        if not n:
            return []
        if mode == "training":
            return [x for x in range(0, n, step) if min(size, n - x) >= size // 2]
        if mode == "anchored":
            whole = [0] if n <= size else list(range(0, n - size + 1, step))
            return whole + [n - size] * (n > size and whole[-1] + size < n)
        before = [c * step for c in range((n - 1) // step)]
        return before + [n - size] if n > size else before or [0]

    df = spark.createDataFrame([(w,) for w in widths], "width int").withColumn("o", windows.origins(F.col("width"), 128, 0.25, mode))
    assert {r.width: r.o for r in df.collect()} == {w: want(w) for w in widths}
    cut = windows.chip_windows(spark.createDataFrame([(130, 100)], "width int, height int"), 128, 0.25, mode).collect()
    assert all(r.x + r.w <= 130 and r.y + r.h <= 100 and r.h == 100 for r in cut) and {r.x for r in cut} == set(want(130))


def test_wrong_windows():
    for size, overlap, mode in ((0, 0.1, "training"), (10, 1.0, "training"), (10, 0.95, "anchored"), (10, 0.1, "other")):
        with pytest.raises(ValueError):
            windows.origins(F.lit(1), size, overlap, mode)


def test_tile_mask(spark):
    tiles = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 2, 0), ("b", 3, 3)], "k string, i int, j int")
    got = {(r.k, r.i, r.j): (r.ring, r.reason) for r in windows.tile_mask(tiles, ["k"], 1, 4, 4).collect()}
    assert got == {("a", 0, 0): (0, "building"), ("a", 2, 0): (0, "building"), ("a", 1, 0): (1, "buffer_1"), ("a", 0, 1): (1, "buffer_1"), ("a", 2, 1): (1, "buffer_1"), ("a", 3, 0): (1, "buffer_1"), ("b", 3, 3): (0, "building"), ("b", 2, 3): (1, "buffer_1"), ("b", 3, 2): (1, "buffer_1")}
    assert windows.tile_mask(tiles, ["k"], 0, 4, 4).count() == 3 and windows.tile_mask(tiles.limit(0), ["k"], 2, 4, 4).count() == 0
