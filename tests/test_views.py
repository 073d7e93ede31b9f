"""Views over tables whose keys are as large as in large tables."""

import pytest
from pyspark.sql import functions as F

from rooftally.plans import audits, finals, graphs, more, overlays, sweeps
from rooftally.sources.views import view

SF, MORE = "/root/testdata/sf0.001", 50_000_000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    for name in ("region", "nation", "supplier", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "lineitem":
            rows = rows.withColumn("l_orderkey", F.col("l_orderkey") + MORE)
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ids_beyond_a_long(spark, large):
    """Their lowest 63 bits, still one a box; ids that a long holds stay as they are."""
    whole = lambda r, more: ((((r.l_orderkey + more) * 8 + r.l_linenumber) * 100000 + r.l_partkey) * 10000 + r.l_suppkey) * 100 + int(r.l_quantity)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    known = [r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()]
    lines = [r for r in lines if r.l_suppkey in known]
    assert sorted(r.poly_id for r in view(spark, SF, "predictions").collect()) == sorted(whole(r, 0) for r in lines)
    ids = sorted(r.poly_id for r in view(spark, large, "predictions").collect())
    assert min(whole(r, MORE) for r in lines) > 2**63 and ids == sorted(whole(r, MORE) % 2**63 for r in lines) and len(set(ids)) == len(lines)
    assert {r.gt_id for r in view(spark, large, "ground_truth").collect()} < set(ids)


@pytest.mark.parametrize("query", [
    audits.h11_pr_curve, overlays.f2_ring_match_merge, graphs.f13_cluster_metrics, more.f9_dissolve_hairline, sweeps.h24_param_sweep,
    finals.f20_sym_match, finals.e8_gt_dissolve, overlays.e4_ring_gt_covered, finals.g9_finalize, finals.g9_finalize_parity])
def test_queries_take_large_keys(spark, large, query):
    """They ended with an overflow of the ids."""
    assert query(spark, large).count() > 0
