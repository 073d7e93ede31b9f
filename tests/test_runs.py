"""Queries without SQL that go over all runs."""

import pytest

from rooftally.plans import graphs, more


@pytest.mark.parametrize("query", [more.f9_dissolve_hairline, more.f12_overlap_clusters, graphs.f13_cluster_metrics])
def test_all_runs(spark, query):
    runs = {r.model_run for r in query(spark, "/root/testdata/sf0.001").select("model_run").distinct().collect()}
    assert runs == {"run_A", "run_B", "run_C"}
