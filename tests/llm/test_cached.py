from rooftally.llm import decontamination


def test_contamination_leaves_no_cached_frames(spark):
    """A session that calls it often must not keep the plans of all calls, nor nest them."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "other words"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", text[:100])], "item_id string, text string")
    got = decontamination.contamination(docs, "doc_id", "text", items, "item_id", "text")
    assert sorted((r.id, r.contaminated) for r in got.collect()) == [(1, True), (2, False), (3, False)]
    assert "InMemoryRelation" not in got._jdf.queryExecution().withCachedData().toString()
