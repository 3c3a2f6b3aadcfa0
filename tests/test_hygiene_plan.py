"""The cleaning path sorts no texts and stores none that can be put together from others."""

from litlens.operators import hygiene as H
from litlens.plans.base import articles


def test_texts_are_hashed_and_stored_once(spark, sf, monkeypatch):
    seen, real = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df: seen.append(df) or real(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = H.clean_papers(articles(spark, sf))
        told = next(df for df in seen if {"abstract", "duplicate_reason"} <= set(df.columns))
        plan = told._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ShuffledHashJoin" in plan
    assert "abstract_clean" in seen[-1].columns and "embedding_text" not in seen[-1].columns and "embedding_text" in done.clean.columns


def test_texts_are_read_once_for_all_keys(spark, sf):
    """C14 and C15 read a table of keys; rows without a key meet no join."""
    from litlens.plans import registry

    for name in ("c14_dedupe_ids", "c15_dedupe_titles"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "abstract" not in plan and "documents.parquet" not in plan and "regexp" not in plan


def test_rows_without_a_key_stay(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, " ", "x"), (5, "b", "y")]
    kept, dups = H.dedupe_ids(spark.createDataFrame(rows, "id long, k string, l string"), ("k", "l"))
    assert sorted(r[0] for r in kept.select("id").collect()) == [1, 3, 5]
    assert sorted((r[0], r[1]) for r in dups.select("id", "duplicate_reason").collect()) == [(2, "duplicate_k"), (4, "duplicate_l")]
