"""Equal scores whose sums differ in their last digits are one value."""

from litlens.operators import search as G


def test_last_digits_are_no_range(spark):
    noisy = [(0.1 + 0.2) + 0.3, 0.1 + (0.2 + 0.3)]
    assert noisy[0] != noisy[1]
    rows = [(1, i, 0.5, s) for i, s in enumerate(noisy)] + [(2, 0, 0.5, 1.0), (2, 1, 0.5, 1.5), (2, 2, 0.5, None)]
    merged = spark.createDataFrame(rows, "query_id int, id long, vector_score double, bm25_score double")
    got = {(r["query_id"], r["id"]): round(r["fusion_score"], 9) for r in G.fuse_weighted(merged).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (2, 0): 0.65, (2, 1): 1.0, (2, 2): 0.65}
