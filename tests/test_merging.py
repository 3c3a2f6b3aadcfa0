"""Spanning forests, their cuts and pairs by cells against brute force."""

import numpy as np
from pyspark.sql import functions as F

from litlens.operators import merging as M
from litlens.operators import neighbours as NN
from litlens.operators import topics as E


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(3)


def labels(n, edges):
    own = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(own[a], own[b])
            changed |= own[a] != low or own[b] != low
            own[a] = own[b] = low
    return own


def test_pairs_forest_and_cuts(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.5 * rng.normal(size=(20, 8)) for c in rng.normal(size=(9, 8))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    pairs = NN.pairs_within(NN.unit_rows(frame(spark, x), "id", "embedding"), 0.6, target=16)
    got = {(r["a"], r["b"]): r["score"] for r in pairs.collect()}
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if sims[a, b] >= 0.6}
    assert set(got) == want and all(abs(s - sims[a, b]) < 1e-12 for (a, b), s in got.items())
    tree = M.forest(pairs)
    edges = [(r["a"], r["b"], r["score"]) for r in tree.collect()]
    own, best = list(range(len(x))), []
    for (a, b), s in sorted(got.items(), key=lambda e: (-e[1], e[0])):  # Kruskal
        if own[a] != own[b]:
            own = [own[a] if o == own[b] else o for o in own]
            best.append((a, b, s))
    assert sorted(edges) == sorted(best)
    cut = {}
    for r in M.cuts(tree, [(0, 0.6), (1, 0.8), (2, 0.95)]).collect():
        cut.setdefault(r["g"], {})[r["node"]] = r["label"]
    for g, t in ((0, 0.6), (1, 0.8), (2, 0.95)):
        whole = labels(len(x), [p for p, s in got.items() if s >= t])
        assert [cut.get(g, {}).get(i, i) for i in range(len(x))] == whole
    assert M.forest(pairs.limit(0)).count() == 0 and NN.pairs_within(NN.unit_rows(frame(spark, x[:0]), "id", "embedding"), 0.5).count() == 0


def test_many_centroids_by_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    rows = NN.unit_rows(frame(spark, x), "id", "embedding")
    centres = spark.createDataFrame([(i, [float(v) for v in c / np.linalg.norm(c)]) for i, c in enumerate(rng.normal(size=(40, 6)))], "cluster_id int, centroid array<double>")
    few = sorted(map(tuple, E.nearest_centroid(rows, centres).withColumn("similarity", F.round("similarity", 9)).collect()))
    monkeypatch.setattr(E, "MOST_CENTROIDS", 10)
    assert few == sorted(map(tuple, E.nearest_centroid(rows, centres).withColumn("similarity", F.round("similarity", 9)).select("id", "nearest", "similarity").collect()))
