"""One hierarchy of similar clusters for all merge thresholds: a spanning forest by Boruvka rounds, cut where it is asked.

Two clusters are merged at a threshold if a chain of pairs, each at least that similar, leads from one to the other. Such chains
need only the edges of a maximum spanning forest, so the forest is made once, for the lowest threshold. Every step is a join or
an aggregation over edges; the loops run over rounds, of which there are about as many as doublings of the cluster count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlens.operators.tables import cut, discard


def forest(edges: DataFrame) -> DataFrame:
    """(a, b, score): the edges of a maximum spanning forest of (a, b, score), a < b. Equal scores go by (a, b)."""
    edges = cut(edges.select("a", "b", "score"))
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    where, out = ends.select("node", F.col("node").alias("comp")), edges.limit(0)
    while True:
        of = lambda x: where.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
        left = cut(edges.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb"))
        if left.isEmpty():
            return out
        both = left.select("ca", "cb", "a", "b", "score").unionByName(left.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "a", "b", "score"))
        order = F.struct("score", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), "a", "b", "cb")
        best = cut(both.groupBy("ca").agg(F.max(order).alias("e")).select("ca", "e.a", "e.b", "e.score", F.col("e.cb").alias("up")))
        out = cut(out.unionByName(best.select("a", "b", "score")).distinct())
        # of two components that chose each other the smaller one stays
        other = best.select(F.col("ca").alias("up"), F.col("up").alias("back"))
        roots = best.select("ca", "up").join(other, "up").select("ca", F.when((F.col("back") == F.col("ca")) & (F.col("ca") < F.col("up")), F.col("ca")).otherwise(F.col("up")).alias("up"))
        roots = cut(roots)
        while True:
            above = roots.select(F.col("ca").alias("up"), F.col("up").alias("top"))
            more = cut(roots.join(above, "up").select("ca", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            done = more.filter("moved").isEmpty()
            discard(roots)
            roots = more.select("ca", "up")
            if done:
                break
        where = cut(where.join(roots, where["comp"] == roots["ca"], "left").select("node", F.coalesce("up", "comp").alias("comp")))
        edges = left.select("a", "b", "score")


def components(edges: DataFrame) -> DataFrame:
    """(g, node, label): the smallest node of each component of the edges (g, a, b) of every graph g."""
    both = cut(edges.select("g", "a", "b").unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.select("g", F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(label.select("g", F.col("node").alias("b"), "label"), ["g", "b"]).groupBy("g", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = label.join(near, ["g", "node"]).select("g", "node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        above = low.select("g", F.col("node").alias("low"), F.col("low").alias("top"))
        new = cut(low.join(above, ["g", "low"]).select("g", "node", F.least("low", "top").alias("label"), (F.least("low", "top") != F.col("was")).alias("moved")))
        done = new.filter("moved").isEmpty()
        discard(label)
        label = new.select("g", "node", "label")
        if done:
            return label


def cuts(tree: DataFrame, thresholds: list[tuple[int, float]]) -> DataFrame:
    """(g, node, label) of a forest (a, b, score) cut at each threshold, given as (g, threshold). Nodes without an edge above it
    are not there."""
    asked = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(float(t)).alias("t")) for g, t in thresholds])
    kept = tree.select("a", "b", "score", F.explode(asked).alias("x")).filter(F.col("score") >= F.col("x.t"))
    return components(kept.select("x.g", "a", "b"))
