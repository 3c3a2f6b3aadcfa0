"""Density topics with a noise label (E1): hierarchical density clustering of unit vectors over neighbour lists.

1. Equal vectors become one point with a weight. Each point gets its nearest points from an inverted file (neighbours.py).
2. The core distance of a point is the distance to its min_samples-th neighbour, copies counted; an edge of the lists weighs the
   largest of its length and its ends' core distances (mutual reachability).
3. Boruvka rounds over regions of the space contract the graph. In a region, edges are taken in order of weight. Two components
   below min_topic_size merge if no edge that leaves the region could have come first; one that reaches the size is a seed,
   born at that weight. A small component whose first edge leads to a seed falls to it at that weight. What must wait goes to
   the next round with larger regions: cells, then coarse cells, then everything. Edges that are the heaviest of a circle within
   a region are dropped. What the last round holds is the seeds, at most n / min_topic_size, and what could not be decided.
4. The minimum spanning tree of the seeds gives the condensed tree: its edges join topics of sufficient size. Points
   find the cluster that they fall to by jumps to their seed's 2^j-th ancestors. Stabilities are sums over points; the most
   stable clusters that do not contain each other are the topics.

Lists that hold all other points (probe and k large) give the exact hierarchy. Trees that the lists do not connect count as
joined at infinite distance. The root of a single tree is no topic, as everything lies in it.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litlens.operators import neighbours as NN
from litlens.operators.tables import cut, discard

#: Weights below this count as this: copies have no distance.
LEAST = 1e-6


class _Sets:
    """Union-find over hashable names; the root of a union is its smallest name."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a, b):
        a, b = sorted((a, b))
        self.up[b] = a
        return a


def contract(nodes: pd.DataFrame, edges: pd.DataFrame, least: int) -> tuple[list, list, list]:
    """One region. nodes: node, size, birth (null: below least). edges: a, b, w, inside, of which a lies in the region. Returns
    maps (node, comp, entry; entry null while undecided), components (comp, size, birth), edges (a, b, w, inside) with a as a
    component, and b too where it is inside."""
    size, birth = dict(zip(nodes["node"], nodes["size"], strict=True)), dict(zip(nodes["node"], nodes["birth"], strict=True))
    birth = {x: b for x, b in birth.items() if b == b and b is not None}
    comps, tree, blocked, members, entry = _Sets(), _Sets(), set(), {x: [x] for x in size}, {}
    hung = {}  # small component: the seed that it fell to
    kept = []

    def top(x):
        x = comps.find(x)
        while x in hung:
            x = comps.find(hung[x])
        return x

    low, high = np.minimum(edges["a"], edges["b"]), np.maximum(edges["a"], edges["b"])
    for i in np.lexsort((high, low, edges["w"])):
        a, b, w, inside = edges["a"].iat[i], edges["b"].iat[i], edges["w"].iat[i], edges["inside"].iat[i]
        if not inside:
            if (x := top(a)) not in birth:
                blocked.add(x)
            continue
        if tree.find(a) == tree.find(b):
            continue  # the heaviest edge of a circle, or seen from its other end
        tree.join(tree.find(a), tree.find(b))
        x, y = top(a), top(b)
        if y not in birth and (x in birth or x in blocked):
            x, y = y, x
        # x: a small one if there is any, one that is free if there is any
        if x in birth or x in blocked:
            kept.append((a, b, w))
        elif y in birth:
            hung[x] = y
            for m in members.pop(x):
                entry[m] = w
        elif y in blocked:
            # what y has joined outside is not known here; x can't come before it
            blocked.add(x)
            kept.append((a, b, w))
        else:
            z = comps.join(x, y)
            size[z] = size[x] + size[y]
            other = y if z == x else x
            members[z] += members.pop(other)
            if size[z] >= least:
                birth[z] = w
                for m in members[z]:
                    entry[m] = w
    maps = [(x, top(x), entry.get(x)) for x in nodes["node"]]
    alive = {c for _, c, _ in maps}
    found = [(c, int(size[c]), birth.get(c)) for c in alive]
    out = {}
    for a, b, w in kept:
        x, y = top(a), top(b)
        if x != y:
            pair = min(x, y), max(x, y)
            out[pair] = min(w, out.get(pair, math.inf))
    inner = [(x, y, w, True) for (x, y), w in out.items()]
    cross = {}
    for a, b, w in edges.loc[~edges["inside"].astype(bool), ["a", "b", "w"]].itertuples(index=False):
        pair = top(a), b
        cross[pair] = min(w, cross.get(pair, math.inf))
    return maps, found, inner + [(x, b, w, False) for (x, b), w in cross.items()]


_KINDS = "kind string, a long, b long, w double, size long, inside boolean"


def _region(nodes: pd.DataFrame, edges: pd.DataFrame, least: int) -> pd.DataFrame:
    maps, comps, kept = contract(nodes, edges, least)
    rows = [("map", n, c, w, None, None) for n, c, w in maps] + [("comp", c, None, b, n, None) for c, n, b in comps] + [("edge", a, b, w, None, i) for a, b, w, i in kept]
    out = pd.DataFrame(rows, columns=["kind", "a", "b", "w", "size", "inside"])
    return out.astype({"a": "Int64", "b": "Int64", "w": "float64", "size": "Int64", "inside": "boolean"})


def condensed(seeds: pd.DataFrame, edges: pd.DataFrame) -> list[tuple]:
    """(cluster, parent, formed, left, ups): the tree over seeds (node, birth). A seed is a leaf; a cluster of a negative number
    is made where two or more clusters come together that were there before. A seed that joins at the weight of its birth is no
    cluster: no point stays in it. left: the weight at which a cluster joins its parent, null for a root. ups: (ancestor, formed)
    at the 1st, 2nd, 4th, ... step up."""
    formed, parent, left = dict(zip(seeds["node"], seeds["birth"], strict=True)), {}, {}
    sets, cluster, made = _Sets(), {}, 0
    for w, some in edges.sort_values(["w", "a", "b"]).groupby("w"):
        met: dict = {}  # what comes together at this weight, by the root that it has so far
        for a, b in some[["a", "b"]].itertuples(index=False):
            x, y = sets.find(a), sets.find(b)
            if x != y:
                together = {*met.pop(x, (cluster.get(x, x),)), *met.pop(y, (cluster.get(y, y),))}
                met[sets.join(x, y)] = together
        for root, together in met.items():
            old = [c for c in together if formed[c] < w]
            if len(old) > 1:
                made += 1
                whole = -made
                formed[whole] = w
                for c in old:
                    parent[c], left[c] = whole, w
            else:  # one goes on, or all were born at this weight
                whole = old[0] if old else min(together)
            for c in together - {whole} - set(old):
                parent[c], left[c] = whole, w
            cluster[root] = whole
    up = {c: parent.get(c) for c in formed}
    ups: dict = defaultdict(list)
    while any(x is not None for x in up.values()):
        for c, x in up.items():
            if x is not None:
                ups[c].append((int(x), float(formed[x])))
        up = {c: None if x is None else up[x] for c, x in up.items()}
    return [(int(c), parent.get(c), float(f), left.get(c), ups[c]) for c, f in formed.items()]


def select(tree: pd.DataFrame, single: bool = False) -> list[tuple]:
    """(cluster, topic) of tree (cluster, parent, left, own_size, own_sum): topic is the selected cluster that holds it, or null.
    own_sum: the sum of 1 / weight of the points that fall to the cluster itself."""
    kids = defaultdict(list)
    for c, p in zip(tree["cluster"], tree["parent"], strict=True):
        if p == p and p is not None:
            kids[int(p)].append(int(c))
    rows = tree.set_index("cluster")
    roots = [int(c) for c, p in zip(tree["cluster"], tree["parent"], strict=True) if not (p == p and p is not None)]
    order, at = list(roots), 0
    while at < len(order):
        order += kids[order[at]]
        at += 1
    size, score, chosen = {}, {}, set()
    for c in reversed(order):
        own = rows.loc[c]
        size[c] = int(own["own_size"]) + sum(size[x] for x in kids[c])
        total = float(own["own_sum"]) + sum(size[x] / max(rows.loc[x, "left"], LEAST) for x in kids[c])
        birth = 1 / max(own["left"], LEAST) if own["left"] == own["left"] and own["left"] is not None else 0.0
        mine, theirs = total - size[c] * birth, sum(score[x] for x in kids[c])
        root = len(roots) == 1 and c == roots[0] and not single
        score[c] = theirs if root or (kids[c] and theirs > mine) else mine
        if not root and not (kids[c] and theirs > mine):
            chosen.add(c)
    topic: dict = {}
    for c in order:
        p = rows.loc[c, "parent"]
        above = topic.get(int(p)) if p == p and p is not None else None
        topic[c] = above if above is not None else c if c in chosen else None
    return list(topic.items())


def neighbour_edges(points: DataFrame, lists: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w) in both directions, by mutual reachability, of points (id, n) and their lists (query_id, id, score)."""
    length = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))
    each = lists.select(F.col("query_id").alias("a"), F.col("id").alias("b"), length.alias("d"), "rank").join(points.select(F.col("id").alias("b"), "n"), "b")
    entry = F.struct("rank", "d", "n")
    near = each.groupBy("a").agg(F.sort_array(F.collect_list(entry)).alias("near"))  # one list a point, of k entries
    # copies of the point itself are neighbours at distance 0
    walk = F.aggregate("near", F.struct((F.col("n") - 1).cast("long").alias("seen"), F.when(F.col("n") > min_samples, 0.0).alias("core"), F.lit(0.0).alias("last")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["core"], F.when(s["seen"] + x["n"] >= min_samples, x["d"])).alias("core"), x["d"].alias("last")))
    core = points.join(near, points["id"] == near["a"]).select("a", walk.alias("s")).select("a", F.coalesce("s.core", "s.last").alias("core"))
    both = each.select("a", "b", "d").unionByName(each.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    other = core.select(F.col("a").alias("b"), F.col("core").alias("core_b"))
    return both.join(core, "a").join(other, "b").select("a", "b", F.greatest("d", "core", "core_b", F.lit(LEAST)).alias("w"))


def density_topics(df: DataFrame, min_topic_size: int = 15, min_samples: int | None = None, k: int | None = None, probe: int = 12, target: int = 256, single: bool = False, seed: int = 5) -> DataFrame:
    """(id, topic) of df (id, embedding): topics from 0, the largest first (ties by smallest member), noise -1. Rows without a
    usable vector are left out. k: length of the neighbour lists (twice min_samples, at least 16, unless given)."""
    spark = df.sparkSession
    min_samples = min_samples or max(2, min(15, min_topic_size))
    k = k or max(16, 2 * min_samples)
    rows = cut(NN.unit_rows(df, "id", "embedding"))
    points = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    cells = NN.fit(points.select("id", "v"), target, seed)
    if cells is None:
        return spark.createDataFrame([], "id long, topic int")
    assigned = cut(NN.assign(points.select("id", "v"), cells))
    lists = NN.nearest(assigned, points.select("id", "v"), NN.measured(cells, assigned), k, probe)
    edges = cut(neighbour_edges(points, lists, min_samples).withColumn("w", F.round("w", 12)))
    places = assigned.select(F.col("id").alias("node"), "cell", "region")
    # a point of enough copies is a seed by itself
    big = F.col("n") >= min_topic_size
    at = points.select(F.col("id").alias("point"), F.col("n").alias("size"), F.col("id").alias("comp"), F.when(big, F.lit(LEAST)).alias("entry"))
    nodes = points.select(F.col("id").alias("node"), F.col("n").alias("size"), F.when(big, F.lit(LEAST)).alias("birth")).join(places, "node")
    for level in ("cell", "region", None):
        where = nodes.select("node", F.col(level) if level else F.lit(0)).toDF("node", "g")
        e = edges.join(where.toDF("a", "ga"), "a").join(where.toDF("b", "gb"), "b")
        e = e.select("a", "b", "w", (F.col("ga") == F.col("gb")).alias("inside"), F.col("ga").alias("g"))
        step = lambda n, x: _region(n, x, min_topic_size)
        done = cut(nodes.withColumn("g", F.col(level) if level else F.lit(0)).groupBy("g").cogroup(e.groupBy("g")).applyInPandas(step, _KINDS))
        moved = done.filter("kind = 'map'").select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("w").alias("entered"))
        old = at, edges, nodes
        late = at.filter("entry IS NULL").join(moved, at["comp"] == moved["node"]).select("point", "size", F.col("to").alias("comp"), F.col("entered").alias("entry"))
        at = cut(at.filter("entry IS NOT NULL").unionByName(late))
        comps = done.filter("kind = 'comp'").select(F.col("a").alias("node"), "size", F.col("w").alias("birth"))
        nodes = cut(comps.join(places, "node"))  # a component lies where the point lies that it is named after
        kept = done.filter("kind = 'edge'")
        inner = kept.filter("inside").select("a", "b", "w")
        ends = moved.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        outer = kept.filter("NOT inside").select("a", "b", "w").join(ends, "b").select("a", F.col("b2").alias("b"), "w").filter("a <> b")
        one = inner.unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).unionByName(outer)
        edges = cut(one.groupBy("a", "b").agg(F.min("w").alias("w")))
        discard(*old, done)
    # the seeds' tree: at most n / min_topic_size of them
    grow = lambda s, x: pd.DataFrame(condensed(s, x), columns=["cluster", "parent", "formed", "left", "ups"]).astype({"parent": "Int64", "left": "float64"})
    seeds = nodes.filter("birth IS NOT NULL").select("node", "birth", F.lit(0).alias("g"))
    tree = cut(seeds.groupBy("g").cogroup(edges.filter("a < b").withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(grow, "cluster long, parent long, formed double, left double, ups array<struct<c: long, f: double>>"))
    falls = at.filter("entry IS NOT NULL").select("point", "size", F.col("comp").alias("cluster"), "entry")
    for j in reversed(range(tree.agg(F.coalesce(F.max(F.size("ups")), F.lit(0))).first()[0])):
        jump = tree.select("cluster", F.get("ups", F.lit(j)).alias("to"))
        falls = falls.join(jump, "cluster", "left").select("point", "size", F.when(F.col("to.f") <= F.col("entry"), F.col("to.c")).otherwise(F.col("cluster")).alias("cluster"), "entry")
    falls = cut(falls)
    own = falls.groupBy("cluster").agg(F.sum("size").alias("own_size"), F.sum(F.col("size") / F.greatest(F.col("entry"), F.lit(LEAST))).alias("own_sum"))
    weighed = tree.join(own, "cluster", "left").select("cluster", "parent", "left", F.coalesce("own_size", F.lit(0)).alias("own_size"), F.coalesce("own_sum", F.lit(0.0)).alias("own_sum"), F.lit(0).alias("g"))
    pick = lambda t: pd.DataFrame(select(t, single), columns=["cluster", "chosen"]).astype({"chosen": "Int64"})
    chosen = weighed.groupBy("g").applyInPandas(pick, "cluster long, chosen long")
    labelled = falls.join(chosen, "cluster").select("point", "chosen")
    member = cut(rows.join(points.select("v", F.col("id").alias("point")), "v").select("id", "point").join(labelled, "point", "left").select("id", "chosen"))
    sizes = member.filter("chosen IS NOT NULL").groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    names = sizes.select("chosen", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("topic"))  # a row a topic
    return member.join(names, "chosen", "left").select("id", F.coalesce("topic", F.lit(-1)).cast("int").alias("topic"))
