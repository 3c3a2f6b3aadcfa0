"""Maximum-inner-product search with one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of a bounded size by a hash of their content. Inner products become distances by one added
component sqrt(M^2 - |v|^2), M being the largest norm of the corpus, so that the nearest neighbour is the largest product.
A shard's graph has geometric levels; on each, a node keeps diverse near neighbours (a neighbour is passed over when a kept
one is closer to it than the node is), links go both ways up to a fixed degree, and the graph is stored as flat arrays:
members, offsets and neighbours per level. As a shard is bounded, a node's candidates come from exact distances in the
shard, block by block. Beside them stand long links, the nearest members of ever smaller random
parts of the level, as an insertion would leave them. A search runs a beam of width `ef` on every level, for a block of
queries at once. The shards' results are merged by score.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query nor
as candidate; rows of one vec_id count once (the smallest vector in array order); equal vectors are one node that carries
its k + 1 smallest ids (larger ids of the same vector can never be among k nearest with ties to smaller ids); vectors of
differing length raise an error; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.llm.common import checkpoint, read_table

#: Most vectors of a shard, on average; neighbours per node above and on the lowest level; queries per block.
SHARD, DEGREE, DEGREE0, BLOCK = 16_384, 16, 32, 512


def _diverse(near: np.ndarray, dist: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """near, dist: candidates of each node, nearest first. Positions of up to m diverse ones each, -1 behind; passed-over
    candidates fill what is left, nearest first."""
    n, c = near.shape
    v = x[near]
    sq = (v**2).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.einsum("nid,njd->nij", v, v, optimize=True)
    keep = np.zeros((n, c), bool)
    for j in range(c):
        worse = (keep[:, :j] & (between[:, j, :j] < dist[:, j, None])).any(1) if j else np.zeros(n, bool)
        keep[:, j] = ~worse & (keep.sum(1) < m) & (near[:, j] >= 0)
    order = np.argsort(~keep, axis=1, kind="stable")[:, :m]
    return np.take_along_axis(near, order, 1)


def _far(d: np.ndarray, near: np.ndarray, parts: list[np.ndarray], y: np.ndarray, m: int) -> np.ndarray:
    """m diverse long links of each row of distances d: from the nearest members of each part that are not among near."""
    d = d.copy()
    np.put_along_axis(d, near, np.inf, 1)
    found = []
    for part in parts:
        e = d[:, part]
        c = min(8, len(part))
        found.append(part[np.argpartition(e, c - 1, axis=1)[:, :c]])
    at = np.concatenate(found, 1)
    dist = np.take_along_axis(d, at, 1)
    again = np.sort(at, axis=1)
    if (again[:, 1:] == again[:, :-1]).any():  # a member of two parts counts once
        o = np.argsort(at, axis=1, kind="stable")
        s = np.take_along_axis(at, o, 1)
        twice = np.zeros(at.shape, bool)
        np.put_along_axis(twice, o[:, 1:], s[:, 1:] == s[:, :-1], 1)
        dist = np.where(twice, np.inf, dist)
    at = np.where(np.isinf(dist), -1, at)
    order = np.argsort(dist, axis=1, kind="stable")
    at, dist = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
    return np.concatenate([_diverse(at[b : b + 128], dist[b : b + 128], y, m) for b in range(0, len(at), 128)])


def _level(x: np.ndarray, members: np.ndarray, m: int, width: int) -> np.ndarray:
    """Neighbour array [len(members), m] (numbers of nodes, -1: none) of one level."""
    n = len(members)
    out = np.full((n, m), -1, np.int32)
    if n < 2:
        return out
    y, c = x[members], min(width, n - 1)
    sq = (y**2).sum(1)
    half = m // 2 if m > 2 else m
    far = half // 4
    # what an insertion of the nodes in a mixed order would have seen: ever smaller parts of the level
    mixed, parts = np.random.default_rng(n).permutation(n), []
    while (size := n >> 2 * (len(parts) + 1)) >= 16:
        parts.append(mixed[:size])
    lists: list[np.ndarray] = []
    for a in range(0, n, 512):
        d = sq[a : a + 512, None] + sq[None] - 2 * (y[a : a + 512] @ y.T)
        rows = np.arange(len(d))
        d[rows, rows + a] = np.inf
        at = np.argpartition(d, c - 1, axis=1)[:, :c] if c < n else np.argsort(d, axis=1)[:, :c]
        dist = np.take_along_axis(d, at, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        at, dist = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
        links = np.concatenate([_diverse(at[b : b + 128], dist[b : b + 128], y, half - far if parts else half) for b in range(0, len(at), 128)])
        if parts:
            links = np.concatenate([links, _far(d, at, parts, y, far)], 1)
        lists.append(links)
    own = np.concatenate(lists)
    out[:, : own.shape[1]] = own
    # links back, in the order of the sources, while the degree lasts
    src, dst = np.repeat(np.arange(n), own.shape[1]), own.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    start = np.searchsorted(dst, np.arange(n))
    rank = np.arange(len(dst)) - start[dst]
    fits = rank < m - own.shape[1]
    out[dst[fits], own.shape[1] + rank[fits]] = src[fits]
    return np.where(out >= 0, members[np.maximum(out, 0)], -1).astype(np.int32)


def build(x: np.ndarray, seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(members, neighbours) per level, lowest first."""
    n = len(x)
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
    members, links = [], []
    for level in range(height.max(initial=0) + 1):
        at = np.flatnonzero(height >= level).astype(np.int32)
        members.append(at)
        links.append(_level(x, at, DEGREE if level else DEGREE0, 2 * (DEGREE if level else DEGREE0)))
    return members, links


def search(q: np.ndarray, x: np.ndarray, members: list[np.ndarray], links: list[np.ndarray], ef: int, seeds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (nodes, products) [queries, ef], best first, -1 where there are fewer."""
    nq, n = len(q), len(x)
    start = np.broadcast_to(members[-1][:seeds], (nq, len(members[-1][:seeds]))).astype(np.int32)
    for at, near in zip(members[::-1], links[::-1], strict=True):
        row = np.full(n, -1, np.int32)
        row[at] = np.arange(len(at))
        start, vals = _beam(q, x, row, near, start, ef)
    return start, vals


def _beam(q: np.ndarray, x: np.ndarray, row: np.ndarray, near: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on one level (row: each node's row of near) from start, a row of nodes for each query, -1 for none."""
    nq, n = len(q), len(x)
    score = np.where(start >= 0, np.einsum("qd,qmd->qm", q, x[np.maximum(start, 0)]), -np.inf)
    nodes = np.full((nq, ef), -1, np.int32)
    vals = np.full((nq, ef), -np.inf, x.dtype)
    done = np.ones((nq, ef), bool)
    seen = np.zeros((nq, n + 1), bool)  # -1 marks the last column
    k = min(ef, start.shape[1])
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    nodes[:, :k], vals[:, :k] = np.take_along_axis(start, order, 1), np.take_along_axis(score, order, 1)
    done[:, :k] = nodes[:, :k] < 0
    np.put_along_axis(seen, start.astype(np.int64), True, 1)
    seen[:, n] = True
    live = np.arange(nq)
    while len(live):
        open_ = ~done[live]
        first = open_.argmax(1)
        go = open_[np.arange(len(live)), first]
        live, first = live[go], first[go]
        if not len(live):
            break
        done[live, first] = True
        cand = near[row[nodes[live, first]]].astype(np.int64)
        new = ~seen[live[:, None], cand] & (cand >= 0)
        # a node may stand twice in a list (own link and link back)
        srt = np.sort(cand, axis=1)
        if (srt[:, 1:] == srt[:, :-1]).any():
            o = np.argsort(cand, axis=1, kind="stable")
            s = np.take_along_axis(cand, o, 1)
            dup = np.zeros_like(new)
            np.put_along_axis(dup, o[:, 1:], s[:, 1:] == s[:, :-1], 1)
            new &= ~dup
        seen[live[:, None], np.where(cand >= 0, cand, n)] = True
        s = np.where(new, np.einsum("qd,qmd->qm", q[live], x[np.maximum(cand, 0)]), -np.inf)
        allv, alln = np.concatenate([vals[live], s], 1), np.concatenate([nodes[live], np.where(new, cand, -1).astype(np.int32)], 1)
        alld = np.concatenate([done[live], ~new], 1)
        o = np.argsort(-allv, axis=1, kind="stable")[:, :ef]
        vals[live], nodes[live], done[live] = np.take_along_axis(allv, o, 1), np.take_along_axis(alln, o, 1), np.take_along_axis(alld, o, 1)
    return nodes, vals


def _pack(frame: pd.DataFrame, bound: float) -> dict:
    """One shard as flat arrays of bytes."""
    v = np.array(frame["vector"].tolist(), np.float64)
    lift = np.sqrt(np.maximum(bound**2 - (v**2).sum(1), 0))
    x = np.concatenate([v, lift[:, None]], 1).astype(np.float32)
    members, links = build(x)
    ids = frame["ids"].tolist()
    return {
        "vectors": v.tobytes(), "lifted": x.tobytes(), "ids": np.concatenate(ids).astype(np.int64).tobytes(), "n_ids": np.array([len(i) for i in ids], np.int32).tobytes(),
        "members": np.concatenate(members).tobytes(), "sizes": np.array([len(m) for m in members], np.int32).tobytes(), "links": np.concatenate([a.ravel() for a in links]).tobytes(),
    }


def _graph(row: dict) -> tuple:
    sizes = np.frombuffer(row["sizes"], np.int32)
    flat, at = np.frombuffer(row["members"], np.int32), np.r_[0, np.cumsum(sizes)]
    members = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    links, all_links, a = [], np.frombuffer(row["links"], np.int32), 0
    for level, n in enumerate(sizes):
        m = DEGREE if level else DEGREE0
        links.append(all_links[a : a + n * m].reshape(n, m))
        a += n * m
    n = sizes[0]
    return np.frombuffer(row["vectors"], np.float64).reshape(n, -1), np.frombuffer(row["lifted"], np.float32).reshape(n, -1), members, links, np.split(np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["n_ids"], np.int32))[:-1])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector array<double>): the rows that take part, one per id."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("vector")).filter("id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("vector").alias("vector"))


def index(rows: DataFrame, k: int = 20, shard_size: int = SHARD) -> DataFrame:
    """One row per shard of usable(): shard and the flat arrays of its graph."""
    w = Window.partitionBy("vector").orderBy("id")
    small = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k + 1)
    nodes = small.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    n, dims, most, bound = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector")), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if n and dims != most:
        raise ValueError(f"vectors of {dims} to {most} components")
    shards = max(1, -(-n // shard_size))
    bound = float(bound or 0.0)
    fields = "shard long, vectors binary, lifted binary, ids binary, n_ids binary, members binary, sizes binary, links binary"

    def one(key, frame):
        return pd.DataFrame([{"shard": key[0]} | _pack(frame.sort_values("ids", key=lambda c: c.map(lambda i: i[0])), bound)])

    return nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))).groupBy("shard").applyInPandas(one, fields)


def nearest(queries: DataFrame, graphs: DataFrame, k: int = 20, ef: int = 96) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (id, vector) against all shards of index()."""
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // BLOCK)))))
    shards = [r[0] for r in graphs.select("shard").collect()]  # numbers only, one per 16,384 vectors
    spread = blocks.withColumn("shard", F.explode(F.array(*[F.lit(s).cast("long") for s in shards]) if shards else F.expr("cast(array() as array<bigint>)")))
    packed = spread.groupBy("shard", "block").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                v, x, members, links, ids = _graph(row)
                qid = np.array([r["id"] for r in row["queries"]], np.int64)
                q = np.array([r["vector"] for r in row["queries"]], np.float64)
                for a in range(0, len(q), BLOCK):
                    lifted = np.concatenate([q[a : a + BLOCK], np.zeros((len(q[a : a + BLOCK]), 1))], 1).astype(np.float32)
                    nodes, _ = search(lifted, x, members, links, ef)
                    out = []
                    for i, found in enumerate(nodes):
                        found = found[found >= 0]
                        score = np.array([np.dot(v[f], q[a + i]) for f in found])
                        for f, s in zip(found, score, strict=True):
                            out += [(qid[a + i], int(c), float(s)) for c in ids[f] if c != qid[a + i]]
                    got = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                    yield got.groupby("query_id").head(k)

    found = packed.join(graphs, "shard").mapInPandas(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    graphs = checkpoint(index(rows))
    return nearest(rows.filter("id % 20 = 0"), graphs)
