"""Density topics against a plain hierarchical density clustering, and the inverted file against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from litlens.operators import density, neighbours


def rand_index(a, b):
    """Adjusted Rand index."""
    pairs, left, right = defaultdict(int), defaultdict(int), defaultdict(int)
    for x, y in zip(a, b, strict=True):
        pairs[x, y] += 1
        left[x] += 1
        right[y] += 1
    two = lambda d: sum(v * (v - 1) / 2 for v in d.values())
    expected = two(left) * two(right) / (len(a) * (len(a) - 1) / 2)
    most = (two(left) + two(right)) / 2
    return 1.0 if most == expected else (two(pairs) - expected) / (most - expected)


def naive(x, least, samples):
    """Labels by the full matrix of mutual reachability: the hierarchy is walked from the top, splits of two sufficient parts
    make clusters, the more stable of a cluster and its children stay."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, samples]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    w = np.round(w, 12)
    # Prim
    n, seen, edges = len(x), [0], []
    best, of = w[0].copy(), np.zeros(len(x), int)
    left = set(range(1, n))
    while left:
        j = min(left, key=lambda i: best[i])
        edges.append((best[j], of[j], j))
        left.remove(j)
        nearer = w[j] < best
        best, of = np.where(nearer, w[j], best), np.where(nearer, j, of)
    label = np.full(n, -1)
    count = [0]

    def parts(points, some):
        near = defaultdict(list)
        for _, a, b in some:
            near[a].append(b)
            near[b].append(a)
        todo, out = set(points), []
        while todo:
            stack, part = [next(iter(todo))], set()
            while stack:
                p = stack.pop()
                if p not in part:
                    part.add(p)
                    stack += near[p]
            out.append(part)
            todo -= part
        return out

    def walk(points, birth, root):
        """(stability of the best choice below, list of chosen point sets)"""
        live, total, whole = set(points), 0.0, set(points)
        some = sorted(e for e in edges if e[1] in live and e[2] in live)
        while some:
            top = some[-1][0]
            lam = 1 / top
            some = [e for e in some if e[0] < top]
            cut = [p for p in parts(live, some)]
            large = [p for p in cut if len(p) >= least]
            if len(large) > 1:
                total += len(live) * lam
                below = [walk(p, lam, False) for p in large]
                theirs = sum(s for s, _ in below)
                mine = total - len(whole) * birth
                if root or theirs > mine:
                    return theirs, [c for _, cs in below for c in cs]
                return mine, [whole]
            if not large:
                total += len(live) * lam
                break
            total += (len(live) - len(large[0])) * lam
            live = large[0]
            some = [e for e in some if e[1] in live and e[2] in live]
        mine = total - len(whole) * birth
        return (0, []) if root else (mine, [whole])

    import sys

    sys.setrecursionlimit(10_000)
    for c in walk(range(n), 0.0, True)[1]:
        label[list(c)] = count[0]
        count[0] += 1
    return label


def planted(groups, each, dims, spread, noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = [c / np.linalg.norm(c) + spread * rng.normal(size=(each, dims)) for c in centres] + [rng.normal(size=(noise, dims))]
    own = np.repeat([*range(groups), -1], [each] * groups + [noise])
    x = np.concatenate(x)
    order = rng.permutation(len(x))
    return x[order], own[order]


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.25), (2, 0.35)])
def test_whole_lists_give_the_exact_hierarchy(spark, seed, spread):
    x, _ = planted(6, 25, 6, spread, 40, seed)
    got = {r["id"]: r["topic"] for r in density.density_topics(frame(spark, x), 8, 5, k=len(x), probe=99, target=24).collect()}
    want = naive(x, 8, 5)
    assert len(got) == len(x) and rand_index([got[i] for i in range(len(x))], list(want)) == pytest.approx(1)
    assert {i for i, t in got.items() if t == -1} == {i for i, t in enumerate(want) if t == -1}


def test_planted_groups_are_found(spark):
    x, own = planted(12, 60, 16, 0.08, 60, 4)
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0), [[0.0] * 16]])  # one vector many times, one of no direction
    own = np.concatenate([own, np.repeat(own[:1], 200), [-1]])
    out = density.density_topics(frame(spark, x), 20, 8, target=64, probe=8)
    got = {r["id"]: r["topic"] for r in out.collect()}
    assert len(got) == len(x) - 1 and -1 in got.values()
    grouped = [i for i in range(len(x) - 1) if own[i] >= 0]
    assert rand_index([got[i] for i in grouped], [own[i] for i in grouped]) >= 0.95
    n = defaultdict(int)
    for t in got.values():
        n[t] += 1
    topics = sorted(t for t in n if t >= 0)
    assert topics == list(range(len(topics))) and all(n[t] >= 20 for t in topics) and [n[t] for t in topics] == sorted((n[t] for t in topics), reverse=True)
    assert density.density_topics(frame(spark, x[:0]), 5).count() == 0


def test_every_cell_gives_exact_neighbours_and_few_are_met(spark):
    x, _ = planted(20, 60, 16, 0.15, 100, 7)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = neighbours.unit_rows(frame(spark, x), "id", "embedding")
    cells = neighbours.fit(rows, 64)
    assigned = neighbours.assign(rows, cells)
    cells = neighbours.measured(cells, assigned)
    assert int(cells.count.sum()) == len(x)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    want = {i: list(np.lexsort((np.arange(len(x)), -np.round(sims[i], 9)))[:7]) for i in range(len(x))}
    # all cells that the bounds leave: nothing is lost
    got = defaultdict(list)
    for r in neighbours.nearest(assigned, rows, cells, 7, 10**6).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["id"])
    assert got == want


def test_index_recall_and_work(spark):
    x, _ = planted(40, 100, 32, 0.1, 0, 3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.build_index(frame(spark, x), target=64)
    asked = unit[::40] + 0.02
    queries = spark.createDataFrame([(i, [float(v) for v in q]) for i, q in enumerate(asked)], "query_id long, vector array<double>")
    hits = defaultdict(set)
    for r in neighbours.search_index(index, queries, 10).collect():
        hits[r["query_id"]].add(r["id"])
    sims = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ unit.T
    recall = np.mean([len(hits[i] & set(np.argsort(-sims[i])[:10])) / 10 for i in range(len(asked))])
    work = neighbours.compared_pairs(index, queries, 10, 8).first()
    assert recall >= 0.95 and work["compared"] < 0.2 * work["pairs"], (recall, work)
    assert neighbours.search_index(neighbours.build_index(frame(spark, x[:0])), queries, 10).count() == 0


def test_kmeans_topics_find_planted_groups(spark):
    from litlens.operators import experiments

    x, own = planted(5, 40, 16, 0.05, 0, 6)
    rows = frame(spark, x).unionByName(spark.createDataFrame([(9000, None), (9001, [])], "id long, embedding array<double>"))
    got = {r["id"]: r["topic"] for r in experiments.kmeans_topics(rows, 5).collect()}
    assert len(got) == len(x) and rand_index([got[i] for i in range(len(x))], list(own)) >= 0.7


def test_batches_are_cut_to_the_number_of_cells():
    """A matrix of rows by cells stays bounded, whatever the batches and cells."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["id"])
    for width in (1, 2_400, 65_536, 1 << 22):
        parts = list(neighbours.slices([batch], width))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(10_000))
        assert all(p.num_rows == 1 or p.num_rows * width <= neighbours.AT_ONCE for p in parts)


def test_pieces_give_the_same_neighbours(spark, monkeypatch):
    x, _ = planted(4, 40, 8, 0.2, 20, 3)
    rows = neighbours.unit_rows(frame(spark, x), "id", "embedding")
    cells = neighbours.fit(rows, 64)

    def found():
        assigned = neighbours.assign(rows, cells)
        out = neighbours.nearest(assigned, rows, neighbours.measured(cells, assigned), 5, 3).collect()
        return sorted((r["query_id"], r["rank"], r["id"]) for r in out)

    want = found()
    real = neighbours.slices
    monkeypatch.setattr(neighbours, "slices", lambda b, width: real(b, width * neighbours.AT_ONCE // 8))
    assert found() == want
