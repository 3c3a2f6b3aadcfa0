"""Nearest neighbours by an inverted file: unit vectors in cells of k-means centres, searched cell by cell (G5; E1 builds on it).

Centres are fitted on bounded samples: a coarse k-means on at most COARSE_TRAIN rows, then one k-means a coarse cell, on about
CELL_TRAIN rows for each fine centre. Every vector is assigned, and nothing but centres, radii and counts, at most MAX_CELLS
rows, goes to all tasks. A query goes to its nearest cells; cells that can't hold a better neighbour than those already sure of
are pruned by the triangle inequality on angles. Members and queries of a cell meet in blocks of at most BLOCK rows each, so a
hot cell is many tasks.

Approximate search compares 8-bit codes of the members' residuals (product quantisation, one table of inner products a query)
and scores the best candidates anew on the original vectors. Zero vectors and such with null or non-finite components take no
part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions import vectors as V
from litlens.operators.tables import cut, ship

COARSE_TRAIN, CELL_TRAIN, CODE_TRAIN = 16_384, 32, 16_384
MAX_COARSE, MAX_FINE, MAX_CELLS = 128, 512, 65_536
BLOCK = 4096
#: Numbers of a matrix of rows by cells, or by members, that a task holds at a time.
AT_ONCE = 1 << 21


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose matrix by `width` columns stays bounded, however many columns there are."""
    step = max(1, AT_ONCE // max(1, width))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5, spherical: bool = True) -> np.ndarray:
    """k-means centres of the rows of x: of unit vectors by cosine, else by distance. Empty cells take the worst placed rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T - (0 if spherical else (centres**2).sum(1) / 2)
        own, how = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            sums[empty], n[empty] = x[np.argsort(how, kind="stable")[: len(empty)]], 1
        centres = sums / n[:, None]
        if spherical:
            size = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(size > 0, centres / np.where(size > 0, size, 1), x[:1])
    return centres


def unit_rows(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v): vectors of length 1."""
    v = F.col(vector)
    return df.filter(V.valid_vector(v)).filter(V.norm(v) > 0).select(F.col(id_).cast("long").alias("id"), V.l2_normalize(v).alias("v"))


@dataclass(frozen=True)
class Cells:
    centres: np.ndarray  # unit vectors
    region: np.ndarray  # coarse cell of each
    radius: np.ndarray | None = None  # largest angle between a centre and a member
    count: np.ndarray | None = None

    @property
    def dims(self) -> int:
        return self.centres.shape[1]


def fit(rows: DataFrame, target: int = 256, seed: int = 5) -> Cells | None:
    """Centres for cells of about `target` rows (id, v); None without rows."""
    ship(rows.sparkSession)
    n = rows.count()
    if not n:
        return None
    n_cells = min(MAX_CELLS, max(1, math.ceil(n / target)))
    n_coarse = min(MAX_COARSE, math.ceil(math.sqrt(n_cells)))
    drawn = lambda size: rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < size) if size < n else rows
    some = drawn(COARSE_TRAIN).select("v").limit(2 * COARSE_TRAIN).toArrow()["v"]
    coarse = lloyd(matrix(some, len(some[0].as_py())), n_coarse, seed=seed)
    train, most, dims = CELL_TRAIN * n_cells, MAX_FINE, coarse.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((matrix(b.column("v"), dims) @ coarse.T).argmax(1).astype(np.int32)), b.column("v")], names=["region", "v"])

    def fine(table: pa.Table) -> pa.Table:
        x = matrix(table["v"], dims)[: most * CELL_TRAIN]
        centres = lloyd(x, max(1, min(most, round(len(x) / CELL_TRAIN))), seed=seed)
        return pa.table({"region": pa.array([table["region"][0].as_py()] * len(centres), pa.int32()), "v": _lists(centres)})

    # a group has the sample of one coarse cell
    found = drawn(train).select("v").mapInArrow(assign, "region int, v array<double>").groupBy("region").applyInArrow(fine, "region int, v array<double>").orderBy("region", "v").toArrow()
    return Cells(matrix(found["v"], dims), np.asarray(found["region"]))


def assign(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows (id, v) with cell, region and angle to its centre."""
    centres, region, dims = cells.centres, cells.region, cells.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(centres)):
            near = matrix(b.column("v"), dims) @ centres.T
            own = near.argmax(1)
            angle = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(region[own].astype(np.int32)), pa.array(angle)], names=["id", "v", "cell", "region", "angle"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, cell int, region int, angle double")


def measured(cells: Cells, assigned: DataFrame) -> Cells:
    """cells with radius and count of the assigned rows: a row for each cell comes to the driver."""
    radius, count = np.zeros(len(cells.centres)), np.zeros(len(cells.centres), np.int64)
    for r in assigned.groupBy("cell").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], count[r["cell"]] = r["a"], r["n"]
    return Cells(cells.centres, cells.region, radius, count)


def probed(queries: DataFrame, cells: Cells, k: int, probe: int, apart: bool = False) -> DataFrame:
    """queries (id, v) for each of the `probe` nearest cells that could hold one of the k nearest. With apart, one more row is
    needed, as a query meets itself."""
    centres, radius, count, dims, k = cells.centres, cells.radius, cells.count, cells.dims, k + apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(centres)):
            angle = np.arccos(np.clip(matrix(b.column("v"), dims) @ centres.T, -1, 1))
            # the k nearest lie no farther than the outer bounds of the cells that surely hold k
            outer, inner = np.where(count > 0, angle + radius, np.inf), np.where(count > 0, angle - radius, np.inf)
            order = np.argsort(outer, axis=1)
            enough = (np.cumsum(count[order], axis=1) >= k).argmax(1)
            bound = np.take_along_axis(outer, np.take_along_axis(order, enough[:, None], 1), 1)
            bound = np.where(count.sum() >= k, bound, np.inf)
            may = inner <= bound + 1e-9
            near = np.argsort(np.where(may & (count > 0), angle, np.inf), axis=1, kind="stable")[:, :probe]
            kept = np.take_along_axis(may & (count > 0), near, 1)
            row, at = np.nonzero(kept)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("v").take(rows), pa.array(near[row, at].astype(np.int32))], names=["id", "v", "cell"])

    return queries.mapInArrow(run, f"id {queries.schema['id'].dataType.simpleString()}, v array<double>, cell int")


def meet(members: DataFrame, queries: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(key, members, queries) for each cell, in blocks of about BLOCK rows of either side."""
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(blocks(members, "_m").join(blocks(queries, "_q"), "cell"))  # MAX_CELLS rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    m = members.join(sizes, "cell").withColumns({"mb": own("_m")}).withColumn("qb", every("_q")).drop("_m", "_q")
    q = queries.join(sizes, "cell").withColumns({"qb": own("_q")}).withColumn("mb", every("_m")).drop("_m", "_q")
    keys = ("cell", "mb", "qb")
    return m.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(fn, schema)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row; more where the last is tied."""
    if sims.shape[1] > k:
        least = np.partition(sims, -k, axis=1)[:, -k]
        return np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
    return np.nonzero(np.isfinite(sims))


def _firsts(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(assigned: DataFrame, queries: DataFrame, cells: Cells, k: int, probe: int) -> DataFrame:
    """(query_id, id, score, rank): exact cosines within the probed cells; a row is no neighbour of the query with its id."""
    dims = cells.dims

    def compare(m: pa.Table, q: pa.Table) -> pa.Table:
        if not m.num_rows or not q.num_rows:
            return pa.table({"query_id": q["id"].slice(0, 0), "id": m["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        members, ids, found = matrix(m["v"], dims).T, np.asarray(m["id"]), []
        for part in slices([q], len(ids)):
            sims = matrix(part["v"], dims) @ members
            sims[np.asarray(part["id"])[:, None] == ids[None, :]] = -np.inf
            row, col = _best(sims, k)
            found.append(pa.table({"query_id": part["id"].take(pa.array(row)), "id": m["id"].take(pa.array(col)), "score": pa.array(sims[row, col])}))
        return pa.concat_tables(found)

    found = meet(assigned.select("cell", "id", "v"), probed(queries, cells, k, probe, True).select("cell", "id", "v"), compare, "query_id long, id long, score double")
    return _firsts(found, k)


# Coded residuals


def _codebooks(assigned: DataFrame, cells: Cells, parts: int, seed: int = 9) -> np.ndarray:
    """(parts, 256, dims / parts): centres of the residuals' parts, fitted on a bounded sample."""
    n = int(cells.count.sum())
    some = (assigned.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < CODE_TRAIN) if n > CODE_TRAIN else assigned).select("v", "cell").limit(2 * CODE_TRAIN).toArrow()
    rest = matrix(some["v"], cells.dims) - cells.centres[np.asarray(some["cell"])]
    books = [lloyd(x, 256, seed=seed, spherical=False) for x in np.split(rest, parts, axis=1)]
    return np.stack([np.concatenate([b, np.full((256 - len(b), b.shape[1]), 1e6)]) for b in books])  # codes that nothing takes


@dataclass(frozen=True)
class VectorIndex:
    cells: Cells
    books: np.ndarray
    coded: DataFrame  # id, cell, code
    vectors: DataFrame  # id, v


def build_index(articles: DataFrame, id_: str = "id", vector: str = "embedding", target: int = 64, parts: int = 8) -> VectorIndex | None:
    """Every usable vector in a cell, as a code of `parts` bytes and as it is. dims must be a multiple of parts."""
    rows = cut(unit_rows(articles, id_, vector))
    cells = fit(rows, target)
    if cells is None:
        return None
    assigned = cut(assign(rows, cells))
    cells = measured(cells, assigned)
    books, centres, dims = _codebooks(assigned, cells, parts), cells.centres, cells.dims

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = matrix(b.column("v"), dims) - centres[np.asarray(b.column("cell"))]
            codes = [(x @ book.T - (book**2).sum(1) / 2).argmax(1).astype(np.uint8) for x, book in zip(np.split(rest, parts, axis=1), books, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cell"), pa.array([c.tobytes() for c in np.stack(codes, axis=1)], pa.binary())], names=["id", "cell", "code"])

    coded = cut(assigned.select("id", "cell", "v").mapInArrow(encode, "id long, cell int, code binary"))
    return VectorIndex(cells, books, coded, assigned.select("id", "v"))


def compared_pairs(index: VectorIndex, queries: DataFrame, k: int, probe: int) -> DataFrame:
    """One row: (compared, pairs): codes that a search scores, and all pairs of queries and vectors."""
    sizes = index.coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    met = probed(unit_rows(queries, "query_id", "vector"), index.cells, k, probe).join(F.broadcast(sizes), "cell")
    n = int(index.cells.count.sum())
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).crossJoin(queries.agg((F.count(F.lit(1)) * n).alias("pairs")))  # one row each


def search_index(index: VectorIndex | None, queries: DataFrame, k: int, probe: int = 8, rescore: int = 10) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, vector): codes in the probed cells, then the rescore * k best of each
    query on the original vectors."""
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    cells, books, dims, keep = index.cells, index.books, index.cells.dims, rescore * k
    centres, parts = cells.centres, len(books)
    q = unit_rows(queries, "query_id", "vector")

    def compare(key, m: pa.Table, q: pa.Table) -> pa.Table:
        if not m.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        codes, found = np.frombuffer(b"".join(m["code"].to_pylist()), np.uint8).reshape(-1, parts), []
        for some in slices([q], len(codes)):
            x = matrix(some["v"], dims)
            sims = np.repeat(x @ centres[key[0].as_py()][:, None], len(codes), axis=1)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                sims += (part @ books[p].T)[:, codes[:, p]]
            row, col = _best(sims, keep)
            found.append(pa.table({"query_id": some["id"].take(pa.array(row)), "id": m["id"].take(pa.array(col)), "score": pa.array(sims[row, col])}))
        return pa.concat_tables(found)

    found = _firsts(meet(index.coded, probed(q, cells, k, probe), compare, "query_id long, id long, score double"), keep).select("query_id", "id")
    exact = found.join(index.vectors, "id").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("_q")), "query_id")
    return _firsts(exact.select("query_id", "id", V.dot(F.col("v"), F.col("_q")).alias("score")), k)


def pairs_within(rows: DataFrame, least: float, target: int = 256) -> DataFrame:
    """(a, b, score) with a < b: all pairs of unit vectors (id, v) with a cosine of `least` or more. Cells that are too far apart
    for that, by the triangle inequality on angles, never meet."""
    rows = cut(rows)
    cells = fit(rows, target)
    if cells is None:
        return rows.sparkSession.createDataFrame([], "a long, b long, score double")
    assigned = cut(assign(rows, cells))
    cells = measured(cells, assigned)
    centres, radius, dims, reach = cells.centres, np.where(cells.count > 0, cells.radius, -np.inf), cells.dims, math.acos(max(-1.0, min(1.0, least)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(centres)):
            angle = np.arccos(np.clip(matrix(b.column("v"), dims) @ centres.T, -1, 1))
            row, cell = np.nonzero(angle - radius <= reach + 1e-6)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("v").take(at), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    def compare(m: pa.Table, q: pa.Table) -> pa.Table:
        if not m.num_rows or not q.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        members, ids, found = matrix(m["v"], dims).T, np.asarray(m["id"]), []
        for part in slices([q], len(ids)):
            sims = matrix(part["v"], dims) @ members
            row, col = np.nonzero((sims >= least) & (np.asarray(part["id"])[:, None] < ids[None, :]))
            found.append(pa.table({"a": part["id"].take(pa.array(row)), "b": m["id"].take(pa.array(col)), "score": pa.array(sims[row, col])}))
        return pa.concat_tables(found)

    asked = rows.mapInArrow(ask, "id long, v array<double>, cell int")
    return meet(assigned.select("cell", "id", "v"), asked.select("cell", "id", "v"), compare, "a long, b long, score double")
