"""One-to-one assignment of clusters to labels with most rows (F12), solved for each connected part of a contingency table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlens.operators import merging as M


def assign(gain: np.ndarray) -> list[int]:
    """The column of each row of a square matrix of whole numbers, for the largest sum: shortest augmenting paths with row and
    column prices. Of several such assignments the one with the smallest columns, row by row: all of them use only entries
    without slack, so each row in turn takes the smallest such column for which the later rows can be moved aside."""
    n = len(gain)
    cost = gain.max(initial=0) - gain
    u, v, of = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.full(n + 1, -1)
    for row in range(n):
        of[n], at = row, n  # column n starts the path
        low, back, seen = np.full(n, np.iinfo(np.int64).max), np.full(n, n), np.zeros(n + 1, bool)
        while of[at] >= 0:
            seen[at] = True
            r = of[at]
            slack = cost[r] - u[r] - v[:n]
            better = ~seen[:n] & (slack < low)
            low, back = np.where(better, slack, low), np.where(better, at, back)
            nearest = int(np.where(seen[:n], np.iinfo(np.int64).max, low).argmin())
            step = low[nearest]
            u[of[seen]] += step
            v[seen] -= step
            low[~seen[:n]] -= step
            at = nearest
        while at != n:
            of[at], at = of[back[at]], back[at]
    column = [0] * n
    for c in range(n):
        column[of[c]] = c
    tight = cost == u[:n, None] + v[None, :n]

    def moved(row: int, taken: set[int], fixed: int) -> bool:
        """Whether a row behind `fixed` finds a column, others behind it moving on."""
        for c in np.flatnonzero(tight[row]).tolist():
            if c not in taken:
                taken.add(c)
                holder = int(of[c])
                if holder < 0 or holder > fixed and moved(holder, taken, fixed):
                    of[c], column[row] = row, c
                    return True
        return False

    for row in range(n):
        for c in np.flatnonzero(tight[row]).tolist():
            if c >= column[row]:
                break
            other = int(of[c])
            if other < row:
                continue
            before = of.copy(), list(column)
            of[column[row]], of[c], column[row] = -1, row, c
            if moved(other, {c}, row):
                break
            of[:], column[:] = before
    return column


def optimal_mapping(table: DataFrame, label: str = "label", cluster: str = "cluster_id") -> DataFrame:
    """(label, cluster_id, n): clusters assigned to labels, each to one, so that most rows agree; pairs without a row are left
    out. Labels and clusters that no chain of cells connects do not compete, so each connected part is solved by itself, as one
    group: its size is numbers of labels and clusters, not of rows."""
    cells = table.select(F.col(label).alias("l"), F.col(cluster).alias("c"), "n")
    name = lambda c, kind: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = M.components(cells.select(F.lit(0).alias("g"), name("l", "l").alias("a"), name("c", "c").alias("b")))
    keyed = cells.withColumn("node", name("l", "l")).join(parts.select("node", F.col("label").alias("part")), "node").drop("node")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(frame["l"].unique()), sorted(frame["c"].unique())
        gain = np.zeros((max(len(rows), len(cols)),) * 2, np.int64)
        gain[np.searchsorted(rows, frame["l"]), np.searchsorted(cols, frame["c"])] = frame["n"]
        found = [(rows[i], cols[j], int(gain[i, j])) for i, j in enumerate(assign(gain)) if gain[i, j] > 0]
        return pd.DataFrame(found, columns=["l", "c", "n"])

    out = keyed.groupBy("part").applyInPandas(solve, cells.schema)
    return out.toDF(label, cluster, "n")


def match_status(rows: DataFrame, optimal: DataFrame, purity: DataFrame) -> DataFrame:
    """(id, status) of rows (id, label, cluster_id): not found without a cluster, direct where they are equal, optimal or purity
    where that mapping (label, cluster_id) gives the label, else mismatch."""
    of = lambda m, name: m.select("cluster_id", F.col("label").alias(name))
    j = rows.join(of(optimal, "_o"), "cluster_id", "left").join(of(purity, "_p"), "cluster_id", "left")
    label = F.col("label")
    return j.select("id", F.when(F.col("cluster_id").isNull(), "not found").when(label == F.col("cluster_id"), "direct").when(label == F.col("_o"), "optimal").when(label == F.col("_p"), "purity").otherwise("mismatch").alias("status"))
