"""Vector algebra as column functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, default: float = 0.0) -> Column:
    """Null vectors give the default, zero norms 0."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(default)).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_normalize(v: Column) -> Column:
    """Zero vectors stay."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def valid_vector(v: Column) -> Column:
    """Not null, not empty, all components finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def parse_vector(text: Column) -> Column:
    """A vector from its text form; null where it is none."""
    return F.from_json(text, "array<double>")


def centroids(df: DataFrame, key: str, vector: str, normalized: bool = True) -> DataFrame:
    """(key, centroid) of the rows whose key is a label >= 0. normalized: mean of unit vectors, made a unit again;
    else the plain mean. Components are averaged as rows (key, place), so sums are partial before the shuffle."""
    v = l2_normalize(F.col(vector)) if normalized else doubles(F.col(vector))
    parts = df.filter((F.col(key) >= 0) & F.col(vector).isNotNull()).select(key, F.posexplode(v).alias("_pos", "_val"))
    means = parts.groupBy(key, "_pos").agg(F.avg("_val").alias("_val"))
    out = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_val"))), lambda s: s["_val"]).alias("centroid"))
    return out.withColumn("centroid", l2_normalize(F.col("centroid"))) if normalized else out


def passage_text(c: Column) -> Column:
    """D1"""
    return _prefixed(c, "passage: ")


def query_text(c: Column) -> Column:
    return _prefixed(c, "query: ")


def _prefixed(c: Column, prefix: str) -> Column:
    t = F.btrim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).startswith(prefix.strip()), t).otherwise(F.concat(F.lit(prefix), t))


def text_hash(c: Column) -> Column:
    """D2"""
    return F.sha2(c, 256)
