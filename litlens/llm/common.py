"""Shared pieces of the training-data operators: reading tables, cutting lineage, bounded semi-joins, components."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of one row of a doc bitmap (fixed by bitmap_construct_agg).
BITMAP_ROW_BITS = 32768


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, for functions that run in their Python workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='litlens-')}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session may do without the setting; on a cluster executors would write to
    their own disks, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="litlens-checkpoint-"))
    return sc.getCheckpointDir()


_tables = "_litlens_path"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: compressed, and read back with its true size."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _tables, path)
    return out


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """checkpoint() that keeps df dealt by keys: later aggregations by them, and by more columns, need no shuffle."""
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(df), *keys).saveAsTable(name)
    out = spark.table(name)
    setattr(out, _tables, path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of checkpoint() and bucketed() that nothing will read again."""
    for df in frames:
        if path := df.__dict__.get(_tables):
            jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
            with contextlib.suppress(Exception):  # a table that stays is only disk
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
                if (name := path.rsplit("/", 1)[-1]).startswith("cut_"):
                    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of at most `size` for the jobs that run inside: the JVM and each Python worker hold whole batches, in
    buffers of twice their size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _marked(df: DataFrame, key: str, wanted: DataFrame, bits: int) -> DataFrame:
    """(row, may): each row of df as a struct, so that no name of its columns can clash, and whether its hashed key is among
    wanted's. The broadcast side is a bitmap of `bits` bits (1 MB) whatever the input, so a constant bounds its size; with
    more keys than bits it marks more rows, never fewer."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    part = lambda c: F.floor(c / BITMAP_ROW_BITS)
    place = lambda c: F.pmod(c, F.lit(BITMAP_ROW_BITS))
    maps = wanted.select(bit(F.col(key)).alias("b")).groupBy(part(F.col("b")).alias("part")).agg(F.bitmap_construct_agg(place(F.col("b"))).alias("map"))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row")).withColumn("b", bit(F.col("row")[key])).withColumn("part", part(F.col("b")))
    byte = F.conv(F.hex(F.expr(f"substring(map, cast(pmod(b, {BITMAP_ROW_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(b, {BITMAP_ROW_BITS}) % 8 as int))")) != 0
    return rows.join(F.broadcast(maps), "part", "left").select("row", F.coalesce(is_set, F.lit(False)).alias("may"))


def semi_by_bitmap(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows of df whose key may be among wanted's: it makes the shuffle of an exact join small, and never stands for it."""
    return _marked(df, key, wanted, bits).filter("may").select("row.*")


def left_join_marked(df: DataFrame, key: str, right: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """(row, right's columns but the key): df left join right on key, each row of df as a struct. Only rows that may have a
    partner are shuffled."""
    marked = _marked(df, key, right.select(key), bits)
    others = [c for c in right.columns if c != key]
    partner = right.withColumnRenamed(key, "_partner")
    joined = marked.filter("may").join(partner, F.col("row")[key] == F.col("_partner"), "left").select("row", *others)
    alone = marked.filter("not may").select("row", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in others])
    return joined.unionByName(alone)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star rounds.

    Returns (node, component): the smallest node of each component. Only nodes with an edge appear. Every round is two
    keyed joins over an edge list no longer than the first one; its lineage is cut by a checkpoint.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is the smallest of its neighbourhood links its larger neighbours to itself
        e1 = large.filter("u <> v").distinct()
        low2 = e1.groupBy("u").agg(F.min("v").alias("m"))
        small = e1.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        old, e = e, checkpoint(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component")).distinct()


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
