"""Intermediate tables in the folder that driver and executors share, and the package for the executors' Python workers."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_PATH = "_litlens_cut"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='litlens-')}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session may do without the setting; on a cluster it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="litlens-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of cut() that nothing will read again."""
    for df in frames:
        if path := df.__dict__.get(_PATH):
            sc = df.sparkSession.sparkContext
            with contextlib.suppress(Exception):  # a table that stays is only disk
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _fs(spark: SparkSession, path: str):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Puts the finished folder `made` in the place of `path`: the old one is moved aside first and deleted last, so a job that is
    lost on the way leaves one of the two whole."""
    fs, at, Path_ = _fs(spark, path)
    aside = Path_(f"{path}.old-{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    had = fs.exists(at)
    if had and not fs.rename(at, aside):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(Path_(made), at):
        if had:
            fs.rename(aside, at)
        raise OSError(f"{made} can't take the place of {path}")
    if had:
        fs.delete(aside, True)
