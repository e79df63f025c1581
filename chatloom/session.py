"""Session helpers: shared storage for cut lineages, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows x row width stay below this.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that one task may have to join.
HOT = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        where = "file://" + tempfile.mkdtemp(prefix="chatloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_written: list[str] = []
_kept: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and every executor can reread it. Kept until ``release``, or to the end of a ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_at_exit, spark)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, but for the tables given to ``keep``."""
    before = len(_written)
    try:
        yield
    finally:
        mine = _written[before:]
        _written[before:] = [p for p in mine if p in _kept]
        _delete(spark, [p for p in mine if p not in _kept])


def keep(df: DataFrame) -> DataFrame:
    """A stored table that outlives its ``scratch``."""
    _kept.add(df.stored_at)
    return df


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete what ``stored`` wrote in this process, once the results that read it are written; the number of tables. Also done when the process ends."""
    paths = _written[:]
    _written.clear()
    _kept.clear()
    _delete(spark, paths)
    return len(paths)


def _at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001 - the JVM may be gone; the folder is then the cluster's to clean
        pass


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Mark a stored table for broadcast if its counted size is within the bound; else leave the join to AQE."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def hot_joined(big: DataFrame, groups: DataFrame, keys: list[str], weight: str, row_bytes: int) -> DataFrame:
    """``big`` joined with ``groups``, which is stored and has one row a key and in ``weight`` how many rows of ``big`` have it.

    The few keys of more than HOT rows, at most rows / HOT, are met by broadcast, so no
    task gets all rows of a hot key; the others meet in a shuffle.
    """
    hot = groups.where(F.col(weight) > HOT)
    n = hot.count()
    if not n:
        return big.join(groups, keys)
    rare = big.join(small(hot.select(*keys), row_bytes, n), keys, "left_anti")
    return big.join(small(hot, row_bytes, n), keys).unionByName(rare.join(groups.where(F.col(weight) <= HOT), keys))


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as the cluster has cores: a single small file would leave all work to one. Scans that have enough are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the driver's directory, spread over the cores."""
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))
