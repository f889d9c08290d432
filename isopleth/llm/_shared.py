"""Helpers that several corpus operators use: shared scratch space, materialised
tables that survive lost executors, ordered partitions and skew-safe lookups."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_CREATED: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; removed when the driver ends.

    The setting names a folder that the driver and all executors share; a path
    without a scheme lies on Hadoop's default file system.  Only on a local master,
    where it may be unset (tests), is a local folder chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="isopleth-")
    path = qualified(spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    if not _CREATED:
        atexit.register(_clean)
    _CREATED.append((spark, path))
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Hadoop's settings give it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    text = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return text.replace("file:/", "file:///", 1) if text.startswith("file:/") and not text.startswith("file://") else text


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def _clean() -> None:
    for spark, path in _CREATED:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch space and read it back (cuts lineage)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)
            _CREATED[:] = [x for x in _CREATED if x[1] != path]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file bytes for a scan); runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, mb: int = 16, most: int = 200_000) -> int:
    """Partitions of about ``mb`` MB of stored input, two per core at least; those of
    the session's shuffles if Catalyst does not know the size."""
    spark, size = df.sparkSession, input_bytes(df)
    if size >= 1 << 58:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, min(most, math.ceil(size / (mb << 20))))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is so small that it may be one row group;
    larger inputs are split where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if input_bytes(df) < cores << 20 else df


def columns(df: DataFrame, *names: str) -> list[Column]:
    """The named columns, found case-insensitively, whatever else the frame holds."""
    return [df[f"`{n}`"] for n in names]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_few(keys: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``keys``, materialised and of a few bytes a row, as the side of a join that is
    broadcast, if it has ``most`` rows or fewer: the other side is then not shuffled."""
    return F.broadcast(keys) if keys.count() <= most else keys


def lookup_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, hot: int = 2000) -> DataFrame:
    """Left join to a table with one row a key, safe when one key holds many rows.

    ``weight`` is the number of left rows of each key.  Keys with at least
    1/``hot`` of all rows number ``hot`` at most, so that their part of ``right``
    has a proven bound and is broadcast; every other key is small enough for a
    shuffle.  A null key finds nothing and is not shuffled.  ``right`` should be
    materialised.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    least = max(2, total // hot)
    rest = right.where(F.col(weight) < least).drop(weight)
    heavy = right.where(F.col(weight) >= least).drop(weight).withColumn("_heavy", F.lit(True))
    both = left.join(F.broadcast(heavy), key, "left")
    names = [c for c in rest.columns if c != key]
    done = both.where(F.col("_heavy") | F.col(key).isNull()).drop("_heavy")
    other = both.where(F.col("_heavy").isNull() & F.col(key).isNotNull()).drop("_heavy", *names).join(rest, key, "left")
    return done.unionByName(other)
