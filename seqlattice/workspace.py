"""Where intermediate tables go, and joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where the session names none, only a local master is accepted and a temporary folder becomes the
    checkpoint directory: on a cluster a machine-local folder would not be seen by the other executors.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-seqlattice-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str = "work") -> str:
    """A new folder below the shared one, kept until the driver ends or ``clear`` is called."""
    path = f"{base_dir(spark)}/seqlattice-{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    _made.append(path)
    return path


_made: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables made so far; data frames that were built on them can't be read any more."""
    while _made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # texts take about half the disk
    return spark.read.schema(df.schema).parquet(path)


def lookup_hot(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", count: str | None = None, hot_share: int = 4096) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per ``key``, when some keys may hold a third of ``rows``.

    Keys with more than 1/``hot_share`` of all rows (so fewer than ``hot_share`` keys, whatever the size) are joined
    by broadcasting their few rows of ``keyed``; the rest is an ordinary shuffled join. ``count`` names a column of
    ``keyed`` with the number of rows of each key, if it is known; it isn't in the result.
    Null keys match nothing; with ``how='left'`` their rows are kept.
    """
    total = rows.count()
    limit = max(100_000, total // hot_share)
    few = keyed.drop(count) if count else keyed
    if total <= limit:
        return rows.join(few, key, how)
    if count:
        counts = keyed.select(key, F.col(count).alias("_n"))
    else:
        counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = [r[0] for r in counts.filter(F.col("_n") > limit).select(key).collect()]  # fewer than hot_share keys
    if not hot:
        return rows.join(few, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    frequent = rows.filter(is_hot).join(F.broadcast(few.filter(F.col(key).isin(hot))), key, how)
    return frequent.unionByName(rows.filter(~is_hot).join(few.filter(~F.col(key).isin(hot)), key, how))
