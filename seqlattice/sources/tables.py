"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per seq_id of ``sequences``: a record that was delivered again keeps its last delivery.

    Ties of loaded_at keep the greatest values; rows without seq_id are no records.
    """
    rest = [c for c in columns if c != "seq_id"]
    rows = table(spark, folder, "sequences").filter("seq_id is not null")
    last = rows.groupBy("seq_id").agg(F.max(F.struct("loaded_at", *rest)).alias("_last"))
    return last.select("seq_id", *(F.col(f"_last.{c}").alias(c) for c in rest))
