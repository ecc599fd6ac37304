"""Versioned stock snapshots and append-only logs on plain Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stock(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> None:
    """Write a whole snapshot as a new version, then point at it.

    Readers follow the pointer, which is appended only after the data is committed, so
    they see the old snapshot or the new one and never a mix; the snapshot being read
    is never overwritten. Each attempt has a folder of its own, so what a failed one left
    behind does not stand in the way of the next.
    """
    folder = f"v{version}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{root}/data/{folder}")
    df.sparkSession.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder")
    ).write.mode("append").parquet(f"{root}/pointer")


def read_stock(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot last pointed at."""
    newest = F.max(F.struct("version", "folder"))
    folder = spark.read.parquet(f"{root}/pointer").agg(newest.alias("p")).first()["p"]["folder"]
    return spark.read.parquet(f"{root}/data/{folder}")


def append_log(df: DataFrame, path: str, day: str = "day", files_per_day: int = 8) -> None:
    """Append outcomes, one row each, laid out by day in at most ``files_per_day`` files."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != day]), F.lit(files_per_day))
    df.repartition(F.col(day), salt).write.mode("append").partitionBy(day).parquet(path)


def put_changes(df: DataFrame, root: str, version: int) -> None:
    """Write the rows a batch changed. Writing a version again replaces it, so a retried
    batch leaves one copy."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")


def latest(spark: SparkSession, root: str, keys: list[str], below: int | None = None) -> DataFrame:
    """Newest row per key over all versions, or those below one. Combines before the shuffle."""
    rows = spark.read.parquet(root)
    if below is not None:
        rows = rows.filter(F.col("version") < below)
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "version").alias("r"))
        .select(*keys, "r.*")
    )
