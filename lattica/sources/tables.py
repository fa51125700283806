"""Readers for the tables of a vault store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One parquet table of ``root``; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def successful_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run ids of runs that ended with success (a small table, one row per run)."""
    return table(spark, root, "sync_runs").where(F.col("status") == "success").select("run_id").distinct()


def current_nodes(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """The stored row of each path with the highest run id among ``runs``.

    ``max_by`` combines on the map side, so a path with very many rows never meets in one task.
    Null paths are dropped; of exact duplicates one row is kept.
    """
    kept = nodes.where(F.col("path").isNotNull()).join(runs.select("run_id").distinct(), "run_id", "left_semi")
    rest = [c for c in nodes.columns if c != "path"]
    row = F.struct(*[F.col(c) for c in rest])
    best = kept.groupBy("path").agg(F.max_by(row, F.struct("run_id", "saved_at")).alias("_row"))
    return best.select(*[F.col("path") if c == "path" else F.col("_row")[c].alias(c) for c in nodes.columns])
