"""Refreshing a stored graph from a new scan, and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, updated, deleted or unchanged, by content hash, of two tables unique in path."""
    a = old.select("path", F.col("content_hash").alias("_old"), F.lit(True).alias("_a"))
    b = new.select("path", F.col("content_hash").alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def update_counts(diff: DataFrame) -> DataFrame:
    """One row: added, updated, deleted, unchanged."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "deleted", "unchanged")])


def upsert_nodes(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    return nodes.join(changed.select("path"), "path", "left_anti").unionByName(changed, allowMissingColumns=True)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the paths ``gone`` on either side."""
    p = gone.select("path").distinct()
    return nodes.join(p, "path", "left_anti"), edges.join(p.withColumnRenamed("path", "src"), "src", "left_anti").join(p.withColumnRenamed("path", "dst"), "dst", "left_anti")


def replace_out_edges(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges with those that leave ``changed(path)`` replaced by ``fresh``."""
    return edges.join(changed.select(F.col("path").alias("src")).distinct(), "src", "left_anti").unionByName(fresh)


def delete_chunks(vectors: DataFrame, notes: DataFrame) -> DataFrame:
    """Vectors without the chunks of ``notes(path)``."""
    return vectors.join(notes.select(F.col("path").alias("note_path")).distinct(), "note_path", "left_anti")


def update_graph(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged notes, diff): unchanged rows stay from ``old``, added and updated ones come from ``new``.

    Links and tags are then resolved against the merged notes with ``build_graph``, which gives what a full rebuild would.
    """
    diff = snapshot_diff(old, new)
    fresh = new.join(diff.where("status in ('added', 'updated')").select("path"), "path", "left_semi")
    return old.join(diff.where("status = 'unchanged'").select("path"), "path", "left_semi").unionByName(fresh, allowMissingColumns=True), diff
