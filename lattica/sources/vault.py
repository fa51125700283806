"""A folder of markdown files as a table."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.config import VaultConfig


def read_vault(spark: SparkSession, root: str, config: VaultConfig = VaultConfig()) -> DataFrame:
    """(path, content, modified_at) of the vault's files; paths are relative to ``root``.

    Suffixes compare without case. Files below an excluded folder, or whose name matches an excluded pattern, are left out.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + _quote(base.removeprefix("file://")) + "/", "")
    return keep_files(files.select(relative.alias("path"), "content", F.col("modificationTime").alias("modified_at")), config)


def keep_files(files: DataFrame, config: VaultConfig = VaultConfig()) -> DataFrame:
    """Rows of ``files(path, ...)`` that belong to a vault."""
    parts = F.split("path", "/")
    parents = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    name = F.element_at(parts, -1)
    fits = F.lit(False)
    for suffix in config.file_extensions:
        fits = fits | F.lower(name).endswith(suffix.lower())
    kept = files.where(fits & ~F.arrays_overlap(parents, F.array(*[F.lit(d.lower()) for d in config.exclude_dirs] or [F.lit(None).cast("string")])))
    for pattern in config.exclude_patterns:
        kept = kept.where(~name.rlike(translate(pattern).replace("(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$")))
    return kept


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"
