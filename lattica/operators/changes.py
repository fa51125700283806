"""Processing only new or changed records.

State is a table of key and content hash, kept in numbered versions. A run diffs the current hashes
against the last published version, does its work, and publishes the next version by creating one file that must not
exist yet; a run that dies before that leaves the published version as it was, so the next run sees the same diff.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import materialize


#: Seconds after which a version file that was begun but not finished is one of a dead run.
STALE_S = 600


def hex_value(col) -> F.Column:
    """A hexadecimal digest in one form: lower case, without leading zeros (all zeros: '0')."""
    low = F.regexp_replace(F.lower(F.trim(col)), r"^(0x)?0*", "")
    return F.when(col.isNotNull(), F.when(low == "", F.lit("0")).otherwise(low))


def latest_hashes(seen: DataFrame, key: str, hash_col: str, order: str) -> DataFrame:
    """(key, hash) of the latest observation per key; ties: the highest hash. Null keys are dropped."""
    rows = seen.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), hex_value(F.col(hash_col)).alias("hash"), F.col(order).alias("_at"))
    return rows.groupBy("key").agg(F.max_by("hash", F.struct("_at", "hash")).alias("hash"))


def with_content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``hash`` over ``columns``; nulls and field limits are told apart."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return rows.withColumn("hash", F.sha2(F.concat_ws("|", *parts), 256))


def diff(current: DataFrame, state: DataFrame) -> DataFrame:
    """(key, change): ``added``, ``updated`` or ``deleted`` keys of ``current(key, hash)`` against ``state(key, hash)``.

    One full outer join on the key; keys are unique on both sides, so no group can be hot. A null hash
    equals a null hash only. Empty tables give all added or all deleted.
    """
    c = current.select("key", F.col("hash").alias("_now"), F.lit(True).alias("_c"))
    s = state.select("key", F.col("hash").alias("_then"), F.lit(True).alias("_s"))
    change = (
        F.when(F.col("_s").isNull(), "added")
        .when(F.col("_c").isNull(), "deleted")
        .when(~F.col("_now").eqNullSafe(F.col("_then")), "updated")
    )
    return c.join(s, "key", "full_outer").select("key", change.alias("change")).where("change is not null")


def merge(state: DataFrame, current: DataFrame, done: DataFrame) -> DataFrame:
    """The state after the keys of ``done(key)`` were processed: their current rows in place of their stored ones.

    Keys that a run could not process keep their stored hash, or none, so that the next run sees them again.
    """
    keys = done.select("key").distinct()
    kept = state.join(keys, "key", "left_anti").select("key", "hash")
    return kept.unionByName(current.join(keys, "key", "left_semi").select("key", "hash"))


class StateStore:
    """Versioned key/hash state in a folder of the cluster's file system.

    ``v=N-token`` folders hold versions; a version counts once ``_published/N`` names its folder. That file is made by
    an exclusive create, of which one of several writers succeeds, and holds one line. A file without a whole line counts as not published:
    its writer is at it, or has died if it is older than ``STALE_S``, and is then replaced. ``read`` takes the highest published version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.root}/_published"))

    def _published(self) -> dict[int, str]:
        """Folders by version, of those that are wholly published."""
        found = {}
        for f in self._fs.listStatus(self._Path(f"{self.root}/_published")):
            name = f.getPath().getName()
            if name.isdigit() and (folder := self._line(f.getPath())):
                found[int(name)] = folder
        return found

    def _line(self, path) -> str | None:
        stream = self._fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def version(self) -> int | None:
        """The highest published version."""
        return max(self._published(), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        """The state of a version, by default the highest; empty before the first."""
        published = self._published()
        if not published:
            return self.spark.createDataFrame([], "key string, hash string")
        return self.spark.read.parquet(f"{self.root}/{published[max(published) if version is None else version]}")

    def publish(self, state: DataFrame, after: int | None = None) -> int:
        """Writes the version that follows ``after``, by default the highest, and swaps it in; its number.

        Fails if another run published that number first, so a run that read version ``after`` can't overwrite newer state.
        """
        before = self.version() if after is None else after
        v = -1 if before is None else before
        v += 1
        folder = f"v={v}-{uuid.uuid4().hex}"
        state.select("key", "hash").write.parquet(f"{self.root}/{folder}")
        target = self._Path(f"{self.root}/_published/{v}")
        try:
            if self._fs.exists(target) and self._line(target) is None and time.time() - self._fs.getFileStatus(target).getModificationTime() / 1000 > STALE_S:
                self._fs.delete(target, False)
            out = self._fs.create(target, False)
        except Exception as e:
            self._fs.delete(self._Path(f"{self.root}/{folder}"), True)
            raise RuntimeError(f"version {v} was published by another run") from e
        out.write(bytearray(f"{folder}\n".encode()))
        out.close()
        return v


def process_changes(store: StateStore, current: DataFrame, work) -> DataFrame:
    """One run: ``work(changes)`` gets (key, change) rows and returns the ``key``s it has processed; then the next version is published.

    If ``work`` fails, nothing is published and the next run sees the same changes. The changes are returned.
    """
    version = store.version()
    state = store.read(version) if version is not None else store.read()
    changes = materialize(diff(current, state), "changes")
    done = work(changes)
    store.publish(merge(state, current, done), after=version)
    return changes


def stored_state(current_rows: DataFrame, deletions: DataFrame) -> DataFrame:
    """(key, hash) of stored rows ``(path, content_hash, saved_at)`` that no later deletion removed.

    Paths are unique in ``current_rows``. A row without a saving time stays; deletions without path or time don't count.
    """
    gone = deletions.where("path is not null").groupBy("path").agg(F.max("deleted_at").alias("_gone"))
    kept = current_rows.join(gone, "path", "left").where("_gone is null or saved_at is null or _gone <= saved_at")
    return kept.select(F.col("path").alias("key"), hex_value(F.col("content_hash")).alias("hash"))
