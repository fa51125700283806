"""Session helpers: the shared folder, lineage cuts and hot-key salting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in ``spark.checkpoint.dir``.

    Where that setting is absent and everything runs in one process, a temporary folder is made, set for the session and
    deleted when Python ends. On a cluster its absence is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(context, "_lattica_shared_dir", None)
    if own is None:
        own = context._lattica_shared_dir = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


#: Tables written by materialize in this process and not discarded yet.
_written: list[str] = []


def discard_all(spark: SparkSession) -> None:
    """Deletes every table that :func:`materialize` wrote in this process. For use between queries, when none is read any more."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that :func:`materialize` wrote for ``df``; nothing may read it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)
        _written[:] = [w for w in _written if w.rsplit("/", 1)[-1] != name.rsplit("/", 1)[-1]]


#: Hot keys up to this many are broadcast; more are joined like any table.
BROADCAST_KEYS = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys that hold more than ``hot_rows`` rows, with the number of salts each is split into.

    The count combines on the map side. The result is written, so that its size is known before it is joined: up to
    ``BROADCAST_KEYS`` keys are marked for broadcast, more are left to Spark, which then shuffles both sides by key.
    """
    hot = materialize(
        df.groupBy(F.col(key).alias("_hot_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select("_hot_key", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")),
        "hot",
    )
    return F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot


def salt_points(df: DataFrame, key: str, hot: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``_salt``: rows of hot keys are spread by a hash of the columns ``by``."""
    joined = df.join(hot, F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    return joined.withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int"))
    ).drop("_hot_key", "_salts")


def salt_states(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Adds ``_salt``: rows of hot keys are repeated once for each salt of :func:`salt_points`."""
    joined = df.join(hot, F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    return joined.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_hot_key", "_salts")
