"""Session helpers: session builder, shared scratch space, durable checkpoints, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count is known to be at most this.
BROADCAST_MAX_ROWS = 200_000


def build_session(app: str = "probelake", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; anything can be overridden by keyword."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local master, where driver and executors share one disk, gets a temporary folder when the
    setting is missing; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus the columns of a one-row aggregate as literals (no join, one row on the driver)."""
    row = one_row.first()
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return df.select("*", *[F.lit(None if row is None else row[c]).cast(types[c]).alias(c) for c in one_row.columns])


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer partitions than the cluster has slots.

    For work that is heavy per row on tables that are small in bytes; a large scan is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def spread(df: DataFrame, per_slot: int = 4) -> DataFrame:
    """Deal narrow rows evenly over all cores, for work that is heavy per row whatever the files of the table look like."""
    return df.repartition(per_slot * df.sparkSession.sparkContext.defaultParallelism)


def small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when a bounded count proves it small, else ``df`` unhinted."""
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df


def either(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` as a side of a join: broadcast when counted small, else never.

    Without a hint Spark goes by the bytes of the files that a checkpoint was read from. Columns that compress well look
    small, and rows by the million are broadcast through the driver.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")
