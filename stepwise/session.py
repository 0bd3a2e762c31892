"""Session construction and lineage-cutting helpers.

Cluster settings always win: nothing here overrides a value the cluster
already set.  ``spark.checkpoint.dir`` is read from the session and only
filled in when it is unset (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults applied only when the key is absent from the session/cluster conf.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # moments of some twenty columns are some three hundred sums in one aggregate
    "spark.sql.codegen.maxFields": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_session(master: str | None = None, app: str = "stepwise",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one for local use."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir``; only when it is unset (a local test run)
    does it pick a fresh scratch folder and register it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="stepwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the path's own store; access errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    The frame is persisted first so the checkpoint write does not recompute
    it.  ``localCheckpoint`` is never used: its blocks die with the executor.
    """
    checkpoint_dir(df.sparkSession)
    df = df.persist()
    out = df.checkpoint(eager=eager)
    df.unpersist()
    return out


def write_and_reload(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet below the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


__all__ = ["get_session", "checkpoint_dir", "scratch_path", "cut_lineage",
           "write_and_reload", "is_local_path", "materialized", "remember"]


_MATERIALIZED: dict = {}


def remember(spark: SparkSession, key, build) -> DataFrame:
    """What ``build()`` returned for ``key`` before in this application."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _MATERIALIZED:
        _MATERIALIZED[k] = build()
    return _MATERIALIZED[k]


def materialized(spark: SparkSession, key, build, partition_by: list[str] | None = None) -> DataFrame:
    """Build a derived table once per application and keep it as Parquet in
    the shared checkpoint folder (lineage cut, survives the loss of an
    executor, and later scans get column pruning and filter pushdown).
    Later calls with the same ``key`` reuse it."""
    name = "_".join(str(x) for x in (key if isinstance(key, tuple) else (key,)))
    name = "".join(ch if ch.isalnum() else "_" for ch in name)[-60:]
    return remember(spark, key, lambda: write_and_reload(build(), name, partition_by))
