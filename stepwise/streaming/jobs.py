"""Streaming jobs (STR1-STR3).

Each job is ``readStream`` over a landing folder -> ``foreachBatch`` with
``availableNow``: it processes what has landed since its last run and stops.
Its checkpoint lies beside the table it writes, one per landing folder, so a
later call goes on where the last one ended.  Every batch is committed to a
versioned table together with its number; a batch that is run again after a
failure finds its number in the ledger and adds nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.operators.relational import column_drift
from stepwise.operators.windows import rolling_alert
from stepwise.session import cut_lineage
from stepwise.sources.versions import Change, Store


def checkpoint_of(table: str, landing: str) -> str:
    """The durable checkpoint of the job that brings ``landing`` into ``table``."""
    return f"{table.rstrip('/')}/_stream/{hashlib.sha256(landing.rstrip('/').encode()).hexdigest()[:16]}"


def _run(stream: DataFrame, fn, checkpoint: str) -> None:
    """Run ``fn(rows, job, batch)`` on every new batch; ``job`` is the checkpoint's own id,
    so batch numbers of a checkpoint that was thrown away are not taken for its successor's."""
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        meta = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])
        fn(df, meta["id"], number)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _files(spark: SparkSession, landing: str, schema: StructType, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)


# STR1 ------------------------------------------------------------------------
def ingest_slices(spark: SparkSession, landing: str, schema: StructType, table: str, keys: Sequence[str],
                  partition: str = "step", max_files: int = 8) -> DataFrame:
    """Upsert every landed slice into ``table`` (partitioned by
    ``partition``) on ``keys``; replaying a slice changes nothing.

    Only the partitions present in a batch are written again, so the cost of a batch
    follows the batch, not the table.  Of rows of a batch that share their keys the
    largest stays.  A failing read, merge or checkpoint fails the batch, which the
    next call runs again; readers keep the version before it."""
    store = Store(spark, table)

    def batch(df: DataFrame, job: str, number: int) -> None:
        rest = [c for c in df.columns if c not in keys]
        new = (df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_rest")).select(*keys, "_rest.*").select(*df.columns)
               if rest else df.select(*keys).distinct())
        new = cut_lineage(new)   # read for its partitions, its keys and its rows
        store.commit({"data": Change(new, "upsert", tuple(keys), partition)}, job, number)
    _run(_files(spark, landing, schema, max_files), batch, checkpoint_of(table, landing))
    out = store.read()
    return spark.createDataFrame([], schema) if out is None else out


# STR2 ------------------------------------------------------------------------
def drift_monitor(spark: SparkSession, landing: str, expected: Sequence[str], alerts: str,
                  epoch_col: str = "epoch", step_col: str = "step", max_files: int = 8) -> DataFrame:
    """Compare the columns of each landed file with ``expected``; append one
    alert row per file with new or dropped columns (never stops).  A batch holds
    at most ``max_files`` files, so the driver sees a bounded list of names."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, TimestampType
    file_schema = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()),
                              StructField("length", LongType()), StructField("content", BinaryType())])

    store = Store(spark, alerts)

    def batch(df: DataFrame, job: str, number: int) -> None:
        found = None
        for p in [r["path"] for r in df.select("path").collect()]:   # file names of this batch
            rows = spark.read.parquet(p)
            new, dropped = column_drift(expected, rows.columns)
            if new or dropped:
                row = rows.agg(F.max(epoch_col).alias("epoch"), F.max(step_col).alias("step")).select(
                    F.lit(number).cast("long").alias("batch"), "epoch", "step", F.lit(",".join(new)).alias("new_columns"),
                    F.lit(",".join(dropped)).alias("dropped_columns"), F.current_timestamp().alias("logged_at"))
                found = row if found is None else found.union(row)
        if found is not None:
            store.commit({"data": Change(found, "append")}, job, number)
    stream = (spark.readStream.format("binaryFile").schema(file_schema).option("pathGlobFilter", "*.parquet")
              .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(landing).select("path"))
    _run(stream, batch, checkpoint_of(alerts, landing))
    out = store.read()
    if out is not None:
        return out
    return spark.createDataFrame([], "batch long, epoch int, step int, new_columns string, "
                                     "dropped_columns string, logged_at timestamp")


# STR3 ------------------------------------------------------------------------
def error_monitor(spark: SparkSession, landing: str, schema: StructType, log: str, by: Sequence[str],
                  y: str, pred: str, threshold: float, k: int = 5, max_files: int = 1) -> DataFrame:
    """Per-slice MAE/RMSE with the rolling ``k``-slice MAE over the whole log
    (ordered by epoch, step) and an alert flag.

    The log keeps mergeable sums (n, absolute and squared error) per slice and
    landed file, upserted on both: a slice may come in several files and
    batches, and a file delivered again replaces its own sums.  A batch
    writes the epochs it touches."""
    key = list(by) + ["epoch", "step"]

    store = Store(spark, log)

    def batch(df: DataFrame, job: str, number: int) -> None:
        e = F.col(pred) - F.col(y)
        m = (df.withColumn("_file", F.input_file_name()).groupBy(*key, "_file")
             .agg(F.count(e).alias("n"), F.sum(F.abs(e)).alias("abs_sum"), F.sum(e * e).alias("sq_sum")))
        store.commit({"data": Change(cut_lineage(m), "upsert", (*key, "_file"), "epoch")}, job, number)
    _run(_files(spark, landing, schema, max_files), batch, checkpoint_of(log, landing))
    sums = store.read()
    if sums is None:
        raise ValueError(f"no slice has landed in {landing}")
    per_slice = sums.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("abs_sum").alias("_a"), F.sum("sq_sum").alias("_s"))
    per_slice = per_slice.select(*key, (F.col("_a") / F.col("n")).alias("mae"), F.sqrt(F.col("_s") / F.col("n")).alias("rmse"), "n")
    return rolling_alert(per_slice, by, ["epoch", "step"], "mae", threshold, k, "rolling_mae", "alert")
