"""Streaming jobs driven by slices derived from the driver tables."""

import uuid

from pyspark.sql import functions as F

from stepwise.catalog import FACT_CTE, register, with_ctes
from stepwise.plans import bindings as B
from stepwise.session import checkpoint_dir
from stepwise.streaming import jobs as J


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"


@register("stream_error_monitor", with_ctes("""
s AS (SELECT segment, epoch, step, avg(abs(xg * 10.0 - points)) AS mae,
             sqrt(avg((xg * 10.0 - points) * (xg * 10.0 - points))) AS rmse, count(*) AS n
      FROM fact GROUP BY ALL)
SELECT segment, epoch, step, mae, rmse, n,
  avg(mae) OVER (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_mae,
  avg(mae) OVER (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 24.0 AS alert
FROM s""", FACT_CTE).replace("\ns AS (", "\n, s AS (", 1), ids=("STR3", "WIN10", "SNK6", "V10"))
def q_str3(spark, sf):
    f = B.fact(spark, sf).select("segment", "epoch", "step", "entity", "fixture", "points",
                                 (F.col("xg") * 10.0).alias("pred"))
    landing = _scratch(spark, "landing-monitor")
    f.repartition("epoch", "step").write.partitionBy("epoch", "step").parquet(landing)
    log = _scratch(spark, "monitor-log")
    schema = spark.read.parquet(landing).schema
    out = J.error_monitor(spark, landing, schema, log, ["segment"], "points", "pred", 24.0, max_files=16)
    return out.select("segment", "epoch", "step", "mae", "rmse", "n", "rolling_mae", "alert")


@register("stream_slice_ingest_replay", with_ctes("""
SELECT entity, fixture, epoch, step, points FROM fact""", FACT_CTE), ids=("STR1", "SNK2"))
def q_str1(spark, sf):
    f = B.fact(spark, sf).select("entity", "fixture", "epoch", "step", "points")
    landing = _scratch(spark, "landing-ingest")
    f.repartition("epoch", "step").write.partitionBy("epoch").parquet(landing)   # several files per slice
    # the slices of one epoch land a second time (a replayed delivery)
    f.where(F.col("epoch") == 2001).write.mode("append").partitionBy("epoch").parquet(landing)
    table = _scratch(spark, "ingested")
    schema = spark.read.parquet(landing).schema
    out = J.ingest_slices(spark, landing, schema, table, ["epoch", "step", "fixture", "entity"], "epoch", 8)
    return out.select("entity", "fixture", "epoch", "step", "points")


@register("stream_schema_drift", with_ctes("""
SELECT 'xg' AS new_columns, 'minutes' AS dropped_columns, max(epoch) AS epoch, max(step) AS step
FROM fact WHERE epoch >= 1998 HAVING count(*) > 0""", FACT_CTE), ids=("STR2", "SET3", "SRC4"))
def q_str2(spark, sf):
    f = B.fact(spark, sf)
    landing = _scratch(spark, "landing-drift")
    base = ["entity", "fixture", "epoch", "step", "points", "minutes"]
    # two schema eras: from 1998 on, `minutes` is gone and `xg` appears
    f.where("epoch < 1998").select(*base).write.parquet(f"{landing}/era1")
    f.where("epoch >= 1998").select(*base[:-1], "xg").write.parquet(f"{landing}/era2")
    alerts = _scratch(spark, "drift-alerts")
    out = J.drift_monitor(spark, landing, base, alerts)   # one row per file
    return out.groupBy("new_columns", "dropped_columns").agg(F.max("epoch").alias("epoch"), F.max("step").alias("step"))
