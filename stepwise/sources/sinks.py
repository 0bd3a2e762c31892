"""Sinks (SNK1-SNK7).

Builds, logs and saved runs are versioned tables (:mod:`stepwise.sources.versions`),
so a failed job never leaves a half-written table behind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.session import path_exists
from stepwise.sources.versions import Change, Store, upsert_slice

__all__ = ["rebuild", "upsert_slice", "snapshot", "export_csv", "cached_table", "freshness_key", "append_log", "save_cv_results"]


# SNK1 ------------------------------------------------------------------------
def rebuild(tables: Mapping[str, DataFrame], base: str) -> Store:
    """Full rebuild of several tables, published together as one version."""
    store = Store(next(iter(tables.values())).sparkSession, base)
    store.commit({name: Change(df) for name, df in tables.items()})
    return store


# SNK3 / SNK5 -----------------------------------------------------------------
def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# SNK4 ------------------------------------------------------------------------
def cached_table(spark: SparkSession, base: str, freshness: str, build, force: bool = False) -> DataFrame:
    """Read ``base/fresh=<freshness>`` if present (unless ``force``), else
    build and write it.  ``freshness`` is derived from the inputs (for
    example the max step), so new data never hits a stale cache."""
    path = f"{base.rstrip('/')}/fresh={freshness}"
    if not force and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def freshness_key(df: DataFrame, cols: Sequence[str]) -> str:
    row = df.agg(*[F.max(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n")).first()
    return "-".join(str(row[c]) for c in [*cols, "n"])


# SNK6 / SNK7 -----------------------------------------------------------------
def append_log(df: DataFrame, path: str, replace_keys: Sequence[str] | None = None, partition: str | None = None) -> DataFrame:
    """Append to a log; with ``replace_keys`` rows of the same key are replaced, and
    with ``partition`` only the partitions of the new rows are written again."""
    store = Store(df.sparkSession, path)
    store.commit({"data": Change(df, "upsert" if replace_keys else "append", tuple(replace_keys or ()), partition)})
    return store.read()


def save_cv_results(metrics: DataFrame, oof: DataFrame, base: str) -> Store:
    """Metrics and out-of-fold predictions of one run, published together."""
    store = Store(metrics.sparkSession, base)
    store.commit({"metrics": Change(metrics), "oof": Change(oof, partition="segment")})
    return store
