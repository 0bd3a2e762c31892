"""Slice selection (FLT5, SRC7, SRC10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators.relational import bounded


def select_slice(df: DataFrame, epoch: str, step: str, epoch_value=None, step_value=None) -> DataFrame:
    """Explicit ``(epoch, step)``; an epoch's latest step; or the overall latest.

    The latest slice is found with one global aggregate (a single row, so it is
    broadcast) -- never collected to the driver.
    """
    if epoch_value is not None and step_value is not None:
        return df.where((F.col(epoch) == epoch_value) & (F.col(step) == step_value))
    base = df.where(F.col(epoch) == epoch_value) if epoch_value is not None else df
    latest = (base.groupBy().agg(F.max(F.struct(epoch, step)).alias("_l"))
                  .select(F.col("_l")[epoch].alias("_e"), F.col("_l")[step].alias("_s")))
    return (base.join(bounded(latest, 1, "one global row"),
                      (F.col(epoch) == F.col("_e")) & (F.col(step) == F.col("_s")))
                .drop("_e", "_s"))


def current_and_next(events: DataFrame, id_col: str, finished: str, is_current: str) -> DataFrame:
    """SRC7: max id of finished events and min id of unstarted, non-current ones."""
    return events.groupBy().agg(
        F.max(F.when(F.col(finished), F.col(id_col))).alias("current_step"),
        F.min(F.when(~F.col(finished) & ~F.col(is_current), F.col(id_col))).alias("next_step"))
