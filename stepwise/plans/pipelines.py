"""End-to-end compositions: the slice run (PL2) and the epoch retrain (PL3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators import stats as ST
from stepwise.operators.relational import column_drift
from stepwise.operators.windows import rolling_alert
from stepwise.plans import folds as FD
from stepwise.plans import runner as RN
from stepwise.session import write_and_reload
from stepwise.sources.sinks import rebuild, upsert_slice


def run_slice(existing: DataFrame, new_slice: DataFrame, keys: Sequence[str], expected_cols: Sequence[str],
              features, score, monitor_log: DataFrame | None, threshold: float, base: str | None = None) -> dict[str, DataFrame]:
    """PL2: upsert the new slice (SNK2), check its columns (SET3), rebuild
    features, score the slice, compute its metrics and the rolling monitor.

    ``features(table) -> feature frame``; ``score(features, slice) -> frame with pred``.
    With ``base`` every result is written as one new build there (SNK1) and read back.
    """
    spark = existing.sparkSession
    new_cols, dropped = column_drift(expected_cols, new_slice.columns)
    drift = spark.createDataFrame([(",".join(new_cols), ",".join(dropped))], "new_columns string, dropped_columns string")
    table = upsert_slice(existing, new_slice, keys)
    if base is not None:
        table = write_and_reload(table, "slice-table")
    fm = features(table)
    scored = score(fm, new_slice)
    if base is not None:
        scored = write_and_reload(scored, "slice-scored")   # the slice's rows: metrics and build read them, the features are built once
    m = ST.regression_metrics(scored, ["segment", "epoch", "step"], "points", "pred")
    log = m if monitor_log is None else upsert_slice(monitor_log, m, ["segment", "epoch", "step"])
    mon = rolling_alert(log, ["segment"], ["epoch", "step"], "mae", threshold, 5, "rolling_mae", "alert")
    out = {"table": table, "drift": drift, "scored": scored, "monitor": mon}
    if base is None:
        return out
    build = rebuild(out, base)
    return {name: build.read(name) for name in out}


def retrain(fm: DataFrame, feats: Sequence[str], target: str, alphas: Sequence[float], n_folds: int = 3,
            min_epochs: int = 2) -> dict[str, DataFrame]:
    """PL3: prerequisites, evaluate (CV2), alpha grid (CV3), full fit (ML19),
    meta models (ML17) and the summary (V24)."""
    n_epochs = fm.select("epoch").distinct().count()
    if n_epochs < min_epochs:
        raise ValueError(f"need at least {min_epochs} epochs, found {n_epochs}")
    data = FD.Folds(fm, feats, target, n_folds)
    grid = write_and_reload(FD.ridge_alpha_grid(data, alphas), "retrain-grid")   # one row per segment and alpha
    best = grid.where("is_best").select("segment", F.col("alpha").alias("best_alpha"))
    chosen = {r["segment"]: r["best_alpha"] for r in best.collect()}   # bounded by the segments of the moments
    bases = [RN.linear(f"ridge_{i}", FD.ridge(a)) for i, a in enumerate(alphas)] + [RN.linear("bayesian_ridge", FD.bayesian()), RN.venue_mean()]
    names = [m.name for m in bases]
    run = RN.run(RN.Graph([*bases, RN.average("average", names), RN.stacking(names)]), data, ["average", "stacking"])
    pick = F.lit(None).cast("double")
    for seg, a in chosen.items():
        pick = F.when(F.col("segment") == F.lit(seg), F.col(f"pred_ridge_{list(alphas).index(a)}")).otherwise(pick)
    oof = run.frame.withColumn("pred", pick)
    metrics = ST.metrics_with_rank(oof, ["segment", "fold"], target, "pred")
    cv_mae = metrics.groupBy("segment").agg(F.avg("mae").alias("cv_mae"))
    summary = (metrics.groupBy("segment").agg(F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"),
                                              F.avg("r2").alias("mean_r2"), F.avg("spearman").alias("mean_spearman"))
                      .join(best, "segment"))
    stack_mae = oof.groupBy("segment").agg(
        F.avg(F.abs(F.col("pred_stacking") - F.col(target))).alias("stacking_mae"),
        F.avg(F.abs(F.col("pred_average") - F.col(target))).alias("average_mae"))
    summary = summary.join(stack_mae, "segment", "left")
    stacked = oof
    return {"grid": grid, "metrics": metrics, "cv_mae": cv_mae, "stacked": stacked, "summary": summary}
