"""Statistics, metrics and folds (ST1-ST15, CV1).

Ranks for Spearman come from :mod:`stepwise.operators.positions`: ties are
collapsed to one row per distinct value, and positions are prefix sums over
ranges of values.  A hot value or a huge group therefore never lands in a
single task, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.operators.positions import average_rank, exact_quantiles, rank_correlation  # noqa: F401 (average_rank is used from here)
from stepwise.operators.windows import top_n_per_group


# ST2 -------------------------------------------------------------------------
def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, name: str = "spearman",
             key: Sequence[str] | None = None) -> DataFrame:
    """Spearman correlation per group (Pearson on average ranks), rows with a
    null in either column dropped first."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    return rank_correlation(d, by, "_x", "_y", name)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of a group; null where a column does not vary (``corr`` fails there in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


# ST4 -------------------------------------------------------------------------
def regression_metrics(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    e = F.col(pred) - F.col(y)
    n = F.count(F.lit(1))
    return df.where(F.col(pred).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.sum(e * e) / F.nullif(n * F.var_pop(y), F.lit(0.0))).alias("r2"))


def metrics_with_rank(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    return regression_metrics(df, by, y, pred).join(spearman(df, by, pred, y), list(by), "left")


# ST5 / ST6 -------------------------------------------------------------------
def top_n_precision(df: DataFrame, by: Sequence[str], slice_cols: Sequence[str], y: str, pred: str,
                    key: Sequence[str], n: int = 10, variable_k: bool = False) -> DataFrame:
    """Share of the true top-``n`` found in the predicted top-``n`` per slice,
    averaged over slices.

    ``variable_k=False`` (ST5): slices with ``<= n`` rows are skipped.
    ``variable_k=True`` (ST6): ``k = min(n, rows)`` and every slice counts.
    Both top lists are per-slice ``row_number() <= n`` filters, which Catalyst
    turns into a partial top-k before the shuffle.
    """
    g = list(by) + list(slice_cols)
    k_ = [F.col(c) for c in key]
    tp = top_n_per_group(df, g, [F.col(pred).desc(), *k_], n, rank_name="_rp").select(*g, *key, "_rp")
    ta = top_n_per_group(df, g, [F.col(y).desc(), *k_], n, rank_name="_ra").select(*g, *key, "_ra")
    sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_rows"))
    kk = F.least(F.col("_rows"), F.lit(n)) if variable_k else F.lit(n)
    both = (tp.join(ta, g + list(key)).join(sizes, g)
              .where((F.col("_rp") <= kk) & (F.col("_ra") <= kk))
              .groupBy(*g).agg(F.count(F.lit(1)).alias("_hits")))
    per_slice = sizes.join(both, g, "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    if not variable_k:
        per_slice = per_slice.where(F.col("_rows") > n)
    per_slice = per_slice.withColumn("_p", F.col("_hits") / kk)
    return per_slice.groupBy(*by).agg(F.avg("_p").alias(f"top{n}_precision"),
                                      F.count(F.lit(1)).alias("n_slices"))


# ST7 / ST8 -------------------------------------------------------------------
def stratified_metrics(df: DataFrame, by: Sequence[str], y: str, pred: str,
                       strata: dict[str, Column], min_n: int = 10) -> DataFrame:
    """Metrics per stratum; a row belongs to every stratum whose predicate
    holds (explode of the matching labels); strata with < ``min_n`` rows dropped."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in strata.items()]))
    ex = df.withColumn("stratum", F.explode(labels))
    m = regression_metrics(ex, list(by) + ["stratum"], y, pred)
    return m.where(F.col("n") >= min_n)


def stratified_ranks(df: DataFrame, by: Sequence[str], y: str, pred: str, strata: dict[str, Column], slice_cols: Sequence[str],
                     key: Sequence[str], n: int = 10, min_n: int = 10) -> DataFrame:
    """Spearman and top-``n`` precision per stratum, next to the row count; strata with < ``min_n`` rows dropped.
    Ranks and top lists are those within the stratum."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in strata.items()]))
    ex = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull()).withColumn("stratum", F.explode(labels))
    g = [*by, "stratum"]
    sizes = ex.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    top = top_n_precision(ex, g, slice_cols, y, pred, key, n).select(*g, f"top{n}_precision")
    return sizes.join(spearman(ex, g, pred, y), g, "left").join(top, g, "left")


# ST14 ------------------------------------------------------------------------
def slice_spearman(df: DataFrame, by: Sequence[str], slice_cols: Sequence[str], y: str, pred: str) -> DataFrame:
    """Mean over slices of the Spearman correlation within a slice; slices without one (nothing varies) are left out."""
    per_slice = spearman(df, [*by, *slice_cols], pred, y)
    return per_slice.groupBy(*by).agg(F.avg("spearman").alias("mean_spearman"), F.count("spearman").alias("n_ranked_slices"))


# ST9 -------------------------------------------------------------------------
def residual_stats(df: DataFrame, by: Sequence[str], y: str, pred: str, rank: str, step: str) -> DataFrame:
    r = df.withColumn("_res", F.col(y) - F.col(pred)).withColumn("_abs", F.abs("_res"))
    per_step = r.groupBy(*by, step).agg(F.avg("_abs").alias("_step_mae"))
    worst = per_step.groupBy(*by).agg(F.max_by(step, "_step_mae").alias("worst_step"),
                                      F.max("_step_mae").alias("worst_step_mae"))
    means = r.groupBy(*by).agg(
        F.avg("_res").alias("mean_residual"),
        F.avg(F.when(F.col(rank) <= 5, F.col("_res"))).alias("mean_residual_vs_top5"),
        F.avg(F.when(F.col(rank) >= 21, F.col("_res"))).alias("mean_residual_vs_bottom5"))
    rho = spearman(r, by, "_abs", pred, "rho_abs_residual_pred")
    return means.join(worst, list(by), "left").join(rho, list(by), "left")


# ST11 ------------------------------------------------------------------------
def calibration(df: DataFrame, by: Sequence[str], y: str, pred: str, q: int = 10) -> DataFrame:
    from stepwise.operators.windows import quantile_bins
    b = quantile_bins(df.where(F.col(pred).isNotNull()), pred, q, by=by, name="bin")
    return b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(pred).alias("mean_pred"),
                                     F.avg(y).alias("mean_actual"))


# ST13 / ST15 -----------------------------------------------------------------
def baseline_gate(metrics: DataFrame, by: Sequence[str], model: str, baseline: str,
                  need: int = 2) -> DataFrame:
    """A model passes when it beats the baseline on ``need`` of (MAE lower,
    RMSE lower, Spearman higher)."""
    b = metrics.where(F.col(model) == baseline).select(
        *by, F.col("mae").alias("_bmae"), F.col("rmse").alias("_brmse"), F.col("spearman").alias("_bsp"))
    j = metrics.where(F.col(model) != baseline).join(b, list(by))
    wins = ((F.col("mae") < F.col("_bmae")).cast("int") + (F.col("rmse") < F.col("_brmse")).cast("int")
            + F.coalesce((F.col("spearman") > F.col("_bsp")).cast("int"), F.lit(0)))
    return j.select(*by, model, wins.alias("wins"), (wins >= need).alias("beats_baseline"))


def family_gate(mae: DataFrame, segment: str, model: str, comparator: str, need: int = 2) -> DataFrame:
    c = mae.where(F.col(model) == comparator).select(segment, F.col("mae").alias("_cmae"))
    j = mae.where(F.col(model) != comparator).join(c, segment)
    return j.groupBy(model).agg(F.count_if(F.col("mae") < F.col("_cmae")).alias("segments_won"),
                                (F.count_if(F.col("mae") < F.col("_cmae")) >= need).alias("passes"))


# CV1 -------------------------------------------------------------------------
def expanding_folds(df: DataFrame, epoch: str, n_folds: int, min_train: int = 1) -> DataFrame:
    """``(fold, train_epochs, val_epoch)`` for the last ``n_folds`` epochs:
    fold i trains on every earlier epoch.  Built from the distinct epochs
    (one row per epoch -- a bounded table)."""
    e = df.select(epoch).distinct()
    w = Window.orderBy(epoch)
    e = e.withColumn("_i", F.row_number().over(w))
    e = e.withColumn("train_epochs", F.collect_list(epoch).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # the epoch table is tiny (one row per epoch), so a global window is fine
    e = e.withColumn("_n", F.max("_i").over(Window.partitionBy()))
    out = e.where((F.col("_i") > F.col("_n") - n_folds) & (F.size("train_epochs") >= min_train))
    return out.select((F.col("_i") - F.col("_n") + n_folds).cast("int").alias("fold"),
                      "train_epochs", F.col(epoch).alias("val_epoch"))


def assign_folds(df: DataFrame, folds: DataFrame, epoch: str) -> DataFrame:
    """Long table: every row once per fold it serves in, with ``role``
    ``train`` or ``val``.  ``folds`` is bounded by the number of epochs."""
    roles = (folds.select("fold", F.explode("train_epochs").alias(epoch), F.lit("train").alias("role"))
                  .unionByName(folds.select("fold", F.col("val_epoch").alias(epoch), F.lit("val").alias("role"))))
    # equi-join on the epoch against a table of (folds x epochs) rows: a hash join
    return df.join(F.broadcast(roles), epoch)


# ST12 ------------------------------------------------------------------------
def learning_curve(long: DataFrame, metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fold metrics next to the **computed** training-set size of the fold."""
    sizes = long.where(F.col("role") == "train").groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("train_rows"))
    return metrics.join(sizes, list(by) + ["fold"], "left")
