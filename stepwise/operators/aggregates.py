"""Aggregations (AGG1-AGG24).

Everything is a ``groupBy().agg()`` of mergeable aggregates, so Catalyst plans
a partial (map-side) aggregate before the shuffle and a hot key costs one
partial row per task, not a third of the data in one task.  Exact percentiles
come from positions by ranges (:mod:`stepwise.operators.positions`);
``approx=True`` switches to the fixed-size ``percentile_approx`` sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.operators.positions import exact_quantiles, join_null_safe


# AGG7 -------------------------------------------------------------------------
def mode_smallest(df: DataFrame, keys: Sequence[str], col: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group, ties broken towards the smallest value."""
    return df.groupBy(*keys).agg(F.mode(col, deterministic=True).alias(name))


# AGG8 -------------------------------------------------------------------------
def first_non_null(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                   order: Column) -> DataFrame:
    """First non-null value of each column in ``order`` (``min_by`` skips rows
    whose ordering value is null, so the ordering is nulled with the value)."""
    return df.groupBy(*keys).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


# AGG9 -------------------------------------------------------------------------
def keep_latest(df: DataFrame, key: Sequence[str], order_desc: Sequence[str],
                tie: Sequence[str] = ()) -> DataFrame:
    """Keep the newest row per key (``sort desc`` + ``drop_duplicates``)."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order_desc], *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# AGG10 ------------------------------------------------------------------------
def dedupe_exact(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Column]:
    """Exact-key dedupe keeping the first row in ``order``.

    Returns the marked frame (``_rn = 1`` is kept) plus a ``dropped``
    aggregate expression for the caller's summary aggregate.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("_rn", F.row_number().over(w))
    dropped = F.count_if(F.col("_rn") > 1).alias("dropped")
    return marked, dropped


# AGG13 / AGG14 / AGG15 ------------------------------------------------------
def _with_quantiles(base: DataFrame, df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], names: Sequence[str],
                    approx: bool) -> DataFrame:
    """``base`` with a group's quantiles; a group without values has nulls."""
    if approx:
        q = df.groupBy(*by).agg(F.percentile_approx(col, F.array(*[F.lit(p) for p in probs]), 10000).alias("_q"))
        q = q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        q = exact_quantiles(df, by, col, probs, names)
    return join_null_safe(base, q, by, "left") if by else base.join(F.broadcast(q), how="left")   # one row


def describe(df: DataFrame, by: Sequence[str], col: str, approx: bool = False, skew_safe: bool = True) -> DataFrame:
    """``DataFrame.describe()`` per group: count, mean, sample std, min,
    25/50/75 (linear interpolation), max.

    Quartiles are exact whatever a group's size (``skew_safe`` is always on);
    ``approx`` takes them from a fixed-size sketch."""
    base = df.groupBy(*by).agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                               F.min(col).alias("min"), F.max(col).alias("max"))
    out = _with_quantiles(base, df, by, col, [0.25, 0.5, 0.75], ["p25", "p50", "p75"], approx)
    return out.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def spread(df: DataFrame, by: Sequence[str], col: str, approx: bool = False) -> DataFrame:
    """Median, p5, p95, sample std and coefficient of variation per group."""
    base = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    out = _with_quantiles(base, df, by, col, [0.05, 0.5, 0.95], ["p5", "median", "p95"], approx)
    return out.select(*by, "n", "mean", "std", "p5", "median", "p95", (F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"))


# AGG16 ------------------------------------------------------------------------
def share_of_total(df: DataFrame, by: Sequence[str], within: Sequence[str],
                   name: str = "share") -> DataFrame:
    """Counts per ``by`` and each count's share of its ``within`` total.

    The inner window runs over the already aggregated (small) table.
    """
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    return g.withColumn(name, F.col("n") / F.sum("n").over(w))


# AGG17 ------------------------------------------------------------------------
def pivot_table(df: DataFrame, index: Sequence[str], column: str, values: Sequence,
                agg: Column) -> DataFrame:
    """Pivot with a fixed, explicit column order (no value discovery job)."""
    return df.groupBy(*index).pivot(column, list(values)).agg(agg)


# AGG18 ------------------------------------------------------------------------
def null_coverage(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                  fmt: str = "{c}_cov") -> DataFrame:
    """Share of non-null values per column, per group, in one pass."""
    return df.groupBy(*by).agg(*[
        F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias(fmt.format(c=c))
        for c in cols])


# AGG19 ------------------------------------------------------------------------
def histogram(df: DataFrame, by: Sequence[str], col: str, lo: float, width: float) -> DataFrame:
    """Fixed-width histogram: bin index, left edge, count and density
    (``n / (group total * width)``)."""
    b = F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("bigint")
    g = (df.where(F.col(col).isNotNull())
           .groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return (g.withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width))
             .withColumn("density", F.col("n") / (F.sum("n").over(w) * F.lit(width))))


# AGG20 ------------------------------------------------------------------------
def value_distribution(df: DataFrame, by: Sequence[str], bucket: Column, name: str = "bucket") -> DataFrame:
    """Counts per bucket label and the percentage of the group."""
    g = df.groupBy(*by, bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return g.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(w))


# AGG21 ------------------------------------------------------------------------
def result_points(gf: Column, ga: Column) -> Column:
    """PRJ10: 3 for a win, 1 for a draw, 0 for a loss."""
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def standings(matches: DataFrame, epoch: str, home: str, away: str,
              home_score: str, away_score: str, match_keys: Sequence[str] = ("step",),
              distinct: bool = True) -> DataFrame:
    """League table per ``(epoch, side)``: points, goal difference, goals for.

    Each match row contributes one row per side; with ``distinct`` duplicate
    match rows (one per player in the reference) are removed first.
    """
    m = matches.select(epoch, *match_keys, home, away, home_score, away_score)
    if distinct:
        m = m.distinct()
    # one pass over the matches: each match row becomes a row per side
    sides = F.explode(F.array(
        F.struct(F.col(home).alias("side"), F.col(home_score).alias("gf"), F.col(away_score).alias("ga")),
        F.struct(F.col(away).alias("side"), F.col(away_score).alias("gf"), F.col(home_score).alias("ga"))))
    both = m.select(epoch, sides.alias("_s")).select(epoch, "_s.side", "_s.gf", "_s.ga")
    both = both.withColumn("p", result_points(F.col("gf"), F.col("ga")))
    return (both.groupBy(epoch, "side")
                .agg(F.sum("p").cast("bigint").alias("pts"),
                     (F.sum("gf") - F.sum("ga")).cast("bigint").alias("gd"),
                     F.sum("gf").cast("bigint").alias("gf")))


# AGG22 ------------------------------------------------------------------------
def epoch_summary(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(col).alias("total"), F.count(col).alias("n"),
                                 F.avg(col).alias("mean"), F.max(col).alias("best"))


# AGG24 ------------------------------------------------------------------------
def mean_metric_ranked(df: DataFrame, by: Sequence[str], model: str, metric: str,
                       name: str = "mean_metric") -> DataFrame:
    g = df.groupBy(*by, model).agg(F.avg(metric).alias(name))
    w = Window.partitionBy(*by).orderBy(F.col(name), F.col(model)) if by else \
        Window.orderBy(F.col(name), F.col(model))
    return g.withColumn("model_rank", F.row_number().over(w).cast("bigint"))
