"""EDA analyses (E1-E24) as compositions of the operators.

Each returns a DataFrame; plotting is out of scope (see README).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.scalars import bucket_right_closed, per90
from stepwise.operators import aggregates as A
from stepwise.operators.stats import correlation


# E2
def score_bucket_shares(fact: DataFrame, col: str, edges, labels) -> DataFrame:
    b = fact.withColumn("bucket", bucket_right_closed(F.col(col), edges, labels))
    return A.share_of_total(b, ["segment", "bucket"], ["segment"])


# E3
def per90_distribution(fact: DataFrame, col: str, min_minutes: int = 1) -> DataFrame:
    r = fact.where(F.col("minutes") >= min_minutes).withColumn(
        "p90", per90(F.col(col).cast("double"), F.col("minutes").cast("double")))
    return A.describe(r, ["segment"], "p90")


# E4
def epoch_totals_distribution(fact: DataFrame, col: str) -> DataFrame:
    t = fact.groupBy("segment", "entity", "epoch").agg(F.sum(col).alias("total"))
    return A.describe(t, ["segment"], "total")


# E5
def trend_by_epoch(fact: DataFrame, col: str) -> DataFrame:
    """Mean per epoch; peak, trough, and the decline from peak to the last epoch."""
    m = fact.groupBy("epoch").agg(F.avg(col).alias("mean"))
    return m.groupBy().agg(
        F.max_by("epoch", "mean").alias("peak_epoch"), F.max("mean").alias("peak_mean"),
        F.min_by("epoch", "mean").alias("trough_epoch"), F.min("mean").alias("trough_mean"),
        F.max_by("mean", "epoch").alias("last_mean"),
    ).withColumn("decline_pct", F.lit(100.0) * (F.col("peak_mean") - F.col("last_mean")) / F.col("peak_mean"))


# E6
def era_comparison(fact: DataFrame, col: str, split_epoch: int) -> DataFrame:
    e = fact.withColumn("era", F.when(F.col("epoch") >= split_epoch, "late").otherwise("early"))
    return A.pivot_table(e, ["segment"], "era", ["early", "late"], F.avg(col))


# E7
def early_late(fact: DataFrame, col: str, early_max: int, late_min: int) -> DataFrame:
    s = fact.groupBy("step").agg(F.avg(col).alias("mean"))
    return s.groupBy().agg(F.avg(F.when(F.col("step") <= early_max, F.col("mean"))).alias("early_mean"),
                           F.avg(F.when(F.col("step") >= late_min, F.col("mean"))).alias("late_mean"))


# E8
def step_integrity(fact: DataFrame) -> DataFrame:
    return fact.groupBy("epoch").agg(F.count_distinct("step").alias("n_steps"),
                                     F.min("step").alias("first_step"), F.max("step").alias("last_step"))


# E9
def segment_profiles(fact: DataFrame, cols: Sequence[str]) -> DataFrame:
    g = fact.groupBy("segment").agg(F.sum("minutes").alias("minutes"), *[F.sum(c).alias(c) for c in cols])
    return g.select("segment", *[per90(F.col(c), F.col("minutes")).alias(f"{c}_p90") for c in cols])


# E10
def decomposition(fact: DataFrame, weights: Mapping[str, Mapping[str, float]], default: Mapping[str, float]) -> DataFrame:
    """Mean contribution of each component: ``avg(count * weight(segment))``."""
    out = []
    for comp, w_default in default.items():
        w = None
        for seg, ws in weights.items():
            if comp in ws:
                cond = F.col("segment") == seg
                w = F.when(cond, F.lit(ws[comp])) if w is None else w.when(cond, F.lit(ws[comp]))
        w = F.lit(w_default) if w is None else w.otherwise(F.lit(w_default))
        out.append(F.avg(F.col(comp) * w).alias(f"{comp}_pts"))
    return fact.groupBy("segment").agg(*out)


# E11
def heterogeneity(fact: DataFrame, col: str, min_minutes: int) -> DataFrame:
    t = (fact.groupBy("segment", "entity", "epoch")
             .agg(F.sum(col).alias("x"), F.sum("minutes").alias("m"))
             .where(F.col("m") >= min_minutes)
             .withColumn("p90", per90(F.col("x"), F.col("m"))))
    return A.spread(t, ["segment"], "p90")


def with_overall(df: DataFrame, by: str, table, name: str = "ALL") -> DataFrame:
    """A table per group and, as one more group, over all rows; ``table(df, by)`` builds either."""
    return table(df, [by]).unionByName(table(df, []).withColumn(by, F.lit(name)))


# E12 / E16 / E17 / E21 --------------------------------------------------------
def regression_summary(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(y, x).alias("r"),
                               F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def target_correlations(df: DataFrame, by: Sequence[str], target: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[correlation(target, c).alias(f"r_{c}") for c in cols])


# E13
def clean_sheet_table(fact: DataFrame) -> DataFrame:
    ga = F.when(F.col("is_home") == 1, F.col("away_score")).otherwise(F.col("home_score"))
    t = (fact.select("side", "fixture", ga.alias("ga")).distinct()
             .groupBy("side").agg(F.count_if(F.col("ga") == 0).alias("clean_sheets"),
                                  F.count(F.lit(1)).alias("fixtures")))
    w = Window.partitionBy()
    return t.withColumn("top_bottom_ratio",
                        F.max("clean_sheets").over(w) / F.nullif(F.min("clean_sheets").over(w), F.lit(0)))


# E14 / E15 ---------------------------------------------------------------------
def uplift(fact: DataFrame, col: str, flag, yes: str, no: str) -> DataFrame:
    g = fact.groupBy("segment").agg(F.avg(F.when(flag, F.col(col))).alias(yes),
                                    F.avg(F.when(~flag, F.col(col))).alias(no))
    return g.withColumn("pct_diff", F.lit(100.0) * (F.col(yes) - F.col(no)) / F.nullif(F.col(no), F.lit(0.0)))


# E19
def career_lengths(fact: DataFrame) -> DataFrame:
    c = fact.groupBy("entity").agg(F.count_distinct("epoch").alias("n_epochs"))
    return A.value_distribution(c, [], F.col("n_epochs"), "n_epochs")
