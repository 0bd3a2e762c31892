"""EDA analyses E1-E24 bound to the fact binding, with oracles."""

from pyspark.sql import functions as F

from stepwise.catalog import EVENTS_CTE, FACT_CTE, register, with_ctes
from stepwise.functions.scalars import bucket_left_closed, bucket_right_closed
from stepwise.operators import aggregates as A
from stepwise.operators import windows as W
from stepwise.plans import analyses as X
from stepwise.plans import bindings as B

_DESC = """count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min,
  quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, max({x}) AS max"""


@register("eda01_target_distribution", with_ctes(f"""
SELECT segment, {_DESC.format(x='points')} FROM fact WHERE minutes > 0 GROUP BY segment""", FACT_CTE), ids=("E1",))
def q_e1(spark, sf):
    return A.describe(B.fact(spark, sf).where(F.col("minutes") > 0), ["segment"], "points")


@register("eda02_score_bucket_shares", with_ctes("""
SELECT segment, bucket, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY segment) AS share FROM (
  SELECT segment, CASE WHEN points >= 0 AND points <= 2 THEN 'blank' WHEN points > 2 AND points <= 20 THEN 'low'
    WHEN points > 20 AND points <= 40 THEN 'mid' WHEN points > 40 AND points <= 1000 THEN 'haul' END AS bucket
  FROM fact) t GROUP BY segment, bucket""", FACT_CTE), ids=("E2", "PRJ15", "AGG16"))
def q_e2(spark, sf):
    return X.score_bucket_shares(B.fact(spark, sf), "points", [0, 2, 20, 40, 1000], ["blank", "low", "mid", "haul"])


@register("eda03_per90_distribution", with_ctes(f"""
SELECT segment, {_DESC.format(x='p90')} FROM (
  SELECT segment, CAST(points AS DOUBLE) / nullif(minutes / 90.0, 0) AS p90 FROM fact WHERE minutes >= 9) t
GROUP BY segment""", FACT_CTE), ids=("E3",))
def q_e3(spark, sf):
    return X.per90_distribution(B.fact(spark, sf), "points", 9)


@register("eda04_epoch_totals", with_ctes(f"""
SELECT segment, {_DESC.format(x='total')} FROM (
  SELECT segment, entity, epoch, CAST(sum(points) AS BIGINT) AS total FROM fact GROUP BY ALL) t GROUP BY segment""", FACT_CTE),
    ids=("E4",))
def q_e4(spark, sf):
    return X.epoch_totals_distribution(B.fact(spark, sf), "points")


@register("eda05_trend_by_epoch", with_ctes("""
SELECT arg_max(epoch, mean) AS peak_epoch, max(mean) AS peak_mean, arg_min(epoch, mean) AS trough_epoch,
       min(mean) AS trough_mean, arg_max(mean, epoch) AS last_mean,
       100.0 * (max(mean) - arg_max(mean, epoch)) / max(mean) AS decline_pct
FROM (SELECT epoch, avg(points) AS mean FROM fact GROUP BY epoch) t""", FACT_CTE), ids=("E5", "SRT5"))
def q_e5(spark, sf):
    return X.trend_by_epoch(B.fact(spark, sf), "points")


@register("eda06_era_comparison", with_ctes("""
SELECT segment, avg(points) FILTER (WHERE epoch < 1998) AS early, avg(points) FILTER (WHERE epoch >= 1998) AS late
FROM fact GROUP BY segment""", FACT_CTE), ids=("E6", "AGG17"))
def q_e6(spark, sf):
    return X.era_comparison(B.fact(spark, sf), "points", 1998)


@register("eda07_early_late", with_ctes("""
SELECT avg(mean) FILTER (WHERE step <= 3) AS early_mean, avg(mean) FILTER (WHERE step >= 10) AS late_mean
FROM (SELECT step, avg(points) AS mean FROM fact GROUP BY step) t""", FACT_CTE), ids=("E7",))
def q_e7(spark, sf):
    return X.early_late(B.fact(spark, sf), "points", 3, 10)


@register("eda08_step_integrity", with_ctes("""
SELECT epoch, count(DISTINCT step) AS n_steps, min(step) AS first_step, max(step) AS last_step
FROM fact GROUP BY epoch""", FACT_CTE), ids=("E8", "AGG2"))
def q_e8(spark, sf):
    return X.step_integrity(B.fact(spark, sf))


@register("eda09_segment_profiles", with_ctes("""
SELECT segment, sum(goals) / nullif(sum(minutes) / 90.0, 0) AS goals_p90,
       sum(assists) / nullif(sum(minutes) / 90.0, 0) AS assists_p90,
       sum(saves) / nullif(sum(minutes) / 90.0, 0) AS saves_p90
FROM fact GROUP BY segment""", FACT_CTE), ids=("E9",))
def q_e9(spark, sf):
    return X.segment_profiles(B.fact(spark, sf), ["goals", "assists", "saves"])


# Fixed scoring weights (component -> points) used by the decomposition query.
WEIGHTS = {"EUROPE": {"goals": 6.0}, "ASIA": {"goals": 5.0}}
DEFAULT_WEIGHTS = {"goals": 4.0, "assists": 3.0, "bonus": 1.0}


@register("eda10_decomposition", with_ctes("""
SELECT segment,
  avg(goals * CASE WHEN segment = 'EUROPE' THEN 6.0 WHEN segment = 'ASIA' THEN 5.0 ELSE 4.0 END) AS goals_pts,
  avg(assists * 3.0) AS assists_pts, avg(bonus * 1.0) AS bonus_pts
FROM fact GROUP BY segment""", FACT_CTE), ids=("E10",))
def q_e10(spark, sf):
    return X.decomposition(B.fact(spark, sf), WEIGHTS, DEFAULT_WEIGHTS)


@register("eda11_heterogeneity", with_ctes("""
SELECT segment, count(p90) AS n, avg(p90) AS mean, stddev_samp(p90) AS std, quantile_cont(p90, 0.05) AS p5,
       quantile_cont(p90, 0.5) AS median, quantile_cont(p90, 0.95) AS p95,
       stddev_samp(p90) / nullif(avg(p90), 0) AS cv
FROM (SELECT segment, sum(points) / nullif(sum(minutes) / 90.0, 0) AS p90 FROM fact
      GROUP BY segment, entity, epoch HAVING sum(minutes) >= 900) t GROUP BY segment""", FACT_CTE),
    ids=("E11", "AGG14", "AGG15"))
def q_e11(spark, sf):
    return X.heterogeneity(B.fact(spark, sf), "points", 900)


@register("eda12_saves_regression", with_ctes("""
SELECT segment, count(*) AS n, corr(points, saves) AS r, regr_slope(points, saves) AS slope,
       regr_intercept(points, saves) AS intercept
FROM (SELECT segment, entity, epoch, avg(points) AS points, avg(saves) AS saves FROM fact
      GROUP BY ALL HAVING count(*) >= 10) t GROUP BY segment""", FACT_CTE), ids=("E12", "ST3"))
def q_e12(spark, sf):
    t = (B.fact(spark, sf).groupBy("segment", "entity", "epoch")
         .agg(F.avg("points").alias("points"), F.avg("saves").alias("saves"), F.count(F.lit(1)).alias("_n"))
         .where(F.col("_n") >= 10))
    return X.regression_summary(t, ["segment"], "points", "saves")


@register("eda13_clean_sheet_table", with_ctes("""
SELECT side, clean_sheets, fixtures, max(clean_sheets) OVER () / nullif(min(clean_sheets) OVER (), 0) AS top_bottom_ratio
FROM (SELECT side, count(*) FILTER (WHERE ga = 0) AS clean_sheets, count(*) AS fixtures FROM (
  SELECT DISTINCT side, fixture, CASE WHEN is_home = 1 THEN away_score ELSE home_score END AS ga FROM fact) u
  GROUP BY side) t""", FACT_CTE), ids=("E13",))
def q_e13(spark, sf):
    return X.clean_sheet_table(B.fact(spark, sf))


@register("eda14_home_uplift", with_ctes("""
SELECT segment, avg(points) FILTER (WHERE is_home = 1) AS home, avg(points) FILTER (WHERE NOT is_home = 1) AS away,
  100.0 * (avg(points) FILTER (WHERE is_home = 1) - avg(points) FILTER (WHERE NOT is_home = 1))
    / nullif(avg(points) FILTER (WHERE NOT is_home = 1), 0) AS pct_diff
FROM fact GROUP BY segment""", FACT_CTE), ids=("E14", "V2"))
def q_e14(spark, sf):
    return X.uplift(B.fact(spark, sf), "points", F.col("is_home") == 1, "home", "away")


@register("eda15_vs_strong_opponents", with_ctes("""
SELECT segment, avg(points) FILTER (WHERE other_side IN (1, 2, 3, 4, 5)) AS vs_top,
  avg(points) FILTER (WHERE NOT other_side IN (1, 2, 3, 4, 5)) AS vs_rest,
  100.0 * (avg(points) FILTER (WHERE other_side IN (1, 2, 3, 4, 5)) - avg(points) FILTER (WHERE NOT other_side IN (1, 2, 3, 4, 5)))
    / nullif(avg(points) FILTER (WHERE NOT other_side IN (1, 2, 3, 4, 5)), 0) AS pct_diff
FROM fact GROUP BY segment""", FACT_CTE), ids=("E15",))
def q_e15(spark, sf):
    return X.uplift(B.fact(spark, sf), "points", F.col("other_side").isin(1, 2, 3, 4, 5), "vs_top", "vs_rest")


@register("eda16_concession_vs_points", with_ctes("""
SELECT count(*) AS n, corr(conceded, seg_mean) AS r, regr_slope(seg_mean, conceded) AS slope,
       regr_intercept(seg_mean, conceded) AS intercept FROM (
  SELECT epoch, side, avg(CASE WHEN is_home = 1 THEN away_score ELSE home_score END) AS conceded,
         avg(points) FILTER (WHERE segment = 'EUROPE') AS seg_mean
  FROM fact GROUP BY epoch, side HAVING count(*) >= 10) t""", FACT_CTE), ids=("E16", "ST1", "ST3"))
def q_e16(spark, sf):
    f = B.fact(spark, sf)
    ga = F.when(F.col("is_home") == 1, F.col("away_score")).otherwise(F.col("home_score"))
    t = (f.groupBy("epoch", "side")
         .agg(F.avg(ga).alias("conceded"),
              F.avg(F.when(F.col("segment") == "EUROPE", F.col("points"))).alias("seg_mean"),
              F.count(F.lit(1)).alias("_n"))
         .where(F.col("_n") >= 10))
    return t.groupBy().agg(F.count(F.lit(1)).alias("n"), F.corr("conceded", "seg_mean").alias("r"),
                           F.regr_slope("seg_mean", "conceded").alias("slope"),
                           F.regr_intercept("seg_mean", "conceded").alias("intercept"))


@register("eda17_price_vs_points", with_ctes("""
SELECT segment, count(*) AS n, corr(points, price) AS r, regr_slope(points, price) AS slope,
       regr_intercept(points, price) AS intercept FROM (SELECT segment, points, price FROM fact UNION ALL SELECT 'ALL', points, price FROM fact) t
GROUP BY segment""", FACT_CTE), ids=("E17", "ST1", "ST3"))
def q_e17(spark, sf):
    return X.with_overall(B.fact(spark, sf), "segment", lambda df, by: X.regression_summary(df, by, "points", "price"))


@register("eda18_price_bands", with_ctes("""
SELECT band, count(*) AS n, avg(points) AS mean_points, CAST(sum(goals) AS BIGINT) AS goals FROM (
  SELECT CASE WHEN price >= 0 AND price < 93 THEN 'budget' WHEN price >= 93 AND price < 96 THEN 'mid'
              WHEN price >= 96 THEN 'premium' END AS band, points, goals FROM fact) t GROUP BY band""",
    FACT_CTE), ids=("E18", "PRJ15"))
def q_e18(spark, sf):
    b = bucket_left_closed(F.col("price"), [0, 93, 96, float("inf")], ["budget", "mid", "premium"])
    return (B.fact(spark, sf).withColumn("band", b).groupBy("band")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("points").alias("mean_points"), F.sum("goals").alias("goals")))


@register("eda19_career_lengths", with_ctes("""
SELECT n_epochs, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM (
  SELECT entity, count(DISTINCT epoch) AS n_epochs FROM fact GROUP BY entity) t GROUP BY n_epochs""", FACT_CTE),
    ids=("E19", "AGG20"))
def q_e19(spark, sf):
    return X.career_lengths(B.fact(spark, sf))


@register("eda20_minutes_distribution", with_ctes("""
SELECT bucket, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM (
  SELECT CASE WHEN minutes >= 0 AND minutes <= 0 THEN '0' WHEN minutes > 0 AND minutes <= 45 THEN '1-45'
              WHEN minutes > 45 AND minutes <= 89 THEN '46-89' WHEN minutes > 89 AND minutes <= 90 THEN '90' END AS bucket
  FROM fact) t GROUP BY bucket""", FACT_CTE), ids=("E20", "AGG20", "PRJ13"))
def q_e20(spark, sf):
    b = bucket_right_closed(F.col("minutes"), [0, 0, 45, 89, 90], ["0", "1-45", "46-89", "90"])
    return A.value_distribution(B.fact(spark, sf), [], b)


@register("eda21_target_correlations", with_ctes("""
SELECT segment, corr(points, minutes) AS r_minutes, corr(points, goals) AS r_goals, corr(points, xg) AS r_xg,
       corr(points, price) AS r_price FROM (SELECT * FROM fact UNION ALL SELECT * REPLACE ('ALL' AS segment) FROM fact) t
GROUP BY segment""", FACT_CTE), ids=("E21", "ST1"))
def q_e21(spark, sf):
    return X.with_overall(B.fact(spark, sf), "segment", lambda df, by: X.target_correlations(df, by, "points", ["minutes", "goals", "xg", "price"]))


@register("eda22_lag1_autocorr_entity", with_ctes("""
p AS (SELECT segment, points, points_prev FROM (
  SELECT segment, points, lag(points) OVER (PARTITION BY entity, epoch ORDER BY step, fixture) AS points_prev
  FROM fact) t WHERE points_prev IS NOT NULL AND points IS NOT NULL),
r AS (SELECT segment, points, points_prev,
        rank() OVER (PARTITION BY segment ORDER BY points) + (count(*) OVER (PARTITION BY segment, points) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY segment ORDER BY points_prev) + (count(*) OVER (PARTITION BY segment, points_prev) - 1) / 2.0 AS ry FROM p)
SELECT segment, count(*) AS n_pairs, corr(points, points_prev) AS autocorr, corr(rx, ry) AS spearman FROM r GROUP BY segment""", FACT_CTE)
    .replace("\np AS (", "\n, p AS (", 1), ids=("E22", "WIN11", "ST2"))
def q_e22(spark, sf):
    from stepwise.operators import stats as ST
    f = B.fact(spark, sf).select("entity", "epoch", "step", "fixture", "segment", "points")
    p = W.lag1_pairs(f, B.FACT_ROLES, "points")
    pearson = p.groupBy("segment").agg(F.count(F.lit(1)).alias("n_pairs"), ST.correlation("points", "points_prev").alias("autocorr"))
    return pearson.join(ST.spearman(p, ["segment"], "points", "points_prev"), "segment")


@register("eda24_transfers_by_band", with_ctes("""
SELECT band, avg(transfers_in) AS mean_transfers_in, count(*) AS n FROM (
  SELECT CASE WHEN points >= 0 AND points <= 10 THEN 'low' WHEN points > 10 AND points <= 30 THEN 'mid'
              WHEN points > 30 AND points <= 1000 THEN 'high' END AS band, transfers_in FROM fact) t GROUP BY band""",
    FACT_CTE), ids=("E24",))
def q_e24(spark, sf):
    b = bucket_right_closed(F.col("points"), [0, 10, 30, 1000], ["low", "mid", "high"])
    return (B.fact(spark, sf).withColumn("band", b).groupBy("band")
            .agg(F.avg("transfers_in").alias("mean_transfers_in"), F.count(F.lit(1)).alias("n")))


@register("eda_event_value_bands", with_ctes("""
SELECT segment, CASE WHEN target >= 0 AND target <= 10 THEN 'a' WHEN target > 10 AND target <= 100 THEN 'b'
  WHEN target > 100 AND target <= 1000 THEN 'c' END AS bucket, count(*) AS n
FROM ev GROUP BY ALL""", EVENTS_CTE), ids=("PRJ13",))
def q_ev_bands(spark, sf):
    b = bucket_right_closed(F.col("target"), [0, 10, 100, 1000], ["a", "b", "c"])
    return B.events(spark, sf).groupBy("segment", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
