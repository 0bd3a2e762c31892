"""Window operators bound to the driver tables (WIN1-WIN14)."""

from pyspark.sql import functions as F

from stepwise.catalog import EVENTS_CTE, FACT_CTE, MATCHES_CTE, ORDERS_CTE, register, with_ctes
from stepwise.operators import windows as W
from stepwise.operators.aggregates import standings
from stepwise.plans import bindings as B

R = B.EVENT_ROLES
_WIN = "PARTITION BY entity, epoch ORDER BY step, seq"


@register("win_lagged_rolling_mean", with_ctes(f"""
SELECT entity, epoch, step, seq, target,
  avg(target) OVER ({_WIN} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS target_roll3,
  avg(target) OVER ({_WIN} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS target_roll5
FROM ev""", EVENTS_CTE), ids=("WIN1",))
def q_win1(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "target")
    return W.lagged_rolling_mean(ev, R, ["target"], ks=(3, 5))


@register("win_lagged_expanding_mean", with_ctes(f"""
SELECT entity, epoch, step, seq,
  avg(target) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target_todate
FROM ev""", EVENTS_CTE), ids=("WIN2",))
def q_win2(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "target")
    return W.lagged_expanding_mean(ev, R, ["target"]).drop("target")


@register("win_lag1", with_ctes(f"""
SELECT entity, epoch, step, seq,
  lag(target, 1) OVER ({_WIN}) AS target_lag1,
  lag(segment, 1) OVER ({_WIN}) AS segment_lag1
FROM ev""", EVENTS_CTE), ids=("WIN3",))
def q_win3(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "target", "segment")
    return W.lag_features(ev, R, ["target", "segment"]).drop("target", "segment")


@register("win_lagged_expanding_sum", with_ctes(f"""
SELECT entity, epoch, step, seq,
  sum(target) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target_cum_prior
FROM ev""", EVENTS_CTE), ids=("WIN4",))
def q_win4(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "target")
    return W.lagged_expanding_sum(ev, R, ["target"]).drop("target")


@register("win_prior_count_rate", with_ctes(f"""
SELECT entity, epoch, step, seq,
  CAST(row_number() OVER ({_WIN}) - 1 AS BIGINT) AS n_prior,
  sum(target) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    / nullif(row_number() OVER ({_WIN}) - 1, 0) AS target_prior_rate
FROM ev""", EVENTS_CTE), ids=("WIN5",))
def q_win5(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "target")
    return W.prior_count_and_rate(ev, R, "target").drop("target")


@register("win_lagged_rolling_rate", with_ctes(f"""
SELECT entity, epoch, step, seq,
  avg(CAST(segment = 'purchase' AS DOUBLE)) OVER ({_WIN} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS purchase_rate5
FROM ev""", EVENTS_CTE), ids=("WIN6",))
def q_win6(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "segment")
    return W.lagged_rolling_rate(ev, R, F.col("segment") == "purchase", 5, "purchase_rate5").drop("segment")


@register("win_standings_rank", with_ctes("""
SELECT epoch, side, pts, gd, gf,
  CAST(rank() OVER (PARTITION BY epoch ORDER BY pts DESC, gd DESC, gf DESC) AS BIGINT) AS rank
FROM (
  SELECT epoch, side, CAST(sum(pts) AS BIGINT) AS pts, CAST(sum(gf) - sum(ga) AS BIGINT) AS gd,
         CAST(sum(gf) AS BIGINT) AS gf
  FROM (
    SELECT epoch, home_side AS side, home_score AS gf, away_score AS ga,
           CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS pts
    FROM mt
    UNION ALL
    SELECT epoch, away_side, away_score, home_score,
           CASE WHEN away_score > home_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END
    FROM mt) t
  GROUP BY epoch, side) s""", MATCHES_CTE), ids=("WIN7", "AGG21", "PRJ10"))
def q_win7(spark, sf):
    table = standings(B.matches(spark, sf), "epoch", "home_side", "away_side", "home_score", "away_score")
    return W.multi_key_rank(table, ["epoch"], ["pts", "gd", "gf"])


@register("win_group_count_share", with_ctes("""
SELECT entity, segment, n, count(*) OVER (PARTITION BY entity) AS group_n,
       n / sum(n) OVER (PARTITION BY entity) AS share
FROM (SELECT entity, segment, count(*) AS n FROM ev GROUP BY entity, segment) t""", EVENTS_CTE),
    ids=("WIN8", "AGG16"))
def q_win8(spark, sf):
    g = B.events(spark, sf).groupBy("entity", "segment").agg(F.count(F.lit(1)).alias("n"))
    return W.group_count_share(g, ["entity"], "n", "group_n", "share")


@register("win_inclusive_rolling", with_ctes(f"""
SELECT entity, epoch, step, seq,
  avg(target) OVER ({_WIN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS target_roll3_incl,
  avg(target) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS target_cum_incl
FROM ev""", EVENTS_CTE), ids=("WIN9",))
def q_win9(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "target")
    return W.inclusive_rolling_mean(ev, R, "target", 3, scale=None).drop("target")


@register("win_rolling_alert", with_ctes("""
SELECT segment, epoch, step, mae,
  avg(mae) OVER (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling,
  avg(mae) OVER (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 60.0 AS alert
FROM (SELECT segment, epoch, step, avg(abs(target - 50.0)) AS mae FROM ev GROUP BY ALL) t""", EVENTS_CTE),
    ids=("WIN10",))
def q_win10(spark, sf):
    sl = (B.events(spark, sf).groupBy("segment", "epoch", "step")
          .agg(F.avg(F.abs(F.col("target") - 50.0)).alias("mae")))
    return W.rolling_alert(sl, ["segment"], ["epoch", "step"], "mae", 60.0)


@register("win_lag1_autocorr", with_ctes(f"""
SELECT segment, count(*) AS n_pairs, corr(target, target_prev) AS autocorr
FROM (SELECT segment, target, lag(target) OVER ({_WIN}) AS target_prev FROM ev) t
WHERE target_prev IS NOT NULL AND target IS NOT NULL
GROUP BY segment""", EVENTS_CTE), ids=("WIN11",))
def q_win11(spark, sf):
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "segment", "target")
    p = W.lag1_pairs(ev, R, "target")
    return p.groupBy("segment").agg(F.count(F.lit(1)).alias("n_pairs"),
                                    F.corr("target", "target_prev").alias("autocorr"))


@register("win_quantile_bins", with_ctes("""
SELECT seq, target,
  CAST(len(list_filter(e[2:len(e)-1], lambda x: x < target)) AS INTEGER) AS bin
FROM ev, (SELECT list_sort(list_distinct(quantile_cont(target, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM ev) q
""", EVENTS_CTE), ids=("WIN12",))
def q_win12(spark, sf):
    ev = B.events(spark, sf).select("seq", "target")
    return W.quantile_bins(ev, "target", 10)


@register("win_top_n_per_segment", with_ctes("""
SELECT segment, entity, epoch, step, seq, target FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY target DESC, seq) AS rn FROM ev) t
WHERE rn <= 5""", EVENTS_CTE), ids=("WIN13",))
def q_win13(spark, sf):
    ev = B.events(spark, sf).select("segment", "entity", "epoch", "step", "seq", "target")
    return W.top_n_per_group(ev, ["segment"], [F.col("target").desc(), F.col("seq")], 5)


@register("win_median_flag", with_ctes("""
SELECT seq, segment, target, median(target) OVER (PARTITION BY segment) AS segment_median,
       coalesce(target >= median(target) OVER (PARTITION BY segment) AND entity < 10, false) AS flag
FROM ev""", EVENTS_CTE), ids=("WIN14",))
def q_win14(spark, sf):
    ev = B.events(spark, sf).select("seq", "segment", "target", "entity")
    return W.median_flag(ev, ["segment"], "target", F.col("entity") < 10).drop("entity")


@register("win_features_hot_split", with_ctes(f"""
SELECT entity, epoch, step, seq, target,
  avg(target) OVER ({_WIN} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS target_roll3,
  avg(target) OVER ({_WIN} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS target_roll5,
  avg(target) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target_todate,
  lag(target, 1) OVER ({_WIN}) AS target_lag1
FROM ev""", EVENTS_CTE), ids=("WIN1", "WIN2", "WIN3"))
def q_win_hot(spark, sf):
    """Same features with every group above 12 rows treated as hot (forces
    the split path on most user-weeks: blocks of 8 positions, 4 ranges)."""
    from stepwise.operators.hotgroups import lagged_features
    ev = B.events(spark, sf).select("entity", "epoch", "step", "seq", "target")
    return lagged_features(ev, R, ["target"], (3, 5), ["target"], ["target"], hot_rows=12, partitions=4, block=8)
