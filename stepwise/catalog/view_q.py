"""Dashboard tables V1-V24 bound to the fact binding."""

from pyspark.sql import functions as F

from stepwise.catalog import FACT_CTE, MATCHES_CTE, register, with_ctes
from stepwise.functions.scalars import bucket_right_closed, clip01
from stepwise.operators import aggregates as A
from stepwise.operators import windows as W
from stepwise.plans import bindings as B
from stepwise.plans import views as V

_MQ = __import__("stepwise.catalog.model_q", fromlist=["FM_SQL", "BASE_PRED_CTE"])
BP = (*_MQ.FM_SQL, _MQ.BASE_PRED_CTE)


@register("view01_points_histogram", with_ctes("""
SELECT epoch, segment, bin, n, 0.0 + bin * 5.0 AS bin_lo, n / (sum(n) OVER (PARTITION BY epoch, segment) * 5.0) AS density
FROM (SELECT epoch, segment, CAST(floor((points - 0.0) / 5.0) AS BIGINT) AS bin, count(*) AS n FROM fact
      WHERE points IS NOT NULL GROUP BY ALL) t""", FACT_CTE), ids=("V1", "AGG19"))
def q_v1(spark, sf):
    return A.histogram(B.fact(spark, sf), ["epoch", "segment"], "points", 0.0, 5.0)


@register("view03_side_strength", with_ctes("""
SELECT epoch, side, avg(gf) AS attack, avg(ga) AS defence, count(*) AS fixtures FROM (
  SELECT DISTINCT epoch, side, fixture, CASE WHEN is_home = 1 THEN home_score ELSE away_score END AS gf,
         CASE WHEN is_home = 1 THEN away_score ELSE home_score END AS ga FROM fact) t GROUP BY epoch, side""",
    FACT_CTE), ids=("V3", "SET2"))
def q_v3(spark, sf):
    return V.side_strength(B.fact(spark, sf))


@register("view05_expected_vs_actual", with_ctes("""
SELECT entity, epoch, sum(xg) AS xg, CAST(sum(goals) AS BIGINT) AS goals, sum(goals) - sum(xg) AS over_performance
FROM fact GROUP BY entity, epoch HAVING count(*) >= 5""", FACT_CTE), ids=("V5",))
def q_v5(spark, sf):
    g = (B.fact(spark, sf).groupBy("entity", "epoch")
         .agg(F.sum("xg").alias("xg"), F.sum("goals").alias("goals"), F.count(F.lit(1)).alias("_n"))
         .where(F.col("_n") >= 5))
    return g.select("entity", "epoch", "xg", "goals", (F.col("goals") - F.col("xg")).alias("over_performance"))


@register("view06_attack_defence_quadrants", with_ctes("""
s AS (SELECT epoch, side, avg(gf) AS attack, avg(ga) AS defence, count(*) AS fixtures FROM (
  SELECT DISTINCT epoch, side, fixture, CASE WHEN is_home = 1 THEN home_score ELSE away_score END AS gf,
         CASE WHEN is_home = 1 THEN away_score ELSE home_score END AS ga FROM fact) t GROUP BY epoch, side),
m AS (SELECT epoch, median(attack) AS mx, median(defence) AS my FROM s GROUP BY epoch)
SELECT s.epoch, side, attack, defence, fixtures,
  CASE WHEN attack >= mx AND defence >= my THEN 'high-high' WHEN attack >= mx THEN 'high-low'
       WHEN defence >= my THEN 'low-high' ELSE 'low-low' END AS quadrant
FROM s JOIN m USING (epoch)""", FACT_CTE).replace("\ns AS (", "\n, s AS (", 1), ids=("V6", "AGG14"))
def q_v6(spark, sf):
    return V.quadrants(V.side_strength(B.fact(spark, sf)), ["epoch"], "attack", "defence")


@register("view07_points_by_opponent_rank", with_ctes("""
SELECT segment, CASE WHEN opp_rank >= 1 AND opp_rank <= 6 THEN 'top' WHEN opp_rank > 6 AND opp_rank <= 14 THEN 'middle'
  WHEN opp_rank > 14 AND opp_rank <= 25 THEN 'bottom' END AS rank_bucket, avg(points) AS mean_points, count(*) AS n
FROM fm GROUP BY ALL""", FACT_CTE, MATCHES_CTE, __import__("stepwise.catalog.model_q", fromlist=["FM_CTE"]).FM_CTE),
    ids=("V7", "PRJ13"))
def q_v7(spark, sf):
    from stepwise.catalog.model_q import feature_matrix
    b = bucket_right_closed(F.col("opp_rank"), [1, 6, 14, 25], ["top", "middle", "bottom"])
    return (feature_matrix(spark, sf).groupBy("segment", b.alias("rank_bucket"))
            .agg(F.avg("points").alias("mean_points"), F.count(F.lit(1)).alias("n")))


@register("view09_calibration_summary", with_ctes("""
SELECT segment, corr(pred, points) AS r, avg(abs(pred - points)) AS mae FROM bp WHERE pred IS NOT NULL
GROUP BY segment""", *BP), ids=("V9", "ST1", "ST4"))
def q_v9(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    p = _baseline_pred(spark, sf).where(F.col("pred").isNotNull())
    return p.groupBy("segment").agg(F.corr("pred", "points").alias("r"),
                                    F.avg(F.abs(F.col("pred") - F.col("points"))).alias("mae"))


@register("view10_monitor_alerts", with_ctes("""
SELECT segment, epoch, step, mae, rolling FROM (
  SELECT segment, epoch, step, mae,
    avg(mae) OVER (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling
  FROM (SELECT segment, epoch, step, avg(abs(points - 25.0)) AS mae FROM fact GROUP BY ALL) t) u
WHERE rolling > 1.5 * 8.0""", FACT_CTE), ids=("V10", "WIN10", "STR3"))
def q_v10(spark, sf):
    sl = (B.fact(spark, sf).groupBy("segment", "epoch", "step")
          .agg(F.avg(F.abs(F.col("points") - 25.0)).alias("mae")))
    out = W.rolling_alert(sl, ["segment"], ["epoch", "step"], "mae", 1.5 * 8.0)
    return out.where("alert").drop("alert")


@register("view13_difficulty_calendar", with_ctes("""
st AS (SELECT epoch, side, CAST(rank() OVER (PARTITION BY epoch ORDER BY pts DESC, gd DESC, gf DESC) AS BIGINT) AS rank
  FROM (SELECT epoch, side, sum(p) AS pts, sum(gf) - sum(ga) AS gd, sum(gf) AS gf FROM (
      SELECT epoch, home_side AS side, home_score AS gf, away_score AS ga,
             CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS p FROM mt
      UNION ALL SELECT epoch, away_side, away_score, home_score,
             CASE WHEN away_score > home_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END FROM mt) u
    GROUP BY epoch, side) s),
fo AS (SELECT side, step, arg_min(other_side, fixture) AS opponent FROM fact WHERE epoch = 1999 GROUP BY ALL)
SELECT fo.opponent, fo.side, fo.step, upper(substring(n_name, 1, 3)) AS opp_abbr,
  CASE WHEN st.rank IS NULL THEN NULL WHEN st.rank <= 6 THEN 5 WHEN st.rank <= 10 THEN 4 WHEN st.rank <= 14 THEN 3
       WHEN st.rank <= 17 THEN 2 ELSE 1 END AS difficulty
FROM fo LEFT JOIN st ON st.epoch = 1999 AND st.side = fo.opponent LEFT JOIN nation ON n_nationkey = fo.opponent""",
    FACT_CTE, MATCHES_CTE).replace("\nst AS (", "\n, st AS (", 1), ids=("V13", "AGG8", "PRJ17", "PRJ20"))
def q_v13(spark, sf):
    from stepwise.catalog.rel_q import standings_rank
    return V.difficulty_calendar(B.fact(spark, sf), standings_rank(spark, sf), B.table(spark, sf, "nation"), 1999)


@register("view15_ownership_quadrants", with_ctes("""
p AS (SELECT bp.segment, bp.entity, bp.fixture, pred, f.selected FROM bp JOIN fact f USING (entity, fixture)
      WHERE pred IS NOT NULL),
m AS (SELECT segment, median(pred) AS mx, median(selected) AS my FROM p GROUP BY segment)
SELECT p.segment, entity, fixture, pred, selected,
  CASE WHEN pred >= mx AND selected >= my THEN 'high-high' WHEN pred >= mx THEN 'high-low'
       WHEN selected >= my THEN 'low-high' ELSE 'low-low' END AS quadrant
FROM p JOIN m USING (segment)""", *BP).replace("\np AS (", "\n, p AS (", 1), ids=("V15", "AGG14"))
def q_v15(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    p = _baseline_pred(spark, sf).join(B.fact(spark, sf).select("entity", "fixture", "selected"), ["entity", "fixture"])
    return V.quadrants(p.where(F.col("pred").isNotNull()), ["segment"], "pred", "selected").select(
        "segment", "entity", "fixture", "pred", "selected", "quadrant")


@register("view16_boom_bust", with_ctes("""
g AS (SELECT entity, epoch, avg(points) AS mean, stddev_samp(points) AS std, count(*) AS n FROM fact GROUP BY ALL
      HAVING count(*) >= 5 AND stddev_samp(points) IS NOT NULL),
m AS (SELECT epoch, median(mean) AS mx, median(std) AS my FROM g GROUP BY epoch)
SELECT g.entity, g.epoch, mean, std, n,
  CASE WHEN mean >= mx AND std >= my THEN 'boom-bust' WHEN mean >= mx THEN 'steady-high'
       WHEN std >= my THEN 'volatile-low' ELSE 'steady-low' END AS quadrant
FROM g JOIN m USING (epoch)""", FACT_CTE).replace("\ng AS (", "\n, g AS (", 1), ids=("V16", "AGG15"))
def q_v16(spark, sf):
    return V.boom_bust(B.fact(spark, sf))


@register("view17_value_picks", with_ctes("""
SELECT segment, entity, points, price, points_per_price, pick FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY points_per_price DESC, entity) AS pick FROM (
    SELECT segment, entity, CAST(sum(points) AS BIGINT) AS points, arg_max(price, (step, fixture)) AS price,
           sum(points) / nullif(arg_max(price, (step, fixture)) / 10.0, 0.0) AS points_per_price
    FROM fact WHERE epoch = 1999 GROUP BY segment, entity) t) u WHERE pick <= 3""", FACT_CTE), ids=("V17", "WIN13"))
def q_v17(spark, sf):
    return V.value_picks(B.fact(spark, sf), 1999, 3)


@register("view18_form_vs_price", with_ctes("""
SELECT entity, points_roll5, price_lag1 FROM (
  SELECT entity, points_roll5, price_lag1, row_number() OVER (PARTITION BY entity ORDER BY epoch DESC, step DESC, fixture DESC) AS rn
  FROM fm) t WHERE rn = 1""", FACT_CTE, MATCHES_CTE, __import__("stepwise.catalog.model_q", fromlist=["FM_CTE"]).FM_CTE),
    ids=("V18", "AGG9"))
def q_v18(spark, sf):
    from stepwise.catalog.model_q import feature_matrix
    from stepwise.operators.aggregates import keep_latest
    fm = feature_matrix(spark, sf).select("entity", "epoch", "step", "fixture", "points_roll5", "price_lag1")
    return keep_latest(fm, ["entity"], ["epoch", "step", "fixture"]).select("entity", "points_roll5", "price_lag1")


@register("view19_entity_comparison", with_ctes("""
SELECT entity, epoch, step, fixture,
  avg(points) OVER (PARTITION BY entity, epoch ORDER BY step, fixture ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS points_roll5_incl,
  avg(points) OVER (PARTITION BY entity, epoch ORDER BY step, fixture ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS points_cum_incl
FROM fact WHERE entity IN (7, 8)""", FACT_CTE), ids=("V19", "WIN9"))
def q_v19(spark, sf):
    f = B.fact(spark, sf).where(F.col("entity").isin(7, 8)).select("entity", "epoch", "step", "fixture", "points")
    return W.inclusive_rolling_mean(f, B.FACT_ROLES, "points", 5, scale=None).drop("points")


@register("view20_price_trajectory", with_ctes("""
SELECT entity, epoch, arg_min(price, step) AS start_price, arg_max(price, step) AS end_price,
       arg_max(price, step) - arg_min(price, step) AS delta, CAST(sum(points) AS BIGINT) AS points
FROM (SELECT entity, epoch, step, max(price) AS price, sum(points) AS points FROM fact GROUP BY ALL) t
GROUP BY entity, epoch""", FACT_CTE), ids=("V20", "AGG23"))
def q_v20(spark, sf):
    return V.price_trajectory(B.fact(spark, sf))


@register("view21_rotation_risk", with_ctes("""
SELECT entity, fixture, pred, least(greatest(minutes_roll5 / 90.0, 0.0), 1.0) AS p_play FROM bp
ORDER BY pred DESC NULLS LAST, p_play ASC NULLS FIRST, entity, fixture LIMIT 20""", *BP), ids=("V21", "SRT3", "PRJ20"))
def q_v21(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    p = _baseline_pred(spark, sf).withColumn("p_play", clip01(F.col("minutes_roll5") / 90.0))
    return p.orderBy(F.col("pred").desc_nulls_last(), F.col("p_play").asc(), "entity", "fixture").limit(20) \
            .select("entity", "fixture", "pred", "p_play")


@register("view23_worst_misses", with_ctes("""
SELECT segment, entity, fixture, points, pred, abs(points - pred) AS abs_error FROM bp WHERE pred IS NOT NULL
ORDER BY abs_error DESC, entity, fixture LIMIT 5""", *BP), ids=("V23", "SRT2"))
def q_v23(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    p = _baseline_pred(spark, sf).where(F.col("pred").isNotNull()).withColumn(
        "abs_error", F.abs(F.col("points") - F.col("pred")))
    return p.orderBy(F.col("abs_error").desc(), "entity", "fixture").limit(5).select(
        "segment", "entity", "fixture", "points", "pred", "abs_error")


_EPOCHS = range(1995, 2002)


@register("view03_attack_by_epoch", with_ctes("""
SELECT side, """ + ", ".join(f"max(attack) FILTER (WHERE epoch = {e}) AS attack_{e}" for e in _EPOCHS) + """ FROM (
  SELECT epoch, side, avg(gf) AS attack FROM (
    SELECT DISTINCT epoch, side, fixture, CASE WHEN is_home = 1 THEN home_score ELSE away_score END AS gf,
           CASE WHEN is_home = 1 THEN away_score ELSE home_score END AS ga FROM fact) t GROUP BY epoch, side) s GROUP BY side""", FACT_CTE), ids=("V3", "AGG17"))
def q_v3_pivot(spark, sf):
    return V.by_epoch(V.side_strength(B.fact(spark, sf)), "attack", _EPOCHS)


@register("view23_top_lists", with_ctes("""
n AS (SELECT bp.*, abs(pred - points) AS abs_error FROM bp WHERE pred IS NOT NULL AND (epoch, step) = (SELECT max((epoch, step)) FROM bp WHERE pred IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY pred DESC, entity, fixture) AS a,
             row_number() OVER (PARTITION BY segment ORDER BY points DESC, entity, fixture) AS b FROM n)
SELECT segment, 'predicted' AS list, CAST(a AS INTEGER) AS place, entity, fixture, pred, points, abs_error FROM r WHERE a <= 5
UNION ALL SELECT segment, 'actual', CAST(b AS INTEGER), entity, fixture, pred, points, abs_error FROM r WHERE b <= 5""", *BP)
    .replace("\nn AS (", "\n, n AS (", 1), ids=("V23", "WIN13"))
def q_v23_lists(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    from stepwise.plans.slices import select_slice
    p = select_slice(_baseline_pred(spark, sf).where(F.col("pred").isNotNull()), "epoch", "step")
    return V.top_lists(p, ["segment"], "points", ["entity", "fixture"])


@register("view23_slice_summary", with_ctes("""
m AS (SELECT segment, epoch, step, count(*) AS n, avg(abs(pred - points)) AS mae, sqrt(avg((pred - points) * (pred - points))) AS rmse,
        1.0 - sum((pred - points) * (pred - points)) / nullif(count(*) * var_pop(points), 0) AS r2 FROM bp WHERE pred IS NOT NULL GROUP BY ALL),
l AS (SELECT *, avg(mae) OVER (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_mae FROM m),
k AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY pred) + (count(*) OVER (PARTITION BY segment, pred) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY segment ORDER BY points) + (count(*) OVER (PARTITION BY segment, points) - 1) / 2.0 AS ry
      FROM bp WHERE pred IS NOT NULL AND (epoch, step) = (SELECT max((epoch, step)) FROM m)),
c AS (SELECT segment, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS spearman FROM k GROUP BY segment)
SELECT l.*, rolling_mae > 14.0 AS alert, spearman FROM l LEFT JOIN c USING (segment) WHERE (epoch, step) = (SELECT max((epoch, step)) FROM m)""", *BP)
    .replace("\nm AS (", "\n, m AS (", 1), ids=("V23", "WIN10", "ST2"))
def q_v23_summary(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    return V.slice_summary(_baseline_pred(spark, sf), ["segment"], "points", 14.0)


LATEST_CTE = """lat AS (SELECT max((epoch, step)) AS m FROM bp WHERE pred IS NOT NULL),
sl AS (SELECT bp.*, f.selected FROM bp JOIN (SELECT epoch, step, fixture, entity, selected FROM fact) f USING (epoch, step, fixture, entity), lat
       WHERE pred IS NOT NULL AND (bp.epoch, bp.step) = lat.m)"""
_FDR = "CASE WHEN opp_rank <= 6 THEN 5 WHEN opp_rank <= 10 THEN 4 WHEN opp_rank <= 14 THEN 3 WHEN opp_rank <= 17 THEN 2 ELSE 1 END"


def _latest_pred(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    from stepwise.operators.relational import reattach
    from stepwise.plans.slices import select_slice
    p = select_slice(_baseline_pred(spark, sf).where(F.col("pred").isNotNull()), "epoch", "step")
    return reattach(p, B.fact(spark, sf), ["epoch", "step", "fixture", "entity"], ["selected"])


@register("view12_ranked_predictions", with_ctes(f"""
SELECT segment, entity, fixture, pred, price, difficulty, ownership_pct, differential, CAST(pick AS INTEGER) AS pick FROM (
  SELECT sl.segment, entity, fixture, pred, round(price_lag1 / 10.0, 1) AS price, {_FDR} AS difficulty,
         100.0 * selected / nullif(total, 0) AS ownership_pct, pred >= md AND 100.0 * selected / nullif(total, 0) < 10.0 AS differential,
         row_number() OVER (PARTITION BY sl.segment ORDER BY pred DESC, entity, fixture) AS pick
  FROM sl JOIN (SELECT segment, median(pred) AS md, sum(selected) AS total FROM sl GROUP BY segment) g ON g.segment = sl.segment) t
WHERE pick <= 10""", *BP, LATEST_CTE), ids=("V12", "PRJ17", "WIN13", "WIN14", "JN16"))
def q_v12(spark, sf):
    return V.ranked_predictions(_latest_pred(spark, sf), ["segment"], "price_lag1", "opp_rank", "selected", 10)


@register("view14_captain_candidates", with_ctes(f"""
SELECT entity, fixture, segment, side, other_side, CASE WHEN is_home = 1 THEN 'H' ELSE 'A' END AS venue, {_FDR} AS difficulty, pred
FROM sl ORDER BY pred DESC, entity, fixture LIMIT 3""", *BP, LATEST_CTE), ids=("V14", "SRT2"))
def q_v14(spark, sf):
    return V.captain_candidates(_latest_pred(spark, sf), "opp_rank", 3)


@register("view22_landing_status", with_ctes("""
m AS (SELECT segment, epoch, step, avg(abs(pred - points)) AS mae FROM bp WHERE pred IS NOT NULL GROUP BY ALL),
a AS (SELECT *, avg(mae) OVER (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 20.0 AS alert FROM m)
SELECT segment, epoch, step, mae, 20.0 AS threshold, CASE WHEN alert THEN 'ALERT' ELSE 'PASS' END AS status
FROM a WHERE (epoch, step) = (SELECT max((epoch, step)) FROM a)""", *BP).replace("\nm AS (", "\n, m AS (", 1), ids=("V22", "FLT5", "WIN10"))
def q_v22(spark, sf):
    from stepwise.catalog.model_q import _baseline_pred
    from stepwise.operators import stats as ST
    m = ST.regression_metrics(_baseline_pred(spark, sf), ["segment", "epoch", "step"], "points", "pred")
    return V.latest_status(W.rolling_alert(m, ["segment"], ["epoch", "step"], "mae", 20.0, 5, "rolling_mae", "alert"), 20.0)
