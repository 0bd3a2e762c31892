"""Aggregations bound to the driver tables (AGG1-AGG23)."""

from pyspark.sql import functions as F

from stepwise.catalog import EVENTS_CTE, FACT_CTE, register, with_ctes
from stepwise.functions import scalars as S
from stepwise.operators import aggregates as A
from stepwise.plans import bindings as B


@register("agg_group_basic", with_ctes("""
SELECT segment, epoch, CAST(sum(points) AS BIGINT) AS total_points, avg(points) AS mean_points,
       min(points) AS min_points, max(points) AS max_points, count(*) AS n_rows
FROM fact GROUP BY segment, epoch""", FACT_CTE), ids=("AGG1", "JN4"))
def q_agg1(spark, sf):
    return (B.fact(spark, sf).groupBy("segment", "epoch")
            .agg(F.sum("points").alias("total_points"), F.avg("points").alias("mean_points"),
                 F.min("points").alias("min_points"), F.max("points").alias("max_points"),
                 F.count(F.lit(1)).alias("n_rows")))


@register("agg_count_distinct", with_ctes("""
SELECT epoch, count(DISTINCT entity) AS n_entities, count(DISTINCT fixture) AS n_fixtures,
       count(DISTINCT CASE WHEN goals > 0 THEN fixture END) AS n_scoring_fixtures
FROM fact GROUP BY epoch""", FACT_CTE), ids=("AGG2", "AGG3"))
def q_agg2(spark, sf):
    return (B.fact(spark, sf).groupBy("epoch")
            .agg(F.count_distinct("entity").alias("n_entities"),
                 F.count_distinct("fixture").alias("n_fixtures"),
                 F.count_distinct(F.when(F.col("goals") > 0, F.col("fixture"))).alias("n_scoring_fixtures")))


@register("agg_conditional_ratio", with_ctes("""
SELECT segment, count(*) FILTER (WHERE points >= 40) AS n_hauls,
       avg(CASE WHEN is_home = 1 THEN points END) AS home_mean,
       100.0 * sum(goals) / nullif(count(*), 0) AS goals_pct
FROM fact GROUP BY segment""", FACT_CTE), ids=("AGG3", "AGG4"))
def q_agg3(spark, sf):
    return (B.fact(spark, sf).groupBy("segment")
            .agg(F.count_if(F.col("points") >= 40).alias("n_hauls"),
                 F.avg(F.when(F.col("is_home") == 1, F.col("points"))).alias("home_mean"),
                 (F.lit(100.0) * F.sum("goals") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("goals_pct")))


@register("agg_having", with_ctes("""
SELECT entity, epoch, CAST(sum(points) AS BIGINT) AS total
FROM fact GROUP BY entity, epoch HAVING total > 2300""", FACT_CTE), ids=("AGG5",))
def q_agg5(spark, sf):
    return (B.fact(spark, sf).groupBy("entity", "epoch").agg(F.sum("points").alias("total"))
            .where(F.col("total") > 2300))


@register("agg_mode_smallest", with_ctes("""
SELECT entity, epoch, other_side AS mode FROM (
  SELECT entity, epoch, other_side,
         row_number() OVER (PARTITION BY entity, epoch ORDER BY count(*) DESC, other_side) AS rn
  FROM fact GROUP BY entity, epoch, other_side) t WHERE rn = 1""", FACT_CTE), ids=("AGG7",))
def q_agg7(spark, sf):
    return A.mode_smallest(B.fact(spark, sf), ["entity", "epoch"], "other_side")


@register("agg_first_non_null", with_ctes("""
SELECT entity, epoch, other_side FROM (
  SELECT entity, epoch, other_side,
         row_number() OVER (PARTITION BY entity, epoch ORDER BY step, fixture) AS rn
  FROM fact WHERE is_home = 1) t WHERE rn = 1
UNION ALL
SELECT DISTINCT entity, epoch, NULL FROM fact f WHERE NOT EXISTS (
  SELECT 1 FROM fact g WHERE g.entity = f.entity AND g.epoch = f.epoch AND g.is_home = 1)""",
    FACT_CTE), ids=("AGG8",))
def q_agg8(spark, sf):
    f = B.fact(spark, sf).withColumn("other_side", F.when(F.col("is_home") == 1, F.col("other_side")))
    return A.first_non_null(f, ["entity", "epoch"], ["other_side"], F.struct("step", "fixture"))


@register("agg_keep_latest", with_ctes("""
SELECT entity, epoch, step, fixture, price FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY epoch DESC, step DESC, fixture) AS rn
  FROM fact) t WHERE rn = 1""", FACT_CTE), ids=("AGG9",))
def q_agg9(spark, sf):
    f = B.fact(spark, sf).select("entity", "epoch", "step", "fixture", "price")
    return A.keep_latest(f, ["entity"], ["epoch", "step"], [F.col("fixture")])


@register("agg_dedupe_exact", """
SELECT l_returnflag, count(*) FILTER (WHERE rn = 1) AS kept, count(*) FILTER (WHERE rn > 1) AS dropped
FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                 l_linestatus, l_shipdate) AS rn FROM lineitem) t
GROUP BY l_returnflag""", ids=("AGG10",))
def q_agg10(spark, sf):
    li = B.table(spark, sf, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
    marked, _ = A.dedupe_exact(li, ["l_orderkey", "l_linenumber"], order)
    return marked.groupBy("l_returnflag").agg(F.count_if(F.col("_rn") == 1).alias("kept"),
                                              F.count_if(F.col("_rn") > 1).alias("dropped"))


@register("agg_debut_epoch", with_ctes("""
SELECT entity, min(epoch) AS debut_epoch, max(epoch) AS last_epoch,
       count(DISTINCT epoch) AS n_epochs FROM fact GROUP BY entity""", FACT_CTE), ids=("AGG11",))
def q_agg11(spark, sf):
    return (B.fact(spark, sf).groupBy("entity")
            .agg(F.min("epoch").alias("debut_epoch"), F.max("epoch").alias("last_epoch"),
                 F.count_distinct("epoch").alias("n_epochs")))


@register("agg_collapse_min", with_ctes("""
SELECT epoch, side, fixture, min(home_score) AS home_score, min(away_score) AS away_score,
       min(is_home) AS is_home, min(other_side) AS other_side
FROM fact GROUP BY epoch, side, fixture""", FACT_CTE), ids=("AGG12",))
def q_agg12(spark, sf):
    return (B.fact(spark, sf).groupBy("epoch", "side", "fixture")
            .agg(F.min("home_score").alias("home_score"), F.min("away_score").alias("away_score"),
                 F.min("is_home").alias("is_home"), F.min("other_side").alias("other_side")))


@register("agg_describe", with_ctes("""
SELECT segment, count(points) AS count, avg(points) AS mean, stddev_samp(points) AS std,
       min(points) AS min, quantile_cont(points, 0.25) AS p25, quantile_cont(points, 0.5) AS p50,
       quantile_cont(points, 0.75) AS p75, max(points) AS max
FROM fact GROUP BY segment""", FACT_CTE), ids=("AGG13",))
def q_agg13(spark, sf):
    return A.describe(B.fact(spark, sf), ["segment"], "points")


@register("agg_spread", with_ctes("""
SELECT segment, count(target) AS n, avg(target) AS mean, stddev_samp(target) AS std,
       quantile_cont(target, 0.05) AS p5, quantile_cont(target, 0.5) AS median,
       quantile_cont(target, 0.95) AS p95, stddev_samp(target) / nullif(avg(target), 0) AS cv
FROM ev GROUP BY segment""", EVENTS_CTE), ids=("AGG14", "AGG15"))
def q_agg14(spark, sf):
    return A.spread(B.events(spark, sf), ["segment"], "target")


@register("agg_share_of_total", with_ctes("""
SELECT segment, is_home, count(*) AS n,
       count(*) / sum(count(*)) OVER (PARTITION BY segment) AS share
FROM fact GROUP BY segment, is_home""", FACT_CTE), ids=("AGG16",))
def q_agg16(spark, sf):
    return A.share_of_total(B.fact(spark, sf), ["segment", "is_home"], ["segment"])


@register("agg_pivot_venue", with_ctes("""
SELECT segment, avg(points) FILTER (WHERE is_home = 1) AS Home,
       avg(points) FILTER (WHERE is_home = 0) AS Away
FROM fact GROUP BY segment""", FACT_CTE), ids=("AGG17", "PRJ11"))
def q_agg17(spark, sf):
    f = B.fact(spark, sf).withColumn("venue", S.venue_label(F.col("is_home")))
    return A.pivot_table(f, ["segment"], "venue", ["Home", "Away"], F.avg("points"))


@register("agg_null_coverage", with_ctes("""
SELECT epoch,
  avg(CASE WHEN nullif(goals, 0) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS goals_cov,
  avg(CASE WHEN nullif(red, 0) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS red_cov,
  avg(CASE WHEN nullif(bonus, 0) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS bonus_cov
FROM fact GROUP BY epoch""", FACT_CTE), ids=("AGG18",))
def q_agg18(spark, sf):
    f = B.fact(spark, sf).select("epoch", *[F.nullif(F.col(c), F.lit(0)).alias(c)
                                           for c in ("goals", "red", "bonus")])
    return A.null_coverage(f, ["epoch"], ["goals", "red", "bonus"])


@register("agg_histogram", with_ctes("""
SELECT segment, bin, n, 0.0 + bin * 10.0 AS bin_lo,
       n / (sum(n) OVER (PARTITION BY segment) * 10.0) AS density
FROM (SELECT segment, CAST(floor((points - 0.0) / 10.0) AS BIGINT) AS bin, count(*) AS n
      FROM fact WHERE points IS NOT NULL GROUP BY ALL) t""", FACT_CTE), ids=("AGG19",))
def q_agg19(spark, sf):
    return A.histogram(B.fact(spark, sf), ["segment"], "points", 0.0, 10.0)


@register("agg_value_distribution", with_ctes("""
SELECT segment, bucket, n, 100.0 * n / sum(n) OVER (PARTITION BY segment) AS pct FROM (
  SELECT segment, CASE WHEN minutes < 30 THEN '<30' WHEN minutes < 60 THEN '30-59' ELSE '60+' END AS bucket,
         count(*) AS n FROM fact GROUP BY ALL) t""", FACT_CTE), ids=("AGG20", "PRJ16"))
def q_agg20(spark, sf):
    b = S.bucket_upper_bounds(F.col("minutes"), [(30, "<30"), (60, "30-59")], "60+")
    return A.value_distribution(B.fact(spark, sf), ["segment"], b)


@register("agg_epoch_summary", with_ctes("""
SELECT entity, epoch, CAST(sum(points) AS BIGINT) AS total, count(points) AS n, avg(points) AS mean,
       max(points) AS best FROM fact GROUP BY entity, epoch""", FACT_CTE), ids=("AGG22",))
def q_agg22(spark, sf):
    return A.epoch_summary(B.fact(spark, sf), ["entity", "epoch"], "points")


@register("agg_multislice_rollup", with_ctes("""
SELECT entity, epoch, step, max(price) AS max_price, CAST(sum(points) AS BIGINT) AS step_points,
       count(*) AS n_fixtures FROM fact GROUP BY entity, epoch, step""", FACT_CTE), ids=("AGG23",))
def q_agg23(spark, sf):
    return (B.fact(spark, sf).groupBy("entity", "epoch", "step")
            .agg(F.max("price").alias("max_price"), F.sum("points").alias("step_points"),
                 F.count(F.lit(1)).alias("n_fixtures")))


@register("agg_describe_skew_safe", with_ctes("""
SELECT segment, count(target) AS count, avg(target) AS mean, stddev_samp(target) AS std, min(target) AS min,
       quantile_cont(target, 0.25) AS p25, quantile_cont(target, 0.5) AS p50, quantile_cont(target, 0.75) AS p75,
       max(target) AS max
FROM ev GROUP BY segment""", EVENTS_CTE), ids=("AGG13", "AGG14"))
def q_agg13_safe(spark, sf):
    return A.describe(B.events(spark, sf), ["segment"], "target", skew_safe=True)
