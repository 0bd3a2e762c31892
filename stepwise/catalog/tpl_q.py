"""Analyst templates T1-T20 bound to the fact binding, with oracles."""

from pyspark.sql import functions as F

from stepwise.catalog import FACT_CTE, register, with_ctes
from stepwise.plans import bindings as B
from stepwise.plans import templates as T

LATEST = "(epoch, step, fixture)"


def _f(spark, sf):
    return B.fact(spark, sf)


@register("tpl01_team_roster", with_ctes("""
SELECT entity, segment, CAST(sum(points) AS BIGINT) AS points, CAST(sum(minutes) AS BIGINT) AS minutes,
       CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists,
       count(*) FILTER (WHERE minutes > 0) AS apps
FROM fact WHERE side = 3 AND epoch = 1998 AND segment IN ('EUROPE', 'AMERICA') GROUP BY entity, segment""",
    FACT_CTE), ids=("T1",))
def q_t1(spark, sf):
    return T.team_roster(_f(spark, sf), 3, 1998, ["EUROPE", "AMERICA"])


@register("tpl02_top_scorers", with_ctes(f"""
SELECT entity, CAST(sum(points) AS BIGINT) AS points, CAST(sum(goals) AS BIGINT) AS goals,
       arg_max(side, {LATEST}) AS side, arg_max(segment, {LATEST}) AS segment
FROM fact WHERE epoch = 1998 AND segment = 'EUROPE' GROUP BY entity ORDER BY points DESC, entity LIMIT 10""",
    FACT_CTE), ids=("T2", "AGG6"))
def q_t2(spark, sf):
    return T.top_scorers(_f(spark, sf), 1998, 10, "EUROPE")


@register("tpl03_team_summary", with_ctes("""
SELECT side, count(DISTINCT entity) AS squad, CAST(sum(points) AS BIGINT) AS points,
       CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists
FROM fact WHERE epoch = 1997 GROUP BY side ORDER BY goals DESC, side""", FACT_CTE), ids=("T3",))
def q_t3(spark, sf):
    return T.team_summary(_f(spark, sf), 1997, "goals")


@register("tpl04_entity_career", with_ctes("""
SELECT epoch, CAST(sum(points) AS BIGINT) AS points, CAST(sum(minutes) AS BIGINT) AS minutes,
       CAST(sum(goals) AS BIGINT) AS goals, count(*) AS rows,
       arg_min(price, (step, fixture)) AS start_price, arg_max(price, (step, fixture)) AS end_price,
       arg_max(price, (step, fixture)) - arg_min(price, (step, fixture)) AS price_change
FROM fact WHERE entity = 7 GROUP BY epoch""", FACT_CTE), ids=("T4", "V4", "AGG22"))
def q_t4(spark, sf):
    return T.entity_career(_f(spark, sf), 7)


@register("tpl05_step_results", with_ctes("""
SELECT entity, fixture, segment, side, other_side, minutes, points,
       CASE WHEN is_home = 1 THEN 'H' ELSE 'A' END AS venue
FROM fact WHERE epoch = 1999 AND step = 6 AND minutes >= 45 AND segment IN ('ASIA', 'EUROPE', 'AFRICA')""",
    FACT_CTE), ids=("T5",))
def q_t5(spark, sf):
    return T.step_results(_f(spark, sf), 1999, 6, 45, ["ASIA", "EUROPE", "AFRICA"])


@register("tpl06_head_to_head", with_ctes("""
SELECT epoch, CAST(sum(points) FILTER (WHERE entity = 7) AS BIGINT) AS points_a,
       CAST(sum(points) FILTER (WHERE entity = 8) AS BIGINT) AS points_b
FROM fact WHERE entity IN (7, 8) GROUP BY epoch""", FACT_CTE), ids=("T6", "SET1"))
def q_t6(spark, sf):
    return T.head_to_head(_f(spark, sf), 7, 8)


@register("tpl07_xg_leaders_per90", with_ctes(f"""
SELECT entity, sum(xg) AS total, CAST(sum(minutes) AS BIGINT) AS minutes, arg_max(side, {LATEST}) AS side,
       sum(xg) / nullif(sum(minutes) / 90.0, 0) AS value
FROM fact WHERE epoch = 2000 AND minutes > 0 GROUP BY entity ORDER BY value DESC NULLS LAST, entity LIMIT 10""", FACT_CTE),
    ids=("T7", "PRJ12"))
def q_t7(spark, sf):
    return T.xg_leaders(_f(spark, sf), 2000, 10, "xg", per_90=True)


@register("tpl08_price_movers", with_ctes("""
SELECT entity, start_price, end_price, change FROM (
  SELECT entity, arg_min(price, (step, fixture)) AS start_price, arg_max(price, (step, fixture)) AS end_price,
         arg_max(price, (step, fixture)) - arg_min(price, (step, fixture)) AS change
  FROM fact WHERE epoch = 1996 GROUP BY entity) t
WHERE change IS NOT NULL ORDER BY change DESC, entity LIMIT 10""", FACT_CTE), ids=("T8",))
def q_t8(spark, sf):
    return T.price_movers(_f(spark, sf), 1996, 10, "risers")


@register("tpl09_reliable_starters", with_ctes("""
SELECT entity, count(*) FILTER (WHERE minutes > 0) AS apps, CAST(sum(minutes) AS BIGINT) AS minutes,
       CAST(sum(points) AS BIGINT) AS points,
       sum(points) / nullif(count(*) FILTER (WHERE minutes > 0), 0) AS points_per_app
FROM fact WHERE epoch = 1998 AND segment = 'ASIA' AND minutes > 0 GROUP BY entity HAVING apps >= 60
ORDER BY minutes DESC, entity LIMIT 10""", FACT_CTE), ids=("T9", "AGG5"))
def q_t9(spark, sf):
    return T.reliable_starters(_f(spark, sf), 1998, 60, 10, "ASIA")


@register("tpl10_transfers", with_ctes("""
SELECT entity, fixture, selected FROM fact WHERE epoch = 1999 AND step = 3
ORDER BY selected DESC, entity, fixture LIMIT 15""", FACT_CTE), ids=("T10",))
def q_t10(spark, sf):
    return T.transfers(_f(spark, sf), 1999, 3, "selected", 15)


@register("tpl11_defensive_record", with_ctes("""
SELECT side, count(DISTINCT CASE WHEN (CASE WHEN is_home = 1 THEN away_score ELSE home_score END) = 0 THEN fixture END) AS clean_sheets,
       count(DISTINCT fixture) AS fixtures,
       100.0 * count(DISTINCT CASE WHEN (CASE WHEN is_home = 1 THEN away_score ELSE home_score END) = 0 THEN fixture END)
         / nullif(count(DISTINCT fixture), 0) AS clean_sheet_pct
FROM fact WHERE epoch = 1997 AND segment = 'AMERICA' AND minutes >= 60 GROUP BY side""", FACT_CTE),
    ids=("T11", "AGG3"))
def q_t11(spark, sf):
    return T.defensive_record(_f(spark, sf), 1997, "AMERICA", 60)


@register("tpl12_bonus_leaders", with_ctes(f"""
SELECT entity, CAST(sum(bonus) AS BIGINT) AS bonus, CAST(sum(points) AS BIGINT) AS points,
       arg_max(side, {LATEST}) AS side, 100.0 * sum(bonus) / nullif(sum(points), 0) AS bonus_pct
FROM fact WHERE epoch = 1999 AND minutes > 0 GROUP BY entity ORDER BY bonus DESC, entity LIMIT 10""", FACT_CTE), ids=("T12",))
def q_t12(spark, sf):
    return T.bonus_leaders(_f(spark, sf), 1999, 10)


@register("tpl13_haul_hunters", with_ctes(f"""
SELECT entity, count(*) FILTER (WHERE points >= 45) AS hauls, count(*) FILTER (WHERE minutes > 0) AS apps,
       max(points) AS best, avg(points) FILTER (WHERE minutes > 0) AS mean_points, arg_max(side, {LATEST}) AS side,
       count(*) FILTER (WHERE points >= 45) / nullif(count(*) FILTER (WHERE minutes > 0), 0) AS haul_rate
FROM fact GROUP BY entity HAVING apps >= 5 ORDER BY hauls DESC, mean_points DESC, entity LIMIT 10""", FACT_CTE), ids=("T13",))
def q_t13(spark, sf):
    return T.haul_hunters(_f(spark, sf), 45, 10)


@register("tpl14_current_form", with_ctes("""
SELECT entity, CAST(sum(points) AS BIGINT) AS form_points, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) AS rows
FROM fact WHERE epoch = 2000 AND step > (SELECT max(step) FROM fact WHERE epoch = 2000) - 3
AND minutes >= 45 GROUP BY entity ORDER BY form_points DESC, entity LIMIT 10""", FACT_CTE),
    ids=("T14", "JN9"))
def q_t14(spark, sf):
    return T.current_form(_f(spark, sf), 2000, 3, 45, 10)


@register("tpl15_venue_splits", with_ctes("""
SELECT epoch, CASE WHEN is_home = 1 THEN 'Home' ELSE 'Away' END AS venue, count(*) AS rows,
       avg(points) AS mean_points, CAST(sum(goals) AS BIGINT) AS goals
FROM fact WHERE entity = 11 AND minutes > 0 GROUP BY ALL""", FACT_CTE), ids=("T15", "PRJ11"))
def q_t15(spark, sf):
    return T.venue_splits(_f(spark, sf), 11, by_epoch=True)


@register("tpl15_venue_splits_overall", with_ctes("""
SELECT CASE WHEN is_home = 1 THEN 'Home' ELSE 'Away' END AS venue, count(*) AS rows, avg(points) AS mean_points, CAST(sum(goals) AS BIGINT) AS goals
FROM fact WHERE entity = 11 AND minutes > 0 GROUP BY ALL""", FACT_CTE), ids=("T15", "PRJ11"))
def q_t15_overall(spark, sf):
    return T.venue_splits(_f(spark, sf), 11)


@register("tpl16_expected_returns", with_ctes("""
SELECT entity, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, count(*) AS apps,
       CAST(sum(goals) + sum(assists) AS BIGINT) AS returns, sum(xg) AS xg, sum(goals) - sum(xg) AS goals_over_xg
FROM fact WHERE epoch = 1997 AND minutes > 0 AND segment = 'ASIA' GROUP BY entity HAVING count(*) >= 5 ORDER BY goals DESC, entity LIMIT 10""",
    FACT_CTE), ids=("T16",))
def q_t16_xg(spark, sf):
    return T.attacking_returns(_f(spark, sf), 1997, "goals", 5, 10, segment="ASIA", expected=True)


@register("tpl16_attacking_returns", with_ctes("""
SELECT entity, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists,
       count(*) FILTER (WHERE minutes > 0) AS apps, CAST(sum(goals) + sum(assists) AS BIGINT) AS returns
FROM fact WHERE epoch = 1997 AND minutes > 0 GROUP BY entity HAVING apps >= 50 ORDER BY returns DESC, entity LIMIT 10""",
    FACT_CTE), ids=("T16",))
def q_t16(spark, sf):
    return T.attacking_returns(_f(spark, sf), 1997, "returns", 50, 10)


@register("tpl17_double_steps", with_ctes("""
SELECT entity, step, count(DISTINCT fixture) AS fixtures, CAST(sum(points) AS BIGINT) AS points,
       CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists,
       round(max(price) / 10.0, 1) AS price, arg_max(side, (epoch, step, fixture)) AS side,
       arg_max(segment, (epoch, step, fixture)) AS segment
FROM fact WHERE epoch = 1998 GROUP BY entity, step HAVING fixtures > 1""", FACT_CTE), ids=("T17",))
def q_t17(spark, sf):
    return T.double_steps(_f(spark, sf), 1998)


@register("tpl18_keeper_stats", with_ctes("""
SELECT entity, CAST(sum(saves) AS BIGINT) AS saves, CAST(sum(minutes) AS BIGINT) AS minutes,
       count(*) FILTER (WHERE minutes > 0) AS apps, CAST(round(sum(saves) / 3) AS BIGINT) AS save_points,
       sum(saves) / nullif(sum(minutes) / 90.0, 0) AS saves_per_90
FROM fact WHERE epoch = 1999 AND segment = 'MIDDLE EAST' AND minutes >= 60 GROUP BY entity HAVING apps >= 10
ORDER BY saves_per_90 DESC NULLS LAST, entity LIMIT 10""", FACT_CTE), ids=("T18",))
def q_t18(spark, sf):
    return T.keeper_stats(_f(spark, sf), 1999, "MIDDLE EAST", "saves_per_90", 10, 10)


@register("tpl19_suspension_risk", with_ctes("""
SELECT entity, CAST(sum(yellow) AS BIGINT) AS yellow, CAST(sum(red) AS BIGINT) AS red,
       count(*) FILTER (WHERE minutes > 0) AS apps,
       (sum(yellow) + sum(red)) / nullif(count(*) FILTER (WHERE minutes > 0), 0) AS cards_per_app,
       sum(yellow) >= 5 AS at_risk
FROM fact WHERE epoch = 2001 AND minutes > 0 GROUP BY entity ORDER BY yellow DESC, red DESC, entity LIMIT 10""", FACT_CTE), ids=("T19",))
def q_t19(spark, sf):
    return T.suspension_risk(_f(spark, sf), 2001, 10)


@register("tpl17_double_steps_of_step", with_ctes("""
SELECT entity, step, count(DISTINCT fixture) AS fixtures, CAST(sum(points) AS BIGINT) AS points,
       CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists,
       round(max(price) / 10.0, 1) AS price, arg_max(side, (epoch, step, fixture)) AS side,
       arg_max(segment, (epoch, step, fixture)) AS segment
FROM fact WHERE epoch = 1998 AND step = 5 AND segment = 'ASIA' GROUP BY entity, step HAVING fixtures > 1""", FACT_CTE), ids=("T17",))
def q_t17_step(spark, sf):
    return T.double_steps(_f(spark, sf), 1998, 5, "ASIA")


@register("tpl17_double_step_list", with_ctes("""
SELECT DISTINCT step FROM (SELECT entity, step FROM fact WHERE epoch = 1998 GROUP BY entity, step HAVING count(DISTINCT fixture) > 1) t""",
    FACT_CTE), ids=("T17",))
def q_t17_list(spark, sf):
    return T.double_step_list(_f(spark, sf), 1998)


@register("tpl20_season_history", with_ctes("""
h AS (SELECT entity, epoch, sum(points) AS points, sum(minutes) AS minutes, sum(goals) AS goals, sum(assists) AS assists,
        count(*) FILTER (WHERE CASE WHEN is_home = 1 THEN away_score ELSE home_score END = 0) AS clean_sheets,
        sum(saves) AS saves, sum(bonus) AS bonus,
        arg_min(price, (step, fixture)) AS start_cost, arg_max(price, (step, fixture)) AS end_cost
      FROM fact GROUP BY entity, epoch),
dim AS (SELECT DISTINCT epoch, CAST(epoch AS VARCHAR) || '/' || lpad(CAST((epoch + 1) % 100 AS VARCHAR), 2, '0') AS label FROM fact)
SELECT epoch, label AS season, CAST(points AS BIGINT) AS points, CAST(minutes AS BIGINT) AS minutes, CAST(goals AS BIGINT) AS goals,
       CAST(assists AS BIGINT) AS assists, clean_sheets, CAST(saves AS BIGINT) AS saves, CAST(bonus AS BIGINT) AS bonus,
       round(start_cost / 10.0, 1) AS start_price, round(end_cost / 10.0, 1) AS end_price,
       round((end_cost - start_cost) / 10.0, 1) AS price_change
FROM h JOIN dim USING (epoch) WHERE entity = 7""", FACT_CTE).replace("\nh AS (", "\n, h AS (", 1), ids=("T20",))
def q_t20(spark, sf):
    f = _f(spark, sf)
    dim = f.select("epoch").distinct().withColumn(
        "label", F.concat_ws("/", F.col("epoch").cast("string"), F.lpad(((F.col("epoch") + 1) % 100).cast("string"), 2, "0")))
    return T.season_history(T.epoch_history(f), dim, 7)
