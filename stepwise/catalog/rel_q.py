"""Joins, set operations, sorts, projections and filters on the driver tables."""

from pyspark.sql import functions as F

from stepwise.catalog import EVENTS_CTE, FACT_CTE, MATCHES_CTE, ORDERS_CTE, register, with_ctes
from stepwise.functions import scalars as S
from stepwise.operators import aggregates as A
from stepwise.operators import relational as R
from stepwise.operators import windows as W
from stepwise.plans import bindings as B

STANDINGS_SQL = """st AS (
  SELECT epoch, side, CAST(rank() OVER (PARTITION BY epoch ORDER BY pts DESC, gd DESC, gf DESC) AS BIGINT) AS rank
  FROM (SELECT epoch, side, sum(p) AS pts, sum(gf) - sum(ga) AS gd, sum(gf) AS gf FROM (
      SELECT epoch, home_side AS side, home_score AS gf, away_score AS ga,
             CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS p FROM mt
      UNION ALL
      SELECT epoch, away_side, away_score, home_score,
             CASE WHEN away_score > home_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END FROM mt) u
    GROUP BY epoch, side) s)"""


def standings_rank(spark, sf):
    t = A.standings(B.matches(spark, sf), "epoch", "home_side", "away_side", "home_score", "away_score")
    return W.multi_key_rank(t, ["epoch"], ["pts", "gd", "gf"]).select("epoch", "side", "rank")


# ---------------------------------------------------------------- joins
@register("jn_bridge_unmatched", """
SELECT o_orderkey, c_custkey, c_nationkey FROM orders
LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') c
  ON o_custkey = c_custkey
WHERE c_custkey IS NOT NULL""", ids=("JN1",))
def q_jn1(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    bridge = (B.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
              .select("c_custkey", "c_nationkey"))
    out, _obs = R.bridge_join(o, bridge.withColumn("matched", F.lit(True)), ["c_custkey"], "matched")
    return out.select("o_orderkey", "c_custkey", "c_nationkey")


@register("jn_two_key_lookup_default", with_ctes("""
SELECT f.entity, f.fixture, f.epoch, coalesce(a.rank, 10) AS side_rank, coalesce(b.rank, 10) AS other_rank
FROM fact f LEFT JOIN st a ON f.epoch = a.epoch AND f.side = a.side
LEFT JOIN st b ON f.epoch = b.epoch AND f.other_side = b.side""", FACT_CTE, MATCHES_CTE, STANDINGS_SQL),
    ids=("JN2", "JN5"))
def q_jn2(spark, sf):
    f = B.fact(spark, sf).select("entity", "fixture", "epoch", "side", "other_side")
    st = standings_rank(spark, sf)
    a = st.withColumnRenamed("rank", "side_rank")
    b = st.withColumnsRenamed({"side": "other_side", "rank": "other_rank"})
    out = R.left_with_default(f, a, ["epoch", "side"], {"side_rank": 10})
    out = R.left_with_default(out, b, ["epoch", "other_side"], {"other_rank": 10})
    return out.select("entity", "fixture", "epoch", "side_rank", "other_rank")


@register("jn_own_side_from_other", with_ctes("""
SELECT entity, fixture, is_home,
  CASE WHEN is_home = 1
       THEN min(other_side) FILTER (WHERE is_home = 0) OVER (PARTITION BY epoch, fixture)
       ELSE min(other_side) FILTER (WHERE is_home = 1) OVER (PARTITION BY epoch, fixture) END AS own_side
FROM fact""", FACT_CTE), ids=("JN3",))
def q_jn3(spark, sf):
    f = B.fact(spark, sf).select("entity", "fixture", "epoch", "is_home", "other_side")
    return R.own_side_from_other(f, ["epoch", "fixture"], "is_home", "other_side").drop("epoch", "other_side")


@register("jn_orphans", """
SELECT c_custkey, c_nationkey FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998)""",
    ids=("JN6", "DQ2"))
def q_jn6(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = B.table(spark, sf, "orders").where(F.year("o_orderdate") == 1998)
    return R.orphans(c, o, ["c_custkey"], ["o_custkey"], not_in=True)


@register("jn_semi_filter", """
SELECT o_orderstatus, count(*) AS n FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
GROUP BY o_orderstatus""", ids=("JN7",))
def q_jn7(spark, sf):
    o = B.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    keys = B.table(spark, sf, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE")
    return R.keep_known(o, keys, ["c_custkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("jn_reconcile", with_ctes("""
SELECT a.entity, a.epoch, a.left_total, b.right_total, a.left_total - coalesce(b.right_total, 0) AS diff
FROM (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS epoch, sum(l_quantity) AS left_total
      FROM lineitem GROUP BY 1, 2) a
LEFT JOIN (SELECT entity, epoch, CAST(sum(points) AS BIGINT) AS right_total FROM fact GROUP BY 1, 2) b
  ON a.entity = b.entity AND a.epoch = b.epoch
WHERE abs(a.left_total - coalesce(b.right_total, 0)) > 5""", FACT_CTE), ids=("JN8", "DQ5"))
def q_jn8(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"),
                                               F.year("l_shipdate").alias("epoch"), "l_quantity")
    return R.reconcile(li, B.fact(spark, sf), ["entity", "epoch"], "l_quantity", "points", 5,
                       "left_total", "right_total")


@register("jn_last_n_steps", with_ctes("""
SELECT entity, count(*) AS n_recent, avg(target) AS recent_mean
FROM ev WHERE step > (SELECT max(step) FROM ev) - 3 GROUP BY entity""", EVENTS_CTE), ids=("JN9",))
def q_jn9(spark, sf):
    return (R.last_n_steps(B.events(spark, sf), "step", 3).groupBy("entity")
            .agg(F.count(F.lit(1)).alias("n_recent"), F.avg("target").alias("recent_mean")))


@register("jn_consecutive_step_jump", with_ctes("""
WITH s AS (SELECT entity, epoch, step, max(price) AS price FROM fact GROUP BY ALL)
SELECT a.entity, a.epoch, a.step, a.price, b.price AS price_next, b.step AS step_next
FROM s a JOIN s b ON a.entity = b.entity AND a.epoch = b.epoch AND b.step = a.step + 1
WHERE abs(b.price - a.price) >= 5""", FACT_CTE), ids=("JN10", "DQ15"))
def q_jn10(spark, sf):
    s = B.fact(spark, sf).groupBy("entity", "epoch", "step").agg(F.max("price").alias("price"))
    p = R.consecutive_pairs(s, ["entity", "epoch"], "step", ["price"])
    return p.where(F.abs(F.col("price_next") - F.col("price")) >= 5)


@register("jn_opponent_enrichment", with_ctes("""
WITH tm AS (SELECT epoch, step, side, CAST(sum(goals) AS BIGINT) AS side_goals FROM fact GROUP BY ALL)
SELECT f.entity, f.fixture, t.side_goals AS opp_goals
FROM fact f LEFT JOIN tm t ON f.epoch = t.epoch AND f.step = t.step AND f.other_side = t.side
""", FACT_CTE), ids=("JN12",))
def q_jn12(spark, sf):
    f = B.fact(spark, sf)
    tm = f.groupBy("epoch", "step", "side").agg(F.sum("goals").alias("opp_goals"))
    tm = tm.withColumnRenamed("side", "other_side")
    return f.join(tm, ["epoch", "step", "other_side"], "left").select("entity", "fixture", "opp_goals")


@register("jn_refresh_dimension", with_ctes("""
SELECT d.epoch, coalesce(m.mx, d.total_steps) AS total_steps FROM
  (SELECT DISTINCT epoch, 12 AS total_steps FROM od) d
  LEFT JOIN (SELECT epoch, max(step) AS mx FROM fact GROUP BY epoch) m ON d.epoch = m.epoch""",
    ORDERS_CTE, FACT_CTE), ids=("JN13", "LD1"))
def q_jn13(spark, sf):
    dim = B.orders(spark, sf).select("epoch").distinct().withColumn("total_steps", F.lit(12))
    return R.refresh_from_facts(dim, B.fact(spark, sf), ["epoch"], "total_steps", "step")


@register("jn_prior_epoch", with_ctes("""
WITH s AS (SELECT entity, epoch, avg(points) AS mean_points FROM fact GROUP BY ALL)
SELECT a.entity, a.epoch, a.mean_points, b.mean_points AS mean_points_prev_epoch
FROM s a LEFT JOIN s b ON a.entity = b.entity AND a.epoch = b.epoch + 1""",
    FACT_CTE), ids=("JN14",))
def q_jn14(spark, sf):
    s = B.fact(spark, sf).groupBy("entity", "epoch").agg(F.avg("points").alias("mean_points"))
    return R.prior_epoch(s, s, "entity", "epoch", ["mean_points"])


@register("jn_name_enrichment", with_ctes("""
SELECT f.entity, f.epoch, CAST(sum(points) AS BIGINT) AS total, coalesce(any_value(s_name), 'Unknown') AS name,
       coalesce(any_value(n_name), 'Unknown') AS nation
FROM fact f LEFT JOIN supplier ON f.entity = s_suppkey LEFT JOIN nation ON f.side = n_nationkey
GROUP BY f.entity, f.epoch""", FACT_CTE), ids=("JN16",))
def q_jn16(spark, sf):
    s = B.fact(spark, sf).groupBy("entity", "epoch", "side").agg(F.sum("points").alias("total"))
    sup = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    nat = R.bounded(B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("side"),
                                                        F.col("n_name").alias("nation")), 25, "TPC-H nation")
    out = s.join(sup, "entity", "left").join(nat, "side", "left")
    return out.select("entity", "epoch", "total", F.coalesce("name", F.lit("Unknown")).alias("name"),
                      F.coalesce("nation", F.lit("Unknown")).alias("nation"))


@register("jn_using_region", """
SELECT r_name, count(*) AS n_customers FROM customer JOIN
  (SELECT n_nationkey AS c_nationkey, n_regionkey AS r_regionkey FROM nation) n USING (c_nationkey)
  JOIN region USING (r_regionkey) GROUP BY r_name""", ids=("JN17",))
def q_jn17(spark, sf):
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                            F.col("n_regionkey").alias("r_regionkey"))
    c = B.table(spark, sf, "customer")
    out = c.join(R.bounded(n, 25, "TPC-H nation"), ["c_nationkey"]).join(
        R.bounded(B.table(spark, sf, "region"), 5, "TPC-H region"), ["r_regionkey"])
    return out.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_customers"))


# ---------------------------------------------------------------- set ops
@register("set_union_all", with_ctes("""
SELECT epoch, count(*) AS n, count(xg) AS n_xg FROM (
  SELECT epoch, entity, CASE WHEN epoch >= 1998 THEN xg END AS xg FROM fact) t GROUP BY epoch""", FACT_CTE), ids=("SET1", "SRC4"))
def q_set1(spark, sf):
    """Extracts of all epochs united by name; those before 1998 have no xg column."""
    from functools import reduce
    f = B.fact(spark, sf).select("epoch", "entity", "xg")
    epochs = [r[0] for r in f.select("epoch").distinct().collect()]   # one row per epoch
    parts = [f.where(F.col("epoch") == e) if e >= 1998 else f.where(F.col("epoch") == e).drop("xg") for e in sorted(epochs, reverse=True)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.count("xg").alias("n_xg"))


@register("set_distinct_pairs", with_ctes("""
SELECT DISTINCT epoch, side, other_side FROM fact""", FACT_CTE), ids=("SET2",))
def q_set2(spark, sf):
    return B.fact(spark, sf).select("epoch", "side", "other_side").distinct()


@register("set_top_overlap", with_ctes("""
SELECT segment, count(*) FILTER (WHERE ra <= 10 AND rb <= 10) AS overlap, count(*) AS n FROM (
  SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY points DESC, fixture, entity) AS ra,
         row_number() OVER (PARTITION BY segment ORDER BY xg DESC, fixture, entity) AS rb FROM fact) t
GROUP BY segment""", FACT_CTE), ids=("SET4",))
def q_set4(spark, sf):
    f = B.fact(spark, sf).withColumn("key", F.struct("fixture", "entity"))
    return R.top_set_overlap(f, ["segment"], "points", "xg", "key", 10)


@register("set_missing_steps", with_ctes("""
SELECT k.entity, k.epoch, s.step FROM (SELECT DISTINCT entity, epoch FROM fact) k
CROSS JOIN (SELECT unnest(range(1, 13)) AS step) s
WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.entity = k.entity AND f.epoch = k.epoch AND f.step = s.step)""",
    FACT_CTE), ids=("SET5", "E8", "DQ13"))
def q_set5(spark, sf):
    f = B.fact(spark, sf).select("entity", "epoch", "step")
    out = R.missing_members(f, ["entity", "epoch"], "step", 1, 12)
    return out.withColumn("step", F.col("step").cast("bigint"))


# ---------------------------------------------------------------- sorts
@register("srt_top_k", with_ctes("""
SELECT entity, fixture, points FROM fact ORDER BY points DESC, entity, fixture LIMIT 20""", FACT_CTE),
    ids=("SRT1", "SRT2"))
def q_srt1(spark, sf):
    f = B.fact(spark, sf).select("entity", "fixture", "points")
    return R.top_k(f, [F.col("points").desc(), "entity", "fixture"], 20, ["points", "goals"], "points")


@register("srt_two_key_opposing", with_ctes("""
SELECT entity, fixture, xg, price FROM fact ORDER BY xg DESC, price ASC, entity, fixture LIMIT 20""", FACT_CTE),
    ids=("SRT3",))
def q_srt3(spark, sf):
    f = B.fact(spark, sf).select("entity", "fixture", "xg", "price")
    return R.top_k(f, [F.col("xg").desc(), F.col("price").asc(), "entity", "fixture"], 20)


@register("srt_by_abs_change", with_ctes("""
WITH c AS (SELECT entity, epoch, max_by(price, step * 100000000 + fixture) - min_by(price, step * 100000000 + fixture) AS change
           FROM fact GROUP BY entity, epoch)
SELECT entity, epoch, change FROM c WHERE change IS NOT NULL ORDER BY abs(change) DESC, entity, epoch LIMIT 10
""", FACT_CTE), ids=("SRT4", "T8"))
def q_srt4(spark, sf):
    f = B.fact(spark, sf)
    o = F.struct("step", "fixture")
    c = f.groupBy("entity", "epoch").agg((F.max_by("price", o) - F.min_by("price", o)).alias("change"))
    return R.top_k(c.where(F.col("change").isNotNull()),
                   [F.abs(F.col("change")).desc(), "entity", "epoch"], 10)


@register("srt_arg_extremes", with_ctes("""
WITH s AS (SELECT segment, step, avg(points) AS mean_points FROM fact GROUP BY ALL)
SELECT segment, arg_max(step, mean_points) AS peak_step, max(mean_points) AS peak_mean_points,
       arg_min(step, mean_points) AS trough_step, min(mean_points) AS trough_mean_points
FROM s GROUP BY segment""", FACT_CTE), ids=("SRT5", "E5"))
def q_srt5(spark, sf):
    s = B.fact(spark, sf).groupBy("segment", "step").agg(F.avg("points").alias("mean_points"))
    return R.arg_extremes(s, ["segment"], "step", "mean_points")


# ---------------------------------------------------------------- projections
@register("prj_coerce_flags", with_ctes("""
SELECT seq,
  CAST(floor(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS k,
  coalesce(CAST(floor(TRY_CAST(CASE WHEN target > 100 THEN 'n/a' ELSE CAST(target AS VARCHAR) END AS DOUBLE)) AS BIGINT), 0) AS target_count,
  CASE WHEN lower(CAST(target > 50 AS VARCHAR)) IN ('true', '1', '1.0') THEN 1 ELSE 0 END AS high,
  CASE WHEN target > 80 THEN NULL WHEN target > 50 THEN 1 WHEN target > 20 THEN 0 END AS flag,
  CASE segment WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS code
FROM ev""", EVENTS_CTE), ids=("PRJ1", "PRJ2", "PRJ3", "PRJ4", "PRJ5", "SRC6"))
def q_prj_coerce(spark, sf):
    ev = B.events(spark, sf)
    raw = F.when(F.col("target") > 100, F.lit("n/a")).otherwise(F.col("target").cast("string"))
    return ev.select(
        "seq",
        S.coerce_numeric(F.get_json_object("props", "$.k"), "bigint").alias("k"),
        S.count_stat(raw).alias("target_count"),
        S.bool_to_int((F.col("target") > 50)).alias("high"),
        # text that is neither true nor false is no flag
        S.bool_to_int(F.when(F.col("target") > 80, "yes").when(F.col("target") > 50, "True").when(F.col("target") > 20, "0.0")).alias("flag"),
        S.code_map("segment", {"view": 1, "click": 2, "purchase": 3}, 0).alias("code"))


@register("prj_null_unless_override", with_ctes("""
SELECT entity, fixture,
  CASE WHEN points + goals + assists > 30 THEN goals END AS goals,
  CASE WHEN points + goals + assists > 30 THEN assists END AS assists,
  coalesce(nullif(saves, 0), price - bonus) AS start_price,
  CASE WHEN is_home = 1 THEN home_score ELSE away_score END AS goals_for,
  CASE WHEN is_home = 1 THEN away_score ELSE home_score END AS goals_against,
  CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS result_points,
  CASE WHEN is_home = 1 THEN 'H' ELSE 'A' END AS venue
FROM fact""", FACT_CTE), ids=("PRJ6", "PRJ8", "PRJ9", "PRJ10", "PRJ11"))
def q_prj_null(spark, sf):
    f = B.fact(spark, sf)
    f = S.null_unless(f, (F.col("points") + F.col("goals") + F.col("assists")) > 30, ["goals", "assists"])
    h = F.col("is_home")
    return f.select("entity", "fixture", "goals", "assists",
                    S.derived_with_override(F.col("saves"), F.col("price"), F.col("bonus")).alias("start_price"),
                    S.side_value(h, F.col("home_score"), F.col("away_score")).alias("goals_for"),
                    S.side_value(h, F.col("away_score"), F.col("home_score")).alias("goals_against"),
                    A.result_points(F.col("home_score"), F.col("away_score")).alias("result_points"),
                    S.venue_label(h, short=True).alias("venue"))


@register("prj_surrogate_key", """
SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS nation_sk FROM nation""", ids=("PRJ7",))
def q_prj7(spark, sf):
    return S.ordinal_key(B.table(spark, sf, "nation").select("n_name"), ["n_name"], "nation_sk")


@register("prj_per90_rates", with_ctes("""
SELECT entity, epoch, CAST(sum(minutes) AS BIGINT) AS minutes,
       sum(goals) / nullif(sum(minutes) / 90.0, 0) AS goals_p90, sum(xg) / nullif(sum(minutes) / 90.0, 0) AS xg_p90
FROM fact GROUP BY entity, epoch""", FACT_CTE), ids=("PRJ12", "T7"))
def q_prj12(spark, sf):
    g = B.fact(spark, sf).groupBy("entity", "epoch").agg(
        F.sum("minutes").alias("minutes"), F.sum("goals").alias("g"), F.sum("xg").alias("x"))
    return g.select("entity", "epoch", "minutes", S.per90(F.col("g"), F.col("minutes")).alias("goals_p90"),
                    S.per90(F.col("x"), F.col("minutes")).alias("xg_p90"))


@register("prj_buckets", with_ctes("""
SELECT entity, fixture,
  CASE WHEN points >= 0 AND points <= 10 THEN '0-10' WHEN points > 10 AND points <= 25 THEN '11-25'
       WHEN points > 25 AND points <= 50 THEN '26-50' END AS points_band,
  CASE WHEN coalesce(price, 95) >= 0 AND coalesce(price, 95) < 93 THEN 'low'
       WHEN coalesce(price, 95) >= 93 AND coalesce(price, 95) < 96 THEN 'mid'
       WHEN coalesce(price, 95) >= 96 THEN 'high' END AS price_band,
  CASE WHEN other_side IS NULL THEN NULL WHEN other_side <= 6 THEN 5 WHEN other_side <= 10 THEN 4
       WHEN other_side <= 14 THEN 3 WHEN other_side <= 17 THEN 2 ELSE 1 END AS difficulty,
  CASE WHEN coalesce(nullif(other_side, 0), 10) <= 6 THEN 'A' WHEN coalesce(nullif(other_side, 0), 10) <= 14 THEN 'B'
       ELSE 'C' END AS rank_bin,
  CAST(epoch AS BIGINT) * 1000 + step AS slice_key
FROM fact""", FACT_CTE), ids=("PRJ13", "PRJ14", "PRJ15", "PRJ17", "PRJ18", "PRJ19"))
def q_prj_buckets(spark, sf):
    f = B.fact(spark, sf)
    return f.select(
        "entity", "fixture",
        S.bucket_right_closed(F.col("points"), [0, 10, 25, 50], ["0-10", "11-25", "26-50"]).alias("points_band"),
        S.fill_then_band(F.col("price"), F.lit(95), [0, 93, 96, float("inf")], ["low", "mid", "high"]).alias("price_band"),
        S.rank_difficulty(F.col("other_side")).alias("difficulty"),
        S.rank_bin(F.nullif(F.col("other_side"), F.lit(0))).alias("rank_bin"),
        S.composite_key(F.col("epoch"), F.col("step")).alias("slice_key"))


@register("prj_clip_label", """
SELECT n_nationkey, upper(substring(n_name, 1, 3)) AS abbr,
       least(greatest(n_nationkey / 20.0, 0.0), 1.0) AS share,
       concat(upper(substring(n_name, 1, 3)), ' (', r_name, ')') AS label
FROM nation JOIN region ON n_regionkey = r_regionkey""", ids=("PRJ20", "PRJ23"))
def q_prj20(spark, sf):
    n = B.table(spark, sf, "nation").join(R.bounded(B.table(spark, sf, "region"), 5, "TPC-H region"),
                                          F.col("n_regionkey") == F.col("r_regionkey"))
    abbr = S.abbrev3(F.col("n_name"))
    return n.select("n_nationkey", abbr.alias("abbr"), S.clip01(F.col("n_nationkey") / 20.0).alias("share"),
                    F.concat(abbr, F.lit(" ("), F.col("r_name"), F.lit(")")).alias("label"))


# ---------------------------------------------------------------- filters
@register("flt_base_and_group_size", with_ctes("""
SELECT entity, epoch, step, fixture, points FROM fact f
WHERE minutes > 0 AND segment IN ('ASIA', 'EUROPE') AND epoch >= 1996
  AND (SELECT count(*) FROM fact g WHERE g.entity = f.entity AND g.epoch = f.epoch
       AND g.minutes > 0 AND g.segment IN ('ASIA', 'EUROPE')) >= 90""", FACT_CTE), ids=("FLT1", "FLT2", "FLT3"))
def q_flt1(spark, sf):
    f = B.fact(spark, sf)
    cond = S.all_of([F.col("minutes") > 0, S.in_list("segment", ["ASIA", "EUROPE"]),
                     F.col("epoch") >= 1996, None])
    base = f.where(cond).select("entity", "epoch", "step", "fixture", "points")
    return S.min_group_size(base, ["entity", "epoch"], 90)


@register("flt_name_search", """
SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), lower('00001'))
ORDER BY c_name, c_custkey LIMIT 20""", ids=("FLT4", "SRC9"))
def q_flt4(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.where(S.contains_ci(F.col("c_name"), "00001")).select("c_custkey", "c_name") \
            .orderBy("c_name", "c_custkey").limit(20)


@register("flt_latest_slice", with_ctes("""
SELECT entity, fixture, epoch, step FROM fact
WHERE epoch = (SELECT max(epoch) FROM fact) AND step = (SELECT max(step) FROM fact WHERE epoch = (SELECT max(epoch) FROM fact))
  AND price BETWEEN 92 AND 97 AND is_home = 1""", FACT_CTE), ids=("FLT5", "FLT6"))
def q_flt5(spark, sf):
    from stepwise.plans.slices import select_slice
    f = B.fact(spark, sf)
    sl = select_slice(f, "epoch", "step")
    return sl.where(F.col("price").between(92, 97) & (F.col("is_home") == 1)).select("entity", "fixture", "epoch", "step")
