"""Feature matrix, statistics, CV folds and models on the fact binding."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.catalog import FACT_CTE, MATCHES_CTE, register, with_ctes
from stepwise.catalog.rel_q import STANDINGS_SQL, standings_rank
from stepwise.plans import bindings as B
from stepwise.plans.features import build_feature_matrix


def feature_matrix(spark, sf):
    from stepwise.session import materialized
    return materialized(spark, ("feature_matrix", sf),
                        lambda: build_feature_matrix(B.fact(spark, sf), standings_rank(spark, sf)))


_W = "PARTITION BY entity, epoch ORDER BY step, fixture"
_TW = "PARTITION BY side, epoch ORDER BY step"
FM_CTE = STANDINGS_SQL + """,
base AS (
  SELECT * FROM fact f WHERE minutes > 0 AND (SELECT count(*) FROM fact g
    WHERE g.entity = f.entity AND g.epoch = f.epoch AND g.minutes > 0) >= 5),
tfx AS (
  SELECT epoch, side, step, fixture,
         min(CASE WHEN is_home = 1 THEN home_score ELSE away_score END) AS gf,
         min(CASE WHEN is_home = 1 THEN away_score ELSE home_score END) AS ga
  FROM fact GROUP BY ALL),
ts AS (SELECT epoch, side, step, sum(gf) AS gf, sum(ga) AS ga FROM tfx GROUP BY ALL),
tf AS (
  SELECT epoch, side, step,
    sum(gf) OVER (""" + _TW + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS team_gf_prior,
    avg(CAST(ga = 0 AS DOUBLE)) OVER (""" + _TW + """ ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS team_cs_rate5,
    sum(ga) OVER (""" + _TW + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      / nullif(row_number() OVER (""" + _TW + """) - 1, 0) AS ga_prior_rate
  FROM ts),
bw AS (
  SELECT epoch, step, fixture, entity, segment, side, other_side, is_home, points,
""" + ",\n".join(
    f"    avg({c}) OVER ({_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {c}_roll{k}"
    for c in ("points", "minutes", "goals", "xg", "assists", "bonus", "saves") for k in (3, 5)) + """,
    avg(points) OVER (""" + _W + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS points_todate,
    avg(minutes) OVER (""" + _W + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS minutes_todate,
    lag(points) OVER (""" + _W + """) AS points_lag1,
    lag(price) OVER (""" + _W + """) AS price_lag1
  FROM base),
fm AS (
  SELECT b.*, o.team_gf_prior, o.team_cs_rate5, p.ga_prior_rate AS opp_ga_prior_rate, coalesce(st.rank, 10) AS opp_rank
  FROM bw b
  LEFT JOIN tf o ON b.epoch = o.epoch AND b.side = o.side AND b.step = o.step
  LEFT JOIN tf p ON b.epoch = p.epoch AND b.other_side = p.side AND b.step = p.step
  LEFT JOIN st ON b.epoch = st.epoch AND b.other_side = st.side)"""


@register("pl_feature_matrix", with_ctes("SELECT * FROM fm", FACT_CTE, MATCHES_CTE, FM_CTE),
          ids=("PL1", "FLT1", "FLT2", "WIN1", "WIN2", "WIN3", "WIN4", "WIN5", "WIN6", "JN5", "JN12",
               "AGG12", "PRJ21", "PRJ22"))
def q_pl1(spark, sf):
    return feature_matrix(spark, sf)


def _segment_sql():
    from stepwise.plans.features import SEGMENT_WITHOUT, feature_names
    lines = []
    for c in feature_names():
        without = ", ".join(f"'{s}'" for s, w in SEGMENT_WITHOUT.items() if c in w)
        where = f" WHERE segment NOT IN ({without})" if without else ""
        name = {"opp_rank": "opponent_rank"}.get(c, c)
        lines.append(f"SELECT segment, '{name}' AS feature, count({c}) AS n, avg({c}) AS mean FROM fm{where} GROUP BY segment")
    return "\nUNION ALL ".join(lines)


@register("pl_segment_features", with_ctes(_segment_sql(), FACT_CTE, MATCHES_CTE, FM_CTE), ids=("PL1", "PRJ21", "PRJ22", "PRJ23"))
def q_pl1_segments(spark, sf):
    """Coverage and mean of the features each segment uses, under the names that reports show."""
    from functools import reduce

    from stepwise.functions.scalars import feature_columns, rename, select_present
    from stepwise.plans.features import CONTEXT, segment_features
    fm = feature_matrix(spark, sf)
    parts = []
    for seg in [r[0] for r in fm.select("segment").distinct().collect()]:   # one row per segment
        rows = fm.where(F.col("segment") == seg)
        # a list may name features that this build of the matrix lacks
        rows = rename(select_present(rows, [*CONTEXT, "points", *segment_features(seg), "odds"]), {"opp_rank": "opponent_rank"})
        cols = feature_columns(rows, CONTEXT, "points")
        wide = rows.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean")).alias(c) for c in cols])
        parts.append(wide.select(F.lit(seg).alias("segment"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), f"{c}.n", f"{c}.mean") for c in cols])).alias("f"))
                         .select("segment", "f.*"))
    return reduce(DataFrame.union, parts)


@register("snk_partition_refresh", with_ctes("""
SELECT epoch, count(*) AS n, CAST(sum(points) AS BIGINT) AS points, epoch = 1998 AS rebuilt FROM fm GROUP BY epoch""", FACT_CTE, MATCHES_CTE, FM_CTE), ids=("SNK4", "PL1"))
def q_snk4(spark, sf):
    """The feature matrix is kept by epoch; rows that come late to one epoch rebuild that epoch only."""
    from stepwise.session import scratch_path
    from stepwise.sources.versions import Store, refresh
    f = B.fact(spark, sf)
    rank = standings_rank(spark, sf)
    late = (F.col("epoch") == 1998) & (F.col("step") >= 6)
    store = Store(spark, scratch_path(spark, "feature-store"))
    refresh(store, "features", f.where(~late), "epoch", lambda rows: build_feature_matrix(rows, rank))
    rebuilt = refresh(store, "features", f, "epoch", lambda rows: build_feature_matrix(rows, rank))
    out = store.read("features").groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))
    return out.withColumn("rebuilt", F.hex(F.col("epoch").cast("string")).isin(rebuilt))


# ============================================================ statistics / CV / models
from stepwise.operators import models as M  # noqa: E402
from stepwise.operators import stats as ST  # noqa: E402

#: The validation epoch is the newest one of the feature matrix, in SQL and in Spark.
VAL_SQL = "(SELECT max(epoch) FROM fm)"


def val_epoch(fm):
    return fm.agg(F.max("epoch")).first()[0]


FM_SQL = (FACT_CTE, MATCHES_CTE, FM_CTE)


def _fm_split(spark, sf):
    fm = feature_matrix(spark, sf)
    last = val_epoch(fm)
    return fm.where(F.col("epoch") < last), fm.where(F.col("epoch") == last)


def _baseline_pred(spark, sf):
    """ML8 on the validation epoch: rolling mean, else the segment's training mean."""
    train, val = _fm_split(spark, sf)
    tm = train.groupBy("segment").agg(F.avg("points").alias("_tm"))
    v = val.join(F.broadcast(tm), "segment", "left")
    return M.rolling_baseline(v, "points_roll5", F.col("_tm")).drop("_tm")


BASE_PRED_CTE = f"""tm AS (SELECT segment, avg(points) AS m FROM fm WHERE epoch < {VAL_SQL} GROUP BY segment),
bp AS (SELECT fm.*, coalesce(points_roll5, tm.m) AS pred FROM fm LEFT JOIN tm USING (segment) WHERE epoch = {VAL_SQL})"""


@register("cv_expanding_folds", with_ctes("""
SELECT fold, CAST(val_epoch AS INTEGER) AS val_epoch, CAST(len(tr) AS INTEGER) AS n_train_epochs,
       array_to_string(tr, ',') AS train_epochs FROM (
  SELECT CAST(i - n + 3 AS INTEGER) AS fold, epoch AS val_epoch,
         coalesce(list(epoch) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS tr, i, n
  FROM (SELECT epoch, row_number() OVER (ORDER BY epoch) AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT epoch FROM fact) d) e) t
WHERE i > n - 3 AND len(tr) >= 1""", FACT_CTE), ids=("CV1",))
def q_cv1(spark, sf):
    f = ST.expanding_folds(B.fact(spark, sf), "epoch", 3)
    return f.select("fold", "val_epoch", F.size("train_epochs").alias("n_train_epochs"),
                    F.array_join("train_epochs", ",").alias("train_epochs"))


@register("st_baseline_metrics", with_ctes("""
SELECT segment, count(*) AS n, avg(abs(pred - points)) AS mae, sqrt(avg((pred - points) * (pred - points))) AS rmse,
       1.0 - sum((pred - points) * (pred - points)) / nullif(count(*) * var_pop(points), 0) AS r2
FROM bp WHERE pred IS NOT NULL AND points IS NOT NULL GROUP BY segment""", *FM_SQL, BASE_PRED_CTE),
    ids=("ST4", "ML8"))
def q_st4(spark, sf):
    return ST.regression_metrics(_baseline_pred(spark, sf), ["segment"], "points", "pred")


_AVG_RANK = "(rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0)"


@register("st_spearman", with_ctes(f"""
SELECT segment, corr(rx, ry) AS spearman FROM (
  SELECT segment, {_AVG_RANK.format(g='segment', x='points_roll5')} AS rx, {_AVG_RANK.format(g='segment', x='points')} AS ry
  FROM fm WHERE points_roll5 IS NOT NULL AND points IS NOT NULL) t GROUP BY segment""", *FM_SQL), ids=("ST2",))
def q_st2(spark, sf):
    return ST.spearman(feature_matrix(spark, sf), ["segment"], "points_roll5", "points")


def _topn_sql(variable: bool) -> str:
    k = "least(rows, 10)" if variable else "10"
    skip = "" if variable else "WHERE rows > 10"
    return with_ctes(f"""
r AS (SELECT segment, epoch, step, entity, fixture,
        row_number() OVER (PARTITION BY segment, epoch, step ORDER BY coalesce(points_roll5, 0) DESC, entity, fixture) AS rp,
        row_number() OVER (PARTITION BY segment, epoch, step ORDER BY points DESC, entity, fixture) AS ra,
        count(*) OVER (PARTITION BY segment, epoch, step) AS rows FROM fm),
s AS (SELECT segment, epoch, step, any_value(rows) AS rows,
        count(*) FILTER (WHERE rp <= {k} AND ra <= {k}) AS hits FROM r GROUP BY ALL)
SELECT segment, avg(hits / {k}) AS top10_precision, count(*) AS n_slices FROM s {skip} GROUP BY segment""",
                     *FM_SQL).replace("\nr AS (", "\n, r AS (", 1).replace("SELECT * FROM fm", "")


@register("st_topn_precision", _topn_sql(False), ids=("ST5", "SET4", "WIN13"))
def q_st5(spark, sf):
    fm = feature_matrix(spark, sf).withColumn("pred", F.coalesce("points_roll5", F.lit(0.0)))
    return ST.top_n_precision(fm, ["segment"], ["epoch", "step"], "points", "pred", ["entity", "fixture"], 10)


@register("st_topk_precision_variable", _topn_sql(True), ids=("ST6",))
def q_st6(spark, sf):
    fm = feature_matrix(spark, sf).withColumn("pred", F.coalesce("points_roll5", F.lit(0.0)))
    return ST.top_n_precision(fm, ["segment"], ["epoch", "step"], "points", "pred", ["entity", "fixture"], 10,
                              variable_k=True)


@register("st_stratified_metrics", with_ctes("""
SELECT segment, stratum, count(*) AS n, avg(abs(pred - points)) AS mae,
       sqrt(avg((pred - points) * (pred - points))) AS rmse,
       1.0 - sum((pred - points) * (pred - points)) / nullif(count(*) * var_pop(points), 0) AS r2 FROM (
  SELECT segment, pred, points, 'home' AS stratum FROM bp WHERE is_home = 1
  UNION ALL SELECT segment, pred, points, 'away' FROM bp WHERE NOT is_home = 1
  UNION ALL SELECT segment, pred, points, 'vs_top6' FROM bp WHERE opp_rank <= 6
  UNION ALL SELECT segment, pred, points, 'vs_rest' FROM bp WHERE opp_rank > 6) t
WHERE pred IS NOT NULL AND points IS NOT NULL GROUP BY segment, stratum HAVING count(*) >= 10""",
    *FM_SQL, BASE_PRED_CTE), ids=("ST7",))
def q_st7(spark, sf):
    strata = {"home": F.col("is_home") == 1, "away": F.col("is_home") != 1,
              "vs_top6": F.col("opp_rank") <= 6, "vs_rest": F.col("opp_rank") > 6}
    return ST.stratified_metrics(_baseline_pred(spark, sf), ["segment"], "points", "pred", strata, 10)


@register("st_stratified_ranks", with_ctes(f"""
x AS (SELECT * FROM (SELECT bp.*, 'home' AS stratum FROM bp WHERE is_home = 1 UNION ALL SELECT bp.*, 'away' FROM bp WHERE NOT is_home = 1
        UNION ALL SELECT bp.*, 'vs_top6' FROM bp WHERE opp_rank <= 6 UNION ALL SELECT bp.*, 'vs_rest' FROM bp WHERE opp_rank > 6) u
      WHERE pred IS NOT NULL AND points IS NOT NULL),
sp AS (SELECT segment, stratum, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS spearman FROM (
        SELECT segment, stratum, {_AVG_RANK.format(g='segment, stratum', x='pred')} AS rx, {_AVG_RANK.format(g='segment, stratum', x='points')} AS ry FROM x) t
       GROUP BY ALL HAVING count(*) >= 10),
r AS (SELECT segment, stratum, epoch, step, row_number() OVER (PARTITION BY segment, stratum, epoch, step ORDER BY pred DESC, entity, fixture) AS rp,
        row_number() OVER (PARTITION BY segment, stratum, epoch, step ORDER BY points DESC, entity, fixture) AS ra,
        count(*) OVER (PARTITION BY segment, stratum, epoch, step) AS rows FROM x),
tp AS (SELECT segment, stratum, avg(hits / 10) AS top10_precision FROM (
        SELECT segment, stratum, epoch, step, count(*) FILTER (WHERE rp <= 10 AND ra <= 10) AS hits, any_value(rows) AS rows FROM r GROUP BY ALL) t
       WHERE rows > 10 GROUP BY ALL)
SELECT sp.segment, sp.stratum, sp.n, sp.spearman, tp.top10_precision FROM sp LEFT JOIN tp ON tp.segment = sp.segment AND tp.stratum = sp.stratum""",
    *FM_SQL, BASE_PRED_CTE).replace("\nx AS (", "\n, x AS (", 1), ids=("ST7", "ST2", "ST5"))
def q_st7_ranks(spark, sf):
    strata = {"home": F.col("is_home") == 1, "away": F.col("is_home") != 1,
              "vs_top6": F.col("opp_rank") <= 6, "vs_rest": F.col("opp_rank") > 6}
    return ST.stratified_ranks(_baseline_pred(spark, sf), ["segment"], "points", "pred", strata, ["epoch", "step"], ["entity", "fixture"])


MINUTE_BUCKETS = ((30, "cameo"), (60, "rotation"))
PRICE_EDGES = (0.0, 120.0, 150.0, 180.0, float("inf"))
PRICE_BANDS = ("budget", "mid", "premium", "elite")


@register("st_minutes_price_metrics", with_ctes("""
md AS (SELECT segment, median(price_lag1) AS md FROM bp GROUP BY segment),
x AS (SELECT bp.segment, pred, points, CASE WHEN mins < 30 THEN 'cameo' WHEN mins < 60 THEN 'rotation' ELSE 'starter' END AS bucket,
        CASE WHEN price < 120 THEN 'budget' WHEN price < 150 THEN 'mid' WHEN price < 180 THEN 'premium' ELSE 'elite' END AS band
      FROM (SELECT bp.*, coalesce(f.minutes, 60) AS mins, coalesce(bp.price_lag1, md.md) AS price
            FROM bp LEFT JOIN (SELECT epoch, step, fixture, entity, minutes FROM fact) f USING (epoch, step, fixture, entity)
            LEFT JOIN md ON md.segment = bp.segment) bp)
SELECT segment, stratum, count(*) AS n, avg(abs(pred - points)) AS mae, sqrt(avg((pred - points) * (pred - points))) AS rmse,
       1.0 - sum((pred - points) * (pred - points)) / nullif(count(*) * var_pop(points), 0) AS r2
FROM (SELECT segment, pred, points, bucket AS stratum FROM x UNION ALL SELECT segment, pred, points, band FROM x) t
WHERE pred IS NOT NULL AND points IS NOT NULL GROUP BY segment, stratum HAVING count(*) >= 10""", *FM_SQL, BASE_PRED_CTE)
    .replace("\nmd AS (", "\n, md AS (", 1), ids=("ST8", "JN11", "PRJ14", "PRJ16"))
def q_st8(spark, sf):
    from stepwise.functions.scalars import bucket_upper_bounds, fill_then_band
    from stepwise.operators.relational import reattach
    p = reattach(_baseline_pred(spark, sf), B.fact(spark, sf), ["epoch", "step", "fixture", "entity"], ["minutes"], {"minutes": 60})
    med = ST.exact_quantiles(p, ["segment"], "price_lag1", [0.5], ["_median"])
    p = p.join(med, "segment", "left")
    bucket = bucket_upper_bounds(F.col("minutes"), MINUTE_BUCKETS, "starter")
    band = fill_then_band(F.col("price_lag1"), F.col("_median"), PRICE_EDGES, PRICE_BANDS)
    strata = {b: bucket == b for b in ("cameo", "rotation", "starter")} | {b: band == b for b in PRICE_BANDS}
    return ST.stratified_metrics(p, ["segment"], "points", "pred", strata, 10)


@register("st_calibration", with_ctes("""
q AS (SELECT segment, list_sort(list_distinct(quantile_cont(pred, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e
      FROM bp WHERE pred IS NOT NULL GROUP BY segment)
SELECT segment, CAST(len(list_filter(e[2:len(e)-1], lambda x: x < pred)) AS INTEGER) AS bin, count(*) AS n,
       avg(pred) AS mean_pred, avg(points) AS mean_actual
FROM bp JOIN q USING (segment) WHERE pred IS NOT NULL GROUP BY ALL""", *FM_SQL, BASE_PRED_CTE).replace(
    "\nq AS (", "\n, q AS (", 1), ids=("ST11", "WIN12"))
def q_st11(spark, sf):
    return ST.calibration(_baseline_pred(spark, sf), ["segment"], "points", "pred")


@register("st_residuals_by_step", with_ctes("""
SELECT segment, step, avg(points - pred) AS mean_residual, count(*) AS n,
       avg(points - pred) FILTER (WHERE opp_rank <= 5) AS mean_residual_vs_top5
FROM bp WHERE pred IS NOT NULL GROUP BY segment, step""", *FM_SQL, BASE_PRED_CTE), ids=("ST10", "V11"))
def q_st10(spark, sf):
    p = _baseline_pred(spark, sf).where(F.col("pred").isNotNull()).withColumn("_r", F.col("points") - F.col("pred"))
    return p.groupBy("segment", "step").agg(F.avg("_r").alias("mean_residual"), F.count(F.lit(1)).alias("n"),
                                            F.avg(F.when(F.col("opp_rank") <= 5, F.col("_r"))).alias("mean_residual_vs_top5"))


@register("st_holdout_per_slice", with_ctes(f"""
e AS (SELECT segment, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, count(*) AS n_slices FROM (
  SELECT segment, step, avg(abs(pred - points)) AS mae, sqrt(avg((pred - points) * (pred - points))) AS rmse
  FROM bp WHERE pred IS NOT NULL GROUP BY segment, step) t GROUP BY segment),
c AS (SELECT segment, step, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS sp FROM (
  SELECT segment, step, {_AVG_RANK.format(g='segment, step', x='pred')} AS rx, {_AVG_RANK.format(g='segment, step', x='points')} AS ry
  FROM bp WHERE pred IS NOT NULL) t GROUP BY ALL)
SELECT e.*, mean_spearman, n_ranked_slices FROM e JOIN (SELECT segment, avg(sp) AS mean_spearman, count(sp) AS n_ranked_slices FROM c GROUP BY segment) s
  USING (segment)""", *FM_SQL, BASE_PRED_CTE).replace("\ne AS (", "\n, e AS (", 1), ids=("ST14",))
def q_st14(spark, sf):
    p = _baseline_pred(spark, sf)
    m = ST.regression_metrics(p, ["segment", "step"], "points", "pred")
    m = m.groupBy("segment").agg(F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("n_slices"))
    return m.join(ST.slice_spearman(p, ["segment"], ["step"], "points", "pred"), "segment")


def _model_preds(spark, sf):
    from stepwise.session import materialized
    return materialized(spark, ("model_preds", sf), lambda: _build_model_preds(spark, sf))


def _build_model_preds(spark, sf):
    """Long table (model, keys, pred) for three closed-form baselines."""
    train, val = _fm_split(spark, sf)
    keys = ["segment", "entity", "epoch", "step", "fixture", "points", "opp_rank", "is_home"]
    b = _baseline_pred(spark, sf).select(*keys, "pred").withColumn("model", F.lit("rolling"))
    v = M.venue_mean_baseline(train, val, ["segment"], "is_home", "points").select(*keys, "pred") \
        .withColumn("model", F.lit("venue_mean"))
    d = M.difficulty_baseline(train, val, ["segment"], "opp_rank", "points_roll5", "points") \
        .select(*keys, "pred").withColumn("model", F.lit("difficulty"))
    return b.unionByName(v).unionByName(d)


PREDS_CTE = f"""vm AS (SELECT segment, is_home, avg(points) AS m FROM fm WHERE epoch < {VAL_SQL} GROUP BY ALL),
gm AS (SELECT segment, avg(points) AS g FROM fm WHERE epoch < {VAL_SQL} GROUP BY ALL),
mb AS (SELECT segment, CASE WHEN coalesce(opp_rank, 10) <= 6 THEN 'A' WHEN coalesce(opp_rank, 10) <= 14 THEN 'B' ELSE 'C' END AS bin,
         avg(points) / nullif(avg(coalesce(points_roll5, 0.0)), 0.0) AS m FROM fm WHERE epoch < {VAL_SQL} GROUP BY ALL),
preds AS (
  SELECT 'rolling' AS model, segment, entity, epoch, step, fixture, points, opp_rank, is_home, pred FROM bp
  UNION ALL
  SELECT 'venue_mean', f.segment, entity, epoch, step, fixture, points, opp_rank, f.is_home, coalesce(vm.m, gm.g)
  FROM fm f LEFT JOIN vm ON f.segment = vm.segment AND f.is_home = vm.is_home LEFT JOIN gm ON f.segment = gm.segment
  WHERE epoch = {VAL_SQL}
  UNION ALL
  SELECT 'difficulty', f.segment, entity, epoch, step, fixture, points, opp_rank, is_home,
         coalesce(points_roll5, 0.0) * coalesce(CASE WHEN mb.m > 0 THEN mb.m ELSE 1.0 END, 1.0)
  FROM fm f LEFT JOIN mb ON f.segment = mb.segment
    AND mb.bin = CASE WHEN coalesce(opp_rank, 10) <= 6 THEN 'A' WHEN coalesce(opp_rank, 10) <= 14 THEN 'B' ELSE 'C' END
  WHERE epoch = {VAL_SQL})"""


@register("ml_baseline_predictions", with_ctes("""
SELECT model, segment, entity, step, fixture, pred FROM preds""", *FM_SQL, BASE_PRED_CTE, PREDS_CTE),
    ids=("ML8", "ML9", "ML10", "PRJ18", "JN11"))
def q_ml_baselines(spark, sf):
    return _model_preds(spark, sf).select("model", "segment", "entity", "step", "fixture", "pred")


@register("st_model_comparison", with_ctes("""
SELECT model, avg(mae) AS mean_metric, CAST(row_number() OVER (ORDER BY avg(mae), model) AS BIGINT) AS model_rank
FROM (SELECT model, segment, avg(abs(pred - points)) AS mae FROM preds WHERE pred IS NOT NULL GROUP BY ALL) t
GROUP BY model""", *FM_SQL, BASE_PRED_CTE, PREDS_CTE), ids=("AGG24", "V8", "V24"))
def q_agg24(spark, sf):
    from stepwise.operators.aggregates import mean_metric_ranked
    m = ST.regression_metrics(_model_preds(spark, sf), ["model", "segment"], "points", "pred")
    return mean_metric_ranked(m, [], "model", "mae")


@register("st_baseline_gate", with_ctes(f"""
m AS (SELECT model, segment, avg(abs(pred - points)) AS mae, sqrt(avg((pred - points) * (pred - points))) AS rmse
      FROM preds WHERE pred IS NOT NULL GROUP BY ALL),
sp AS (SELECT model, segment, corr(rx, ry) AS spearman FROM (
   SELECT model, segment, {_AVG_RANK.format(g='model, segment', x='pred')} AS rx,
          {_AVG_RANK.format(g='model, segment', x='points')} AS ry FROM preds WHERE pred IS NOT NULL) t GROUP BY ALL),
mm AS (SELECT * FROM m JOIN sp USING (model, segment))
SELECT a.segment, a.model,
  CAST(a.mae < b.mae AS INTEGER) + CAST(a.rmse < b.rmse AS INTEGER) + coalesce(CAST(a.spearman > b.spearman AS INTEGER), 0) AS wins,
  CAST(a.mae < b.mae AS INTEGER) + CAST(a.rmse < b.rmse AS INTEGER) + coalesce(CAST(a.spearman > b.spearman AS INTEGER), 0) >= 2 AS beats_baseline
FROM mm a JOIN mm b ON a.segment = b.segment AND b.model = 'rolling' WHERE a.model <> 'rolling'""",
    *FM_SQL, BASE_PRED_CTE, PREDS_CTE).replace("\nm AS (", "\n, m AS (", 1), ids=("ST13", "ST2"))
def q_st13(spark, sf):
    p = _model_preds(spark, sf)
    m = ST.metrics_with_rank(p, ["model", "segment"], "points", "pred")
    return ST.baseline_gate(m, ["segment"], "model", "rolling")


@register("st_family_gate", with_ctes("""
SELECT model, count(*) FILTER (WHERE a.mae < b.mae) AS segments_won, count(*) FILTER (WHERE a.mae < b.mae) >= 2 AS passes
FROM (SELECT model, segment, avg(abs(pred - points)) AS mae FROM preds WHERE pred IS NOT NULL GROUP BY ALL) a
JOIN (SELECT segment, avg(abs(pred - points)) AS mae FROM preds WHERE pred IS NOT NULL AND model = 'venue_mean' GROUP BY ALL) b
  USING (segment) WHERE model <> 'venue_mean' GROUP BY model""", *FM_SQL, BASE_PRED_CTE, PREDS_CTE), ids=("ST15",))
def q_st15(spark, sf):
    m = ST.regression_metrics(_model_preds(spark, sf), ["model", "segment"], "points", "pred")
    return ST.family_gate(m, "segment", "model", "venue_mean")


@register("ml_impute_stratified", with_ctes(f"""
em AS (SELECT epoch, avg(points_roll3) AS e1, avg(opp_ga_prior_rate) AS e2 FROM fm WHERE epoch < {VAL_SQL} GROUP BY epoch),
gmn AS (SELECT avg(points_roll3) AS g1, avg(opp_ga_prior_rate) AS g2 FROM fm WHERE epoch < {VAL_SQL})
SELECT entity, fixture, epoch, coalesce(points_roll3, em.e1, gmn.g1, 0.0) AS points_roll3,
       coalesce(opp_ga_prior_rate, em.e2, gmn.g2, 0.0) AS opp_ga_prior_rate
FROM fm LEFT JOIN em USING (epoch), gmn""", *FM_SQL).replace("\nem AS (", "\n, em AS (", 1), ids=("ML1",))
def q_ml1(spark, sf):
    fm = feature_matrix(spark, sf)
    feats = ["points_roll3", "opp_ga_prior_rate"]
    means = M.impute_fit(fm.where(F.col("epoch") < val_epoch(fm)), "epoch", feats)
    return M.impute_apply(fm.select("entity", "fixture", "epoch", *feats), means, "epoch", feats)


@register("ml_ridge_one_feature", with_ctes(f"""
s AS (SELECT segment, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(points) AS my FROM
      (SELECT segment, coalesce(points_roll5, 0.0) AS x, points FROM fm WHERE epoch < {VAL_SQL}) t GROUP BY segment),
b AS (SELECT t.segment, sum(((x - mx) / CASE WHEN sx = 0 THEN 1 ELSE sx END) * (points - my)) / (any_value(n) + 10.0) AS beta
      FROM (SELECT segment, coalesce(points_roll5, 0.0) AS x, points FROM fm WHERE epoch < {VAL_SQL}) t JOIN s USING (segment)
      GROUP BY t.segment)
SELECT f.segment, entity, fixture,
       my + beta * (coalesce(points_roll5, 0.0) - mx) / CASE WHEN sx = 0 THEN 1 ELSE sx END AS pred
FROM fm f JOIN s USING (segment) JOIN b USING (segment) WHERE epoch = {VAL_SQL}""", *FM_SQL)
    .replace("\ns AS (", "\n, s AS (", 1), ids=("ML3", "ML2", "CV2"))
def q_ml3_one(spark, sf):
    fm = feature_matrix(spark, sf).withColumn("x", F.coalesce("points_roll5", F.lit(0.0)))
    coefs = M.fit_linear(fm.where(F.col("epoch") < val_epoch(fm)), ["segment"], ["x"], "points", [10.0])
    out = M.linear_predict(fm.where(F.col("epoch") == val_epoch(fm)), coefs, ["segment"], ["x"])
    return out.select("segment", "entity", "fixture", "pred")


# ------------------------------------------------------------ CV runner and learners
from stepwise.plans import cv as CV  # noqa: E402
from stepwise.plans import folds as FD  # noqa: E402
from stepwise.plans import runner as RN  # noqa: E402
from stepwise.plans.features import SEGMENT_WITHOUT, feature_names, segment_features  # noqa: E402

RIDGE_FEATS = feature_names()
SEGMENT_LISTS = {seg: segment_features(seg) for seg in SEGMENT_WITHOUT}


def _long(spark, sf):
    from stepwise.session import remember
    return remember(spark, ("cv_long", sf), lambda: CV.prepare_folds(feature_matrix(spark, sf), RIDGE_FEATS, 3))


def _folds(spark, sf):
    from stepwise.session import remember
    return remember(spark, ("folds", sf), lambda: FD.Folds(feature_matrix(spark, sf), RIDGE_FEATS, "points", 3, lists=SEGMENT_LISTS))


ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0]


@register("cv_ridge_alpha_grid", ids=("CV3", "CV2", "ML3", "ML1", "ML2"))
def q_cv3(spark, sf):
    return FD.ridge_alpha_grid(_folds(spark, sf), ALPHAS)


#: The last three epochs of the feature matrix validate folds 1 to 3.
FOLD_CTE = """fd AS (SELECT epoch AS val_epoch, CAST(4 - r AS INTEGER) AS fold FROM (
  SELECT epoch, row_number() OVER (ORDER BY epoch DESC) AS r FROM (SELECT DISTINCT epoch FROM fm) a) b WHERE r <= 3)"""


@register("cv_ridge_alpha_grid_two_features", with_ctes("""
em AS (SELECT segment, epoch, avg(points_roll5) AS e1, avg(opp_ga_prior_rate) AS e2 FROM fm GROUP BY ALL),
gm AS (SELECT segment, fold, avg(points_roll5) AS g1, avg(opp_ga_prior_rate) AS g2 FROM fm JOIN fd ON epoch < val_epoch GROUP BY ALL),
tr AS (SELECT segment, fold, coalesce(points_roll5, e1, g1, 0.0) AS x1, coalesce(opp_ga_prior_rate, e2, g2, 0.0) AS x2, points AS y
       FROM fm JOIN fd ON epoch < val_epoch JOIN em USING (segment, epoch) JOIN gm USING (segment, fold)),
s AS (SELECT segment, fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(y) AS my,
        covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM tr GROUP BY ALL),
ab AS (SELECT s.*, alpha, n + alpha AS a1, n * c12 / (s1 * s2) AS a2, n * c1 / s1 AS b1, n * c2 / s2 AS b2
       FROM s, (SELECT unnest([0.1, 1.0, 10.0, 100.0, 1000.0])::DOUBLE AS alpha) al),
be AS (SELECT *, (a1 * b1 - a2 * b2) / (a1 * a1 - a2 * a2) AS w1, (a1 * b2 - a2 * b1) / (a1 * a1 - a2 * a2) AS w2 FROM ab),
mf AS (SELECT f.segment, fd.fold, alpha, avg(abs(my + w1 * (coalesce(points_roll5, g1, 0.0) - m1) / s1
                                                 + w2 * (coalesce(opp_ga_prior_rate, g2, 0.0) - m2) / s2 - points)) AS mae
       FROM fm f JOIN fd ON f.epoch = val_epoch JOIN gm ON gm.segment = f.segment AND gm.fold = fd.fold
       JOIN be ON be.segment = f.segment AND be.fold = fd.fold GROUP BY ALL),
mm AS (SELECT segment, alpha, avg(mae) AS mean_mae FROM mf GROUP BY ALL)
SELECT segment, alpha, mean_mae, best_alpha, alpha = best_alpha AS is_best
FROM mm JOIN (SELECT segment, arg_min(alpha, struct_pack(m := mean_mae, a := alpha)) AS best_alpha FROM mm GROUP BY segment) t USING (segment)""",
    *FM_SQL, FOLD_CTE).replace("\nem AS (", "\n, em AS (", 1), ids=("CV3", "CV2", "ML1", "ML2", "ML3"))
def q_cv3_two(spark, sf):
    """The alpha search on two features, whose ridge has a closed form in SQL."""
    return FD.ridge_alpha_grid(FD.Folds(feature_matrix(spark, sf), ["points_roll5", "opp_ga_prior_rate"], "points", 3), ALPHAS)


@register("ml_collinear_columns", with_ctes("""
em AS (SELECT segment, epoch, avg(goals_roll5) AS e1, avg(xg_roll5) AS e2, avg(goals_roll5 + xg_roll5) AS e3 FROM fm GROUP BY ALL),
x AS (SELECT segment, coalesce(goals_roll5, e1) AS x1, coalesce(xg_roll5, e2) AS x2, coalesce(goals_roll5 + xg_roll5, e3) AS x3
      FROM fm JOIN em USING (segment, epoch)),
r AS (SELECT segment, 1 - corr(x1, x2) ** 2 >= 1 - corr(x1, x3) ** 2 AS second FROM x GROUP BY segment)
SELECT segment, CASE WHEN second THEN 'xgi_roll5' ELSE 'xg_roll5' END AS dropped,
       CASE WHEN second THEN 'goals_roll5,xg_roll5' ELSE 'goals_roll5,xgi_roll5' END AS kept FROM r""", *FM_SQL)
    .replace("\nem AS (", "\n, em AS (", 1), ids=("ML3",))
def q_ml3_collinear(spark, sf):
    """A sum of two features is found and dropped by name, whichever of the three the pivots leave last."""
    fm = feature_matrix(spark, sf).withColumn("xgi_roll5", F.col("goals_roll5") + F.col("xg_roll5"))
    return FD.dependent_columns(FD.Folds(fm, ["goals_roll5", "xg_roll5", "xgi_roll5"], "points", 3))


def _graph(spark, sf):
    """Models of the feature matrix.  ``market`` is not registered, so what needs it is skipped."""
    bases = ["ridge", "bayesian_ridge", "rolling", "venue_mean"]
    return RN.Graph([
        RN.linear("ridge", FD.ridge(10.0)), RN.linear("bayesian_ridge", FD.bayesian(), std=True),
        RN.linear("lasso", FD.enet(0.1, 1.0)), RN.linear("elastic_net", FD.enet(0.5, 0.5)),
        RN.rolling("points_roll5"), RN.venue_mean(),
        RN.poisson(alpha=1e-4),
        RN.average("average", bases), RN.stacking(bases), RN.blending(["ridge", "bayesian_ridge", "poisson"]),
        RN.average("baselines", ["rolling", "venue_mean"]), RN.average("with_market", ["ridge", "market"])])


def _run(spark, sf, *names):
    from stepwise.session import remember
    return remember(spark, ("run", sf, names), lambda: RN.run(_graph(spark, sf), _folds(spark, sf), names))


@register("cv_oof_metrics", ids=("CV2", "ST4", "ST12", "UDX1"))
def q_cv2(spark, sf):
    """Metrics per model, segment and fold of a run of the model graph; a skipped model is one row with its reason."""
    run = _run(spark, sf, "stacking", "average", "lasso", "elastic_net", "with_market")
    gone = spark.createDataFrame(list(run.skipped.items()), "model string, skipped string")
    return run.metrics().withColumn("skipped", F.lit(None).cast("string")).unionByName(gone, allowMissingColumns=True)


@register("ml_average_baselines", with_ctes("""
tm AS (SELECT segment, fold, avg(points) AS m FROM fm JOIN fd ON epoch < val_epoch GROUP BY ALL),
vm AS (SELECT segment, fold, is_home, avg(points) AS v FROM fm JOIN fd ON epoch < val_epoch GROUP BY ALL),
pr AS (SELECT f.segment, fd.fold, points, coalesce(points_roll5, tm.m) AS p1, coalesce(vm.v, tm.m) AS p2
       FROM fm f JOIN fd ON f.epoch = val_epoch LEFT JOIN tm ON tm.segment = f.segment AND tm.fold = fd.fold
       LEFT JOIN vm ON vm.segment = f.segment AND vm.fold = fd.fold AND vm.is_home = f.is_home)
SELECT segment, fold, count(*) AS n, avg(abs(p1 - points)) AS mae_rolling, avg(abs(p2 - points)) AS mae_venue_mean,
       avg(abs((p1 + p2) / 2 - points)) AS mae_average FROM pr GROUP BY ALL""", *FM_SQL, FOLD_CTE)
    .replace("\ntm AS (", "\n, tm AS (", 1), ids=("ML17", "ML8", "ML9", "UDX1", "SNK7"))
def q_ml17_average(spark, sf):
    """Worked out from the saved run, as it is read back."""
    from stepwise.session import scratch_path
    from stepwise.sources.sinks import save_cv_results
    run = _run(spark, sf, "baselines")
    f = save_cv_results(run.metrics(), run.frame, scratch_path(spark, "cv-results")).read("oof")
    return f.groupBy("segment", "fold").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.abs(F.col(f"pred_{p}") - F.col("points"))).alias(f"mae_{a}") for p, a in (("rolling", "rolling"), ("venue_mean", "venue_mean"), ("baselines", "average"))])


@register("ml_bayesian_ridge", ids=("ML6",))
def q_ml6(spark, sf):
    f = _run(spark, sf, "bayesian_ridge").frame
    return f.groupBy("segment", "fold").agg(F.avg("pred_bayesian_ridge").alias("mean_pred"), F.avg("pred_std_bayesian_ridge").alias("mean_std"),
                                            F.avg(F.abs(F.col("pred_bayesian_ridge") - F.col("points"))).alias("mae"))


#: Points a component is worth, by segment where it differs.
COMPONENT_POINTS = {"goals": 4.0, "assists": 3.0, "bonus": 1.0, "saves": 0.0, "yellow": -1.0}
SEGMENT_POINTS = {"AFRICA": COMPONENT_POINTS | {"goals": 6.0, "saves": 1.0 / 3}, "ASIA": COMPONENT_POINTS | {"goals": 6.0},
                  "AMERICA": COMPONENT_POINTS | {"goals": 5.0}}


@register("ml_component_model", ids=("ML15", "JN15", "JN11"))
def q_ml15(spark, sf):
    from stepwise.operators.relational import reattach
    comps = list(COMPONENT_POINTS)
    rows = reattach(feature_matrix(spark, sf), B.fact(spark, sf), ["epoch", "step", "fixture", "entity"], comps)
    p = FD.components(FD.Folds(rows, RIDGE_FEATS, "points", 3, more=comps), comps, SEGMENT_POINTS, COMPONENT_POINTS)
    return p.groupBy("segment", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"),
                                            F.avg(F.abs(F.col("pred") - F.col("points"))).alias("mae"))


@register("ml_pairwise_ridge", ids=("ML16",))
def q_ml16(spark, sf):
    base = ["points_roll5", "minutes_roll5", "xg_roll5", "opp_rank", "team_cs_rate5"]
    long, names = M.pairwise_products(_long(spark, sf), base)
    oof = CV.ridge_oof(long, names, "points", [10.0], "pairwise_ridge")
    return ST.regression_metrics(oof, ["segment", "fold"], "points", "pred")


@register("ml_two_stage", ids=("ML14",))
def q_ml14(spark, sf):
    from stepwise.operators.relational import reattach
    from stepwise.session import write_and_reload
    fm = feature_matrix(spark, sf)
    rows = write_and_reload(reattach(fm, B.fact(spark, sf), ["epoch", "step", "fixture", "entity"], ["minutes"]), "two-stage-rows")
    long = CV.prepare_folds(fm, RIDGE_FEATS, 3, rows)
    oof = CV.two_stage(long, RIDGE_FEATS, "points", "minutes", 60,
                       start_feats=["minutes_roll3", "minutes_roll5", "minutes_todate", "points_roll5", "opp_rank"])
    return ST.regression_metrics(oof, ["segment", "fold"], "points", "pred")


def _learner(kind, **params):
    def q(spark, sf):
        feats = ["points_roll5", "minutes_roll5", "xg_roll5", "points_todate", "opp_rank", "team_cs_rate5"]
        oof = CV.spark_learner_oof(_long(spark, sf), feats, "points", kind, **params)
        return ST.regression_metrics(oof, ["model", "segment", "fold"], "points", "pred")
    return q


def _one_model(name):
    def q(spark, sf):
        run = _run(spark, sf, name)
        return ST.regression_metrics(run.frame, ["segment", "fold"], "points", f"pred_{name}").withColumn("model", F.lit(name))
    return q


register("ml_lasso", ids=("ML5",))(_one_model("lasso"))
register("ml_elastic_net", ids=("ML4",))(_one_model("elastic_net"))
register("ml_poisson_glm", ids=("ML7",))(_one_model("poisson"))
register("ml_random_forest", ids=("ML12",))(_learner("forest", trees=200, depth=6))
register("ml_gradient_boosting", ids=("ML13",))(_learner("gbt", trees=30, depth=4))


def _ensemble_mae(f, *names):
    return f.groupBy("segment", "fold").agg(*[F.avg(F.abs(F.col(f"pred_{m}") - F.col("points"))).alias(f"mae_{m}") for m in names])


@register("ml_stacking", ids=("ML17", "UDX1"))
def q_ml17(spark, sf):
    return _ensemble_mae(_run(spark, sf, "stacking", "average").frame, "average", "stacking")


@register("ml_blending", ids=("ML17", "ML4", "UDX1"))
def q_ml17_blending(spark, sf):
    return _ensemble_mae(_run(spark, sf, "blending").frame, "ridge", "bayesian_ridge", "poisson", "blending")


@register("ml_padded_sequences", with_ctes("""
SELECT entity, epoch, CAST(block AS INTEGER) AS block, CAST(count(*) AS INTEGER) AS n_steps,
       string_agg(x, ',' ORDER BY pos) || repeat(',0:0', CAST(38 - count(*) AS INTEGER)) AS seq,
       repeat('1', CAST(count(*) AS INTEGER)) || repeat('0', CAST(38 - count(*) AS INTEGER)) AS mask FROM (
  SELECT *, pos // 38 AS block FROM (
    SELECT entity, epoch, row_number() OVER (PARTITION BY entity, epoch ORDER BY step, fixture) - 1 AS pos,
           CAST(round(coalesce(points_roll3, 0.0) * 1000) AS BIGINT) || ':' || CAST(round(coalesce(minutes_roll3, 0.0) * 1000) AS BIGINT) AS x FROM fm) a) t
GROUP BY entity, epoch, block""", *FM_SQL), ids=("ML18",))
def q_ml18(spark, sf):
    """Each block's steps in order, in thousandths, and its mask, as text."""
    s = M.padded_sequences(feature_matrix(spark, sf), ["entity", "epoch"], ["step", "fixture"],
                           ["points_roll3", "minutes_roll3"], 38)
    thousandths = F.transform("seq", lambda x: F.array_join(F.transform(x, lambda v: F.round(v * 1000).cast("bigint").cast("string")), ":"))
    return s.select("entity", "epoch", "block", "n_steps", F.array_join(thousandths, ",").alias("seq"),
                    F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask"))


@register("ml_full_fit_metadata", ids=("ML19",))
def q_ml19(spark, sf):
    cv = FD.ridge_alpha_grid(_folds(spark, sf), ALPHAS).where("is_best").select(
        "segment", F.col("alpha").alias("cv_alpha"), F.col("mean_mae").alias("cv_mae"))
    return CV.full_fit_and_save(_folds(spark, sf), 10.0, cv)


def score_slice(spark, sf, models=("ridge", "rolling", "venue", "market")):
    """ML20: the newest slice scored by every model of the list that there is; another one's column is null."""
    from stepwise.plans.slices import select_slice
    fm = feature_matrix(spark, sf)
    train = fm.where(F.col("epoch") < val_epoch(fm))
    p = select_slice(fm, "epoch", "step", val_epoch(fm))
    tm = train.groupBy("segment").agg(F.avg("points").alias("_tm"))
    known = {
        "ridge": lambda d: FD.score(d, FD.full_fit(FD.Folds(train, RIDGE_FEATS, "points", 3), 10.0), RIDGE_FEATS, "pred_ridge"),
        "rolling": lambda d: d.join(F.broadcast(tm), "segment", "left").withColumn("pred_rolling", F.coalesce("points_roll5", "_tm")).drop("_tm"),
        "venue": lambda d: M.venue_mean_baseline(train, d, ["segment"], "is_home", "points", "pred_venue")}
    for m in models:
        p = known[m](p) if m in known else p.withColumn(f"pred_{m}", F.lit(None).cast("double"))
    return M.average_ensemble(p, [f"pred_{m}" for m in models], "pred_ensemble")


@register("ml_score_slice_ensemble", ids=("ML20", "FLT5", "WIN13"))
def q_ml20(spark, sf):
    from stepwise.operators.windows import top_n_per_group
    p = score_slice(spark, sf)
    return top_n_per_group(p.select("segment", "entity", "fixture", "pred_ridge", "pred_rolling", "pred_venue", "pred_market", "pred_ensemble"),
                           ["segment"], [F.col("pred_ensemble").desc(), F.col("entity"), F.col("fixture")], 5,
                           rank_name="rank")


@register("ml_cold_start", with_ctes(f"""
pe AS (SELECT entity, epoch + 1 AS epoch, avg(points) AS prev_mean FROM fm GROUP BY entity, epoch),
fs AS (SELECT entity, epoch, min(step) AS first_step FROM fm GROUP BY ALL),
g AS (SELECT avg(points) AS gm FROM fm WHERE epoch < {VAL_SQL})
SELECT entity, fixture, step,
  CASE WHEN step = first_step THEN coalesce(prev_mean, points_roll5, gm) ELSE coalesce(points_roll5, gm) END AS pred
FROM fm LEFT JOIN pe USING (entity, epoch) JOIN fs USING (entity, epoch), g WHERE epoch = {VAL_SQL}""",
    *FM_SQL).replace("\npe AS (", "\n, pe AS (", 1), ids=("ML11", "JN14"))
def q_ml11(spark, sf):
    from stepwise.operators.relational import prior_epoch
    fm = feature_matrix(spark, sf)
    stats = fm.groupBy("entity", "epoch").agg(F.avg("points").alias("prev_mean"))
    first = fm.groupBy("entity", "epoch").agg(F.min("step").alias("first_step"))
    gm = fm.where(F.col("epoch") < val_epoch(fm)).groupBy().agg(F.avg("points").alias("gm"))
    v = (prior_epoch(fm.where(F.col("epoch") == val_epoch(fm)), stats, "entity", "epoch", ["prev_mean"], "{c}")
         .join(first, ["entity", "epoch"])
         .withColumn("_k", F.lit(0)).join(F.broadcast(gm.withColumn("_k", F.lit(0))), "_k").drop("_k"))
    out = M.cold_start_baseline(v, "prev_mean", "points_roll5", F.col("gm"), F.col("step") == F.col("first_step"))
    return out.select("entity", "fixture", "step", "pred")


@register("st_residual_stats", with_ctes(f"""
r AS (SELECT segment, step, opp_rank, points - pred AS res, abs(points - pred) AS ab, pred FROM bp WHERE pred IS NOT NULL),
mn AS (SELECT segment, avg(res) AS mean_residual, avg(res) FILTER (WHERE opp_rank <= 5) AS mean_residual_vs_top5,
              avg(res) FILTER (WHERE opp_rank >= 21) AS mean_residual_vs_bottom5 FROM r GROUP BY segment),
wst AS (SELECT segment, arg_max(step, m) AS worst_step, max(m) AS worst_step_mae FROM
        (SELECT segment, step, avg(ab) AS m FROM r GROUP BY ALL) t GROUP BY segment),
rho AS (SELECT segment, corr(rx, ry) AS rho_abs_residual_pred FROM (
        SELECT segment, {_AVG_RANK.format(g='segment', x='ab')} AS rx, {_AVG_RANK.format(g='segment', x='pred')} AS ry
        FROM r) t GROUP BY segment)
SELECT * FROM mn LEFT JOIN wst USING (segment) LEFT JOIN rho USING (segment)""", *FM_SQL, BASE_PRED_CTE)
    .replace("\nr AS (", "\n, r AS (", 1), ids=("ST9", "SRT5"))
def q_st9(spark, sf):
    return ST.residual_stats(_baseline_pred(spark, sf).where(F.col("pred").isNotNull()), ["segment"],
                             "points", "pred", "opp_rank", "step")


@register("pl_epoch_retrain_summary", ids=("PL3", "V24", "CV3", "ML17"))
def q_pl3(spark, sf):
    from stepwise.plans.pipelines import retrain
    out = retrain(feature_matrix(spark, sf), RIDGE_FEATS, "points", [1.0, 10.0, 100.0])
    return out["summary"]


@register("pl_slice_run_monitor", with_ctes("""
s AS (SELECT segment, epoch, step, count(*) AS n, avg(abs(pred - points)) AS mae, sqrt(avg((pred - points) * (pred - points))) AS rmse,
        1.0 - sum((pred - points) * (pred - points)) / nullif(count(*) * var_pop(points), 0) AS r2
      FROM bp WHERE pred IS NOT NULL GROUP BY ALL)
SELECT *, avg(mae) OVER w AS rolling_mae, avg(mae) OVER w > 20.0 AS alert, 'delivery' AS new_columns, '' AS dropped_columns
FROM s WINDOW w AS (PARTITION BY segment ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", *FM_SQL, BASE_PRED_CTE)
    .replace("\ns AS (", "\n, s AS (", 1), ids=("PL2", "SNK1", "SNK2", "SET3", "ST4", "WIN10"))
def q_pl2(spark, sf):
    """The newest slice arrives with an extra column; the log holds the epoch's earlier slices."""
    from stepwise.plans.pipelines import run_slice
    from stepwise.session import scratch_path
    f = B.fact(spark, sf)
    last = f.groupBy().agg(F.max(F.struct("epoch", "step")).alias("m")).first()["m"]   # one scalar
    is_new = (F.col("epoch") == last["epoch"]) & (F.col("step") == last["step"])
    existing, new = f.where(~is_new), f.where(is_new).withColumn("delivery", F.lit("2nd"))

    def features(table):
        from stepwise.catalog.rel_q import standings_rank
        return build_feature_matrix(table, standings_rank(spark, sf))

    def score(fm, sl):
        # learnt from the epochs before the slice's own
        tm = fm.where(F.col("epoch") < last["epoch"]).groupBy("segment").agg(F.avg("points").alias("_tm"))
        s = fm.join(sl.select("entity", "fixture"), ["entity", "fixture"], "left_semi")
        return M.rolling_baseline(s.join(F.broadcast(tm), "segment", "left"), "points_roll5", F.col("_tm"))
    earlier = existing.where(F.col("epoch") == last["epoch"])
    log = ST.regression_metrics(score(feature_matrix(spark, sf), earlier), ["segment", "epoch", "step"], "points", "pred")
    out = run_slice(existing, new, ["epoch", "step", "fixture", "entity"], f.columns, features, score, log, 20.0,
                    base=scratch_path(spark, "slice-run"))
    d = out["drift"].withColumn("_k", F.lit(0))   # one row
    return out["monitor"].withColumn("_k", F.lit(0)).join(F.broadcast(d), "_k").drop("_k")
