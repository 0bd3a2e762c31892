"""Cross-validation of learners that read rows, two-stage models and the saved
full fit (CV2, ML12-ML14, ML16, ML19).  Linear models are in
:mod:`stepwise.plans.folds`, the model graph in :mod:`stepwise.plans.runner`."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.operators import models as M
from stepwise.operators import stats as ST
from stepwise.operators.boosting import fit_boosting
from stepwise.operators.forest import fit_forests, predict_forests
from stepwise.operators.glm import fit_logistic, fit_poisson, fitted_mean
from stepwise.plans import folds as FD
from stepwise.session import scratch_path, write_and_reload

FIT_THREADS = 4   # concurrent Spark ML fits (separate jobs share the cluster)


def _per_group(long: DataFrame, name: str, fit_one) -> DataFrame:
    """Run ``fit_one(segment, fold) -> predictions`` for every (segment,
    fold) group -- a bounded list -- on a small thread pool, appending each
    group's predictions to one table in the shared checkpoint folder.  Plans
    stay small and nothing is held in driver memory."""
    from concurrent.futures import ThreadPoolExecutor
    spark = long.sparkSession
    groups = [(r["segment"], r["fold"]) for r in
              long.where(F.col("role") == "train").select("segment", "fold").distinct().collect()]
    path = scratch_path(spark, name)

    def run(ig):
        i, g = ig
        try:
            fit_one(*g).write.mode("overwrite").parquet(f"{path}/grp={i}")   # one folder per group
            return None
        except Exception as e:  # noqa: BLE001 -- retried below
            import logging
            logging.getLogger("stepwise").warning("group %s failed, will retry: %s", g, str(e)[-2000:])
            return ig
    with ThreadPoolExecutor(max_workers=FIT_THREADS) as ex:
        failed = [x for x in ex.map(run, enumerate(groups)) if x is not None]
    for i, g in failed:   # a failed group is refitted once, alone; overwrite keeps it idempotent
        fit_one(*g).write.mode("overwrite").parquet(f"{path}/grp={i}")
    return spark.read.parquet(path).drop("grp")

KEYS = ["segment", "epoch", "step", "fixture", "entity"]


def prepare_folds(fm: DataFrame, feats: Sequence[str], n_folds: int = 3, rows: DataFrame | None = None) -> DataFrame:
    """Long (row x fold) table with stratified imputation fitted on each
    fold's training rows (ML1), of ``rows`` (``fm`` with more columns) where they are given.

    Only the folds and the means are written (rows per epoch, segment and fold).  A row's
    copies are made as it is read, so no copy is stored or sorted, and a reader that
    takes a few features reads only those columns of the matrix."""
    folds = write_and_reload(ST.expanding_folds(fm, "epoch", n_folds), "fold-epochs")
    train = ST.assign_folds(fm, folds, "epoch").where(F.col("role") == "train")
    means = tuple(write_and_reload(m, "fold-means") for m in M.impute_fit_grouped(train, ["segment", "fold"], "epoch", feats))
    long = ST.assign_folds(fm if rows is None else rows, folds, "epoch")
    return M.impute_apply(long, means, "epoch", feats, by=["segment", "fold"])


def ridge_oof(long: DataFrame, feats: Sequence[str], target: str, alphas: Sequence[float],
              model: str = "ridge") -> DataFrame:
    """CV2 for linear models: one Gram pass per (segment, fold), every alpha
    solved from it, out-of-fold predictions for the validation rows."""
    train = long.where(F.col("role") == "train")
    coefs = M.fit_linear(train, ["segment", "fold"], feats, target, alphas, model)
    cols = list(dict.fromkeys([*KEYS, "fold", target, "is_home", "opp_rank", *feats]))
    val = long.where(F.col("role") == "val").select(*cols)
    return _predict_all_alphas(val, coefs, feats)


def _predict_all_alphas(val: DataFrame, coefs: DataFrame, feats: Sequence[str]) -> DataFrame:
    j = val.join(F.broadcast(coefs), ["segment", "fold"])
    pred = F.col("intercept")
    for i, f in enumerate(feats):
        pred = pred + F.col("coef")[i] * (F.col(f) - F.col("mu")[i]) / F.col("sd")[i]
    return j.withColumn("pred", pred).drop("intercept", "coef", "mu", "sd", "cov", "noise_var")


def two_stage(long: DataFrame, feats: Sequence[str], target: str, minutes: str, start_min: int = 60,
              alpha: float = 1.0, min_rows: int = 10, start_feats: Sequence[str] | None = None) -> DataFrame:
    """ML14: P(start) x E[y | start] + (1 - P) x E[y | bench] per segment and
    fold; a split with fewer than ``min_rows`` training rows uses all rows.

    ``minutes`` is the row's own match, read as a label in training rows only
    (null: not started); P(start) is fitted on ``start_feats``."""
    start_feats = list(start_feats or feats)
    d = long.withColumn("_start", F.coalesce((F.col(minutes) >= start_min).cast("double"), F.lit(0.0)))
    train = d.where(F.col("role") == "train")
    val = d.where(F.col("role") == "val")
    keys = ["segment", "fold"]
    # one row per segment, fold and flag; all linear fits are solved from one pass over the rows
    sizes = {(r["segment"], r["fold"], r["_start"]): r["n"] for r in train.groupBy(*keys, "_start").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = M.fit_linear(train, [*keys, "_start"], feats, target, [alpha])
    small = [(s, f, flag) for s, f in {(s, f) for s, f, _ in sizes} for flag in (1.0, 0.0) if sizes.get((s, f, flag), 0) < min_rows]
    spark = long.sparkSession
    lacking = spark.createDataFrame(small, T.StructType([*[train.schema[k] for k in keys], T.StructField("_start", T.DoubleType())]))
    fits = split.join(F.broadcast(lacking), [*keys, "_start"], "left_anti")
    if small:
        whole = M.fit_linear(train.join(F.broadcast(lacking.select(*keys).distinct()), keys, "left_semi"), keys, feats, target, [alpha])
        fits = fits.unionByName(whole.join(F.broadcast(lacking), keys))
    # one row per segment, fold and flag
    linear: dict[float, list[tuple]] = {1.0: [], 0.0: []}
    every = list(dict.fromkeys([*feats, *start_feats]))
    none, at = [0.0] * len(every), [every.index(c) for c in feats]

    def weights(places, w):
        out = np.zeros(len(every))
        out[places] = w
        return out.tolist()

    for r in fits.collect():
        w = np.array(r["coef"]) / np.array(r["sd"])
        linear[r["_start"]].append((r["segment"], r["fold"], weights(at, w), float(r["intercept"] - w @ np.array(r["mu"])), none, none, none, None, None))
    # the classifiers of all groups are fitted together; where all rows are of one kind, that kind is certain
    ends = {(s, f): (sizes.get((s, f, 0.0), 0), sizes.get((s, f, 1.0), 0)) for s, f, _ in sizes if s is not None}
    starts = [(s, f, none, float("inf") if n1 else float("-inf"), none, none, none, None, None) for (s, f), (n0, n1) in ends.items() if not (n0 and n1)]
    both = spark.createDataFrame([g for g, (n0, n1) in ends.items() if n0 and n1], T.StructType([train.schema[k] for k in keys]))
    for g, (b, w) in fit_logistic(train.join(F.broadcast(both), keys, "left_semi"), keys, start_feats, "_start", n_rows=sum(sizes.values())).items():
        starts.append((*g, weights([every.index(c) for c in start_feats], w), b, none, none, none, None, None))
    told = FD.predict_all(val.select(*KEYS, "fold", target, *[c for c in every if c not in (*KEYS, "fold", target)]),
                          [(starts, "_eta", None), (linear[1.0], "_e1", None), (linear[0.0], "_e0", None)], every)
    told = told.where(F.col("_eta").isNotNull() & F.col("_e1").isNotNull() & F.col("_e0").isNotNull()).withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_eta"))))
    out = told.withColumn("pred", F.col("_p") * F.col("_e1") + (1 - F.col("_p")) * F.col("_e0")).select(*KEYS, "fold", target, "pred", F.col("_p").alias("p_start"))
    return write_and_reload(out, "two-stage")


def spark_learner_oof(long: DataFrame, feats: Sequence[str], target: str, kind: str, **params) -> DataFrame:
    """OOF predictions of a Spark ML learner, fitted per (segment, fold); Poisson regression, forests and boosting fit them all at once."""
    train = long.where(F.col("role") == "train")
    val = long.where(F.col("role") == "val")

    if kind == "poisson":   # all groups in one pass an iteration
        p = predict_poisson(val, fit_poisson(train, ["segment", "fold"], feats, target, **params), feats)
        return write_and_reload(p.select(*KEYS, "fold", target, "pred"), "oof-poisson").withColumn("model", F.lit(kind))

    if kind == "forest":    # all groups in one pass a level
        fits = fit_forests(train, ["segment", "fold"], KEYS, feats, target, **params)
        p = predict_forests(val.select(*KEYS, "fold", target, *feats), fits, ["segment", "fold"], feats)
        return write_and_reload(p, "oof-forest").withColumn("model", F.lit(kind))

    if kind == "gbt":       # all groups in one pass a level
        fits = fit_boosting(train, ["segment", "fold"], feats, target, **params)
        p = predict_forests(val.select(*KEYS, "fold", target, *feats), fits, ["segment", "fold"], feats)
        return write_and_reload(p, "oof-gbt").withColumn("model", F.lit(kind))

    def fit_one(seg, fold):
        sel = (F.col("segment") == seg) & (F.col("fold") == fold)
        model = M.spark_ml_fit(train.where(sel).select(*feats, target), feats, target, kind, **params)
        return M.spark_ml_predict(model, val.where(sel), feats, "pred").select(*KEYS, "fold", target, "pred")
    return _per_group(long, f"oof-{kind}", fit_one).withColumn("model", F.lit(kind))


def poisson_oof(data: FD.Folds, **params) -> DataFrame:
    """OOF predictions of Poisson regression: a row is read once for all folds it trains, and filled as
    :func:`prepare_folds` fills it, by its epoch's mean, else by the fold's."""
    serves: dict[tuple, list] = {}
    fills: dict[tuple, list[float]] = {}
    for g in data.moments.groups:
        means = data.moments.epoch_means(g, data.feats)
        for f, e in data.val.items():
            got = data.moments.fold(g, data.feats, [data.target], hi=e)
            if got is not None and g[0] is not None:
                fills[g[0], f] = got[1].tolist()
                for epoch, m in means.items():
                    if epoch < e:
                        serves.setdefault((g[0], epoch), []).append(((g[0], f), np.where(np.isnan(m), got[1], m)))
    fits = fit_poisson(data.rows, ["segment", "epoch"], data.feats, data.target, serves=serves, **params)
    p = predict_poisson(data.validation(), fits, data.feats, fills)
    return write_and_reload(p.select(*KEYS, "fold", data.target, "pred"), "oof-poisson")


def predict_poisson(val: DataFrame, fits: dict, feats: Sequence[str], fills: dict | None = None) -> DataFrame:
    """Rows of the groups (segment, fold) that have a fit, with ``pred``."""
    none = [0.0] * len(feats)
    linear = [(*g, w, b, (fills or {}).get(g, none), none, none, None, None) for g, (b, w, _) in fits.items()]
    shifts = F.lit(None).cast("double")
    for (seg, fold), (_, _, shift) in fits.items():
        shifts = F.when((F.col("segment") == F.lit(seg)) & (F.col("fold") == F.lit(fold)), F.lit(shift)).otherwise(shifts)
    eta = FD.predict(val, linear, feats, "_eta")
    return eta.where(F.col("_eta").isNotNull()).withColumn("pred", fitted_mean(F.col("_eta"), shifts)).drop("_eta")


def full_fit_and_save(data: FD.Folds, alpha: float, cv_mae: DataFrame, path: str | None = None) -> DataFrame:
    """ML19: fit on every epoch, write coefficients and a metadata row per
    segment (features, epochs, rows, CV MAE) as Parquet."""
    spark = data.rows.sparkSession
    path = path or scratch_path(spark, "model")
    FD.full_fit(data, alpha).write.mode("overwrite").parquet(f"{path}/coefficients")
    fitted = spark.read.parquet(f"{path}/coefficients")
    meta = fitted.select("segment", F.to_json("features").alias("features"), F.transform("epochs", lambda e: e.cast("int")).alias("epochs"), "rows")
    meta.join(cv_mae, "segment", "left").write.mode("overwrite").parquet(f"{path}/metadata")
    return spark.read.parquet(f"{path}/metadata").withColumn("path", F.lit(path))
