"""Models (ML1-ML20); the model graph (UDX1) is :mod:`stepwise.plans.runner`.

Linear models are fitted from sufficient statistics: one ``agg`` pass
computes ``n, sum x, sum y, sum x x', sum x y, sum y^2`` per group (segment,
fold), only those ``O(d^2)`` numbers reach the driver, and the solve is
exact.  Predictions join the (bounded) coefficient table back and are plain
column expressions.  Boosting and the classifier use Spark ML estimators; the GLM and
the forests of all groups are fitted together in :mod:`stepwise.operators.glm`
and :mod:`stepwise.operators.forest`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.operators.positions import prefix


# ML1 -------------------------------------------------------------------------
def impute_fit(train: DataFrame, epoch: str, feats: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per-epoch and global training means (bounded: one row per epoch / one row)."""
    per_epoch = train.groupBy(epoch).agg(*[F.avg(f).alias(f"_em_{f}") for f in feats])
    glob = train.groupBy().agg(*[F.avg(f).alias(f"_gm_{f}") for f in feats])
    return per_epoch, glob


def impute_apply(df: DataFrame, means: tuple[DataFrame, DataFrame], epoch: str,
                 feats: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``coalesce(x, epoch mean, global mean, 0)``; an unseen epoch gets the
    global mean.  ``by`` keys (segment, fold) select the matching statistics."""
    per_epoch, glob = means
    out = df.join(F.broadcast(per_epoch), list(by) + [epoch], "left")
    if by:
        out = out.join(F.broadcast(glob), list(by), "left")
    else:
        out = (out.withColumn("_k", F.lit(0))
                  .join(F.broadcast(glob.withColumn("_k", F.lit(0))), "_k", "left").drop("_k"))
    out = out.withColumns({f: F.coalesce(F.col(f), F.col(f"_em_{f}"), F.col(f"_gm_{f}"), F.lit(0.0))
                           for f in feats})
    return out.drop(*[f"_em_{f}" for f in feats], *[f"_gm_{f}" for f in feats])


def impute_fit_grouped(train: DataFrame, by: Sequence[str], epoch: str, feats: Sequence[str]):
    per_epoch = train.groupBy(*by, epoch).agg(*[F.avg(f).alias(f"_em_{f}") for f in feats])
    glob = train.groupBy(*by).agg(*[F.avg(f).alias(f"_gm_{f}") for f in feats])
    return per_epoch, glob


# Gram statistics -------------------------------------------------------------
def gram_stats(df: DataFrame, by: Sequence[str], feats: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One aggregation pass: every moment a linear fit needs, per group."""
    d = len(feats)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(f).cast("double")).alias(f"sx_{i}") for i, f in enumerate(feats)]
    for i in range(d):
        for j in range(i, d):
            aggs.append(F.sum(F.col(feats[i]) * F.col(feats[j])).alias(f"sxx_{i}_{j}"))
    for t, y in enumerate(targets):
        aggs.append(F.sum(F.col(y).cast("double")).alias(f"sy_{t}"))
        aggs.append(F.sum(F.col(y) * F.col(y)).alias(f"syy_{t}"))
        aggs += [F.sum(F.col(f) * F.col(y)).alias(f"sxy_{i}_{t}") for i, f in enumerate(feats)]
    return df.groupBy(*by).agg(*aggs)


def grouped_moments(df: DataFrame, by: Sequence[str], feats: Sequence[str], target: str) -> list[tuple[tuple, Moments]]:
    """(group, moments) from the sums of :func:`gram_stats`, which tasks add up as matrix products: as columns, those
    of some tens of features are more code than the JVM compiles."""
    d = len(feats)
    if not by or d > 60:
        return [(tuple(r[k] for k in by), moments_from_row(r, d, 1)) for r in gram_stats(df, by, feats, [target]).collect()]   # O(groups * d^2) numbers
    from stepwise.operators.moments import moment_table
    upper, out = np.triu_indices(d + 1), []
    for r in moment_table(df, by[:-1], by[-1], [*feats, target], [0.0] * (d + 1), patterns=False).collect():   # one row per group
        n, sums, xx = float(r["n"]), np.array(r["sums"]), np.zeros((d + 1, d + 1))
        xx[upper] = r["products"]
        mean = sums / n
        co = xx + np.triu(xx, 1).T - n * np.outer(mean, mean)
        out.append((tuple(r[k] for k in by), Moments(n, mean[:d], co[:d, :d], mean[d:], co[:d, d:], np.diag(co)[d:])))
    return out


@dataclass
class Moments:
    n: float
    mu: np.ndarray
    C: np.ndarray      # centered X'X
    ybar: np.ndarray   # per target
    cxy: np.ndarray    # centered X'y, d x t
    syy: np.ndarray    # centered y'y per target


def moments_from_row(row, d: int, t: int) -> Moments:
    n = float(row["n"])
    sx = np.array([row[f"sx_{i}"] or 0.0 for i in range(d)])
    xx = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            xx[i, j] = xx[j, i] = row[f"sxx_{i}_{j}"] or 0.0
    mu = sx / n
    C = xx - n * np.outer(mu, mu)
    sy = np.array([row[f"sy_{k}"] or 0.0 for k in range(t)])
    ybar = sy / n
    sxy = np.array([[row[f"sxy_{i}_{k}"] or 0.0 for k in range(t)] for i in range(d)]).reshape(d, t)
    cxy = sxy - n * np.outer(mu, ybar)
    syy = np.array([(row[f"syy_{k}"] or 0.0) - n * ybar[k] ** 2 for k in range(t)])
    return Moments(n, mu, C, ybar, cxy, syy)


def scaled(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ML2: population std (zero -> 1); returns (sd, Z'Z, Z'y) of the
    standardised, centered design."""
    var = np.clip(np.diag(m.C) / m.n, 0.0, None)
    sd = np.sqrt(var)
    sd[sd == 0] = 1.0
    ZZ = m.C / np.outer(sd, sd)
    Zy = m.cxy / sd[:, None]
    return sd, ZZ, Zy


# ML3 / CV3 -----------------------------------------------------------------------
def ridge_solve(m: Moments, alpha: float, target: int = 0, standardize: bool = True) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Exact ridge on (standardised) features with intercept.

    Returns (coef on standardised scale, intercept, mu, sd)."""
    d = len(m.mu)
    if standardize:
        sd, A, b = scaled(m)
    else:
        sd, A, b = np.ones(d), m.C, m.cxy
    beta = np.linalg.solve(A + alpha * np.eye(d), b[:, target]) if d else np.zeros(0)
    return beta, float(m.ybar[target]), m.mu, sd


COEF_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("alpha", T.DoubleType()),
    T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
    T.StructField("mu", T.ArrayType(T.DoubleType())), T.StructField("sd", T.ArrayType(T.DoubleType())),
    T.StructField("cov", T.ArrayType(T.DoubleType())), T.StructField("noise_var", T.DoubleType()),
])


def fit_linear(train: DataFrame, by: Sequence[str], feats: Sequence[str], target: str,
               alphas: Sequence[float] = (1.0,), model: str = "ridge",
               solver: Callable | None = None) -> DataFrame:
    """Fit one linear model per group (and per alpha) from Gram statistics.

    Returns a coefficient table ``(by..., model, alpha, intercept, coef, mu,
    sd, cov, noise_var)`` with one row per group and alpha -- bounded by
    groups x alphas, so it is safe to broadcast back for scoring."""
    spark = train.sparkSession
    rows = []
    for group, m in grouped_moments(train, by, feats, target):
        for a in alphas:
            if solver is None:
                beta, b0, mu, sd = ridge_solve(m, a)
                cov, nv = None, None
            else:
                beta, b0, mu, sd, cov, nv = solver(m, a)
            rows.append(group + (model, float(a), b0, beta.tolist(), mu.tolist(), sd.tolist(), cov, nv))
    key_fields = [train.schema[k] for k in by]
    schema = T.StructType(key_fields + COEF_SCHEMA.fields)
    return spark.createDataFrame(rows, schema)


def linear_predict(df: DataFrame, coefs: DataFrame, by: Sequence[str], feats: Sequence[str],
                   name: str = "pred", std_name: str | None = None) -> DataFrame:
    """Score rows with their group's coefficients (broadcast join of the
    bounded coefficient table; the prediction is a codegen expression)."""
    j = df.join(F.broadcast(coefs), list(by), "inner")
    z = [(F.col(f) - F.col("mu")[i]) / F.col("sd")[i] for i, f in enumerate(feats)]
    pred = F.col("intercept")
    for i, zi in enumerate(z):
        pred = pred + F.col("coef")[i] * zi
    out = j.withColumn(name, pred)
    if std_name:
        # z' S z as plain arithmetic (codegen), using the symmetry of S
        d = len(feats)
        out = out.withColumns({f"_z{i}": zi for i, zi in enumerate(z)})
        quad = F.lit(0.0)
        for a in range(d):
            row = F.col("cov")[a * d + a] * F.col(f"_z{a}")
            for b in range(a + 1, d):
                row = row + F.lit(2.0) * F.col("cov")[a * d + b] * F.col(f"_z{b}")
            quad = quad + F.col(f"_z{a}") * row
        out = out.withColumn(std_name, F.sqrt(F.col("noise_var") + quad)).drop(*[f"_z{i}" for i in range(d)])
    return out.drop("model", "alpha", "intercept", "coef", "mu", "sd", "cov", "noise_var")


# ML6 -------------------------------------------------------------------------
def bayesian_ridge_solver(max_iter: int = 300, tol: float = 1e-3, a1: float = 1e-6, a2: float = 1e-6,
                          l1: float = 1e-6, l2: float = 1e-6):
    """Evidence-maximisation Bayesian ridge on the standardised Gram.

    Returns a solver for :func:`fit_linear` that also yields the posterior
    covariance and noise variance for the predictive std
    ``sqrt(1/alpha + z' S z)``."""
    def solve(m: Moments, _alpha_unused: float):
        sd, ZZ, Zy = scaled(m)
        y = Zy[:, 0]
        n = m.n
        eig, V = np.linalg.eigh(ZZ)
        eig = np.clip(eig, 0.0, None)
        Vy = V.T @ y
        var_y = m.syy[0] / n
        alpha = 1.0 / (var_y + np.finfo(float).eps)
        lam = 1.0
        coef_old = None
        for _ in range(max_iter):
            coef = V @ (Vy / (eig + lam / alpha))
            sse = m.syy[0] - 2 * coef @ y + coef @ ZZ @ coef
            gamma = np.sum(alpha * eig / (lam + alpha * eig))
            lam = (gamma + 2 * l1) / (np.sum(coef ** 2) + 2 * l2)
            alpha = (n - gamma + 2 * a1) / (sse + 2 * a2)
            if coef_old is not None and np.sum(np.abs(coef_old - coef)) < tol:
                break
            coef_old = coef
        coef = V @ (Vy / (eig + lam / alpha))
        S = V @ np.diag(1.0 / (alpha * eig + lam)) @ V.T
        return coef, float(m.ybar[0]), m.mu, sd, S.flatten().tolist(), float(1.0 / alpha)
    return solve


# ML15 ------------------------------------------------------------------------
def fit_components(train: DataFrame, by: Sequence[str], feats: Sequence[str], components: Sequence[str],
                   alpha: float = 1.0) -> DataFrame:
    """One ridge per component from a single Gram pass (several right-hand
    sides); weights are applied at prediction time."""
    spark = train.sparkSession
    stats = gram_stats(train, by, feats, components).collect()
    rows = []
    for r in stats:
        m = moments_from_row(r, len(feats), len(components))
        for t, comp in enumerate(components):
            beta, b0, mu, sd = ridge_solve(m, alpha, target=t)
            rows.append(tuple(r[k] for k in by) + (comp, float(alpha), b0, beta.tolist(), mu.tolist(),
                                                  sd.tolist(), None, None))
    schema = T.StructType([train.schema[k] for k in by] + COEF_SCHEMA.fields)
    return spark.createDataFrame(rows, schema)


def predict_components(df: DataFrame, coefs: DataFrame, by: Sequence[str], feats: Sequence[str],
                       weights: Column | dict, key: Sequence[str], name: str = "pred") -> DataFrame:
    """Weighted sum of component predictions; ``weights`` maps component ->
    weight (or a Column over ``model``, e.g. per segment)."""
    long = linear_predict(df.select(*key, *by, *feats), coefs.withColumn("component", F.col("model")),
                          by, feats, "_cp")
    if isinstance(weights, dict):
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]),
                                    F.col("component")), F.lit(0.0))
    else:
        w = weights
    return long.groupBy(*key, *by).agg(F.sum(F.col("_cp") * w).alias(name))


# ML16 ------------------------------------------------------------------------
def pairwise_products(df: DataFrame, feats: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Products of every feature pair (no squares)."""
    names = []
    cols = {}
    for i in range(len(feats)):
        for j in range(i + 1, len(feats)):
            n = f"{feats[i]}__x__{feats[j]}"
            cols[n] = F.col(feats[i]) * F.col(feats[j])
            names.append(n)
    return df.withColumns(cols), list(feats) + names


# ML8 - ML11 baselines ---------------------------------------------------------
def rolling_baseline(df: DataFrame, rolling: str, train_mean: Column, name: str = "pred") -> DataFrame:
    """ML8: the rolling-mean feature, else the training mean."""
    return df.withColumn(name, F.coalesce(F.col(rolling), train_mean))


def venue_mean_baseline(train: DataFrame, df: DataFrame, by: Sequence[str], is_home: str, target: str,
                        name: str = "pred") -> DataFrame:
    """ML9: training mean per (group, venue); unseen venue -> group mean."""
    m = train.groupBy(*by, is_home).agg(F.avg(target).alias("_vm"))
    g = train.groupBy(*by).agg(F.avg(target).alias("_gm"))
    out = df.join(F.broadcast(m), list(by) + [is_home], "left").join(F.broadcast(g), list(by), "left")
    return out.withColumn(name, F.coalesce("_vm", "_gm")).drop("_vm", "_gm")


def difficulty_baseline(train: DataFrame, df: DataFrame, by: Sequence[str], rank: str, rolling: str,
                        target: str, name: str = "pred") -> DataFrame:
    """ML10: bin multiplier = mean(target) / mean(rolling, null as 0) per
    difficulty bin (1 when not positive); prediction = rolling x multiplier."""
    from stepwise.functions.scalars import rank_bin
    tb = train.withColumn("_bin", rank_bin(F.col(rank)))
    mult = tb.groupBy(*by, "_bin").agg((F.avg(target) / F.nullif(F.avg(F.coalesce(F.col(rolling), F.lit(0.0))),
                                                                  F.lit(0.0))).alias("_m"))
    mult = mult.withColumn("_m", F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0)))
    out = df.withColumn("_bin", rank_bin(F.col(rank))).join(F.broadcast(mult), list(by) + ["_bin"], "left")
    return out.withColumn(name, F.coalesce(F.col(rolling), F.lit(0.0)) * F.coalesce(F.col("_m"), F.lit(1.0))) \
              .drop("_bin", "_m")


def cold_start_baseline(df: DataFrame, prior_mean: str, rolling: str, global_mean: Column, step_is_first: Column,
                        name: str = "pred") -> DataFrame:
    """ML11: first step -> prior-epoch mean; else rolling; else global mean."""
    first = F.coalesce(F.col(prior_mean), F.col(rolling), global_mean)
    later = F.coalesce(F.col(rolling), global_mean)
    return df.withColumn(name, F.when(step_is_first, first).otherwise(later))


# ML4 / ML5 / ML7 / ML12 / ML13 / ML14 (Spark ML) --------------------------------
def _assemble(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="keep").transform(df)


def elastic_net_params(alpha: float, l1_ratio: float, y_std: float) -> tuple[float, float]:
    """Map an (alpha, l1_ratio) objective with unscaled target to Spark's
    (regParam, elasticNetParam), which scale the L2 part by the target std."""
    l1 = alpha * l1_ratio
    l2 = alpha * (1 - l1_ratio) * y_std
    reg = l1 + l2
    return reg, (l1 / reg if reg else 0.0)


def spark_ml_fit(train: DataFrame, feats: Sequence[str], target: str, kind: str, **params):
    """Fit a Spark ML regressor on assembled features.

    kind: ``lasso``, ``elasticnet``, ``poisson``, ``forest``, ``gbt``, ``logistic``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import (GBTRegressor, GeneralizedLinearRegression, LinearRegression,
                                       RandomForestRegressor)
    d = _assemble(train, feats)
    if kind == "lasso":
        est = LinearRegression(labelCol=target, regParam=params.get("alpha", 1.0), elasticNetParam=1.0,
                               standardization=False)
    elif kind == "elasticnet":
        y_std = d.agg(F.stddev_pop(target)).first()[0] or 1.0
        reg, enp = elastic_net_params(params.get("alpha", 0.5), params.get("l1_ratio", 0.5), y_std)
        est = LinearRegression(labelCol=target, regParam=reg, elasticNetParam=enp, standardization=False)
    elif kind == "poisson":
        est = GeneralizedLinearRegression(labelCol=target, family="poisson", link="log",
                                          regParam=params.get("alpha", 1e-4), maxIter=params.get("max_iter", 100))
    elif kind == "forest":
        est = RandomForestRegressor(labelCol=target, numTrees=params.get("trees", 200),
                                    maxDepth=params.get("depth", 8), seed=params.get("seed", 42))
    elif kind == "gbt":
        est = GBTRegressor(labelCol=target, maxIter=params.get("trees", 100), maxDepth=params.get("depth", 4),
                           stepSize=params.get("lr", 0.1), seed=params.get("seed", 42))
    elif kind == "logistic":
        n = params["n"]
        est = LogisticRegression(labelCol=target, regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    else:
        raise ValueError(kind)
    return est.fit(d)


def spark_ml_predict(model, df: DataFrame, feats: Sequence[str], name: str = "pred",
                     prob: bool = False) -> DataFrame:
    out = model.transform(_assemble(df, feats))
    if prob:
        from pyspark.ml.functions import vector_to_array
        out = out.withColumn(name, vector_to_array("probability")[1])
        return out.drop("features", "probability", "rawPrediction", "prediction")
    return out.withColumnRenamed("prediction", name).drop("features")


def poisson_shift(train: DataFrame, target: str) -> float:
    """ML7 target shift ``max(0, 1 - min(y))`` (one scalar aggregate)."""
    mn = train.agg(F.min(target)).first()[0]
    return max(0.0, 1.0 - (mn or 0.0))


# ML17 ------------------------------------------------------------------------
def average_ensemble(oof_wide: DataFrame, pred_cols: Sequence[str], name: str = "pred_average") -> DataFrame:
    """Null-skipping row mean of the prediction columns (ML17 average, ML20)."""
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in pred_cols), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in pred_cols), F.lit(0))
    return oof_wide.withColumn(name, s / F.nullif(n, F.lit(0)))


# ML18 ------------------------------------------------------------------------
def padded_sequences(df: DataFrame, group: Sequence[str], order: Sequence[str], feats: Sequence[str],
                     length: int) -> DataFrame:
    """Ordered feature sequences per group cut into consecutive blocks of
    ``length`` rows, each padded with zeros and a boolean mask.

    A long group yields several blocks (nothing is dropped), and positions come
    from prefix counts over ranges, so no row and no task holds a whole group.
    """
    d = prefix(df, group, order, name="_pos")
    d = d.withColumn("block", (F.col("_pos") / length).cast("int"))
    g = d.groupBy(*group, "block").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_pos"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0))
                                                                     for f in feats]).alias("x")))).alias("_s"))
    n = F.size("_s")
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), len(feats)), F.lit(length) - n)
    return g.select(*group, "block",
                    F.concat(F.transform("_s", lambda s: s["x"]), pad).alias("seq"),
                    F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(length) - n)).alias("mask"),
                    n.alias("n_steps"))


# UDX1 ------------------------------------------------------------------------
@dataclass
class ModelSpec:
    name: str
    family: str
    tier: str
    fit: Callable
    predict: Callable
    requires_imputation: bool = True
    requires_scaling: bool = False
    deps: tuple[str, ...] = field(default_factory=tuple)


class Registry:
    """Models by name; anything with ``name``, ``family`` and ``deps`` can be registered."""

    def __init__(self):
        self._specs: dict = {}

    def register(self, spec):
        if spec.name in self._specs:
            raise ValueError(f"model {spec.name} is registered already")
        self._specs[spec.name] = spec
        return spec

    def get(self, name: str):
        return self._specs[name]

    def by_family(self, family: str) -> list:
        return [s for s in self._specs.values() if s.family == family]

    def order(self, names: Sequence[str]) -> tuple[list, dict[str, str]]:
        """Models to run, dependencies first, and the skipped ones with the reason.

        A ring of dependencies is an error that names the ring."""
        runs: dict[str, bool] = {}     # name: whether it can run
        skipped: dict[str, str] = {}
        out: list = []
        for start in names:
            path: list[str] = []
            stack = [(start, False)]
            while stack:
                name, leaving = stack.pop()
                if leaving:
                    path.pop()
                    lacking = [d for d in self._specs[name].deps if not runs[d]]
                    runs[name] = not lacking
                    if lacking:
                        skipped[name] = "needs " + ", ".join(lacking)
                    else:
                        out.append(self._specs[name])
                elif name in path:
                    raise ValueError("models depend on each other: " + " -> ".join([*path[path.index(name):], name]))
                elif name not in self._specs:
                    runs[name] = False
                    skipped[name] = "not registered"
                elif name not in runs:
                    path.append(name)
                    stack.append((name, True))
                    stack += [(d, False) for d in reversed(self._specs[name].deps)]
        return out, skipped

    def resolve(self, names: Sequence[str]) -> list:
        """Models in dependency order (dependencies first); an unknown name is an error."""
        out, skipped = self.order(names)
        if skipped:
            raise KeyError(", ".join(f"{k}: {v}" for k, v in skipped.items()))
        return out
