"""Cross-validation of linear models on moments (CV1-CV3, ML1-ML6, ML15-ML17, ML19).

The feature matrix is aggregated once to moments per (segment, epoch)
(:mod:`stepwise.operators.moments`).  A fold's training set is a run of
epochs, so its moments are the difference of two prefix rows, and the rows of
an epoch are read again only to be predicted, by the one fold they validate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.operators import models as M
from stepwise.operators import stats as ST
from stepwise.operators.moments import EpochMoments, elastic_net, independent_columns

KEYS = ["segment", "epoch", "step", "fixture", "entity"]
CONTEXT = [*KEYS, "is_home", "opp_rank"]

#: (beta on the standardised scale, posterior covariance or None, noise variance or None)
Solver = Callable[[M.Moments], tuple[np.ndarray, np.ndarray | None, float | None]]


def ridge(alpha: float) -> Solver:
    return lambda m: (M.ridge_solve(m, alpha)[0], None, None)


def enet(alpha: float, l1_ratio: float) -> Solver:
    def solve(m: M.Moments):
        _, zz, zy = M.scaled(m)
        return elastic_net(zz, zy[:, 0], m.n, alpha, l1_ratio), None, None
    return solve


def bayesian() -> Solver:
    inner = M.bayesian_ridge_solver()

    def solve(m: M.Moments):
        beta, _, _, _, cov, noise = inner(m, 0.0)
        return beta, np.array(cov), noise
    return solve


@dataclass
class Folds:
    """Rows with their moments and folds: fold f trains on the epochs before ``val`` of it."""

    rows: DataFrame
    feats: Sequence[str]
    target: str
    n_folds: int = 3
    #: features of a segment, where they are not all of ``feats``
    lists: dict[str, Sequence[str]] = field(default_factory=dict)
    #: further columns whose moments are wanted (component targets)
    more: Sequence[str] = ()

    def __post_init__(self):
        known = self.rows.where(F.col(self.target).isNotNull())
        self.moments = EpochMoments.of(known, ["segment"], "epoch", [*self.feats, self.target, *self.more])
        self.epochs = sorted({e for es in self.moments.epochs.values() for e in es})
        last = self.epochs[1:][-self.n_folds:]  # the first epoch has nothing before it to train on
        self.val = {self.n_folds - len(last) + i + 1: e for i, e in enumerate(last)}

    def feats_of(self, segment: str) -> list[str]:
        return list(self.lists.get(segment, self.feats))

    def fold_number(self) -> Column:
        out = F.lit(None).cast("int")
        for f, e in self.val.items():
            out = F.when(F.col("epoch") == F.lit(e), F.lit(f)).otherwise(out)
        return out

    def validation(self, *extra: str) -> DataFrame:
        """Rows of the validation epochs with their fold; an epoch serves one fold."""
        have = [c for c in dict.fromkeys([*CONTEXT, self.target, *self.feats, *extra]) if c in self.rows.columns]
        return self.rows.where(F.col("epoch").isin(list(self.val.values()))).select(*have).withColumn("fold", self.fold_number())

    def train_sizes(self) -> DataFrame:
        """Rows (segment, fold, train_rows), read off the moments."""
        out = [(g[0], f, int(got[0])) for g in self.moments.groups for f, e in self.val.items() if (got := self.moments.run(g, hi=e))]
        return self.rows.sparkSession.createDataFrame(out, "segment string, fold int, train_rows long")

    def fit(self, solver: Solver, target: str | None = None, independent: bool = True) -> list[tuple]:
        """(segment, fold, weights, offset, fill, mu, sd, cov, noise) per segment and fold.

        Weights are on the raw scale and run over ``feats``; features a segment does not
        use, or that are combinations of its others (``independent``), weigh 0."""
        out = []
        for g in self.moments.groups:
            for f, e in self.val.items():
                use = self.feats_of(g[0])
                got = self.moments.fold(g, use, [target or self.target], hi=e)
                if got is None:
                    continue
                m, fill = got
                keep = list(range(len(use)))
                if independent:
                    keep, _ = independent_columns(m.C)
                    m = M.Moments(m.n, m.mu[keep], m.C[np.ix_(keep, keep)], m.ybar, m.cxy[keep], m.syy)
                beta, cov, noise = solver(m)
                sd = M.scaled(m)[0]
                at = [list(self.feats).index(use[i]) for i in keep]
                full = {k: np.zeros(len(self.feats)) for k in ("w", "fill", "mu")} | {"sd": np.ones(len(self.feats))}
                full["w"][at], full["mu"][at], full["sd"][at] = beta / sd, m.mu, sd
                full["fill"][[list(self.feats).index(c) for c in use]] = fill
                wide = None
                if cov is not None:
                    wide = np.zeros((len(self.feats),) * 2)
                    wide[np.ix_(at, at)] = np.reshape(cov, (len(at),) * 2)
                out.append((g[0], f, full["w"].tolist(), float(m.ybar[0] - m.mu @ (beta / sd)), full["fill"].tolist(), full["mu"].tolist(), full["sd"].tolist(),
                            None if wide is None else wide.ravel().tolist(), None if noise is None else float(noise)))
        return out


def predict(frame: DataFrame, fits: list[tuple], feats: Sequence[str], name: str, std_name: str | None = None) -> DataFrame:
    """Add a linear model's prediction to rows that have (segment, fold), null without a fit, and its predictive
    deviation ``sqrt(noise + z' S z)`` where ``std_name`` asks for it."""
    return predict_all(frame, [(fits, name, std_name)], feats)


def predict_all(frame: DataFrame, models: Sequence[tuple[list[tuple], str, str | None]], feats: Sequence[str]) -> DataFrame:
    """Add the predictions of linear models (fits, name, std_name) as :func:`predict` does, reading the rows once.

    The fits are one row per segment and fold, which the moments bound, so a task gets them all.  It multiplies
    matrices: as columns, some tens of terms make a method that the JVM only interprets."""
    d, at = len(feats), [frame.columns.index(c) for c in ("segment", "fold", *feats)]
    known = [{(seg, f): (np.array(w, float), b, np.array(fill, float), np.array(mu, float), np.array(sd, float), None if cov is None else np.reshape(cov, (d, d)), noise)
              for seg, f, w, b, fill, mu, sd, cov, noise in fits if seg is not None} for fits, _, _ in models]
    added = [c for _, name, std_name in models for c in ([name, std_name] if std_name else [name])]
    stds = [bool(std_name) for _, _, std_name in models]

    def add(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            code, names = np.zeros(batch.num_rows, np.int64), [()]
            for i in at[:2]:
                e = batch.column(i).dictionary_encode(null_encoding="encode")
                code = code * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False)
                names = [(*n, v) for n in names for v in e.dictionary.to_pylist()]
            x, gone = np.empty((batch.num_rows, d)), np.zeros((batch.num_rows, d), bool)
            for i in range(d):
                c = batch.column(at[2 + i]).cast(pa.float64(), safe=False)
                gone[:, i] = c.is_null().to_numpy(zero_copy_only=False)
                x[:, i] = c.fill_null(0.0).to_numpy(zero_copy_only=False)
            out, null = np.zeros((len(added), batch.num_rows)), np.ones((len(added), batch.num_rows), bool)
            for k in np.unique(code):
                idx, line = np.flatnonzero(code == k), 0
                own, own_gone = x[idx], gone[idx]
                for fits, std in zip(known, stds):
                    if names[k] in fits:
                        w, b, fill, mu, sd, cov, noise = fits[names[k]]
                        v = np.where(own_gone, fill, own)
                        out[line, idx], null[line, idx] = b + v @ w, False
                        if std and cov is not None and noise is not None:
                            z = (v - mu) / sd
                            out[line + 1, idx], null[line + 1, idx] = np.sqrt(noise + ((z @ cov) * z).sum(1)), False
                    line += 1 + std
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(o, mask=m) for o, m in zip(out, null)]], names=[*batch.schema.names, *added])
    return frame.mapInArrow(add, T.StructType([*frame.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]]))


# CV3 -------------------------------------------------------------------------
def ridge_alpha_grid(data: Folds, alphas: Sequence[float]) -> DataFrame:
    """Mean fold MAE per (segment, alpha) and the best alpha of each segment (ties: the smallest).

    All alphas are solved from the fold's moments and predicted in one pass over the
    validation rows, as columns; rows without a target are left out."""
    both: dict[tuple, list] = {}
    for alpha in alphas:
        for seg, f, w, offset, fill, *_ in data.fit(ridge(alpha)):
            row = both.setdefault((seg, f), [fill, [], []])
            row[1] += w
            row[2].append(offset)
    kind = data.rows.schema["segment"].dataType.simpleString()
    table = data.rows.sparkSession.createDataFrame([(*k, *v) for k, v in both.items()],
                                                   f"segment {kind}, fold int, _fill array<double>, _w array<double>, _offset array<double>")
    rows = data.validation().where(F.col(data.target).isNotNull()).join(F.broadcast(table), ["segment", "fold"])   # one row per segment and fold
    d = len(data.feats)
    rows = rows.select("segment", "fold", data.target, "_w", "_offset", *[F.coalesce(F.col(c).cast("double"), F.col("_fill")[i]).alias(f"_x{i}")
                                                                       for i, c in enumerate(data.feats)])
    preds = []
    for i in range(len(alphas)):
        pred = F.col("_offset")[i]
        for j in range(d):
            pred = pred + F.col("_w")[i * d + j] * F.col(f"_x{j}")
        preds.append(pred)
    per_fold = rows.groupBy("segment", "fold").agg(*[F.avg(F.abs(p - F.col(data.target))).alias(f"_m{i}") for i, p in enumerate(preds)])
    grid = per_fold.select("segment", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_m{i}").alias("mae")) for i, a in enumerate(alphas)]))
                           .alias("g")).groupBy("segment", F.col("g.alpha").alias("alpha")).agg(F.avg("g.mae").alias("mean_mae"))
    # one row per alpha in a segment
    best = F.min_by("alpha", F.struct("mean_mae", "alpha")).over(Window.partitionBy("segment"))
    return grid.withColumn("best_alpha", best).withColumn("is_best", F.col("alpha") == F.col("best_alpha"))


# ML3 -------------------------------------------------------------------------
def dependent_columns(data: Folds, hi=None) -> DataFrame:
    """Rows (segment, dropped, kept): per segment, the features that are combinations of
    the kept ones over the epochs before ``hi`` (all where None)."""
    out = []
    for g in data.moments.groups:
        use = data.feats_of(g[0])
        got = data.moments.fold(g, use, [data.target], hi=hi)
        if got is not None:
            keep, drop = independent_columns(got[0].C)
            out += [(g[0], use[i], ",".join(use[k] for k in keep)) for i in drop]
    return data.rows.sparkSession.createDataFrame(out, "segment string, dropped string, kept string")


# ML19 ------------------------------------------------------------------------
def full_fit(data: Folds, alpha: float) -> DataFrame:
    """Rows (segment, features, w, offset, fill, epochs, rows, alpha): one ridge per segment on every epoch."""
    out = []
    for g in data.moments.groups:
        use = data.feats_of(g[0])
        m, fill = data.moments.fold(g, use, [data.target])
        keep, _ = independent_columns(m.C)
        small = M.Moments(m.n, m.mu[keep], m.C[np.ix_(keep, keep)], m.ybar, m.cxy[keep], m.syy)
        w = ridge(alpha)(small)[0] / M.scaled(small)[0]
        out.append((g[0], [use[i] for i in keep], w.tolist(), float(m.ybar[0] - small.mu @ w), fill[keep].tolist(), [str(e) for e in data.moments.epochs[g]],
                    int(m.n), float(alpha)))
    return data.rows.sparkSession.createDataFrame(
        out, f"segment {data.rows.schema['segment'].dataType.simpleString()}, features array<string>, w array<double>, offset double, fill array<double>, "
             "epochs array<string>, rows long, alpha double")


def score(rows: DataFrame, fitted: DataFrame, feats: Sequence[str], name: str) -> DataFrame:
    """Add the prediction of models as :func:`full_fit` gives them; rows of a segment without a model get null."""
    names = F.array(*[F.lit(c) for c in feats])
    values = F.array(*[F.col(c).cast("double") for c in feats])
    out = rows.join(F.broadcast(fitted.select("segment", F.col("features").alias("_f"), F.col("w").alias("_w"), F.col("offset").alias("_b"),
                                              F.col("fill").alias("_l"))), "segment", "left")
    terms = F.transform(F.sequence(F.lit(0), F.size("_f") - 1), lambda i: F.col("_w")[i] * F.coalesce(
        F.element_at(values, F.array_position(names, F.col("_f")[i]).cast("int")), F.col("_l")[i]))
    return out.withColumn(name, F.aggregate(terms, F.col("_b"), lambda a, x: a + x)).drop("_f", "_w", "_b", "_l")


# ML15 ------------------------------------------------------------------------
def components(data: Folds, targets: Sequence[str], weights: dict[str, dict[str, float]], default: dict[str, float], alpha: float = 1.0) -> DataFrame:
    """Validation rows with ``pred``: per segment a weighted sum of one ridge per component.

    ``weights`` maps segment -> component -> weight, ``default`` serves the others.  A sum of
    linear models is a linear model, so the components' fits are summed before the rows are read."""
    total: dict[tuple, list] = {}
    for t in targets:
        for seg, f, w, offset, fill, mu, sd, _, _ in data.fit(ridge(alpha), t):
            k = weights.get(seg, default).get(t, 0.0)
            row = total.setdefault((seg, f), [np.zeros(len(w)), 0.0, fill, mu, sd])
            row[0] = row[0] + k * np.array(w)
            row[1] += k * offset
    fits = [(seg, f, w.tolist(), b, fill, mu, sd, None, None) for (seg, f), (w, b, fill, mu, sd) in total.items()]
    return predict(data.validation(), fits, data.feats, "pred")


# ST4 / ST12 ---------------------------------------------------------------------
def fold_metrics(data: Folds, oof: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Metrics with Spearman per (model, segment, fold), next to the training rows of the fold."""
    long = oof.select("segment", "fold", data.target, F.explode(F.array(*[F.struct(F.lit(p.removeprefix("pred_")).alias("model"), F.col(p).alias("pred")) for p in preds]))
                      .alias("m")).select("segment", "fold", data.target, "m.*")
    m = ST.metrics_with_rank(long, ["model", "segment", "fold"], data.target, "pred")
    return m.join(F.broadcast(data.train_sizes()), ["segment", "fold"], "left")


__all__ = ["Folds", "predict", "predict_all", "ridge", "enet", "bayesian", "ridge_alpha_grid", "dependent_columns", "components", "fold_metrics", "KEYS", "CONTEXT"]
