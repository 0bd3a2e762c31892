"""The model graph and its runner (UDX1, CV2, ML17).

Models are registered with what they depend on.  A run orders the wanted
models so that each follows its dependencies, refuses rings, skips models
whose dependencies are unknown (and those that depend on them), and adds one
prediction column per model to the validation rows.  Base models see the
folds; meta models see the columns of their dependencies, which are written
before them, and learn from the folds before their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators import models as M
from stepwise.operators.moments import EpochMoments
from stepwise.plans import folds as FD
from stepwise.session import write_and_reload


@dataclass(frozen=True)
class Model:
    """``build(data, frame)`` returns ``frame`` with the column ``pred_<name>``.  A base model that is linear in the
    features may give ``fits(data)``, (fits, name, std_name) as :func:`folds.predict_all` takes them, in its place."""

    name: str
    family: str
    tier: str                      # base or meta
    build: Callable[[FD.Folds, DataFrame], DataFrame]
    deps: tuple[str, ...] = ()
    fits: Callable[[FD.Folds], tuple] | None = None


class Graph(M.Registry):
    """Registered models by name."""

    def __init__(self, models: Sequence[Model] = ()):
        super().__init__()
        for m in models:
            self.register(m)


@dataclass
class Run:
    """Validation rows with a column per model that ran, and what was skipped."""

    data: FD.Folds
    frame: DataFrame
    ran: list[Model]
    skipped: dict[str, str] = field(default_factory=dict)

    def preds(self) -> list[str]:
        return [f"pred_{m.name}" for m in self.ran]

    def metrics(self) -> DataFrame:
        return FD.fold_metrics(self.data, self.frame, self.preds())


def run(graph: Graph, data: FD.Folds, names: Sequence[str]) -> Run:
    """Run the wanted models and all they depend on.  A table is written whenever a meta
    model needs columns that are not written yet: once per layer of the graph.  Linear models
    read the rows together."""
    order, skipped = graph.order(names)
    frame, written = data.validation(), set()
    together = [m.fits(data) for m in order if m.fits]
    if together:
        frame = FD.predict_all(frame, together, data.feats)
    for m in order:
        if m.fits:
            continue
        if m.tier == "meta" and not set(m.deps) <= written:
            frame = write_and_reload(frame, "oof")
            written = {c.removeprefix("pred_") for c in frame.columns}
        frame = m.build(data, frame)
    return Run(data, write_and_reload(frame, "oof"), order, skipped)


# base models -------------------------------------------------------------------
def _linear_fits(name: str, solver: FD.Solver, std: bool, data: FD.Folds) -> tuple:
    return data.fit(solver), f"pred_{name}", f"pred_std_{name}" if std else None


def _linear(name: str, solver: FD.Solver, std: bool, data: FD.Folds, frame: DataFrame) -> DataFrame:
    return FD.predict_all(frame, [_linear_fits(name, solver, std, data)], data.feats)


def linear(name: str, solver: FD.Solver, family: str = "linear", std: bool = False) -> Model:
    """ML3-ML6: solved from the folds' moments; ``std`` adds the predictive deviation."""
    return Model(name, family, "base", partial(_linear, name, solver, std), fits=partial(_linear_fits, name, solver, std))


def _means(by: Sequence[str], data: FD.Folds) -> DataFrame:
    """Training mean of the target per (segment, by..., fold), from moments of one column."""
    em = EpochMoments.of(data.rows, ["segment", *by], "epoch", [data.target])
    rows = [(*g, f, float(got[2][0])) for g in em.groups for f, e in data.val.items() if (got := em.run(g, hi=e))]
    schema = ", ".join(f"`{c}` {data.rows.schema[c].dataType.simpleString()}" for c in ("segment", *by))
    return data.rows.sparkSession.createDataFrame(rows, f"{schema}, fold int, _mean double")


def _rolling(feature: str, data: FD.Folds, frame: DataFrame) -> DataFrame:
    out = frame.join(F.broadcast(_means([], data)), ["segment", "fold"], "left")
    return out.withColumn("pred_rolling", F.coalesce(F.col(feature), F.col("_mean"))).drop("_mean")


def rolling(feature: str) -> Model:
    """ML8: the rolling feature, else the fold's training mean."""
    return Model("rolling", "baseline", "base", partial(_rolling, feature))


def _venue(data: FD.Folds, frame: DataFrame) -> DataFrame:
    out = (frame.join(F.broadcast(_means(["is_home"], data)), ["segment", "is_home", "fold"], "left").withColumnRenamed("_mean", "_venue")
           .join(F.broadcast(_means([], data)), ["segment", "fold"], "left"))
    return out.withColumn("pred_venue_mean", F.coalesce("_venue", "_mean")).drop("_venue", "_mean")


def venue_mean() -> Model:
    """ML9: the fold's training mean at home or away, else the segment's."""
    return Model("venue_mean", "baseline", "base", _venue)


def _joined(name: str, oof: DataFrame, frame: DataFrame) -> DataFrame:
    return frame.join(oof.select(*FD.KEYS, "fold", F.col("pred").alias(f"pred_{name}")), [*FD.KEYS, "fold"], "left")


def _fitted(name: str, kind: str, long: Callable[[], DataFrame], params: dict, data: FD.Folds, frame: DataFrame) -> DataFrame:
    from stepwise.plans import cv
    return _joined(name, cv.spark_learner_oof(long(), data.feats, data.target, kind, **params), frame)


def fitted(name: str, kind: str, long: Callable[[], DataFrame], family: str = "learner", **params) -> Model:
    """A Spark ML learner per (segment, fold) on the rows of :func:`cv.prepare_folds`."""
    return Model(name, family, "base", partial(_fitted, name, kind, long, params))


def _poisson(name: str, params: dict, data: FD.Folds, frame: DataFrame) -> DataFrame:
    from stepwise.plans import cv
    return _joined(name, cv.poisson_oof(data, **params), frame)


def poisson(name: str = "poisson", **params) -> Model:
    """ML7: Poisson regression, all segments and folds fitted together."""
    return Model(name, "glm", "base", partial(_poisson, name, params))


# meta models -------------------------------------------------------------------
def _average(name: str, deps: Sequence[str], data: FD.Folds, frame: DataFrame) -> DataFrame:
    return M.average_ensemble(frame, [f"pred_{d}" for d in deps], f"pred_{name}")


def average(name: str, deps: Sequence[str]) -> Model:
    """ML17: mean of the predictions there are."""
    return Model(name, "ensemble", "meta", partial(_average, name, tuple(deps)), tuple(deps))


def _learned(name: str, deps: Sequence[str], solver: FD.Solver, least: int, data: FD.Folds, frame: DataFrame) -> DataFrame:
    cols = [f"pred_{d}" for d in deps]
    em = EpochMoments.of(frame.where(F.col(data.target).isNotNull()), ["segment"], "fold", [*cols, data.target])
    fits = []
    for g in em.groups:
        for f in em.epochs[g]:
            if sum(e < f for e in em.epochs[g]) >= least:
                m, fill = em.fold(g, cols, [data.target], hi=f)
                beta = solver(m)[0]
                sd = M.scaled(m)[0]
                fits.append((g[0], f, (beta / sd).tolist(), float(m.ybar[0] - m.mu @ (beta / sd)), fill.tolist(), m.mu.tolist(), sd.tolist(), None, None))
    out = M.average_ensemble(FD.predict(frame, fits, cols, "_meta"), cols, "_plain")
    return out.withColumn(f"pred_{name}", F.coalesce("_meta", "_plain")).drop("_meta", "_plain")


def learned(name: str, deps: Sequence[str], solver: FD.Solver, least: int = 2) -> Model:
    """ML17: a linear model of the dependencies' predictions on the folds before, solved from
    one table of moments for all folds; with fewer than ``least`` folds before, the average."""
    return Model(name, "ensemble", "meta", partial(_learned, name, tuple(deps), solver, least), tuple(deps))


def stacking(deps: Sequence[str], alpha: float = 0.5) -> Model:
    return learned("stacking", deps, FD.ridge(alpha))


def blending(deps: Sequence[str], alpha: float = 0.5, l1_ratio: float = 0.5) -> Model:
    return learned("blending", deps, FD.enet(alpha, l1_ratio))
