"""Moments per (segment, epoch), models solved from them and the model graph, against numpy and Spark ML."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepwise.operators import models as M
from stepwise.operators import moments as MM
from stepwise.plans import folds as FD
from stepwise.plans import runner as RN

FEATS = ["a", "b", "c", "d"]


def made(seed=0, n=900, shift=1e6):
    """Two segments, five epochs, missing values; ``d`` has none in epoch 1 and no value at all in segment y's epochs 1 and 2."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=FEATS)
    pdf["a"] += shift
    pdf["segment"], pdf["epoch"] = np.where(rng.random(n) < 0.5, "x", "y"), rng.integers(1, 6, n)
    pdf["points"] = 3 * (pdf["a"] - shift) - pdf["b"] + 0.3 * pdf["c"] + rng.normal(size=n)
    for c in ("b", "c", "d"):
        pdf.loc[rng.random(n) < 0.2, c] = np.nan
    pdf.loc[pdf["epoch"] == 1, "d"] = np.nan
    pdf.loc[(pdf["segment"] == "y") & (pdf["epoch"] == 2), "d"] = np.nan
    for i, c in enumerate(("step", "fixture", "entity")):
        pdf[c] = np.arange(n) * 7 % (50 + i)
    pdf["fixture"], pdf["is_home"], pdf["opp_rank"] = np.arange(n), rng.integers(0, 2, n), 3
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, segment string, epoch int, points double, "
                                 "step int, fixture int, entity int, is_home int, opp_rank int").repartition(4)


def imputed(train, other, feats):
    """What a row-wise imputer does: epoch mean, else the training mean, else 0."""
    glob = train[feats].mean().fillna(0.0)
    by_epoch = train.groupby("epoch")[feats].transform("mean")
    return train[feats].fillna(by_epoch).fillna(glob), other[feats].fillna(glob)


def test_run_moments_equal_numpy_on_imputed_rows(spark):
    pdf = made()
    em = MM.EpochMoments.of(frame(spark, pdf), ["segment"], "epoch", [*FEATS, "points"])
    for seg in "xy":
        for lo, hi in ((None, 2), (None, 3), (None, 6), (2, 5), (3, 4), (None, None)):
            rows = pdf[(pdf.segment == seg) & (pdf.epoch >= (lo or 0)) & (pdf.epoch < (hi or 99))]
            x, _ = imputed(rows, rows, FEATS)
            x["points"] = rows["points"]
            n, fill, mean, co = em.run((seg,), lo, hi)
            assert n == len(rows)
            assert np.allclose(mean, x.mean(), rtol=1e-12, atol=1e-9)
            assert np.allclose(co, np.cov(x.to_numpy().T, ddof=0) * n, rtol=1e-7, atol=1e-6)
            assert np.allclose(fill[:4], rows[FEATS].mean().fillna(0.0))
    assert em.run(("x",), hi=1) is None and em.run(("z",)) is None


def test_too_many_moment_rows_are_refused(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        MM.EpochMoments.of(frame(spark, made()), ["segment"], "epoch", FEATS, max_rows=3)


def test_folds_equal_row_wise_ridge(spark):
    pdf = made(1)
    data = FD.Folds(frame(spark, pdf), FEATS, "points", 3)
    assert data.val == {1: 3, 2: 4, 3: 5}
    got = FD.predict(data.validation(), data.fit(FD.ridge(2.0)), FEATS, "pred").toPandas().set_index("fixture")["pred"]
    assert len(got) == (pdf.epoch >= 3).sum()
    for seg in "xy":
        for val in (3, 4, 5):
            tr, va = pdf[(pdf.segment == seg) & (pdf.epoch < val)], pdf[(pdf.segment == seg) & (pdf.epoch == val)]
            x, xv = (q.to_numpy() for q in imputed(tr, va, FEATS))
            mu, sd = x.mean(0), x.std(0)
            sd[sd < 1e-12] = 1
            z = (x - mu) / sd
            beta = np.linalg.solve(z.T @ z + 2.0 * np.eye(4), z.T @ (tr.points - tr.points.mean()))
            assert np.allclose(got[va.fixture], tr.points.mean() + (xv - mu) / sd @ beta, atol=1e-5)
    sizes = {(r.segment, r.fold): r.train_rows for r in data.train_sizes().collect()}
    assert sizes["x", 2] == ((pdf.segment == "x") & (pdf.epoch < 4)).sum()


def test_validation_rows_are_read_once(spark):
    data = FD.Folds(frame(spark, made(2)), FEATS, "points", 3)
    v = data.validation()
    assert v.count() == v.select("fixture").distinct().count()


def test_few_epochs(spark):
    pdf = made(3)
    assert FD.Folds(frame(spark, pdf[pdf.epoch <= 2]), FEATS, "points", 3).val == {3: 2}
    one = FD.Folds(frame(spark, pdf[pdf.epoch == 2]), FEATS, "points", 3)
    assert one.val == {} and one.validation().count() == 0
    none = FD.Folds(frame(spark, pdf[pdf.epoch > 9]), FEATS, "points", 3)
    assert none.validation().count() == 0 and FD.ridge_alpha_grid(none, [1.0]).count() == 0


def test_a_feature_list_per_segment(spark):
    data = FD.Folds(frame(spark, made(4)), FEATS, "points", 3, lists={"x": ["b", "a"]})
    w = {(r[0], r[1]): r[2] for r in data.fit(FD.ridge(1.0))}
    assert w["x", 3][2:] == [0.0, 0.0] and all(w["x", 3][:2]) and all(w["y", 3])


def test_planted_combinations_are_dropped_by_name(spark):
    pdf = made(5, shift=0.0)
    df = frame(spark, pdf).withColumns({"copy": F.col("b") * 3 - 2, "total": F.col("a") + F.col("c"), "flat": F.lit(4.0)})
    cols = ["a", "b", "c", "d", "copy", "total", "flat"]
    rows = FD.dependent_columns(FD.Folds(df.where("b is not null and c is not null"), cols, "points", 3)).collect()
    for seg in "xy":
        gone = {r.dropped for r in rows if r.segment == seg}
        kept = {r.kept for r in rows if r.segment == seg}
        assert len(gone) == 3 and len(kept) == 1 and "flat" in gone and gone & {"b", "copy"} and gone & {"a", "c", "total"}
        assert set(kept.pop().split(",")) == set(cols) - gone


def test_independent_columns_against_rank():
    rng = np.random.default_rng(6)
    for d, k in ((6, 3), (9, 9), (12, 5), (4, 1)):
        x = rng.normal(size=(200, k)) @ rng.normal(size=(k, d)) * rng.uniform(0.01, 100, d)
        keep, drop = MM.independent_columns(np.cov(x.T, ddof=0) * 200)
        assert len(keep) == k == np.linalg.matrix_rank(x[:, keep]) and sorted(keep + drop) == list(range(d))
    assert MM.independent_columns(np.zeros((3, 3))) == ([], [0, 1, 2])


@pytest.mark.parametrize("alpha,l1", [(0.1, 1.0), (0.5, 0.5), (0.02, 0.2)])
def test_elastic_net_equals_spark_ml(spark, alpha, l1):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5)) @ np.diag([1, 4, 0.2, 2, 1]) + 3
    y = x @ np.array([1.0, -0.5, 2.0, 0.0, 0.01]) + rng.normal(0, 0.7, 400)
    z = (x - x.mean(0)) / x.std(0)
    b = MM.elastic_net(z.T @ z, z.T @ (y - y.mean()), 400, alpha, l1)
    grad = z.T @ (y - y.mean() - z @ b) / 400 - alpha * (1 - l1) * b
    assert np.all(np.where(b != 0, np.abs(grad - alpha * l1 * np.sign(b)), np.maximum(np.abs(grad) - alpha * l1, 0)) < 1e-8)
    df = spark.createDataFrame(pd.DataFrame(z, columns=list("abcde")).assign(y=y))
    kind = "lasso" if l1 == 1.0 else "elasticnet"
    want = M.spark_ml_fit(df, list("abcde"), "y", kind, alpha=alpha, l1_ratio=l1).coefficients.toArray()
    assert np.allclose(b, want, atol=2e-3)


def test_components_sum_linear_models(spark):
    pdf = made(8, shift=0.0)
    df = frame(spark, pdf).withColumns({"u": F.coalesce("b", F.lit(0.0)) * 2, "v": F.col("a")})
    data = FD.Folds(df, FEATS, "points", 3, more=["u", "v"])
    got = FD.components(data, ["u", "v"], {"x": {"u": 1.0, "v": -2.0}}, {"v": 3.0}).toPandas().set_index("fixture")
    u, v = (FD.predict(data.validation(), data.fit(FD.ridge(1.0), t), FEATS, "p").toPandas().set_index("fixture").p for t in "uv")
    x = got.segment == "x"
    assert np.allclose(got.pred[x], (u - 2 * v).loc[got.index][x]) and np.allclose(got.pred[~x], 3 * v.loc[got.index][~x])


# ---- the model graph ----

def one(name, deps=(), tier="base"):
    return RN.Model(name, "test", tier, lambda data, f: f.withColumn(f"pred_{name}", F.lit(1.0)), tuple(deps))


def test_graph_refuses_a_ring():
    g = RN.Graph([one("a", ["c"]), one("b", ["a"]), one("c", ["b"]), one("free"), one("self", ["self"])])
    with pytest.raises(ValueError, match="a -> c -> b -> a"):
        g.order(["free", "a"])
    with pytest.raises(ValueError, match="self -> self"):
        g.order(["self"])
    with pytest.raises(ValueError, match="registered already"):
        g.register(one("a"))


def test_graph_skips_what_lacks_a_dependency():
    g = RN.Graph([one("a"), one("b", ["a", "gone"]), one("c", ["b"]), one("d", ["a"])])
    order, skipped = g.order(["c", "d"])
    assert [m.name for m in order] == ["a", "d"]
    assert skipped == {"gone": "not registered", "b": "needs gone", "c": "needs b"}
    deep = RN.Graph([one(f"m{i}", [f"m{i - 1}"] if i else []) for i in range(3000)])
    assert [m.name for m in deep.order(["m2999"])[0]] == [f"m{i}" for i in range(3000)]


def test_run_of_bases_and_ensembles(spark):
    pdf = made(9, shift=0.0)
    data = FD.Folds(frame(spark, pdf), FEATS, "points", 3)
    bases = ["ridge", "bayesian_ridge", "rolling", "venue_mean"]
    g = RN.Graph([RN.linear("ridge", FD.ridge(1.0)), RN.linear("bayesian_ridge", FD.bayesian(), std=True), RN.rolling("b"), RN.venue_mean(),
                  RN.average("average", bases), RN.stacking(bases), RN.blending(["ridge", "rolling"]), RN.average("lost", ["ridge", "nothing"])])
    run = RN.run(g, data, ["stacking", "blending", "average", "lost"])
    assert run.skipped == {"nothing": "not registered", "lost": "needs nothing"}
    got = run.frame.toPandas().set_index("fixture").sort_index()
    assert (got["pred_std_bayesian_ridge"] > 0).all()
    for seg in "xy":
        for fold, val in data.val.items():
            tr, rows = pdf[(pdf.segment == seg) & (pdf.epoch < val)], got[(got.segment == seg) & (got.fold == fold)]
            want = rows.b.fillna(tr.points.mean())
            assert np.allclose(rows.pred_rolling, want)
            assert np.allclose(rows.pred_venue_mean, [tr[tr.is_home == h].points.mean() for h in rows.is_home])
    cols = [f"pred_{b}" for b in bases]
    assert np.allclose(got.pred_average, got[cols].mean(axis=1))
    early, last = got[got.fold < 3], got[got.fold == 3]
    assert np.allclose(early.pred_stacking, early.pred_average)  # fewer than two folds before
    for seg in "xy":
        tr, va = early[early.segment == seg], last[last.segment == seg]
        for name, use, solve in (("stacking", cols, lambda z, y, n: np.linalg.solve(z.T @ z + 0.5 * np.eye(z.shape[1]), z.T @ y)),
                                 ("blending", ["pred_ridge", "pred_rolling"], lambda z, y, n: MM.elastic_net(z.T @ z, z.T @ y, n, 0.5, 0.5))):
            mu, sd = tr[use].mean().to_numpy(), tr[use].std(ddof=0).to_numpy()
            beta = solve(((tr[use] - mu) / sd).to_numpy(), (tr.points - tr.points.mean()).to_numpy(), len(tr))
            assert np.allclose(va[f"pred_{name}"], tr.points.mean() + ((va[use] - mu) / sd).to_numpy() @ beta, atol=1e-6)
    m = {(r.model, r.segment, r.fold): r for r in run.metrics().collect()}
    assert len(m) == 7 * 6
    want = (got.pred_ridge - got.points)[(got.segment == "x") & (got.fold == 2)].abs().mean()
    assert abs(m["ridge", "x", 2].mae - want) < 1e-9


def test_alpha_grid(spark):
    data = FD.Folds(frame(spark, made(10, shift=0.0)), FEATS, "points", 3)
    grid = FD.ridge_alpha_grid(data, [0.1, 1e5]).collect()
    assert {(r.segment, r.alpha, r.is_best) for r in grid} == {(s, a, a == 0.1) for s in "xy" for a in (0.1, 1e5)}


def test_full_fit_scores_new_rows(spark):
    pdf = made(11, shift=0.0)
    df = frame(spark, pdf)
    data = FD.Folds(df, FEATS, "points", 3)
    fitted = FD.full_fit(data, 1.0)
    assert {r.segment: r.rows for r in fitted.collect()} == pdf.groupby("segment").size().to_dict()
    new = df.limit(50).withColumn("segment", F.when(F.col("fixture") % 9 == 0, F.lit("new")).otherwise(F.col("segment")))
    got = FD.score(new, fitted, FEATS, "pred").toPandas()
    assert got.pred.isna().equals(got.segment == "new")
    n, fill, mean, co = data.moments.run(("x",))
    z = co[:4, :4] / np.sqrt(np.outer(np.diag(co)[:4], np.diag(co)[:4])) * n
    beta = np.linalg.solve(z + np.eye(4), co[:4, 4] / np.sqrt(np.diag(co)[:4] / n)) / np.sqrt(np.diag(co)[:4] / n)
    rows = got[got.segment == "x"]
    assert np.allclose(rows.pred, mean[4] + (rows[FEATS].fillna(dict(zip(FEATS, fill[:4]))).to_numpy() - mean[:4]) @ beta)


def test_linear_models_read_the_rows_together(spark, monkeypatch):
    """one pass over the validation rows for all linear models, with the columns each gives alone."""
    rows = [(g, e, s, f, 1, f % 2, 1, float(f % 7 + e), float((f * 5) % 11), float(f % 3 + e)) for g in "ab" for e in (1, 2, 3) for s in (1, 2) for f in range(12)]
    table = spark.createDataFrame(rows, "segment string, epoch int, step int, fixture int, entity int, is_home int, opp_rank int, x double, z double, points double")
    data = FD.Folds(table, ["x", "z"], "points", 2)
    models = [RN.linear("ridge", FD.ridge(1.0)), RN.linear("bayes", FD.bayesian(), std=True), RN.linear("lasso", FD.enet(0.1, 1.0))]
    passes = []
    real = FD.predict_all
    monkeypatch.setattr(FD, "predict_all", lambda frame, m, feats: passes.append(len(m)) or real(frame, m, feats))
    out = RN.run(RN.Graph(models), data, [m.name for m in models]).frame
    assert passes == [3] and out.count() == 96
    for m in models:
        alone = m.build(data, data.validation())
        cols = [c for c in alone.columns if c.startswith("pred_")]
        assert len(cols) == 1 + (m.name == "bayes")
        assert sorted(map(tuple, alone.select("segment", "epoch", "step", "fixture", *cols).collect())) == sorted(map(tuple, out.select("segment", "epoch", "step", "fixture", *cols).collect()))
