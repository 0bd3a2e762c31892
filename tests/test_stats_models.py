import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stepwise.operators import models as M
from stepwise.operators import stats as ST


def test_spearman_average_ranks_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 300).astype(float)
    y = x + rng.normal(0, 2, 300)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "x": x, "y": y})
    got = {r["g"]: r["spearman"] for r in ST.spearman(spark.createDataFrame(pdf), ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        want = part["x"].rank().corr(part["y"].rank())   # Spearman = Pearson on average ranks
        assert abs(got[g] - want) < 1e-9


def test_average_rank_many_ties_is_exact(spark):
    vals = [5.0] * 50 + [1.0] * 3 + [9.0] * 7
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = ST.average_rank(df, [], "v", "r", buckets=4).orderBy("id").toPandas()["r"].to_numpy()
    want = pd.Series(vals).rank().to_numpy()
    assert np.allclose(got, want)


def test_topn_precision_skips_small_slices(spark):
    rows = [(1, i, float(i), float(i)) for i in range(10)] + [(2, i, float(i), float(-i)) for i in range(11)]
    df = spark.createDataFrame(rows, "s int, k long, y double, p double").withColumn("g", F.lit(1))
    st5 = ST.top_n_precision(df, ["g"], ["s"], "y", "p", ["k"], 10).first()
    st6 = ST.top_n_precision(df, ["g"], ["s"], "y", "p", ["k"], 10, variable_k=True).first()
    assert st5["n_slices"] == 1 and abs(st5["top10_precision"] - 0.9) < 1e-12
    assert st6["n_slices"] == 2 and abs(st6["top10_precision"] - (1.0 + 0.9) / 2) < 1e-12


def test_expanding_folds(spark):
    df = spark.createDataFrame([(e,) for e in [2001, 2002, 2003, 2004, 2004]], "epoch int")
    folds = {r["fold"]: (list(r["train_epochs"]), r["val_epoch"]) for r in ST.expanding_folds(df, "epoch", 3).collect()}
    assert folds == {1: ([2001], 2002), 2: ([2001, 2002], 2003), 3: ([2001, 2002, 2003], 2004)}


def test_imputation_unseen_epoch_and_all_null(spark):
    train = spark.createDataFrame([(1, 2.0, None), (1, 4.0, None), (2, 10.0, None)], "epoch int, a double, b double")
    val = spark.createDataFrame([(3, None, None), (1, None, 1.0)], "epoch int, a double, b double")
    out = M.impute_apply(val, M.impute_fit(train, "epoch", ["a", "b"]), "epoch", ["a", "b"]).orderBy("epoch").collect()
    assert (out[0]["a"], out[0]["b"]) == (3.0, 1.0)
    assert abs(out[1]["a"] - 16.0 / 3) < 1e-12 and out[1]["b"] == 0.0


def _ridge_reference(X, y, alpha):
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1
    Z = (X - mu) / sd
    beta = np.linalg.solve(Z.T @ Z + alpha * np.eye(X.shape[1]), Z.T @ (y - y.mean()))
    return beta, y.mean(), mu, sd


def test_ridge_from_gram_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 4))
    y = X @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(0, 0.1, 200)
    pdf = pd.DataFrame(X, columns=list("abcd")).assign(y=y, g=1)
    df = spark.createDataFrame(pdf)
    coefs = M.fit_linear(df, ["g"], list("abcd"), "y", [3.0])
    row = coefs.first()
    beta, b0, _, _ = _ridge_reference(X, y, 3.0)
    assert np.allclose(row["coef"], beta) and abs(row["intercept"] - b0) < 1e-9
    pred = M.linear_predict(df, coefs, ["g"], list("abcd")).toPandas()["pred"].to_numpy()
    Z = (X - X.mean(0)) / X.std(0)
    assert np.allclose(pred, b0 + Z @ beta)


def test_bayesian_ridge_std_positive(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(150, 3))
    y = X @ np.array([0.5, 1.0, -1.0]) + rng.normal(0, 0.5, 150)
    df = spark.createDataFrame(pd.DataFrame(X, columns=list("abc")).assign(y=y, g=1))
    c = M.fit_linear(df, ["g"], list("abc"), "y", [0.0], "br", solver=M.bayesian_ridge_solver())
    p = M.linear_predict(df, c, ["g"], list("abc"), "pred", std_name="std").toPandas()
    assert (p["std"] > 0).all()
    row = c.first()
    S = np.array(row["cov"]).reshape(3, 3)
    Z = (X - np.array(row["mu"])) / np.array(row["sd"])
    want = np.sqrt(row["noise_var"] + np.einsum("ij,jk,ik->i", Z, S, Z))
    assert np.allclose(p["std"].to_numpy(), want)
    assert np.corrcoef(p["pred"], y)[0, 1] > 0.8


def test_components_weighted_sum(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(100, 2))
    pdf = pd.DataFrame(X, columns=["a", "b"]).assign(c1=X[:, 0] * 2, c2=X[:, 1], g=1, k=range(100))
    df = spark.createDataFrame(pdf)
    coefs = M.fit_components(df, ["g"], ["a", "b"], ["c1", "c2"], alpha=0.0)
    out = M.predict_components(df, coefs, ["g"], ["a", "b"], {"c1": 1.0, "c2": 3.0}, ["k"]).orderBy("k").toPandas()
    assert np.allclose(out["pred"], 2 * X[:, 0] + 3 * X[:, 1], atol=1e-8)


def test_padded_sequences_blocks_keep_all_rows(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "e int, s int, x double")
    out = M.padded_sequences(df, ["e"], ["s"], ["x"], 3).orderBy("block").collect()
    assert [r["n_steps"] for r in out] == [3, 2]
    assert out[1]["mask"] == [True, True, False] and out[1]["seq"][2] == [0.0]


def test_registry_resolves_dependencies():
    reg = M.Registry()
    for name, deps in [("ridge", ()), ("bayes", ()), ("blend", ("ridge", "bayes"))]:
        reg.register(M.ModelSpec(name, "linear", "base", None, None, deps=deps))
    assert [s.name for s in reg.resolve(["blend"])] == ["ridge", "bayes", "blend"]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    vals = np.concatenate([rng.integers(0, 5, 500).astype(float), rng.normal(10, 3, 300)])
    g = np.where(np.arange(len(vals)) % 3 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": vals}))
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in ST.exact_quantiles(df, ["g"], "v", probs, buckets=7).collect()}
    for key in ("a", "b"):
        want = np.quantile(vals[g == key], probs)
        have = [got[key][f"q{int(round(p * 100))}"] for p in probs]
        assert np.allclose(have, want)
