import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stepwise.operators import windows as W
from stepwise.roles import Roles

R = Roles(entity="e", epoch="ep", step="st", seq="sq", segment=None, target="x")


def frame(spark, rows):
    return spark.createDataFrame(rows, "e long, ep int, st int, sq long, x double")


def test_lagged_rolling_mean_matches_pandas_with_nulls(spark):
    xs = [1.0, None, 3.0, 4.0, None, 6.0, 7.0]
    df = frame(spark, [(1, 1, i + 1, i, x) for i, x in enumerate(xs)])
    got = W.lagged_rolling_mean(df, R, ["x"], ks=(3,)).orderBy("st").toPandas()["x_roll3"]
    want = pd.Series(xs, dtype=float).shift(1).rolling(3, min_periods=1).mean()
    assert np.allclose(got.fillna(-1), want.fillna(-1))
    assert pd.isna(got.iloc[0])


def test_epoch_boundary_resets(spark):
    df = frame(spark, [(1, 1, 1, 1, 5.0), (1, 1, 2, 2, 7.0), (1, 2, 1, 3, 9.0), (1, 2, 2, 4, 11.0)])
    out = W.lagged_expanding_mean(df, R, ["x"]).orderBy("ep", "st").toPandas()
    assert pd.isna(out.loc[0, "x_todate"]) and pd.isna(out.loc[2, "x_todate"])
    assert out.loc[1, "x_todate"] == 5.0 and out.loc[3, "x_todate"] == 9.0


def test_double_step_sees_first_row(spark):
    df = frame(spark, [(1, 1, 1, 10, 2.0), (1, 1, 1, 11, 4.0)])
    out = W.lag_features(df, R, ["x"]).orderBy("sq").toPandas()
    assert out.loc[1, "x_lag1"] == 2.0


def test_expanding_sum_and_prior_rate(spark):
    df = frame(spark, [(1, 1, i, i, float(i)) for i in range(1, 5)])
    out = W.prior_count_and_rate(W.lagged_expanding_sum(df, R, ["x"]), R, "x").orderBy("st").toPandas()
    assert pd.isna(out.loc[0, "x_cum_prior"]) and out.loc[3, "x_cum_prior"] == 6.0
    assert list(out["n_prior"]) == [0, 1, 2, 3]
    assert pd.isna(out.loc[0, "x_prior_rate"]) and out.loc[3, "x_prior_rate"] == 2.0


def test_rank_ties_skip(spark):
    df = spark.createDataFrame([(1, "a", 10, 5, 7), (1, "b", 10, 5, 7), (1, "c", 9, 9, 9)],
                               "ep int, side string, pts int, gd int, gf int")
    out = {r["side"]: r["rank"] for r in W.multi_key_rank(df, ["ep"], ["pts", "gd", "gf"]).collect()}
    assert out == {"a": 1, "b": 1, "c": 3}


def test_quantile_bins_match_qcut_with_ties(spark):
    vals = [1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 5.0, 8.0, 8.0, 13.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = W.quantile_bins(df, "v", 4).orderBy("id").toPandas()["bin"].tolist()
    want = pd.qcut(pd.Series(vals), 4, labels=False, duplicates="drop").tolist()
    assert got == want


def test_top_n_and_median_flag(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "g string, k long, v double")
    top = W.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("k")], 3).toPandas()
    assert sorted(top["k"]) == [7, 8, 9]
    flagged = W.median_flag(df, ["g"], "v").where("flag").count()
    assert flagged == 5


def test_rolling_alert(spark):
    df = spark.createDataFrame([("s", 1, i, m) for i, m in enumerate([1.0, 1.0, 1.0, 5.0, 5.0, 5.0])],
                               "seg string, ep int, st int, mae double")
    out = W.rolling_alert(df, ["seg"], ["ep", "st"], "mae", 2.5).orderBy("st").toPandas()
    assert list(out["alert"]) == [False, False, False, False, True, True]


def test_hot_group_split_matches_plain_windows(spark):
    from stepwise.operators.hotgroups import _plain, lagged_features
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):                      # one dominant group with nulls and double steps
        rows.append((1, 1, i // 3, i, None if i % 7 == 0 else float(rng.integers(0, 20))))
    rows += [(2, 1, i, 1000 + i, float(i)) for i in range(5)]   # a normal group
    df = frame(spark, rows)
    got = lagged_features(df, R, ["x"], (3, 5), ["x"], ["x"], hot_rows=50, partitions=7, block=16)
    want = _plain(df, R, ["x"], (3, 5), ["x"], ["x"])
    cols = ["e", "sq", "x_roll3", "x_roll5", "x_todate", "x_lag1"]
    a = got.select(*cols).orderBy("e", "sq").toPandas()
    b = want.select(*cols).orderBy("e", "sq").toPandas()
    assert len(a) == len(b) == 405
    assert np.allclose(a.fillna(-999).to_numpy(dtype=float), b.fillna(-999).to_numpy(dtype=float))
