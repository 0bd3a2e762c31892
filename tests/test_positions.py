"""Positions, ranks and quantiles by ranges against pandas and numpy, with a group of most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepwise.operators import models as M
from stepwise.operators import positions as P


def hot(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    g = rng.choice(["hot", "a", "b", None], n, p=[0.8, 0.1, 0.05, 0.05])
    v = np.where(rng.random(n) < 0.3, 5.0, np.round(rng.normal(0, 50, n), 1))
    v[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"i": np.arange(n), "g": g, "v": v})


def frame(spark, pdf):
    return spark.createDataFrame([(int(i), g, None if np.isnan(v) else float(v)) for i, g, v in pdf.itertuples(index=False)], "i long, g string, v double").repartition(6)


@pytest.mark.parametrize("buckets", [None, 1, 13])
def test_prefix_is_the_position_in_the_group(spark, buckets):
    pdf = hot()
    got = P.prefix(frame(spark, pdf), ["g"], ["v", "i"], total="t", buckets=buckets).toPandas()
    for _, rows in got.groupby("g", dropna=False):
        rows = rows.sort_values(["v", "i"], na_position="first")
        assert list(rows.before) == list(range(len(rows))) and set(rows.t) == {len(rows)}


def test_weights(spark):
    pdf = hot(500)
    got = P.prefix(frame(spark, pdf).withColumn("w", F.col("i") % 4), ["g"], ["i"], "w", buckets=7).toPandas()
    for _, rows in got.groupby("g", dropna=False):
        rows = rows.sort_values("i")
        assert list(rows.before) == [0, *np.cumsum(rows.w)[:-1]]


@pytest.mark.parametrize("by", [["g"], []])
def test_ranks_and_quantiles(spark, by):
    pdf = hot(seed=1)
    df = frame(spark, pdf)
    got = P.average_rank(df, by, "v", "r").toPandas().set_index("i").r.sort_index()
    want = pdf.groupby("g", dropna=False).v.rank() if by else pdf.v.rank()
    assert np.allclose(got, want, equal_nan=True)
    probs = [0, 0.01, 0.25, 0.5, 0.77, 1]
    rows = P.exact_quantiles(df, by, "v", probs).toPandas()
    assert len(rows) == (4 if by else 1)
    for r in rows.itertuples():
        use = pdf[pdf.g.isna() if getattr(r, "g", 0) is None else pdf.g == r.g] if by else pdf
        assert np.allclose([getattr(r, f"q{int(round(p * 100))}") for p in probs], np.quantile(use.v.dropna(), probs))


def test_no_plan_holds_a_group(spark):
    plan = P.exact_quantiles(frame(spark, hot(50)), ["g"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "collect" not in plan


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(1, "x", None)], "i long, g string, v double")
    assert P.exact_quantiles(df, ["g"], "v", [0.5]).collect() == []
    assert P.exact_quantiles(df, [], "v", [0.5]).first().q50 is None
    assert P.average_rank(df, ["g"], "v", "r").first().r is None
    assert P.prefix(df.limit(0), ["g"], ["v"]).collect() == []


def test_sequences_of_a_hot_group_keep_their_order(spark):
    n = 2500
    rows = [("hot", int(s), float(s)) for s in np.random.default_rng(3).permutation(n)] + [("small", s, float(s)) for s in range(3)]
    out = M.padded_sequences(spark.createDataFrame(rows, "g string, s int, x double").repartition(5), ["g"], ["s"], ["x"], 40).collect()
    for r in out:
        first = r.block * 40
        live = min(40, (n if r.g == "hot" else 3) - first)
        assert [v[0] for v in r.seq] == [float(first + k) if k < live else 0.0 for k in range(40)]
        assert r["mask"] == [k < live for k in range(40)] and r.n_steps == live
    assert len(out) == -(-n // 40) + 1


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("by", [["g"], []])
def test_rank_correlation_with_ties_over_batches_and_ranges(spark, monkeypatch, by, few):
    """the rows go to ranges once and are not joined to their own ranks."""
    from stepwise.operators import stats as ST
    monkeypatch.setattr(P, "FEW_VALUES", few)
    pdf = hot(seed=2)
    pdf["w"] = np.where(pdf.i % 3 == 0, np.round(np.nan_to_num(pdf.v)), np.round(np.random.default_rng(4).normal(0, 30, len(pdf))))
    df = spark.createDataFrame([(g, None if np.isnan(v) else float(v), int(w)) for _, g, v, w in pdf.itertuples(index=False)], "g string, v double, w long").repartition(5)
    df = df.unionByName(spark.createDataFrame([("flat", 1.0, i) for i in range(9)] + [("level", float(i), 2) for i in range(9)] + [("nan", float("nan"), 1), ("nan", float("nan"), 5), ("nan", 2.0, 0)],
                                              df.schema))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)   # values go on from batch to batch
    written = []
    real = P.write_and_reload
    monkeypatch.setattr(P, "write_and_reload", lambda d, n: written.append(d.columns) or real(d, n))
    try:
        got = ST.spearman(df, by, "v", "w").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert not any("_x" in c for c in written)   # only values of w are kept in a table
    if not by:
        assert len(got) == 1 and -0.1 < got[0].spearman < 1
        return
    use = pdf.dropna(subset=["v"])
    want = {g: part.v.rank().corr(part.w.rank()) for g, part in use.groupby(use.g.fillna("null"))}
    got = {r.g or "null": r.spearman for r in got}
    assert got.keys() == {*want, "flat", "level", "nan"} and got["flat"] is None and got["level"] is None
    assert got["nan"] == pytest.approx(pd.Series([2.5, 2.5, 1]).corr(pd.Series([2.0, 3, 1])))
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-12)
