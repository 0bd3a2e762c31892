"""The joint boosting of all groups (F2) against Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwise.operators import boosting as BO
from stepwise.operators import forest as FO
from stepwise.operators import models as M

FEATS = ["x1", "x2", "x3"]


def _rows(spark, n=1500):
    d = spark.range(n, numPartitions=4).withColumn("segment", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    u = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0 for k in range(4)]
    return (d.withColumns({"fold": F.lit(1), "x1": u[0], "x2": u[1], "x3": F.round(u[2] * 4)})
            .withColumn("y", F.when(F.col("x1") > 0.5, 20.0).otherwise(0.0) + 10 * F.col("x2") * F.col("x3") + u[3]))


def _told(rows, fits):
    return {r["id"]: r["pred"] for r in FO.predict_forests(rows.select("id", "segment", "fold", *FEATS), fits, ["segment", "fold"], FEATS).collect()}


def test_boosting_predicts_what_sparks_does(spark, monkeypatch):
    rows = _rows(spark).cache()
    monkeypatch.setattr(BO, "TREES_A_PACKING", 3)   # targets are packed again on the way
    monkeypatch.setattr(BO, "ROWS_PER_TASK", 400)
    monkeypatch.setattr(FO, "ROWS_PER_PIECE", 150)
    fits = BO.fit_boosting(rows, ["segment", "fold"], FEATS, "y", trees=10, depth=4)
    assert set(fits) == {("a", 1), ("b", 1)} and all(f.values.shape == (10, 16) for f in fits.values())
    mine = _told(rows, fits)
    for seg in "ab":
        part = rows.where(F.col("segment") == seg)
        model = M.spark_ml_fit(part, FEATS, "y", "gbt", trees=10, depth=4)
        for r in M.spark_ml_predict(model, part, FEATS, "p").collect():
            assert mine[r["id"]] == pytest.approx(r["p"], abs=1e-6)
    assert len(mine) == 1500


def test_no_fit_per_group_and_no_copies_in_the_heap(spark, monkeypatch):
    """The query's learner makes one pass a level; what the passes read is on disk and goes at the end."""
    from stepwise.plans import cv as CV
    rows = _rows(spark, 300).withColumns({"epoch": F.lit(1), "step": F.lit(1), "fixture": F.col("id"), "entity": F.col("id")})
    long = rows.withColumn("role", F.lit("train")).unionByName(rows.withColumn("role", F.lit("val"))).drop("id")
    monkeypatch.setattr(M, "spark_ml_fit", None)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = CV.spark_learner_oof(long, FEATS, "y", "gbt", trees=8, depth=2)
    assert out.count() == 300 and out.columns == [*CV.KEYS, "fold", "y", "pred", "model"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert np.abs(np.array([r["pred"] - r["y"] for r in out.collect()])).mean() < 7


def test_odd_groups(spark):
    """A row, equal targets, no target, no key."""
    rows = spark.createDataFrame([(1, "one", 1, 0.5, 7.0), *[(i, "flat", 1, i / 10, 3.0) for i in range(2, 30)], (30, "none", 1, 1.0, None),
                                  (31, None, 1, 1.0, 2.0)], "id long, segment string, fold int, x double, y double")
    fits = BO.fit_boosting(rows, ["segment", "fold"], ["x"], "y", trees=3, depth=2)
    assert set(fits) == {("one", 1), ("flat", 1)}
    pred = {r["segment"]: r["pred"] for r in FO.predict_forests(rows, fits, ["segment", "fold"], ["x"]).collect()}
    assert pred == {"one": 7.0, "flat": 3.0}
    assert BO.fit_boosting(rows.where("y is null"), ["segment", "fold"], ["x"], "y") == {}
