"""What a task, a partition or a scratch table holds must not grow with the input."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from stepwise.operators import glm as GLM
from stepwise.operators import hotgroups as H
from stepwise.operators import models as M
from stepwise.operators import moments as MO
from stepwise.functions.scalars import min_group_size
from stepwise.plans import bindings as B
from stepwise.plans import cv as CV
from stepwise.plans import folds as FD
from stepwise.plans import pipelines as P
from stepwise.plans.bindings import FACT_ROLES
from stepwise.sources.versions import Change, Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_the_fact_build_follow_the_lines(spark, tmp_path, monkeypatch):
    """F7-F12"""
    d = datetime.datetime(1998, 1, 1)
    tables = {
        "lineitem": ([(i, 1, 1, 2.0, 0.1, 0.0, "R", "O") for i in range(400)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"),
        "orders": ([(i, 1, d, 10.0) for i in range(400)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double"),
        "customer": ([(1, 0)], "c_custkey long, c_nationkey int"), "supplier": ([(1, 0)], "s_suppkey long, s_nationkey int"),
        "part": ([(1, 10.0)], "p_partkey long, p_retailprice double"), "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(B, "LINES_PER_TASK", 10, raising=False)
    fact = B.build_fact(spark, str(tmp_path))
    assert "hashpartitioning(l_orderkey" in plan(fact) and ", 40), REPARTITION_BY_NUM" in plan(fact)
    assert fact.count() == 400


def test_a_large_partition_of_a_versioned_table_is_cut(spark, tmp_path):
    """F15, F16"""
    store = Store(spark, str(tmp_path / "s"))
    df = spark.range(200_000, numPartitions=8).select(F.lit(1).alias("epoch"), F.xxhash64("id").alias("v"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        store.commit({"data": Change(df, partition="epoch")})
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(store.read().inputFiles()) > 2 and store.read().count() == 200_000


@pytest.mark.parametrize("hot_rows", [5_000_000, 20])
def test_small_groups_go_with_one_exchange_and_sort(spark, hot_rows):
    """The group filter of the feature matrix (F15, F17-F22)."""
    rnd = random.Random(1)
    rows = [(e, 1, rnd.randrange(12), i, float(rnd.randrange(9))) for e in range(6) for i in range(3 + 5 * e)] + [(None, 1, 1, i, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "entity int, epoch int, step int, fixture int, points double")
    args = (["points"], (3,), ["points"], ["points"])
    got = H.lagged_features(df, FACT_ROLES, *args, hot_rows=hot_rows, min_rows=5, block=10)
    want = H.lagged_features(min_group_size(df, FACT_ROLES.group, 5), FACT_ROLES, *args, hot_rows=5_000_000)
    assert sorted(got.collect()) == sorted(want.collect())
    if hot_rows > 1000:
        assert "Join" not in plan(got)


def matrix(spark):
    rnd = random.Random(3)
    rows = [(s, e, 1, i, i, 1, 5, None if rnd.random() < 0.2 else rnd.random() * 5, rnd.random(), float(rnd.randrange(20)),
             90 if s == "A" and e == 1 and i < 3 or s == "B" and i % 2 else 10) for s in "AB" for e in (1, 2, 3) for i in range(30)]
    return spark.createDataFrame(rows, "segment string, epoch int, step int, fixture int, entity int, is_home int, opp_rank int, x double, z double, points double, minutes int")


def test_folds_write_no_copies_of_rows(spark, monkeypatch):
    """F2-F4, F6"""
    written = []
    real = CV.write_and_reload
    monkeypatch.setattr(CV, "write_and_reload", lambda df, name, *a: written.append(real(df, name, *a)) or written[-1])
    fm = matrix(spark)
    long = CV.prepare_folds(fm.drop("minutes"), ["x", "z"], 2, fm)
    assert long.count() == 60 + 60 + 120 + 60 and long.where("x is null").count() == 0 and "minutes" in long.columns
    assert max(w.count() for w in written) < 20


def test_two_stage_solves_its_linear_fits_together(spark, monkeypatch):
    """one pass for all groups; fold 1 of A has 3 starts, so it takes all rows for them."""
    fits = []
    real = M.fit_linear
    monkeypatch.setattr(M, "fit_linear", lambda train, *a: fits.append(1) or real(train, *a))
    long = CV.prepare_folds(matrix(spark), ["x", "z"], 2)
    got = CV.two_stage(long, ["x", "z"], "points", "minutes", start_feats=["z"])
    assert len(fits) == 2 and got.count() == 120
    tr = long.where("role = 'train' and segment = 'A' and fold = 1")
    va = long.where("role = 'val' and segment = 'A' and fold = 1")
    for flag, rows in ((1, tr), (0, tr.where("minutes < 60"))):
        va = M.linear_predict(va, real(rows, ["segment", "fold"], ["x", "z"], "points", [1.0]), ["segment", "fold"], ["x", "z"], f"e{flag}")
    both = va.join(got.where("segment = 'A' and fold = 1").select("entity", "pred", "p_start"), "entity")
    assert both.where(F.abs(F.col("pred") - (F.col("p_start") * F.col("e1") + (1 - F.col("p_start")) * F.col("e0"))) > 1e-9).count() == 0 and both.count() == 30


def test_a_slice_run_builds_its_features_once(spark, tmp_path):
    """F13"""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(v):
        seen.add(1)
        return v

    rows = [(1, s, i, 1, "A", float(i)) for s in (1, 2) for i in range(10)]
    table = spark.createDataFrame(rows, "epoch int, step int, fixture int, entity int, segment string, points double")
    new = table.where("step = 2")
    out = P.run_slice(table.where("step = 1"), new, ["epoch", "step", "fixture", "entity"], table.columns,
                      lambda t: t.withColumn("pred", feature.asNondeterministic()("points")), lambda fm, sl: fm.where("step = 2"), None, 5.0, str(tmp_path / "b"))
    assert out["monitor"].count() == 1 and out["table"].count() == 20
    assert seen.value == 20


def test_poisson_fits_all_groups_in_one_pass_an_iteration(spark, monkeypatch):
    """the coefficients of Spark's GLM, without a fit per segment and fold."""
    long = CV.prepare_folds(matrix(spark).withColumn("c", F.lit(3.0)), ["x", "z", "c"], 2).cache()
    train = long.where("role = 'train'")
    want = {}
    for seg, fold in {(r.segment, r.fold) for r in train.select("segment", "fold").distinct().collect()}:
        rows = train.where((F.col("segment") == seg) & (F.col("fold") == fold))
        shift = M.poisson_shift(rows, "points")
        m = M.spark_ml_fit(rows.withColumn("points", F.col("points") + shift), ["x", "z"], "points", "poisson", alpha=0.01)
        want[seg, fold] = (m.intercept, *m.coefficients, 0.0, shift)
    monkeypatch.setattr(M, "spark_ml_fit", None)
    fits = GLM.fit_poisson(train, ["segment", "fold"], ["x", "z", "c"], "points", alpha=0.01)
    got = {g: (b, *w, shift) for g, (b, w, shift) in fits.items()}
    direct = CV.poisson_oof(FD.Folds(matrix(spark).withColumn("c", F.lit(3.0)), ["x", "z", "c"], "points", 2), alpha=0.01)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-8)
    oof = CV.spark_learner_oof(long, ["x", "z", "c"], "points", "poisson", alpha=0.01)
    assert oof.count() == long.where("role = 'val'").count()
    both = oof.join(direct.select("segment", "fold", "fixture", F.col("pred").alias("p")), ["segment", "fold", "fixture"])
    assert both.count() == oof.count() and both.where(F.abs(F.col("pred") - F.col("p")) > 1e-6).count() == 0
    r = oof.join(long.where("role = 'val'").select("segment", "fold", "fixture", "x", "z"), ["segment", "fold", "fixture"]).first()
    b0, b1, b2, _, shift = want[r.segment, r.fold]
    assert r.pred == pytest.approx(math.exp(b0 + b1 * r.x + b2 * r.z) - shift, rel=1e-6)


def test_poisson_leaves_out_rows_without_target_or_key(spark):
    rows = [("A", 1.0, 2.0), ("A", 2.0, 5.0), ("A", 3.0, 4.0), ("A", 4.0, None), (None, 1.0, 1.0), ("B", 1.0, 7.0), ("B", 2.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fits = GLM.fit_poisson(df, ["g"], ["x"], "y")
    assert set(fits) == {("A",), ("B",)}
    assert math.exp(fits["B",][0] + fits["B",][1][0]) == pytest.approx(7.0, rel=1e-3)   # a target that does not vary
    assert GLM.fit_poisson(df.where("false"), ["g"], ["x"], "y") == {}


def test_moments_are_added_up_by_matrix_products(spark):
    """one row per group and task is aggregated, not a sum per pair of columns and row."""
    rnd = random.Random(5)
    rows = [(g, e, *[None if rnd.random() < 0.2 else rnd.random() for _ in range(3)]) for g in ("a", None) for e in (1, 2, None) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, e int, x double, y double, z double").repartition(5)
    shift = [0.5, 0.0, 0.25]
    table = MO.moment_table(df, ["g"], "e", ["x", "y", "z"], shift)
    assert "MapInArrow" in plan(table)
    got = {(r.g, r.e, r.missing): r for r in table.collect()}
    want = {}
    for g, e, *v in rows:
        k = (g, e, sum(1 << i for i, a in enumerate(v) if a is None))
        x = [0.0 if a is None else a - s for a, s in zip(v, shift)]
        n, s, p = want.get(k, (0, [0.0] * 3, [0.0] * 6))
        want[k] = (n + 1, [a + b for a, b in zip(s, x)], [a + x[i] * x[j] for a, (i, j) in zip(p, [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)])])
    assert got.keys() == want.keys()
    for k, (n, s, p) in want.items():
        assert got[k].n == n and got[k].sums == pytest.approx(s) and got[k].products == pytest.approx(p)


def test_predictive_deviation_is_a_matrix_product(spark):
    """as a column it was too much code to be compiled."""
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 1, None, 1.0), ("b", 1, 1.0, 1.0), (None, 1, 1.0, 1.0)], "segment string, fold int, x double, y double")
    fits = [("a", 1, [1.0, 1.0], 0.5, [3.0, 0.0], [1.0, 0.0], [2.0, 1.0], [2.0, 0.5, 0.5, 1.0], 0.25)]
    out = FD.predict(rows, fits, ["x", "y"], "p", "s")
    assert "MapInArrow" in plan(out) and out.columns == [*rows.columns, "p", "s"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    # z = (0, 2) and (1, 1): z' S z = 4 and 2 + 1 + 1
    s = 4.25 ** 0.5
    assert got == sorted([("a", 1, 1.0, 2.0, 3.5, s), ("a", 1, None, 1.0, 4.5, s), ("b", 1, 1.0, 1.0, None, None), (None, 1, 1.0, 1.0, None, None)], key=str)


def test_two_stage_fits_all_classifiers_together(spark, monkeypatch):
    """Spark's logistic regression of each group, without a fit and a read of the rows per group."""
    long = CV.prepare_folds(matrix(spark).withColumn("c", F.lit(3.0)), ["x", "z", "c"], 2)
    start = F.coalesce((F.col("minutes") >= 60).cast("double"), F.lit(0.0))
    want = {}
    for seg, fold in {(r.segment, r.fold) for r in long.where("role = 'train'").select("segment", "fold").distinct().collect()}:
        part = long.where((F.col("segment") == seg) & (F.col("fold") == fold)).withColumn("_s", start)
        tr = part.where("role = 'train'")
        n, n1 = tr.count(), tr.agg(F.sum("_s")).first()[0]
        if 0 < n1 < n:
            m = M.spark_ml_fit(tr, ["x", "z"], "_s", "logistic", n=n)
            want |= {(seg, fold, r.entity, r.epoch, r.step, r.fixture): r.p for r in M.spark_ml_predict(m, part.where("role = 'val'"), ["x", "z"], "p", prob=True).collect()}
        else:
            want |= {(seg, fold, r.entity, r.epoch, r.step, r.fixture): float(n1 > 0) for r in part.where("role = 'val'").collect()}
    monkeypatch.setattr(M, "spark_ml_fit", None)
    monkeypatch.setattr(CV, "_per_group", None)
    got = CV.two_stage(long, ["x", "z"], "points", "minutes", start_feats=["x", "z", "c"]).collect()
    assert len(got) == len(want) and {r.p_start for r in got} != {0.0, 1.0}
    for r in got:
        assert r.p_start == pytest.approx(want[r.segment, r.fold, r.entity, r.epoch, r.step, r.fixture], abs=1e-4)
