from pyspark.sql import functions as F

from stepwise.functions import scalars as S
from stepwise.operators import relational as R
from stepwise.sources.sinks import upsert_slice


def test_step_gap_no_pair_and_missing_members(spark):
    df = spark.createDataFrame([(1, 29, 5.0), (1, 39, 6.0)], "e long, st int, p double")
    assert R.consecutive_pairs(df, ["e"], "st", ["p"]).count() == 0
    miss = sorted(r["st"] for r in R.missing_members(df, ["e"], "st", 29, 39).collect())
    assert miss == list(range(30, 39))


def test_own_side_from_other_takes_match_day_side(spark):
    # entity 7 plays for side A in fixture 1 (home) and side B in fixture 2 (away)
    rows = [(1, 7, 1, "X"), (1, 8, 0, "A"),      # fixture 1: A (home) v X
            (2, 7, 0, "Y"), (2, 9, 1, "B")]      # fixture 2: Y (home) v B
    df = spark.createDataFrame(rows, "fx int, e int, home int, opp string")
    out = {(r["fx"], r["e"]): r["own_side"] for r in R.own_side_from_other(df, ["fx"], "home", "opp").collect()}
    assert out[(1, 7)] == "A" and out[(2, 7)] == "B"


def test_manager_rows_and_zero_override(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 5, 0, 100, 3), (2, 0, 0, 0, 6, None, 100, 3)],
                               "id int, w int, d int, l int, mng int, hist int, now int, chg int")
    out = S.null_unless(df, (F.col("w") + F.col("d") + F.col("l")) == 1, ["mng"])
    out = out.withColumn("start", S.derived_with_override(F.col("hist"), F.col("now"), F.col("chg")))
    got = {r["id"]: (r["mng"], r["start"]) for r in out.collect()}
    assert got == {1: (5, 97), 2: (None, 97)}


def test_slice_replay_is_idempotent(spark):
    base = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 12, 3.0)], "st int, fx int, v double")
    new = spark.createDataFrame([(2, 12, 4.0)], "st int, fx int, v double")
    once = upsert_slice(base, new, ["st", "fx"])
    twice = upsert_slice(once, new, ["st", "fx"])
    assert once.count() == twice.count() == 3
    assert sorted(r["v"] for r in twice.collect()) == [1.0, 2.0, 4.0]


def test_orphans_not_in_drops_null_keys(spark):
    child = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert R.orphans(child, parent, ["k"]).count() == 2
    assert R.orphans(child, parent, ["k"], not_in=True).count() == 1


def test_coercion_and_flags(spark):
    df = spark.createDataFrame([("1.0", "True"), ("x", "0"), (None, None)], "a string, b string")
    out = df.select(S.coerce_numeric("a", "int").alias("a"), S.bool_to_int("b").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in out] == [(1, 1), (None, 0), (None, None)]


def test_buckets(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (100.0,)], "x double")
    b = df.select(S.bucket_right_closed(F.col("x"), [0, 10, 50], ["lo", "hi"]).alias("b")).collect()
    assert [r["b"] for r in b] == ["lo", "lo", "hi", None]
    d = spark.createDataFrame([(None,), (3,), (12,), (20,)], "r int").select(
        S.rank_difficulty(F.col("r")).alias("d"), S.rank_bin(F.col("r")).alias("b")).collect()
    assert [(r["d"], r["b"]) for r in d] == [(None, "B"), (5, "A"), (3, "B"), (1, "C")]


def test_bridge_join_counts_unmatched(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "lid int")
    bridge = spark.createDataFrame([(1, 10), (3, 30)], "lid int, sk int")
    out, counts = R.bridge_join(df, bridge, ["lid"], "sk")
    assert sorted(r["sk"] for r in out.collect()) == [10, 30]
    c = counts.first()
    assert (c["unmatched"], c["rows"]) == (1, 3)


def test_orphans_not_in_with_a_null_second_key(spark):
    from stepwise.operators import relational as R
    child = spark.createDataFrame([(1, None), (1, 2), (3, 4)], "a int, b int")
    parent = spark.createDataFrame([(1, 2)], "a int, b int")
    assert [tuple(r) for r in R.orphans(child, parent, ["a", "b"], not_in=True).collect()] == [(3, 4)]


def test_row_rules_count_planted_violations(spark):
    from stepwise.operators import quality as Q
    df = spark.createDataFrame([(1, 95), (2, -1), (None, 10), (4, 90)], "k int, minutes int")
    rows = Q.row_rules(df, {"A": ("no null key", F.col("k").isNull()), "B": ("at most 90", F.col("minutes") > 90),
                            "C": ("never 1000", F.col("minutes") == 1000)})
    got = {r["rule_id"]: (r["violations"], r["passed"]) for r in Q.run_checks([], more=[rows]).collect()}
    assert got == {"A": (1, False), "B": (1, False), "C": (0, True)}


def test_top_set_overlap_counts_empty_intersections(spark):
    from stepwise.operators import relational as R
    df = spark.createDataFrame([("g", i, i, -i) for i in range(6)] + [("h", 1, 1, 1)], "g string, k int, a int, b int")
    got = {r["g"]: (r["overlap"], r["n"]) for r in R.top_set_overlap(df, ["g"], "a", "b", "k", 2).collect()}
    assert got == {"g": (0, 6), "h": (1, 1)}
