import json
import os

import pytest
from pyspark.sql import functions as F

from stepwise.sources import files as SF
from stepwise.sources.api import flatten_live
from stepwise.sources.sinks import append_log, cached_table


def test_bad_encoding_routed_per_file(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.csv").write_bytes("name,v\nJosé,1\n".encode("utf-8"))
    (tmp_path / "a" / "bad.csv").write_bytes("name,v\nRen\xe9,2\n".encode("latin-1"))
    df = SF.read_csv_any_encoding(spark, str(tmp_path / "a"))
    assert sorted(r["name"] for r in df.collect()) == ["José", "René"]


def test_schema_eras_union_and_labels(spark, tmp_path):
    for season, header, row in [("2019-20", "id,goals", "1,2"), ("2020-21", "id,goals,xg", "1,3,0.5")]:
        d = tmp_path / season
        d.mkdir()
        (d / "players_raw.csv").write_text(f"{header}\n{row}\n")
    df, missing = SF.read_labelled(spark, str(tmp_path), "players_raw.csv", r"/(\d{4}-\d{2})/", "season",
                                   expected=["2019-20", "2020-21", "2021-22"])
    rows = {r["season"]: r for r in df.collect()}
    assert rows["2019-20"]["xg"] is None and rows["2020-21"]["xg"] == "0.5"
    assert missing == ["2021-22"]


def test_census_and_slice_listing(spark, tmp_path):
    for p in ["2019-20/gws/gw1.csv", "2019-20/gws/gw2.csv", "2020-21/players/x/history.csv"]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("a\n1\n")
    summary, reps = SF.census(spark, str(tmp_path), {"gw": r"/gws/gw\d+\.csv$", "history": r"history\.csv$"},
                              r"/(\d{4}-\d{2})/")
    got = {r["kind"]: r["files"] for r in summary.collect()}
    assert got == {"gw": 2, "history": 1}
    preds = tmp_path / "preds"
    preds.mkdir()
    for e, s in [(9, 30), (10, 2), (10, 1)]:
        (preds / f"pred_e{e}_s{s}.csv").write_text("x\n1\n")
    sl = [(r["epoch"], r["step"]) for r in SF.list_slices(spark, str(preds), r"pred_e(\d+)_s(\d+)").collect()]
    assert sl == [(10, 2), (10, 1), (9, 30)]


def test_read_only_sql(spark):
    spark.range(5).createOrReplaceTempView("r5")
    assert SF.read_only_sql(spark, "SELECT count(*) AS n FROM r5 WHERE id > :k", {"k": 1}).first()["n"] == 3
    with pytest.raises(ValueError):
        SF.read_only_sql(spark, "DROP VIEW r5")
    with pytest.raises(ValueError):
        SF.read_only_sql(spark, "SELECT 1; DROP VIEW r5")


def test_browse(spark):
    df = spark.createDataFrame([("Alpha", 1), ("beta", 2), ("ALPINE", 3)], "n string, v int")
    out = SF.browse(df, {"n": "alp"}, 10, order=["v"])
    assert [r["v"] for r in out.collect()] == [1, 3]


def test_flatten_live(spark, tmp_path):
    boot = {"elements": [{"id": 1, "team": 10, "element_type": 3}, {"id": 2, "team": 20, "element_type": 4},
                         {"id": 3, "team": 30, "element_type": 2}],
            "teams": [{"id": 10, "name": "A"}, {"id": 20, "name": "B"}, {"id": 30, "name": "C"}]}
    fixtures = [{"id": 100, "event": 5, "finished": True, "team_h": 10, "team_a": 20, "team_h_score": 2,
                 "team_a_score": 1, "kickoff_time": "2024-01-01T15:00:00Z"}]
    live = {"elements": [{"id": 1, "stats": {"minutes": 90, "total_points": 6}},
                         {"id": 2, "stats": {"minutes": 45}}, {"id": 3, "stats": {"minutes": 10}},
                         {"id": 99, "stats": {"minutes": 90}}]}
    for name, obj in [("boot", boot), ("fixtures", fixtures), ("live", live)]:
        (tmp_path / f"{name}.json").write_text(json.dumps(obj))
    rd = spark.read.option("multiLine", True)
    out = flatten_live(rd.json(str(tmp_path / "boot.json")), rd.json(str(tmp_path / "fixtures.json")),
                       rd.json(str(tmp_path / "live.json")), 5, ["minutes", "total_points", "bonus"])
    got = {r["element"]: (r["was_home"], r["opponent_team"], r["total_points"], r["bonus"]) for r in out.collect()}
    assert got == {1: (True, 20, 6, 0), 2: (False, 10, 0, 0)}   # 3: team without fixture, 99: unknown


def test_sinks_cache_and_log(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    base = str(tmp_path / "cache")
    cached_table(spark, base, "k1", build)
    cached_table(spark, base, "k1", build)
    assert len(calls) == 1
    cached_table(spark, base, "k2", build)
    assert len(calls) == 2
    log = str(tmp_path / "log")
    append_log(spark.createDataFrame([("a", 1, 1.0)], "seg string, step int, mae double"), log, ["seg", "step"])
    out = append_log(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0)], "seg string, step int, mae double"),
                     log, ["seg", "step"])
    assert sorted((r["step"], r["mae"]) for r in out.collect()) == [(1, 2.0), (2, 3.0)]
    assert os.path.isdir(log)


def test_read_only_sql_accepts_queries_only(spark, tmp_path):
    import pytest

    from stepwise.sources.files import read_only_sql
    spark.range(3).createOrReplaceTempView("ro_t")
    assert read_only_sql(spark, "WITH a AS (SELECT id FROM ro_t) SELECT count(*) AS n, ';' AS s FROM a;").first().n == 3
    for bad in ("FROM ro_t INSERT INTO ro_x SELECT id", "WITH a AS (SELECT 1 AS id) INSERT INTO ro_x SELECT id FROM a", "SELECT 1; SELECT 2", "DROP VIEW ro_t",
                "SET x = 1", "CREATE TABLE z AS SELECT 1"):
        with pytest.raises(ValueError):
            read_only_sql(spark, bad)


def test_ingest_fails_rather_than_losing_rows(spark, tmp_path, monkeypatch):
    import pytest

    from stepwise.streaming import jobs
    schema = "epoch int, step int, k int, v int"
    table, keys = str(tmp_path / "t"), ["epoch", "step", "k"]

    def land(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        return str(tmp_path / name)
    one = land("a", [(1, 1, 1, 10), (1, 1, 2, 20)])
    jobs.ingest_slices(spark, one, spark.read.parquet(one).schema, table, keys)
    two = land("b", [(1, 1, 3, 30), (1, 1, 3, 31)])

    def broken(*a, **k):
        raise OSError("checkpoint store is away")
    with monkeypatch.context() as m:
        m.setattr(jobs, "cut_lineage", broken)
        with pytest.raises(Exception):
            jobs.ingest_slices(spark, two, spark.read.parquet(two).schema, table, keys)
    assert spark.read.parquet(table).count() == 2
    out = jobs.ingest_slices(spark, two, spark.read.parquet(two).schema, table, keys)
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, 10), (2, 20), (3, 31)]


def test_monitor_merges_a_slice_over_two_files(spark, tmp_path):
    from stepwise.streaming import jobs
    schema = "seg string, epoch int, step int, y double, pred double"
    for name, rows in (("x", [("a", 1, 1, 0.0, 1.0), ("a", 1, 1, 0.0, 2.0)]), ("y", [("a", 1, 1, 0.0, 3.0), ("a", 1, 1, 0.0, 4.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    src = str(tmp_path / "landing")
    args = (spark, src, spark.read.parquet(src).schema, str(tmp_path / "log"), ["seg"], "y", "pred", 9.0)
    for _ in range(2):  # the second run delivers the same files again
        r = jobs.error_monitor(*args, max_files=1).collect()
        assert [(x.mae, x.n) for x in r] == [(2.5, 4)]
