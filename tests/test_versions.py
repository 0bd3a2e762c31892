"""Versioned tables, logs and streams: whole versions, injected failures, restarts, per-partition refresh."""

import os

import pytest
from pyspark.sql import functions as F

from stepwise.sources import sinks
from stepwise.sources.versions import Change, CommitConflict, Store, refresh
from stepwise.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def slices(spark, data):
    return spark.createDataFrame(data, "epoch int, step int, v double")


def folders(path):
    return sorted(os.listdir(f"{path}/data"))


def test_versions_are_whole_and_old_ones_go(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"), keep=2)
    assert st.read() is None and st.versions() == []
    for i in range(5):
        st.commit({"a": Change(spark.range(i)), "b": Change(spark.range(i * 10))})
    assert st.versions() == [4, 5] and st.read("a").count() == 4 and st.read("b").count() == 40
    assert st.read("a", 4).count() == 3
    assert len(folders(st.path)) == 4   # two tables of two versions


def test_a_reader_keeps_its_version(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    st.commit({"data": Change(spark.range(3))})
    before = st.read()
    st.commit({"data": Change(spark.range(7))})
    assert before.count() == 3 and st.read().count() == 7


@pytest.mark.parametrize("where", ["_apply", "_publish"])
def test_a_failure_between_the_writes_loses_nothing(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "log")
    sinks.append_log(slices(spark, [(1, 1, 1.0), (1, 2, 2.0)]), path, ["epoch", "step"], "epoch")
    real = getattr(Store, where)

    def broken(self, *a):
        out = real(self, *a) if where == "_apply" else None   # the data is written, the version is not
        raise OSError(f"store is away {out is None}")
    with monkeypatch.context() as m:
        m.setattr(Store, where, broken)
        with pytest.raises(OSError):
            sinks.append_log(slices(spark, [(1, 2, 9.0), (2, 1, 5.0)]), path, ["epoch", "step"], "epoch")
    assert rows(Store(spark, path).read(), "epoch", "step", "v") == [(1, 1, 1.0), (1, 2, 2.0)]
    out = sinks.append_log(slices(spark, [(1, 2, 9.0), (2, 1, 5.0)]), path, ["epoch", "step"], "epoch")
    assert rows(out, "epoch", "step", "v") == [(1, 1, 1.0), (1, 2, 9.0), (2, 1, 5.0)]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.commit({"data": Change(spark.range(1))})
    stale = b.state()
    a.commit({"data": Change(spark.range(2))})
    monkeypatch.setattr(b, "state", lambda version=None: stale)
    with pytest.raises(CommitConflict):
        b.commit({"data": Change(spark.range(3))})
    assert a.read().count() == 2


def test_only_touched_partitions_are_written(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    first = slices(spark, [(e, s, 1.0) for e in (1, 2, 3) for s in (1, 2)] + [(None, 1, 0.0)])
    st.commit({"data": Change(first, partition="epoch")})
    st.commit({"data": Change(slices(spark, [(2, 2, 7.0), (4, 1, 4.0)]), "upsert", ("epoch", "step"), "epoch")})
    parts = st.state()["tables"]["data"]["parts"]
    assert len({f for fs in parts.values() for f in fs}) == 2 and len(parts) == 5
    assert rows(st.read().where("epoch in (2, 4)"), "epoch", "step", "v") == [(2, 1, 1.0), (2, 2, 7.0), (4, 1, 4.0)]
    assert st.read().count() == 8
    with pytest.raises(ValueError, match="must hold the partition column"):
        st.commit({"data": Change(first, "upsert", ("step",), "epoch")})
    with pytest.raises(ValueError, match="is partitioned by"):
        st.commit({"data": Change(first, "append", partition="step")})


def test_appends_gather_into_few_folders_and_take_new_columns(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"), merge_at=3)
    for i in range(8):
        st.commit({"data": Change(spark.createDataFrame([(i,)], "x int"), "append")})
    st.commit({"data": Change(spark.createDataFrame([(8, "new")], "x int, y string"), "append")})
    assert sorted((r.x, r.y) for r in st.read().collect()) == [(i, None) for i in range(8)] + [(8, "new")]
    assert len(st.state()["tables"]["data"]["parts"][""]) <= 3


def test_ledger(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    assert st.done("j") == -1
    for batch in (0, 0, 1, 1, 0):
        st.commit({"data": Change(spark.range(1), "append")}, "j", batch)
    assert st.read().count() == 2 and st.done("j") == 1
    assert st.commit({"data": Change(spark.range(1), "append")}, "other", 0)


def test_saved_runs_and_builds(spark, tmp_path):
    oof = spark.createDataFrame([("a b/c", 1.0), ("d", 2.0)], "segment string, pred double")
    st = sinks.save_cv_results(spark.range(2), oof, str(tmp_path / "cv"))
    assert st.read("metrics").count() == 2 and rows(st.read("oof"), "segment", "pred") == [("a b/c", 1.0), ("d", 2.0)]
    assert sinks.rebuild({"x": spark.range(0)}, str(tmp_path / "b")).read("x").count() == 0


def test_refresh_rebuilds_changed_partitions_only(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    built = []

    def build(src):
        built.append(sorted(r[0] for r in src.select("epoch").distinct().collect()))
        return src.groupBy("epoch").agg(F.sum("v").alias("total"))
    one = slices(spark, [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 5.0), (3, 1, 6.0)])
    refresh(st, "sums", one, "epoch", build)
    assert refresh(st, "sums", one.repartition(7).orderBy("v"), "epoch", build) == []   # order is no change
    two = slices(spark, [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 5.0), (2, 2, 5.0), (4, 1, 0.0)])   # rows in 2, 3 gone, 4 new
    assert len(refresh(st, "sums", two, "epoch", build)) == 2
    assert built == [[1, 2, 3], [2, 4]]
    assert rows(st.read("sums"), "epoch", "total") == [(1, 3.0), (2, 10.0), (4, 0.0)]


# ---- streams ----

def land(spark, path, name, data, schema="epoch int, step int, k int, v int"):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    seen = []
    real = jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: (seen.append(df.count()), real(df))[1])

    def call():
        return jobs.ingest_slices(spark, src, spark.read.parquet(src).schema, table, ["epoch", "step", "k"], max_files=1)
    land(spark, src, "a", [(1, 1, 1, 10), (1, 1, 2, 20)])
    land(spark, src, "b", [(1, 2, 1, 30)])
    assert call().count() == 3 and sorted(seen) == [1, 2]
    seen.clear()
    assert call().count() == 3 and seen == []          # nothing has landed
    land(spark, src, "c", [(1, 2, 1, 31), (2, 1, 1, 40), (2, 1, 2, 50)])
    land(spark, src, "d", [(2, 2, 1, 60)])
    assert rows(call(), "epoch", "step", "k", "v") == [(1, 1, 1, 10), (1, 1, 2, 20), (1, 2, 1, 31), (2, 1, 1, 40), (2, 1, 2, 50), (2, 2, 1, 60)]
    assert sorted(seen) == [1, 3]                      # two new files, two files read


def test_a_batch_that_fails_after_its_write_leaves_no_second_row(spark, tmp_path, monkeypatch):
    src, alerts = str(tmp_path / "in"), str(tmp_path / "alerts")
    land(spark, src, "a", [(1, 1, 1, 10)])
    real, calls = Store.commit, []

    def once(self, *a):
        out = real(self, *a)
        calls.append(out)
        if len(calls) == 1:
            raise OSError("lost after the commit")
        return out
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", once)
        with pytest.raises(Exception, match="lost after the commit"):
            jobs.drift_monitor(spark, src, ["epoch", "step", "w"], alerts)
        out = jobs.drift_monitor(spark, src, ["epoch", "step", "w"], alerts)
    assert calls == [True, False]                      # the second try found the batch in the ledger
    assert [(r.new_columns, r.dropped_columns, r.epoch) for r in out.collect()] == [("k,v", "w", 1)]
    land(spark, src, "b", [(2, 1, 1, 10)])
    assert jobs.drift_monitor(spark, src, ["epoch", "step", "w"], alerts).count() == 2


def test_monitor_reads_new_files_only(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "seg string, epoch int, step int, y double, pred double"

    def call():
        out = jobs.error_monitor(spark, src, spark.read.parquet(src).schema, log, ["seg"], "y", "pred", 2.0, max_files=1)
        return {(r.epoch, r.step): (r.mae, r.n, r.alert) for r in out.collect()}
    land(spark, src, "a", [("a", 1, 1, 0.0, 1.0)], schema)
    assert call() == {(1, 1): (1.0, 1, False)}
    version = max(Store(spark, log).versions())
    assert call() == {(1, 1): (1.0, 1, False)} and max(Store(spark, log).versions()) == version
    land(spark, src, "b", [("a", 1, 1, 0.0, 2.0), ("a", 2, 1, 0.0, 5.0)], schema)
    assert call() == {(1, 1): (1.5, 2, False), (2, 1): (5.0, 1, True)}
