"""File headers by their first line only, schema eras in one scan, files passed over."""

from pyspark.sql import functions as F

from stepwise.sources import files as SF


def bytes_read(spark):
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(stats.get(i).getBytesRead() for i in range(stats.size()) if stats.get(i).getScheme() == "file")


def test_headers_read_no_more_of_a_large_file(spark, tmp_path):
    sizes = {}
    for name, rows in (("small", 10), ("large", 3_000_000)):
        d = tmp_path / name
        d.mkdir()
        (d / "x.csv").write_text("id,goals\n" + "12345,67890\n" * rows)
        before = bytes_read(spark)
        assert [r.header for r in SF.file_headers(spark, str(d)).collect()] == ["id,goals"]
        sizes[name] = bytes_read(spark) - before
    assert (tmp_path / "large" / "x.csv").stat().st_size > 30_000_000
    assert sizes["large"] < 2_000_000


def test_eras_quotes_and_odd_paths(spark, tmp_path):
    for season, text in (("2019-20", 'id,"goals"\n1,"2"\n'), ("2020 21+", "﻿xg,id\r\n0.5,1\r\n0.7,2\r\n"), ("2021-22", "id\n"), ("2022%41", 'name,id\n"a,b",9\n')):
        d = tmp_path / "in" / season
        d.mkdir(parents=True)
        (d / "p.csv").write_bytes(text.encode())
    df, missing = SF.read_labelled(spark, str(tmp_path / "in"), "p.csv", r"/in/([^/]+)/", "season", ["2019-20", "2021-22", "2030"])
    assert missing == ["2030"]
    got = {(r.season, r.id, r.goals, r.xg, r.name) for r in df.select("season", "id", "goals", "xg", F.col("name")).collect()}
    assert got == {("2019-20", "1", "2", None, None), ("2020 21+", "1", None, "0.5", None), ("2020 21+", "2", None, "0.7", None), ("2022%41", "9", None, None, "a,b")}


def test_bad_files_are_named_and_passed_over(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,v\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n5,6\n")
    (tmp_path / "other.csv").write_text("id,w\n3,4\n")
    (tmp_path / "note.txt").write_text("no csv\n")
    headers = SF.file_headers(spark, str(tmp_path))
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in SF.bad_files(headers, ["id", "v"]).collect()}
    assert bad == {"empty.csv": "no header line", "blank.csv": "no header line", "other.csv": "lacks v"}
    df, _ = SF.read_labelled(spark, str(tmp_path), "*.csv", r"/(\w+)\.csv", "file", required=["id", "v"], headers=headers)
    assert [(r.file, r.id, r.v) for r in df.collect()] == [("good", "1", "2")]


def test_no_file(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\n")
    df, missing = SF.read_labelled(spark, str(tmp_path), "*.csv", "(x)", "label", ["a"])
    assert df.count() == 0 and missing == ["a"]
