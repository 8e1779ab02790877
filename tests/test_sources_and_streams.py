import gzip
import zipfile

import pytest

from plumbline.session import checkpoint_folder
from plumbline.sources import readers, writers
from plumbline.streaming import feeds


def test_csv_keeps_leading_zeros_and_na(spark, tmp_path):
    df = spark.createDataFrame([("007", "NA", None), ("1", "", 'say "x", y'), ("1", "", 'say "x", y')], "id string, code string, note string")
    path = str(tmp_path / "release")
    writers.write_release(df, path, ["id", "code", "note"])
    assert writers.verify_csv_round_trip(spark, df, path)
    assert not writers.verify_csv_round_trip(spark, df.limit(2), path)
    assert {r["code"] for r in readers.read_csv_exact(spark, path, ["id"]).collect()} == {"NA", None}
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv_exact(spark, path, ["nope"])


def test_cut_off_json_lines(spark, tmp_path):
    lines = "\n".join(f'{{"id": "{i}", "n": {i}}}' for i in range(20_000))
    whole = gzip.compress(lines.encode())
    (tmp_path / "a.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "b.json").write_text('{"id": "x", "n": 1}\nbroken\n{"id": "x", "n": 3}')
    df = readers.read_jsonl(spark, str(tmp_path), "id string, n int")
    got = df.collect()
    assert 1000 < len(got) < 20_002
    latest = {r["id"]: r["n"] for r in readers.latest_version(df, "id", ["n"]).collect()}
    assert latest["x"] == 3


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "id,code,extra\n007,NA,1\n2,,1\n")
        z.writestr("two.csv", "id\n3\n")
        z.writestr("readme.txt", "no")
    got = sorted(map(tuple, readers.read_zipped_csv(spark, str(tmp_path), ["id", "code"]).collect()), key=str)
    assert got == [("007", "NA"), ("2", None), ("3", None)]
    with pytest.raises(Exception, match="lacks"):
        readers.read_zipped_csv(spark, str(tmp_path), ["id", "code"], ["code"]).collect()


def test_any_encoding_and_header_row(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("Title,,\nProject,Cost £m,Department\nCafé,3,x\n".encode("cp1252"))
    (tmp_path / "u.csv").write_bytes("﻿Project,Department\nÉ,y\n".encode())
    cells = readers.read_csv_any_encoding(spark, str(tmp_path))
    heads = {r["path"][-5:]: r["header_line"] for r in readers.header_row(cells, ["project", "cost", "department"]).collect()}
    assert heads == {"w.csv": 1, "u.csv": 0}
    assert any("Café" in r["cells"] for r in cells.collect())


def test_texts_types_gaps_and_schemas(spark, tmp_path):
    (tmp_path / "P1.txt").write_text("line one\nline two")
    assert [tuple(r) for r in readers.read_texts(spark, str(tmp_path)).collect()] == [("P1", "line one\nline two")]
    df = spark.createDataFrame([("1", "x"), ("2.5", "2020-01-02")], "n string, d string")
    assert [tuple(r) for r in readers.coerce(df, {"n": "int", "d": "date"}).selectExpr("n", "cast(d as string)").collect()] == [(1, None), (None, "2020-01-02")]
    years = spark.createDataFrame([(2010,), (2013,), (None,)], "y int")
    assert sorted(r[0] for r in readers.years_missing(years, "y").collect()) == [2011, 2012]
    assert readers.schema_difference(df, {"n": "string", "z": "int"}) == [("d", None, "string"), ("z", "int", None)]


def test_tables_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020), (2, 2021)], "i int, y int")
    writers.write_table(df, str(tmp_path / "t"), ["y"])
    assert spark.read.parquet(str(tmp_path / "t")).where("y = 2021").count() == 1
    old = spark.createDataFrame([("a", 5, None), ("b", 6, "bad"), ("c", 7, None)], "k string, n int, error string")
    new = spark.createDataFrame([("a", 0, "failed"), ("b", 8, None), ("d", 9, "x")], "k string, n int, error string")
    assert {r["k"]: r["n"] for r in writers.merge_manifest(old, new, "k").collect()} == {"a": 5, "b": 8, "c": 7, "d": 9}
    writers.record_timing(str(tmp_path / "t.json"), "one", 1.5)
    writers.record_timing(str(tmp_path / "t.json"), "two", 2.0, rows=3)
    assert "one" in (tmp_path / "t.json").read_text() and "two" in (tmp_path / "t.json").read_text()


@pytest.fixture
def feed(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", f"u{i % 4}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, at string, user string, v double").selectExpr("id", "cast(at as timestamp) as at", "user", "v")
    for part in range(4):
        df.where(f"id % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return df, str(tmp_path / "feed")


def test_streams_equal_batches(spark, feed):
    batch, folder = feed
    stream = lambda: feeds.read_feed(spark, folder, batch.schema, 1)
    want = sorted(map(tuple, feeds.windowed_counts(batch, "at", ["user"]).collect()))
    assert sorted(map(tuple, feeds.run_once(feeds.windowed_counts(stream(), "at", ["user"], late="30 days"), "w1").collect())) == want
    once = feeds.run_once(feeds.deduplicated(stream().union(stream()), "at", ["id"], "30 days"), "w2", "append")
    assert once.count() == 40


def test_running_counts_keep_state(spark, feed):
    batch, folder = feed
    out = feeds.run_once(feeds.running_counts(feeds.read_feed(spark, folder, batch.schema, 1), "user", "at", "v"), "w3", "update")
    top = {r["user"]: r["m"] for r in out.groupBy("user").agg({"n_so_far": "max"}).withColumnRenamed("max(n_so_far)", "m").collect()}
    assert top == {"u0": 10, "u1": 10, "u2": 10, "u3": 10}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    assert checkpoint_folder("file:///shared", "spark://host:7077") == "file:///shared" and checkpoint_folder(None, "local[4]")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_folder(None, master)
