"""Readers, writers and manifests on small files."""

import pytest

from fleetseries.sources import tables


def put(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_raw_files(spark, tmp_path):
    path = put(tmp_path / "raw", m1__csv="timestamp,value,label\n1,2.5,1\n2,NaN,\n3,,0\n", m2__csv="timestamp,value,label\n9,1,0\n")
    got = sorted((tuple(r) for r in tables.read_raw_csv(spark, path).collect()), key=str)
    assert got == [("m1", 1, 2.5, 1), ("m1", 2, None, 0), ("m1", 3, None, 0), ("m2", 9, 1.0, 0)]


def test_value_files_of_one_or_many_lines(spark, tmp_path):
    path = put(tmp_path / "values", a_x_2_1_2__txt="1\n2\n3\n4\n", b_1_0_0__txt="  5e0   6 7\n")
    got = sorted(tuple(r) for r in tables.read_value_text(spark, path).collect())
    assert got == [("a_x", 2, 0, 1.0, 0), ("a_x", 2, 1, 2.0, 1), ("a_x", 2, 2, 3.0, 1), ("a_x", 2, 3, 4.0, 0), ("b", 1, 0, 5.0, 1), ("b", 1, 1, 6.0, 0), ("b", 1, 2, 7.0, 0)]


def test_records_and_logs(spark, tmp_path):
    path = put(tmp_path / "run7", r__json='{"arm":"a","value":1.5}\n{"arm":"b","val\n{"arm":"c","value":2}\n')
    assert sorted(tuple(r) for r in tables.read_records(spark, path, "arm string, value double").collect()) == [("a", 1.5, "run7"), ("c", 2.0, "run7")]
    path = put(tmp_path / "logs", x__log="start\nepoch=1 step=5 train_loss=0.5\nepoch: 1 step: 10 train_loss: 1e-1 val_loss=0.25\nepoch=2 step=11 val_loss=3\n")
    got = sorted(tuple(r) for r in tables.last_steps(tables.read_training_log(spark, path)).collect())
    assert got == [("x", 1, 10.0, 0.1, 0.25), ("x", 2, 11.0, None, 3.0)]


def test_saved_splits(spark, tmp_path):
    series = spark.createDataFrame([("e1", "train", 0, 1.0), ("e2", "train", 0, 2.0), ("e1", "test", 0, 3.0)], "entity string, split string, t long, value double")
    path = str(tmp_path / "series")
    tables.save_series(series, path, "d")
    assert sorted(r.value for r in tables.load_split(spark, path, "d", "train").collect()) == [1.0, 2.0]
    assert [r.value for r in tables.load_split(spark, path, "d", "train", ["e2"]).collect()] == [2.0]
    assert tables.load_split(spark, path, "d", "val").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        tables.load_split(spark, path, "d", "train", ["e2", "e9"])
    with pytest.raises(ValueError, match="split"):
        tables.load_split(spark, path, "d", "best")


def test_drift_of_two_folders(spark, tmp_path):
    old = tables.manifest(spark, put(tmp_path / "old", same__txt="x", other__txt="abc", less__txt="1"))
    new = tables.manifest(spark, put(tmp_path / "new", same__txt="x", other__txt="abcde", more__txt="z"))
    assert sorted(tuple(r) for r in tables.drift(old, new).collect()) == [("less", "missing", None), ("more", "extra", None), ("other", "drift", 2), ("same", "ok", 0)]


def test_wide(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("y", "a", 3.0)], "r string, c string, v double")
    assert sorted(tuple(r) for r in tables.wide(df, "r", "c", "v").select("r", "a", "b").collect()) == [("x", 1.0, 2.0), ("y", 3.0, None)]
