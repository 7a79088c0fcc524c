"""Sources and sinks: what is refused, and what is never overwritten."""

import json

import pytest

from moments.sources import documents as D
from moments.sources import sinks, text


def lines(spark, *rows):
    return spark.createDataFrame([("d", k, x) for k, x in enumerate(rows)], "doc string, ord int, line string")


def test_protocol(spark):
    photos, dist = D.protocol_photos(D.protocol(lines(spark, "PHOTO\t3\t0.1", "I\t0\t0.5\t0.25\t100\t", "I\t1\t1\t0\t1\t0.75", "D\t0\t1\t0.5")))
    assert [tuple(r) for r in photos.orderBy("idx").collect()] == [("d", 0, 0.5, 0.25, 100, None), ("d", 1, 1.0, 0.0, 1, 0.75)] and dist.first().d == 0.5
    assert [r.tag for r in D.protocol(lines(spark, "VIDEO\t3\t0.1\t60\t15\t0.5", "F\t0\t1.5\t0.5\t", "B\t7")).orderBy("ord").collect()] == ["VIDEO", "F", "B"]


@pytest.mark.parametrize(
    "rows",
    [
        ("I\t0\t0.5\t0.25\t100\t",), ("PHOTO\t3\t0.1", ""), ("PHOTO\t3\t0.1", "PHOTO\t3\t0.1"), ("PHOTO\t3\t0.1", "B\t7"), ("PHOTO\t2001\t0.1",), ("PHOTO\t3\t-0.1",), ("PHOTO\t3\tNaN",), ("PHOTO\t3.0\t0.1",),
        ("PHOTO\t3\t0.1", "I\t-1\t0.5\t0.5\t10\t"), ("PHOTO\t3\t0.1", "I\t1\t1.5\t0.5\t10\t"), ("PHOTO\t3\t0.1", "I\t1\t0.5\t0.5\t0\t"), ("PHOTO\t3\t0.1", "I\t1\t0.5\t0.5\t10"), ("PHOTO\t3\t0.1", "D\t0\t1"),
        ("photo\t3\t0.1",), ("VIDEO\t3\t0.1\t0\t15",), ("VIDEO\t3\t0.1\t60\t15\t",), ("VIDEO\t3\t0.1\t60\t15", "I\t0\t0.5\t0.25\t100\t"), ("PHOTO\t3\t0.1" + " " * 300,), ("PHOTO\t3\t0x1",),
    ],
)
def test_protocol_refuses(spark, rows):
    with pytest.raises(Exception, match="bad line"):
        D.protocol(lines(spark, *rows)).collect()


def test_too_many_records(spark):
    with pytest.raises(Exception, match="bad line"):
        D.protocol(lines(spark, "VIDEO\t3\t0.1\t60\t15", *["B\t7"] * 2001)).collect()


def test_strict_json(spark):
    df = lambda *x: spark.createDataFrame([(k, v) for k, v in enumerate(x)], "n int, j string")
    assert [tuple(r) for r in D.strict_json(df('{"a": 1, "b": 0.5}', '{"a": 2}'), "j", "a long, b double").collect()] == [(0, 1, 0.5), (1, 2, None)]
    for bad in ('{"a": "x"}', '{"a": 1, "c": 2}', "[1]", None, '{"b": NaN}', '{"a": 1' + " " * 2000 + "}"):
        with pytest.raises(Exception):  # noqa: B017
            D.strict_json(df(bad), "j", "a long, b double", 1000).collect()
    with pytest.raises(Exception, match="repeated"):
        D.unique_ids(spark.createDataFrame([(1,), (1,)], "n int"), "n").collect()


def test_fixture_files(spark, tmp_path):
    doc = {"id": "x", "defaults": {"w": 0.2}, "samples": [{"t": 0.0, "w": 0.5}, {"t": 1.0}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    got = D.fixtures(spark, str(tmp_path / "a.json"), "id string, defaults struct<w:double>, samples array<struct<t:double,w:double>>")
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [("x", 0, 0.0, 0.5), ("x", 1, 1.0, 0.2)]


def test_write_new(spark, tmp_path):
    sinks.write_new(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(FileExistsError):
        sinks.write_new(spark.range(9), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_label_log(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "id long, label string, log_order long"
    sinks.add_labels(spark.createDataFrame([(1, "putter", 1), (2, "iron", 2)], schema), log)
    sinks.add_labels(spark.createDataFrame([(1, "non-shot", 3)], schema), log)
    assert {r.id: r.label for r in text.latest_labels(spark.read.parquet(log)).collect()} == {1: "non-shot", 2: "iron"}


def test_numbers_that_are_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="finite"):
        df.select(sinks.finite(df.x)).collect()
