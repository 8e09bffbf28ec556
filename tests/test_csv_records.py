"""CSV records over many lines: split reading against the csv module."""

import csv
import io
import random

import pytest

from truegauge.sources import csv_records, files

FIELDS = ["a", "", "two\nlines", 'say ""hi""', "x,y", "\n\n", 'end"" quote', "é;|", ",", '""', "\r\n", " lead", "ü" * 50, "line\n,\"\",\nline"]


def quoted(field):
    return f'"{field}"'


def make(seed, rows=400):
    rng = random.Random(seed)
    out = ["id,note,rest"]
    for i in range(rows):
        fields = [str(i), quoted(rng.choice(FIELDS)), rng.choice(["plain", quoted("q"), quoted("a\nb"), "", '5" pipe'])]
        out.append(",".join(fields))
        if rng.random() < 0.05:
            out.append("")
    return "\n".join(out) + "\n" * rng.randrange(2)


def plain(text):
    return list(csv.reader(io.StringIO(text, newline="")))


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_records_over_many_splits(spark, tmp_path, small_splits, seed):
    text = make(seed)
    path = tmp_path / "data.csv"
    path.write_bytes(text.encode())
    assert csv_records.lines(spark, str(path), "UTF-8").select("block").distinct().count() > 10
    found = [(tuple(next(csv.reader(io.StringIO(r.record, newline="")))), r.first) for r in csv_records.records(spark, str(path), ",", "UTF-8").collect()]
    want = [(tuple(r), n == 0) for n, r in enumerate(plain(text)) if r]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_dataset_from_several_files(spark, tmp_path, small_splits, encoding):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    want = []
    for n in range(3):
        text = make(10 + n, 60)
        (folder / f"{n}.csv").write_bytes(text.encode(encoding.lower()))
        want += [(r[0], r[1]) for r in plain(text)[1:] if r]
    layout = files.detect_layout(spark, str(folder))
    assert layout == files.Layout(",", encoding, True)
    df = files.read_csv(spark, str(folder), layout=layout, infer=False)
    got = [(r["id"], r["note"] or "") for r in df.collect()]
    assert sorted(got) == sorted((i, "" if n in files.NA_TOKENS else n) for i, n in want)
    # One task per split, not one per file.
    assert csv_records.lines(spark, str(folder), encoding).rdd.getNumPartitions() >= 6


def test_field_over_whole_splits_long_lines_and_bad_lines(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, with \"\"signs\"\"" for i in range(300))
    text = f'id,note\r\n1,"{long}"\r\n2,x,too many\r\n\r\n3\r\n4,"{"y" * 5000}"\r\n5,"a\r\nb"\r\n'
    path = tmp_path / "long.csv"
    path.write_bytes(text.encode())
    rows = {r["id"]: r["note"] for r in files.read_csv(spark, str(path)).collect()}
    assert rows == {1: long.replace('""', '"'), 3: None, 4: "y" * 5000, 5: "a\r\nb"}


def test_a_field_that_never_closes(spark, tmp_path, small_splits):
    path = tmp_path / "open.csv"
    path.write_text("a,b\n1,\"x\ny\"\n2,\"never\nends\n3,z\n")
    found = sorted(r.record for r in csv_records.records(spark, str(path), ",", "UTF-8").collect())
    assert found == ['1,"x\ny"', '2,"never\nends\n3,z', "a,b"]


def test_a_split_is_worked_on_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_records, "SLICE_LINES", 2)
    text = make(5, 80) + '7,"over\n\n\nmany\nmore\nlines\nthan\na\nslice"\n'
    path = tmp_path / "slices.csv"
    path.write_bytes(text.encode())
    rows = csv_records.lines(spark, str(path), "UTF-8")
    assert rows.groupBy(*csv_records.SPLIT).count().where("count > 4").isEmpty()
    found = csv_records.records(spark, str(path), ",", "UTF-8").collect()
    assert sum(r["first"] for r in found) == 1
    assert sorted(next(csv.reader(io.StringIO(r.record, newline=""))) for r in found) == sorted(r for r in plain(text) if r)
