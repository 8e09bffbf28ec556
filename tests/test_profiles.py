"""Profiles of many files in a fixed number of jobs."""

import json
import uuid

from truegauge.sources import csv_records, files
from truegauge.sources.profiles import profile_many


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(spark, paths):
    return {r["path"]: r for r in profile_many(spark, paths).collect()}


def jobs(spark, paths):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "profile")
    try:
        found = profile_many(spark, paths).collect()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_each_file_has_its_own_layout_and_types(spark, tmp_path):
    a = put(tmp_path, "a.csv", "id, name ,id\n1,x,2.5\n2,\"two\nlines; one\",NA\n3,y,7,surplus\n4\n")
    b = put(tmp_path, "b.csv", b"n;ok\nJ\xf6rg;True\nx;False\n")
    c = put(tmp_path, "c.csv", "p|q\n|\n\n")
    d = put(tmp_path, "d.json", json.dumps([{"x": {"y": 1}, "z": [1.5]}, {"x": {"y": "s"}}], indent=1))
    e = put(tmp_path, "e.json", '{"m": 1}\n{"m": 2.5}\n{"m": null}\n')
    folder = tmp_path / "parts.csv"
    put(folder, "1.csv", "k,v\n1,a\n"), put(folder, "2.csv", "k,v\n2,b\n3,c\n")
    found = rows(spark, [a, b, c, d, e, str(folder)])
    assert all(r["status"] == "PENDING" for r in found.values()), found
    told = {p: (r["row_count"], json.loads(r["column_names"]), r["dtypes"]) for p, r in found.items()}
    assert told[a] == (3, ["id", "name", "id.1"], {"id": "bigint", "name": "string", "id.1": "double"})
    assert told[b] == (2, ["n", "ok"], {"n": "string", "ok": "boolean"})
    assert told[c] == (1, ["p", "q"], {"p": "string", "q": "string"})
    assert told[d] == (2, ["x.y", "z"], {"x.y": "string", "z": "array<double>"})
    assert told[e] == (3, ["m"], {"m": "double"})
    assert told[str(folder)] == (3, ["k", "v"], {"k": "bigint", "v": "string"})


def test_profile_agrees_with_the_readers(spark, data, tmp_path):
    paths = []
    for n, name in enumerate(("customer", "orders", "events")):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        path = f"{tmp_path}/{name}.csv"
        df.write.options(header=True, sep=",;|"[n], escape='"').csv(path)
        paths.append(path)
    for path, r in rows(spark, paths).items():
        df = files.read_csv(spark, path)
        assert (r["row_count"], json.loads(r["column_names"]), r["dtypes"]) == (df.count(), df.columns, dict(df.dtypes))


def test_errors_come_from_the_same_pass(spark, tmp_path):
    good = put(tmp_path, "good.csv", "a\n1\n")
    bad = {
        put(tmp_path, "empty.csv", ""): "completely empty",
        put(tmp_path, "empty.json", ""): "completely empty",
        put(tmp_path, "cut.json", '{"a": '): "Invalid JSON",
        put(tmp_path, "none.json", "[]"): "no records",
        put(tmp_path, "scalars.json", "[1]"): "array of objects",
        put(tmp_path, "sheet.xlsx", "x"): "Unsupported",
        f"{tmp_path}/missing.csv": "PATH_NOT_FOUND",
    }
    found = rows(spark, [good, *bad])
    assert found[good]["status"] == "PENDING"
    for path, reason in bad.items():
        assert found[path]["status"] == "ERROR" and reason in found[path]["error"], (path, found[path])


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    few, many = [], []
    for n in range(24):
        csv = put(tmp_path, f"f{n}.csv", "a,b\n" + f"{n},x\n" * (n + 1))
        doc = put(tmp_path, f"f{n}.json", f'{{"a": {n}}}\n' * (n + 1))
        many += [csv, doc]
        if n < 2:
            few += [csv, doc]
    _, first = jobs(spark, few)
    found, second = jobs(spark, many)
    assert [r["row_count"] for r in found] == [n + 1 for n in range(24) for _ in range(2)]
    assert second <= first + 4


def test_lines_that_are_records_are_not_put_together(spark, tmp_path, monkeypatch):
    (tmp_path / "plain.csv").write_text('\na;b\r\n1;"x;""y"""\r\n\r\n2;z;\r\n3;w\r\n')
    monkeypatch.setattr(csv_records, "assemble", None)
    row = profile_many(spark, [str(tmp_path / "plain.csv")]).first()
    assert (row.status, row.row_count, row.column_count, row.dtypes["a"]) == ("PENDING", 2, 2, "bigint")
