"""Readers: layouts, bad lines, null tokens, wrapped and broken JSON, profiles."""

import json

import pytest

from truegauge.sources import files, profiles
from truegauge.sources.files import InvalidInput, read_csv, read_dataset, read_json


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_clean_csv(spark, tmp_path):
    path = put(tmp_path, "people.csv", "id, name ,age,email\n1,Alice,30,a@x.com\n2,Bob,25,b@x.com\n3,Carol,41,c@x.com\n")
    df = read_csv(spark, path)
    assert df.columns == ["id", "name", "age", "email"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "age": "bigint", "email": "string"}
    assert df.count() == 3


def test_ragged_lines(spark, tmp_path):
    path = put(tmp_path, "ragged.csv", "col1,col2\n1,2\n3,4,5\n6\n")
    rows = {tuple(r) for r in read_csv(spark, path).collect()}
    assert rows == {(1, 2), (6, None)}


def test_latin1(spark, tmp_path):
    path = put(tmp_path, "names.csv", b"name,age\nJ\xf6rg,30\n")
    layout = files.detect_layout(spark, path)
    assert layout.encoding == "ISO-8859-1"
    assert read_csv(spark, path).first()["name"] == "Jörg"


@pytest.mark.parametrize("sep", [";", "\t", "|", ","])
def test_delimiters(spark, tmp_path, sep):
    path = put(tmp_path, "sep.csv", f"a{sep}b\n1{sep}x,y\n2{sep}z\n" if sep != "," else "a,b\n1,x\n2,z\n")
    assert files.detect_delimiter(spark, path) == sep
    assert read_csv(spark, path).columns == ["a", "b"]


def test_quoted_newline_and_delimiter(spark, tmp_path):
    path = put(tmp_path, "quoted.csv", 'id,note\n1,"two\nlines, one field"\n2,"say ""hi"""\n')
    layout = files.detect_layout(spark, path)
    assert layout.multi_line and layout.delimiter == ","
    notes = {r["id"]: r["note"] for r in read_csv(spark, path).collect()}
    assert notes == {1: "two\nlines, one field", 2: 'say "hi"'}


def test_null_tokens_and_types(spark, tmp_path):
    path = put(tmp_path, "na.csv", "i,f,b,s\n1,1.5,True,x\nNA,n/a,False,NULL\n<NA>,nan,,None\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string"}
    assert df.where("i is null and f is null and s is null").count() == 2


def test_declared_schema(spark, tmp_path):
    path = put(tmp_path, "typed.csv", "id,score\n1,9.5\nx,bad\n")
    df = read_csv(spark, path, schema=spark.createDataFrame([], "id int, score double").schema)
    assert {tuple(r) for r in df.collect()} == {(1, 9.5), (None, None)}


def test_empty_csv(spark, tmp_path):
    with pytest.raises(InvalidInput, match="empty"):
        read_csv(spark, put(tmp_path, "empty.csv", ""))


def test_json_records(spark, tmp_path):
    path = put(tmp_path, "r.json", json.dumps([{"id": 1, "name": "a", "price": 2.5}, {"id": 2, "name": "b", "price": 3}]))
    assert sorted(read_json(spark, path).columns) == ["id", "name", "price"]
    assert read_json(spark, path).count() == 2


@pytest.mark.parametrize("key", ["data", "records", "results", "items"])
def test_json_wrapped(spark, tmp_path, key):
    path = put(tmp_path, "w.json", json.dumps({"status": "ok", key: [{"id": 1, "val": 2}, {"id": 2, "val": 3}]}))
    df = read_json(spark, path)
    assert sorted(df.columns) == ["id", "val"] and df.count() == 2


def test_json_wrapper_order(spark, tmp_path):
    path = put(tmp_path, "o.json", json.dumps({"items": [{"x": 1}], "data": "text", "records": [{"y": 1}, {"y": 2}]}))
    assert read_json(spark, path).columns == ["y"]


def test_json_single_object_and_nesting(spark, tmp_path):
    path = put(tmp_path, "n.json", json.dumps({"a": {"b": {"c": 1}, "d": [1, 2]}, "e": "x"}))
    df = read_json(spark, path)
    assert sorted(df.columns) == ["a.b.c", "a.d", "e"]
    assert df.select("`a.b.c`").first()[0] == 1


@pytest.mark.parametrize(
    "text, reason",
    [("", "empty"), ('{"id": 1, "na', "Invalid JSON"), ("[]", "no records"), ('{"data": []}', "no records"), ("[{}]", "tabular")],
)
def test_json_rejected(spark, tmp_path, text, reason):
    with pytest.raises(InvalidInput, match=reason):
        read_json(spark, put(tmp_path, "bad.json", text))


def test_json_lines(spark, tmp_path):
    path = put(tmp_path, "l.json", '{"id": 1}\n{"id": 2}\n')
    assert read_json(spark, path, lines=True).count() == 2


def test_json_lines_are_recognised(spark, tmp_path):
    path = put(tmp_path, "five.json", "".join(f'{{"id": {n}}}\n' for n in range(5)))
    assert read_dataset(spark, path).count() == 5


def test_json_documents_of_all_kinds_in_one_folder(spark, tmp_path):
    folder = tmp_path / "all.json"
    folder.mkdir()
    put(folder, "a.json", '[{"id": 1},\n {"id": 2}]')
    put(folder, "b.json", '{"data": [{"id": 3}]}\n{"records": [{"id": 4}, {"id": 5}]}\n{"id": 6}\n')
    put(folder, "c.json", '{\n "items": [{"id": 7}]\n}')
    assert sorted(r["id"] for r in read_dataset(spark, str(folder)).collect()) == list(range(1, 8))


def test_json_values_of_differing_types_are_kept(spark, tmp_path):
    texts = ['{"a": 1, "b": {"c": 2.5, "d": null}, "e": [1, "x"]}', '[{"a": "s", "b": {"c": 3}}, null, {"a": {"z": [1]}, "w \\"q": true}]', '{"data": [{"a": null, "b": 7}]}']
    df = read_json(spark, put(tmp_path, "mixed.json", "\n".join(texts)))
    # One record has a scalar where others have an object: the whole cell is text.
    assert sorted(df.columns) == ["a", "b", "e", 'w "q'] and df.count() == 4
    assert sorted(str(r["a"]) for r in df.collect()) == ["1", "None", "s", '{"z":[1]}']
    assert {r["b"] for r in df.collect()} == {'{"c":2.5,"d":null}', '{"c":3}', "7", None}
    assert [r["e"] for r in df.where("e is not null").collect()] == [["1", "x"]]
    assert dict(df.dtypes)['w "q'] == "boolean"


def test_json_scalars_in_a_list_are_no_records(spark, tmp_path):
    for text in ("[1, 2]", '["a", {"b": 1}]'):
        with pytest.raises(InvalidInput, match="array of objects"):
            read_json(spark, put(tmp_path, "scalars.json", text))


def test_json_schema_given_and_torn_files_over_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        folder = tmp_path / "torn.json"
        folder.mkdir()
        put(folder, "a.json", json.dumps([{"id": n, "v": {"x": n / 2}} for n in range(200)], indent=1))
        put(folder, "b.json", "".join(json.dumps({"id": 200 + n}) + "\n" for n in range(200)))
        df = read_json(spark, str(folder))
        assert dict(df.dtypes) == {"id": "bigint", "v.x": "double"}
        assert sorted(r["id"] for r in df.collect()) == list(range(400))
        schema = spark.createDataFrame([], "id string, v struct<x: double, y: string>").schema
        typed = read_json(spark, str(folder), schema=schema)
        assert typed.columns == ["id", "v.x", "v.y"] and typed.where("id = '7' and `v.x` = 3.5 and `v.y` is null").count() == 1
        assert read_json(spark, str(folder / "b.json"), lines=True).count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_surplus_field_and_stray_quote(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'a,b\n1,2\n3,4,\n5,"x, ""y"""\n6\n7,5" pipe\n8,9,10\n')
    assert sorted(map(tuple, read_csv(spark, path).collect())) == [(1, "2"), (5, 'x, "y"'), (6, None), (7, '5" pipe')]
    assert not files.detect_layout(spark, path).multi_line


def test_nineteen_digits_stay_whole(spark, tmp_path):
    assert read_csv(spark, put(tmp_path, "n.csv", "a\n1234567890123456789\n")).first()[0] == 1234567890123456789
    assert isinstance(read_csv(spark, put(tmp_path, "m.csv", "a\n9999999999999999999\n")).first()[0], float)


def test_dispatch_and_profile(spark, tmp_path):
    good = put(tmp_path, "good.csv", "id,name\n1,a\n2,b\n")
    bad = put(tmp_path, "bad.json", "{")
    other = put(tmp_path, "sheet.xlsx", "x")
    rows = {r["name"]: r for r in profiles.profile_many(spark, [good, bad, other]).collect()}
    assert rows["good"]["status"] == "PENDING" and rows["good"]["row_count"] == 2
    assert json.loads(rows["good"]["column_names"]) == ["id", "name"]
    assert rows["good"]["dtypes"] == {"id": "bigint", "name": "string"}
    assert rows["bad"]["status"] == "ERROR" and "JSON" in rows["bad"]["error"]
    assert rows["sheet"]["status"] == "ERROR"
    assert files.dataset_name(good) == "good"


def test_parquet(spark, data):
    assert read_dataset(spark, f"{data}/nation.parquet").count() == 25
