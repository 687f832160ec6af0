"""CSV files of odd shapes: quoting, line ends in fields, heads, short rows, archives, YAML heads, types that hold all rows."""

import datetime as dt
import gzip
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from slate.sources import csv

INF = float("inf")


@pytest.fixture
def read(spark, tmp_path):
    def run(text, name="t.csv", **kw):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        df = csv.read_csv(spark, str(path), **kw)
        return df.dtypes, [tuple(r) for r in df.collect()]

    return run


def test_short_and_long_rows(read):
    assert read("a,b,c,d\n1,2\n1,2\n3,4,5,6\n") == ([(n, "int") for n in "abcd"], [(1, 2, None, None), (1, 2, None, None), (3, 4, 5, 6)])
    types, rows = read("a,b\n1,2\n" + "3,4\n" * 300 + "5,6,x,7\n")
    assert types == [("a", "int"), ("b", "int"), ("V3", "string"), ("V4", "int")] and rows[-1] == (5, 6, "x", 7) and len(rows) == 302
    with pytest.raises(ValueError, match="fields"):
        read("a,b\n1,2\n1\n", fill=False)
    assert read("a,b\n1,2\n", fill=4)[0] == [("a", "int"), ("b", "int"), ("V3", "string"), ("V4", "string")]


def test_blank_lines_comments_and_spaces(read):
    assert read("a\tb\n1\t1\n2\t2\n\n3\t3\n")[1] == [(1, 1), (2, 2), (3, 3)]
    assert read("# about\na,b\n1,2\n# more\n3,4\n", comment="#")[1] == [(1, 2), (3, 4)]
    types, rows = read("D1   T1  N1    D2  T2   N2\n2015-11-01   00:00:01  32\n2015-11-02 01:13:16   253  2015-11-03   01:13:25 511\n")
    assert [n for n, _ in types] == ["D1", "T1", "N1", "D2", "T2", "N2"] and rows[0][2:4] == (32, None) and rows[1][3] == dt.date(2015, 11, 3)


def test_quoting(read):
    json = '{"f1":"v","f2":"[ \\" ]"}'
    doubled = json.replace('"', '""')
    assert read(f'json1, string1\n"{doubled}", "a, b"\n')[1] == [(json, "a, b")]
    assert read('"No","Comment","Type"\n"0","he said:"wonderful."","A"\n"1","and also "a problem, yes." on","A"\n')[1] == [(0, 'he said:"wonderful."', "A"), (1, 'and also "a problem, yes." on', "A")]
    assert read('a,b\n"x \\"y\\", z",1\n"w",2\n')[1] == [('x "y", z', 1), ("w", 2)]
    assert read("a,b\n'x, y',1\n", quote="'")[1] == [("x, y", 1)]
    assert read('a;b\n5" disk;1\n3" disk;2\n')[1] == [('5" disk', 1), ('3" disk', 2)]
    types, rows = read('John,Doe,"7452 Terrace ""At the Plaza"" road",NJ, 08075\n,Blank,,SD, 00298\n"Joan ""the bone"", Anne",Jet,"9th, at T",CO,00123\n', keep_zeros=True)
    assert rows[2] == ('Joan "the bone", Anne', "Jet", "9th, at T", "CO", "00123") and rows[1][0] is None and types[0] == ("V1", "string")


def test_line_ends_in_fields(read):
    text = "A,B\n" + "1,a\n" * 200 + '2,"two\nlines, and ""more"""\n3,c\n'
    rows = read(text)[1]
    assert len(rows) == 202 and rows[-2:] == [(2, 'two\nlines, and "more"'), (3, "c")]
    assert read(text.replace("\n", "\r\n"))[1][-2] == (2, 'two\nlines, and "more"')


def test_heads(read, spark, tmp_path):
    rows = [(1.5, 'x "y"', None), (2.0, "z", 3)]
    text = 'a note, "of no use"\nanother\na,b,c\n1.5,"x ""y""",\n2,z,3\n'
    assert read(text, skip=2) == ([("a", "double"), ("b", "string"), ("c", "int")], rows)
    assert read(text, skip="a,b")[1] == rows
    with pytest.raises(ValueError, match="skip"):
        read(text, skip="nowhere")
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(7):
        (folder / f"part{k}.csv").write_text(f"made by hand\nk,v\n{k},{k * k}\n{k},x{k}\n")
    df = csv.read_csv(spark, str(folder), skip=1, header=True)
    assert df.count() == 14 and df.dtypes == [("k", "int"), ("v", "string")] and df.where("v = 'x6'").count() == 1
    assert read("﻿a,b\n1,2\n") == ([("a", "int"), ("b", "int")], [(1, 2)])
    assert read("é,ü\nš,1\n")[0] == [("é", "string"), ("ü", "int")]


def test_numbers(read):
    assert read("x;y\n1,5;1\n2,25;2\n")[1] == [(1.5, 1), (2.25, 2)]
    types, rows = read("x\n1.5\n#N/A\n#DIV/0!\n-inf\n0x1.8p1\n1e3\n1.#INF\n")
    assert types == [("x", "double")] and rows[0] == (1.5,) and rows[1] == (None,) and math.isnan(rows[2][0]) and rows[3:] == [(-INF,), (3.0,), (1000.0,), (INF,)]
    assert read("x\n2147483647\n")[0] == [("x", "int")] and read("x\n2147483648\n")[0] == [("x", "bigint")]
    assert read("x\n9223372036854775808\n")[0] == [("x", "double")]
    assert read("x\n5000000000\n", integer64="string")[0] == [("x", "string")]


def test_truth_and_time(read):
    assert read("a,b,c\nTRUE,Y,1\nFALSE,N,0\n", logical_yn=True, logical01=True) == ([(n, "boolean") for n in "abc"], [(True, True, True), (False, False, False)])
    assert read("a,b\nTRUE,Y\nfalse,N\n")[0] == [("a", "string"), ("b", "string")]
    types, rows = read("t,d\n2024-01-02T03:04:05Z,2024-01-02\n2024-01-02 03:04:05.25+02:00,2024-02-30\n")
    assert types == [("t", "timestamp_ntz"), ("d", "string")] and [r[0] for r in rows] == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 1, 4, 5, 250000)]


def test_columns(read):
    text = "a,b,c\n1,x,2.5\n2,y,3.5\n"
    assert read(text, select=["c", 1]) == ([("c", "double"), ("a", "int")], [(2.5, 1), (3.5, 2)])
    assert read(text, drop=[2])[0] == [("a", "int"), ("c", "double")]
    assert read(text, col_names=["p", "q"])[0] == [("p", "int"), ("q", "string"), ("c", "double")]
    assert read(text, nrows=1)[1] == [(1, "x", 2.5)]
    with pytest.raises(ValueError, match="no column"):
        read(text, select=["z"])
    with pytest.warns(UserWarning, match="1 values of c"):
        types, rows = read("c\n1\nx\n", types={"c": "int"})
    assert types == [("c", "string")] and rows == [("1",), ("x",)]


def test_packed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("t.csv", "a,b\n1,2\n3,4\n")
    with gzip.open(tmp_path / "one.csv.gz", "wt") as z:
        z.write("a,b\n1,2\n3,4\n")
    for name in ("one.zip", "one.csv.gz"):
        assert [tuple(r) for r in csv.read_csv(spark, str(tmp_path / name)).collect()] == [(1, 2), (3, 4)]
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("t.csv", "a\n1\n")
        z.writestr("u.csv", "a\n1\n")
    with pytest.raises(Exception, match="2 files"):
        csv.read_csv(spark, str(tmp_path / "two.zip"))


YAML = "---\nname:\nschema:\n  fields:\n  - name: var1\n    title: variable 1\n    type: string\n  - name: var2\n    type: integer\n  - name: var3\n    type: number\nheader: true\nsep: \"|\"\ndec: \",\"\nquote: \"'\"\nna.strings: '@'\n---\n"


def test_yaml_heads(read):
    body = "var1|var2|var3\n'A'|1|2,5\n'B'|@|4,3\n"
    assert read(YAML + body, csvy=True) == ([("var1", "string"), ("var2", "int"), ("var3", "double")], [("A", 1, 2.5), ("B", None, 4.3)])
    assert read("".join("#" + line for line in YAML.splitlines(keepends=True)) + body, csvy=True)[1] == [("A", 1, 2.5), ("B", None, 4.3)]
    with pytest.warns(UserWarning):
        assert read(YAML + body, csvy=True, na=["none"])[0][1] == ("var2", "string")
    assert read(YAML + body, csvy=True, quote='"')[1][0][0] == "'A'"
    assert read(YAML.replace("header: true", "header: false") + body.partition("\n")[2], csvy=True)[0] == [("var1", "string"), ("var2", "int"), ("var3", "double")]
    assert read("---\nschema:\n  fields:\n  - name: a\n  - name: b\n    type: string\nna.strings:\n- x\n- '-'\n---\na,b\n1,2\nx,-\n", csvy=True) == ([("a", "int"), ("b", "string")], [(1, "2"), (None, None)])
    with pytest.raises(ValueError, match="no end"):
        read("---\nname: x\na,b\n1,2\n", csvy=True)


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, 'a "b", c', True), (2, None, None, False)], "k int, x double, s string, b boolean")
    for k, kw in enumerate([{}, {"quote": True}, {"qmethod": "escape"}, {"sep": ";", "dec": ","}, {"yaml": True}, {"bom": True}]):
        csv.write_csv(df.coalesce(1), str(tmp_path / str(k)), **kw)
        back = csv.read_csv(spark, str(tmp_path / str(k)), csvy="yaml" in kw)
        assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str), kw
    csv.write_csv(df, str(tmp_path / "0"), mode="append")
    assert csv.read_csv(spark, str(tmp_path / "0")).count() == 4
    csv.write_csv(df.select("k", "x"), str(tmp_path / "plain"), quote=False, header=False, na="NA", date_times="epoch")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "plain")).collect()) == ["1,1.5", "2,NA"]
    with pytest.raises(ValueError):
        csv.write_csv(df, str(tmp_path / "bad"), dec=",")
    frame = csv.read_frame(spark, str(tmp_path / "1"), key=["k"], index=["s"])
    assert frame.key == ("k",) and frame.has_key() and frame.indexes == (("s",),) and frame.set_index().indexes == ()


def test_empty(read):
    assert read("") == ([], []) and read("a,b\n")[1] in ([], [("a", "b")])
