"""Files of all formats and unlike layouts."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.operators import normalize as N
from quillmark.sources import artifacts as A
from quillmark.sources import files as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return path


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_discover(spark, tmp_path):
    for name in ("a.csv", "b/C.JSON", "b/d.ndjson", "b/e.txt", "f.Parquet"):
        write(tmp_path / name, "x")
    found = S.discover_files(spark, str(tmp_path)).orderBy("relative_path")
    assert rows(found, "relative_path", "suffix") == [
        ("a.csv", "csv"), ("b/C.JSON", "json"), ("b/d.ndjson", "ndjson"), ("f.Parquet", "parquet"),
    ]


def test_discover_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.discover_files(spark, str(tmp_path / "absent"))
    with pytest.raises(FileNotFoundError, match="no supported files"):
        S.union_files(spark, str(tmp_path))


@pytest.mark.parametrize("sep, name", [(",", "t.csv"), ("\t", "t.tsv")])
def test_delimited(spark, tmp_path, sep, name):
    lines = [["code", "label", "note"], ['"def f():\n  return ""x"""', "1", "NA"], ["b", "0", ""], ["c", "1", " keep "]]
    path = write(tmp_path / name, "\n".join(sep.join(x) for x in lines) + "\n")
    df = S.load_file(spark, str(path))
    assert rows(df, "code", "label", "note") == [
        ('def f():\n  return "x"', "1", None), ("b", "0", None), ("c", "1", " keep "),
    ]


RECORDS = [{"code": "a\nb", "label": 0}, {"code": "c", "label": 1}]


@pytest.mark.parametrize(
    "name, text",
    [
        ("array.json", json.dumps(RECORDS, indent=1)),
        ("lines.json", "\n".join(map(json.dumps, RECORDS))),
        ("lines.jsonl", "\n".join(map(json.dumps, RECORDS)) + "\n\n"),
        ("lines.ndjson", "\n".join(map(json.dumps, RECORDS))),
        ("columns.json", json.dumps({"code": {"0": "a\nb", "1": "c"}, "label": {"0": 0, "1": 1}})),
        ("listed.json", json.dumps({"code": ["a\nb", "c"], "label": [0, 1]})),
    ],
)
def test_json_shapes(spark, tmp_path, name, text):
    df = S.load_file(spark, str(write(tmp_path / name, text)))
    assert sorted(rows(df, "code", "label")) == [("a\nb", "0"), ("c", "1")]


@pytest.mark.parametrize("kind, text", [
    ("lines", '{"code": "x", "label": 1}'), ("columns", '{"code": {"0": "x"}}'), ("columns", '{"code": ["x"], "label": {"0": 1}}'),
    ("lines", '{"meta": {"a": 1}, "code": "x"}\n{"meta": {}, "code": "y"}'), ("array", ' \n[{"code": "x"}]'), ("lines", "not json"),
    ("object", '{"code":\n {"0": "x"}}'), ("object", '{\n"code": "x"}'), ("lines", '{"code": "[1]", "label": 1}'),
])
def test_json_kinds(spark, tmp_path, kind, text):
    write(tmp_path / "f.json", text)
    lines = S._lines(spark, str(tmp_path), "*.json")
    assert rows(S.json_kinds(lines), "kind") == [(kind,)]


def test_long_first_record_is_read_right(spark, tmp_path):
    rows = [{"meta": {"pad": "x" * (3 << 20)}, "code": "a"}, {"meta": {}, "code": "b"}]
    write(tmp_path / "long.json", "\n".join(map(json.dumps, rows)))
    assert sorted(r["code"] for r in S.union_files(spark, str(tmp_path)).collect()) == ["a", "b"]


@pytest.mark.parametrize("name, text", [
    ("a.json", '[{"code": "x"}, {"code": '), ("b.jsonl", "not json\n"), ("c.json", '{\n "code": "x"\n}'), ("d.json", '{"code": {"0": "x"'),
])
def test_unreadable_json(spark, tmp_path, name, text):
    write(tmp_path / name, text)
    write(tmp_path / "good.jsonl", '{"code": "fine"}')
    with pytest.raises(Exception, match="unreadable JSON"):
        S.union_files(spark, str(tmp_path)).collect()
    assert [r["code"] for r in S.union_files(spark, str(tmp_path), unreadable="skip").collect()] == ["fine"]
    bad = S.unreadable_json(spark, str(tmp_path)).collect()
    assert {r[S.SOURCE_FILE] for r in bad} == {name} and "".join(r["raw"] for r in bad).replace("\n", "") == text.replace("\n", "")


def test_unsupported(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        S.load_file(spark, str(write(tmp_path / "a.txt", "x")))


def test_union_of_unlike_files(spark, tmp_path):
    write(tmp_path / "a.csv", "code,label\nx,1\n")
    write(tmp_path / "b.jsonl", '{"text": "y", "label": "human"}\n')
    pd.DataFrame({"code": ["z"], "label": [0.0], "extra": [True]}).to_parquet(tmp_path / "c.parquet")
    df = S.union_files(spark, str(tmp_path)).orderBy(S.SOURCE_FILE)
    assert rows(df, "code", "label", "text", "extra", S.SOURCE_FILE) == [
        ("x", "1", None, None, "a.csv"), (None, "human", "y", None, "b.jsonl"), ("z", "0.0", None, "true", "c.parquet"),
    ]


def test_columns_resolved_per_file(spark, tmp_path):
    write(tmp_path / "a.csv", "code,label,lang\nx,1, Python \n")
    write(tmp_path / "b.csv", "SOURCE_CODE,is_ai\ny,human\n")
    write(tmp_path / "c.csv", "Code,code,label\nfirst,last,0\n")
    df = N.load_canonical(spark, str(tmp_path)).orderBy(S.SOURCE_FILE)
    assert rows(df, "code", "label", "language") == [("x", 1, "python"), ("y", 0, "unknown"), ("last", 0, "unknown")]


def test_columns_resolved_globally(spark, tmp_path):
    write(tmp_path / "a.csv", "code,label\nx,1\n")
    write(tmp_path / "b.csv", "source_code,label\ny,0\n")
    df = N.load_canonical(spark, str(tmp_path), resolve="global").orderBy(S.SOURCE_FILE)
    assert rows(df, "code", "label") == [("x", 1), (None, 0)]


def test_global_labels_are_read_per_file(spark, tmp_path):
    write(tmp_path / "a.csv", "code,label\nx,1.0\ny,0.7\n")
    write(tmp_path / "b.csv", "code,label\nz,human\n")
    pd.DataFrame({"code": ["p", "q"], "label": [1.0, 0.0]}).to_parquet(tmp_path / "c.parquet")
    pd.DataFrame({"code": ["r"], "label": [True]}).to_parquet(tmp_path / "d.parquet")
    df = N.load_canonical(spark, str(tmp_path), resolve="global").orderBy("code")
    assert rows(df, "code", "label") == [("p", 1), ("q", 0), ("r", 1), ("x", 1), ("y", 0), ("z", 0)]


def test_missing_column_is_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", "body,label\nx,1\n")
    with pytest.raises(KeyError, match="code column"):
        N.load_canonical(spark, str(tmp_path))


def test_labels_read_per_file(spark, tmp_path):
    write(tmp_path / "a.csv", "code,label\na,0\nb,1\n")
    write(tmp_path / "b.csv", "code,label\nc,human\nd, AI \ne,ChatGPT\n")
    pd.DataFrame({"code": ["f", "g"], "label": [True, False]}).to_parquet(tmp_path / "c.parquet")
    write(tmp_path / "d.csv", "code,label\nh,1.0\ni,0.7\nj,-0.5\nk,1.9\n")
    df = N.load_canonical(spark, str(tmp_path)).orderBy("code")
    assert "".join(str(r[0]) for r in rows(df, "label")) == "01011" "10" "1001"


def test_bad_labels(spark, tmp_path):
    write(tmp_path / "a.csv", "code,label\na,human\nb,maybe\nc,1.0\nd,\n")
    with pytest.raises(Exception, match="unrecognized label"):
        N.load_canonical(spark, str(tmp_path)).collect()
    df = N.load_canonical(spark, str(tmp_path), on_bad_label="quarantine")
    good, bad = N.quarantine(df)
    assert rows(good, "code", "label") == [("a", 0)]
    assert sorted(rows(bad, "code", "label_raw"), key=str) == [("b", "maybe"), ("c", "1.0"), ("d", None)]


def test_numeric_labels_outside_range(spark):
    df = spark.createDataFrame([(2,)], "label int")
    with pytest.raises(Exception, match="unrecognized label: 2"):
        df.select(N.encode_label("label", df.schema["label"].dataType)).collect()


def test_pairs(spark, tmp_path):
    write(tmp_path / "p.csv", "human_code,ai_code,lang,label\nh1,a1,Py,9\nh2,,py,9\n")
    N.load_canonical(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    df = N.mint_row_ids(spark.read.parquet(str(tmp_path / "out"))).orderBy("row_id")
    assert rows(df, "code", "label", "language") == [("h1", 0, "py"), ("h2", 0, "py"), ("a1", 1, "py"), (None, 1, "py")]


def test_row_ids_follow_files_and_places(spark, tmp_path):
    raw = tmp_path / "raw"
    n = 0
    for name, size in (("a.csv", 5), ("b.csv", 700), ("c/d.csv", 3)):
        write(raw / name, "code,label\n" + "".join(f"s{n + i},0\n" for i in range(size)))
        n += size
    write(raw / "z.jsonl", "".join(json.dumps({"code": f"s{n + i}", "label": 1}) + "\n" for i in range(50)))
    N.load_canonical(spark, str(raw)).write.parquet(str(tmp_path / "bronze"))
    df = N.mint_row_ids(spark.read.parquet(str(tmp_path / "bronze")).repartition(7))
    assert df.count() == 758
    assert df.where(F.col("code") != F.concat(F.lit("s"), "row_id")).count() == 0


def test_names_with_blanks(spark, tmp_path):
    write(tmp_path / "my data" / "a+b {1}.csv", "code,label\nx,1\n")
    df = N.load_canonical(spark, str(tmp_path))
    assert rows(df, "code", S.SOURCE_FILE) == [("x", "my data/a+b {1}.csv")]


def test_resolve_column():
    assert N.resolve_column(["Text", "CODE", "code"], C.CODE_COLUMNS, "code") == "code"
    assert N.resolve_column(["Text", "Source"], C.CODE_COLUMNS, "code") == "Text"
    assert N.resolve_column(["x"], C.LANGUAGE_COLUMNS, "language", required=False) is None
    with pytest.raises(KeyError):
        N.resolve_column(["x"], C.CODE_COLUMNS, "code")


@pytest.fixture
def small_splits(spark):
    """Splits so small that records cross their borders."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    yield
    spark.conf.set(key, before)


def _messy(i):
    kinds = [f"plain {i}", f"two\nlines {i}", f'say ""{i}""', "x" * 150 + "\n" + "y" * 150 + str(i), f"comma, {i}", f'""\n""{i}\n']
    return kinds[i % len(kinds)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_of_many_splits(spark, tmp_path, small_splits, end):
    body = "".join(f'"{_messy(i)}",{i % 2},{i}{end}' for i in range(60))
    write(tmp_path / "big.csv", f"code,label,n{end}{body}")
    write(tmp_path / "other.csv", f'code,label,n{end}"q\nr",1,60{end}"tail {"z" * 90}",0,61')
    df = S.union_files(spark, str(tmp_path))
    got = {int(r["n"]): (r["code"], r["label"]) for r in df.collect()}
    expected = {i: (_messy(i).replace('""', '"'), str(i % 2)) for i in range(60)}
    expected |= {60: ("q\nr", "1"), 61: ("tail " + "z" * 90, "0")}
    assert got == expected


STRAY = 'code,label\nprint 5" pipe,0\nfoo(),1\nbar" z,0\nbaz,1\n'


def test_stray_quotes_are_text_at_every_size(spark, tmp_path):
    write(tmp_path / "a.csv", STRAY)
    write(tmp_path / "b.tsv", STRAY.replace(",", "\t"))
    one = [('print 5" pipe', "0"), ("foo()", "1"), ('bar" z', "0"), ("baz", "1")]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in (before, "16"):
            spark.conf.set(key, size)
            assert sorted(rows(S.union_files(spark, str(tmp_path)), "code", "label")) == sorted(one * 2)
    finally:
        spark.conf.set(key, before)


def test_row_ids_of_csv_follow_the_file(spark, tmp_path, small_splits):
    body = "".join(f'"{_messy(i)}",{i % 2},{i}\n' for i in range(60))
    write(tmp_path / "raw" / "big.csv", f"code,label,language\n{body}")
    N.load_canonical(spark, str(tmp_path / "raw")).write.parquet(str(tmp_path / "bronze"))
    ids = N.mint_row_ids(spark.read.parquet(str(tmp_path / "bronze"))).orderBy("row_id")
    assert [r["language"] for r in ids.collect()] == [str(i) for i in range(60)]


def _tricky(i):
    kinds = [
        f"plain {i}", f"braces }} {{ ] [ {i}", f'quote " {i} \\" }}', "back\\\\", f"line\nbreak {i}", "x" * 100 + "}" + "y" * 100,
        '"}, {"', "é😀}" * 20, "",
    ]
    return kinds[i % len(kinds)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_of_many_splits(spark, tmp_path, small_splits, indent):
    data = [{"code": _tricky(i), "label": i % 2, "meta": {"n": i, "list": [{"a": "]"}, {}]}, "n": i} for i in range(70)]
    write(tmp_path / "big.json", json.dumps(data, indent=indent, ensure_ascii=False))
    write(tmp_path / "more.json", json.dumps([{"code": "z}", "label": 1, "meta": {}, "n": 70 + i} for i in range(9)], indent=indent) + "\n")
    df = S.union_files(spark, str(tmp_path))
    got = {int(r["n"]): (r["code"], r["label"], json.loads(r["meta"])) for r in df.collect()}
    expected = {x["n"]: (x["code"], str(x["label"]), x["meta"]) for x in data}
    expected |= {70 + i: ("z}", "1", {}) for i in range(9)}
    assert got == expected
    N.load_canonical(spark, str(tmp_path)).write.parquet(str(tmp_path / "bronze"))
    ids = N.mint_row_ids(spark.read.parquet(str(tmp_path / "bronze"))).orderBy("row_id").limit(70)
    assert [r["code"] for r in ids.collect()] == [x["code"] for x in data]


def test_truncated_array_of_many_splits_is_unreadable(spark, tmp_path, small_splits):
    write(tmp_path / "cut.json", json.dumps([{"code": "x" * 50, "label": i} for i in range(20)], indent=1)[:-9])
    with pytest.raises(Exception, match="unreadable JSON"):
        S.union_files(spark, str(tmp_path)).collect()


def test_only_unreadable_files(spark, tmp_path):
    write(tmp_path / "cut.json", '[{"code": "x"')
    write(tmp_path / "bad.jsonl", "no\n")
    assert S.union_files(spark, str(tmp_path), unreadable="skip").collect() == []
    assert S.unreadable_json(spark, str(tmp_path)).count() == 2


def test_odd_headers(spark, tmp_path):
    write(tmp_path / "bom.csv", "\ufeffcode,label,,Note,note\na,1,x,first,last\n")
    write(tmp_path / "short.csv", "code,label\nb\nc,1,more,cells\n")
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "alone.csv", "code,label,only_named\n")
    df = S.union_files(spark, str(tmp_path)).orderBy("code")
    assert sorted(set(df.columns) - set(S.META)) == ["code", "label", "note", "only_named"]
    assert rows(df, "code", "label", "note") == [("a", "1", "last"), ("b", None, None), ("c", "1", None)]


def test_wide_files(spark, tmp_path):
    names = [f"n{i}" for i in range(90)]
    write(tmp_path / "wide.csv", ",".join([*names, "code", "label"]) + "\n" + ",".join([*map(str, range(90)), "x", "1"]) + "\n")
    write(tmp_path / "narrow.csv", "code,label\ny,0\n")
    df = S.union_files(spark, str(tmp_path)).orderBy("code")
    assert rows(df, "code", "n0", "n89") == [("x", "0", "89"), ("y", None, None)]
    assert rows(N.load_canonical(spark, str(tmp_path)).orderBy("code"), "code", "label") == [("x", 1), ("y", 0)]


def test_a_scan_per_format_not_per_layout(spark, tmp_path):
    """500 files with 200 sets of columns: few branches, all on stored rows, every file by its own columns."""
    expected = []
    for i in range(500):
        code, label = C.CODE_COLUMNS[i % 7], C.LABEL_COLUMNS[i % 5]
        extra = f"extra{i % 200}"
        if i % 3 == 0:
            write(tmp_path / f"{i}.csv", f"{extra},{label},{code}\n9,{i % 2},s{i}\n")
        elif i % 3 == 1:
            write(tmp_path / f"d{i % 9}" / f"{i}.jsonl", json.dumps({extra: 9, label: ["human", "ai"][i % 2], code: f"s{i}"}))
        else:
            write(tmp_path / f"{i}.json", json.dumps([{code: f"s{i}", label: i % 2, extra: None}], indent=1))
        expected.append((f"s{i}", i % 2))
    df = N.load_canonical(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Relation [") <= 6 and " csv" not in plan and " text" not in plan
    assert sorted(rows(df, "code", "label")) == sorted(expected)
    united = S.union_files(spark, str(tmp_path))
    assert len(united.columns) == 7 + 5 + 200 + 3 and united.count() == 500


def test_a_table_replaces_its_own_source(spark, tmp_path):
    path = str(tmp_path / "table")
    A.write_interim(spark.range(10).withColumnRenamed("id", "row_id"), path)
    A.write_interim(A.scan_interim(spark, path).where("row_id % 2 = 0"), path)
    A.write_interim(A.scan_interim(spark, path).withColumn("x", F.col("row_id") * 2), path)
    assert sorted(rows(A.scan_interim(spark, path), "row_id", "x")) == [(i, 2 * i) for i in range(0, 10, 2)]


def test_a_cut_off_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    good = spark.range(10).selectExpr("id AS row_id", "'s' || id % 2 AS split")
    A.write_splits(good, path)
    bad = spark.range(1000).repartition(8).selectExpr("id AS row_id", "if(id = 999, raise_error('cut'), 'x') AS split")
    with pytest.raises(Exception, match="cut"):
        A.write_splits(bad, path)
    (tmp_path / "table" / "versions" / "half").mkdir()
    (tmp_path / "table" / "versions" / "half" / "part-0.parquet").write_bytes(b"PAR1 half")
    assert A.scan_splits(spark, path, ["s0", "s1"]).count() == 10
    with pytest.raises(FileNotFoundError):
        A.scan_interim(spark, str(tmp_path / "none"))


def test_a_plain_folder_is_read_as_it_is(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    assert A.scan_interim(spark, str(tmp_path / "plain")).count() == 3
