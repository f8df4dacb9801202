import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limpid import compared_runs, load_table, read_reports, write_reports, write_table
from limpid.catalog.made_files import _sheet
from limpid.sources import dialect, reports, tables
from limpid.sources.tables import load_with_losses
from limpid.sources.workbook import sheet_rows


def put(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sep", [";", ",", "\t", "|"])
def test_separators(spark, tmp_path, sep):
    path = put(tmp_path, "x.csv", f"a{sep}b\n1{sep}x\n2{sep}y\n")
    assert rows(load_table(spark, path)) == [(1, "x"), (2, "y")]


def seen(spark, tmp_path, content, encoding="utf-8"):
    return dialect.dialects(spark, put(tmp_path, f"d{abs(hash(content))}.csv", content, encoding)).first()


@pytest.mark.parametrize(
    "text, separator",
    [
        ("k|w\n3|4\n", "|"), ("one\ntwo\n", ","), ('p;q\n"u,v";9\n"w,x";8\n', ";"), ('p;q\n3;"r;s;t"\n', ";"),
        ("p;q\n3;4\n5;6;7\n8;9\n", ";"), ("a,b;c\n1;2\n3\n4\n5\n", ","),
    ],
)
def test_separator_is_the_one_most_lines_agree_on(spark, tmp_path, text, separator):
    assert seen(spark, tmp_path, text)["separator"] == separator


def test_encodings(spark, tmp_path):
    path = put(tmp_path, "x.csv", "ville;région\nÉvry;Île\n", "latin1")
    assert rows(load_table(spark, path)) == [("Évry", "Île")]
    assert seen(spark, tmp_path, "prix\n5 €", "cp1252")["encoding"] == "windows-1252"
    assert seen(spark, tmp_path, "é", "latin1")["encoding"] == "ISO-8859-1"
    assert seen(spark, tmp_path, "a" * 4095 + "é")["encoding"] == "UTF-8"


def test_bytes_late_in_a_file_decide_its_encoding(spark, tmp_path):
    path = put(tmp_path, "late.csv", "k,v\n" + "1,plain\n" * 3000 + "2,thé\n", "latin1")
    assert load_table(spark, path).filter("k = 2").first()["v"] == "thé"


def test_headers_in_another_order(spark, tmp_path):
    put(tmp_path, "a.csv", "k,v\n1,left\n")
    put(tmp_path, "b.csv", "v,k\nright,2\n")
    assert rows(load_table(spark, str(tmp_path), "csv").select("k", "v")) == [(1, "left"), (2, "right")]


def test_long_records_are_refused_or_kept(spark, tmp_path):
    path = put(tmp_path, "long.csv", "k,v\n1,w\n2,x,more,most\n")
    with pytest.raises(ValueError, match="1 record"):
        load_table(spark, path)
    kept = tables.read_csv(spark, path, ragged="keep")
    assert rows(kept.select("k", "v", "_overflow_1", "_overflow_2")) == [(1, "w", None, None), (2, "x", "more", "most")]


def test_repeated_and_missing_names(spark, tmp_path):
    assert load_table(spark, put(tmp_path, "n.csv", "k,k,\n1,2,3\n")).columns == ["k", "k.1", "_c2"]


def test_unclosed_quote_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="quoted"):
        load_table(spark, put(tmp_path, "q.csv", 'k,v\n1,"open\n2,x\n'))


def test_json_scalars_stay_beside_lists(spark, tmp_path):
    path = put(tmp_path, "m.json", '{"who": "ann", "marks": [4, 5]}')
    assert rows(load_table(spark, path).select("marks", "who")) == [(4, "ann"), (5, "ann")]


def test_json_of_two_encodings(spark, tmp_path):
    put(tmp_path, "a.json", '[{"k": 1, "v": "thé"}]')
    put(tmp_path, "b.json", '[{"k": 2, "v": "blé"}]', "latin1")
    assert rows(load_table(spark, str(tmp_path), "json").select("k", "v")) == [(1, "thé"), (2, "blé")]
    put(tmp_path, "c.jsonl", '{"v": "5 €"}\n{"v": "six"}\n', "cp1252")
    assert rows(load_table(spark, str(tmp_path / "c.jsonl"))) == [("5 €",), ("six",)]


def test_json_lines_with_bad_lines_can_be_counted(spark, tmp_path):
    path = put(tmp_path, "n.jsonl", '{"k": 1}\n\n{cut\n{"k": 3}\n[\n')
    assert load_table(spark, path).count() == 2
    found = tables.corrupt_lines(spark, path).select("line_number", "line")
    assert rows(found) == [(3, "{cut"), (5, "[")]


def test_mixed_dialects_in_one_folder(spark, tmp_path):
    put(tmp_path, "a.csv", "k,v\n1,é\n")
    put(tmp_path, "b.csv", "k;v\n2;è\n", "latin1")
    put(tmp_path, "empty.csv", "")
    assert rows(load_table(spark, str(tmp_path), "csv")) == [(1, "é"), (2, "è")]


def test_csv_types_tokens_and_codes(spark, tmp_path):
    path = put(
        tmp_path, "x.csv",
        "i,f,b,s,code,gap\n1,1.5,True,x,007,NA\n2,,False,N/A,12,\n3,2e3,true,y,5,7\n",
    )
    df = load_table(spark, path)
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "code": "string", "gap": "bigint",
    }
    assert rows(df.select("s", "code", "gap")) == sorted([("x", "007", None), (None, "12", None), ("y", "5", 7)], key=repr)


def test_short_rows_are_filled_with_null(spark, tmp_path):
    path = put(tmp_path, "x.csv", "a,b\n1,x\n2\n")
    assert rows(load_table(spark, path)) == [(1, "x"), (2, None)]


def test_empty_csv(spark, tmp_path):
    assert load_table(spark, put(tmp_path, "x.csv", "")).count() == 0


def test_quoted_line_breaks(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'a,b\n1,"x\ny"\n')
    assert rows(load_table(spark, path)) == [(1, "x\ny")]


def test_json_shapes(spark, tmp_path):
    listed = put(tmp_path, "a.json", '[{"a": "007", "b": 1}, {"a": "x", "b": 2}]')
    assert rows(load_table(spark, listed)) == [("007", 1), ("x", 2)]
    columnar = put(tmp_path, "b.json", '{"c1": [1, 2], "c2": ["x", "y"]}')
    assert rows(load_table(spark, columnar)) == [(1, "x"), (2, "y")]
    single = put(tmp_path, "c.json", '{"a": 1, "b": {"c": null}}')
    assert rows(load_table(spark, single)) == [(1, '{"c":null}')]
    nested = put(tmp_path, "d.json", '[{"id": 1, "tags": ["a", "b"], "meta": {"k": 1}}]')
    assert rows(load_table(spark, nested).select("id", "tags", "meta")) == [(1, '["a","b"]', '{"k":1}')]


def test_json_documents_of_one_line_are_read_as_lines(spark, tmp_path, monkeypatch):
    """Types of lines are inferred in many tasks; a document of several lines is still read whole."""
    asked, reader = [], type(spark.read)
    read = reader.json
    monkeypatch.setattr(reader, "json", lambda self, path, **options: asked.append(options["multiLine"]) or read(self, path, **options))
    put(tmp_path, "one/a.json", '[{"k": 1, "v": "x"}, {"k": 2, "v": "y"}]\n')
    put(tmp_path, "one/b.json", '{"k": 3, "v": "z"}')
    put(tmp_path, "more/a.json", '[{"k": 1, "v": "x"},\n {"k": 2, "v": "y"},\n{"k": 3, "v": "z"}]')
    for folder, whole in (("one", False), ("more", True)):
        assert rows(load_table(spark, str(tmp_path / folder), "json").select("k", "v")) == [(1, "x"), (2, "y"), (3, "z")]
        assert asked.pop() is whole and not asked


def test_invalid_json_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        load_table(spark, put(tmp_path, "x.json", "{not json"))


def test_json_lines_skip_and_report_bad_lines(spark, tmp_path):
    path = put(tmp_path, "x.jsonl", '{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert rows(load_table(spark, path)) == [(1,), (2,)]
    assert [r["line"] for r in tables.corrupt_lines(spark, path).collect()] == ["{broken"]


def test_sniffing(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}).to_parquet(tmp_path / "plain")
    assert rows(load_table(spark, str(tmp_path / "plain"))) == [(1,), (2,)]
    assert rows(load_table(spark, put(tmp_path, "doc", '  [{"a": 5}]'))) == [(5,)]
    with pytest.raises(ValueError):
        load_table(spark, put(tmp_path, "other", "a;b"))


def test_losses_come_from_the_read_of_the_records(spark, tmp_path):
    """Long records and unreadable lines are listed beside the table, by file."""
    put(tmp_path, "c/a.csv", "k;v\n1;x\n2;y;over;more\n3;z\n")
    put(tmp_path, "c/b.csv", "k;v\n4;w\n5;;1\n")
    found = load_with_losses(spark, str(tmp_path / "c"), "csv")
    assert rows(found.table) == [(1, "x"), (2, "y"), (3, "z"), (4, "w"), (5, None)]
    listed = sorted((r["file"][-5:], r["line_number"], r["kind"], r["text"]) for r in found.losses.collect())
    assert listed == [("a.csv", None, "further fields", "over\tmore"), ("b.csv", None, "further fields", "1")]
    put(tmp_path, "j/a.jsonl", '{"a": 1}\n\n{broken\n{"a": [2]}\n')
    put(tmp_path, "j/b.jsonl", '{"a": "x"}\nnot\n')
    found = load_with_losses(spark, str(tmp_path / "j"), "jsonl")
    assert rows(found.table) == [("1",), ("[2]",), ("x",)]
    listed = sorted((r["file"][-7:], r["line_number"], r["text"]) for r in found.losses.collect())
    assert listed == [("a.jsonl", 3, "{broken"), ("b.jsonl", 2, "not")]
    put(tmp_path, "n/a.csv", "k,v\n1,2\n")
    clean = load_with_losses(spark, str(tmp_path / "n" / "a.csv"))
    assert rows(clean.table) == [(1, 2)] and clean.losses.count() == 0
    with pytest.raises(ValueError):
        load_with_losses(spark, str(tmp_path / "n"), "parquet")


def test_csv_files_are_read_twice(spark, tmp_path):
    """Once for their dialect, once for their records; types and losses come from what is stored."""
    lines = [f"{i},word number {i},{i / 7}" for i in range(40_000)]
    path = put(tmp_path, "x.csv", "n,t,d\n" + "\n".join(lines) + "\n")
    before = bytes_read(spark)
    found = load_with_losses(spark, path)
    assert found.table.count() == 40_000 and found.losses.count() == 0
    read = bytes_read(spark) - before
    stored = sum(len(line) for line in lines)
    assert read < 2.9 * stored, read / stored


def bytes_read(spark):
    every = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in every)


def test_parquet_is_told_without_reading_it(spark, tmp_path):
    """Long values without a line break; a read of its text would be one row of megabytes."""
    noise = np.random.default_rng(0).integers(11, 127, (40, 100_000), dtype=np.uint8)
    pd.DataFrame({"a": [bytes(r).decode() for r in noise]}).to_parquet(tmp_path / "table", compression=None)
    size = (tmp_path / "table").stat().st_size
    before = bytes_read(spark)
    assert tables.sniffed_format(spark, str(tmp_path / "table")) == "parquet"
    assert size > 4_000_000 and bytes_read(spark) - before < 300_000


def test_formats_of_a_mixed_folder(spark, tmp_path):
    pd.DataFrame({"a": [1]}).to_parquet(tmp_path / "x y%20.dat")
    pd.DataFrame({"a": []}).to_parquet(tmp_path / "none.dat")
    put(tmp_path, "doc.dat", '{"a": 1}')
    put(tmp_path, "other.dat", "a;b")
    put(tmp_path, "empty.dat", "")
    found = {r["path"].rsplit("/", 1)[1]: r["format"] for r in dialect.formats(spark, str(tmp_path)).collect()}
    assert found == {"x%20y%2520.dat": "parquet", "none.dat": "parquet", "doc.dat": "json", "other.dat": None}
    with pytest.raises(ValueError):
        tables.sniffed_format(spark, str(tmp_path))


def test_parquet_categories_and_nested(spark, tmp_path):
    pdf = pd.DataFrame({"n": [1, 2], "cat": pd.Categorical(["x", "y"]), "tags": [["a"], []]})
    pdf.to_parquet(tmp_path / "x.parquet")
    df = load_table(spark, str(tmp_path / "x.parquet"))
    assert rows(df) == [(1, "x", '["a"]'), (2, "y", "[]")]


def test_unreadable_inputs_raise(spark, tmp_path):
    with pytest.raises(Exception):
        load_table(spark, str(tmp_path / "absent.parquet")).count()
    with pytest.raises(Exception):
        load_table(spark, put(tmp_path, "x.parquet", "not parquet")).count()


def test_workbooks(spark, tmp_path):
    put(tmp_path, "a.xlsx", _sheet(pd.DataFrame({"nom": ["x", "y"], "tel": ["0612345678", "07"], "m": [1, 2]})))
    put(tmp_path, "b.xlsx", _sheet(pd.DataFrame({"nom": ["z"], "m": [3]})))
    df = load_table(spark, str(tmp_path), "excel")
    assert dict(df.dtypes) == {"nom": "string", "tel": "string", "m": "bigint"}
    assert rows(df) == sorted([("x", "0612345678", 1), ("y", "07", 2), ("z", None, 3)], key=repr)


def test_workbook_shared_strings_and_dates():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet r:id="r7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r7" Target="/xl/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>d</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr(
            "xl/s.xml",
            f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
            '<row><c r="A2" s="1"><v>45000.5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>',
        )
    assert list(sheet_rows(out.getvalue())) == [["d", None, "ab"], ["2023-03-15 12:00:00", None, "True"]]


def test_codes_survive_load_and_clean_in_every_format(spark, tmp_path):
    from limpid import clean

    pdf = pd.DataFrame({"nom": ["a", "b"], "tel": ["0498765432", "0487654321"], "montant": ["2 310,75 €", "41,30 €"]})
    put(tmp_path, "x.csv", pdf.to_csv(index=False, sep=";"))
    put(tmp_path, "x.json", pdf.to_json(orient="records"))
    put(tmp_path, "x.xlsx", _sheet(pdf))
    pdf.to_parquet(tmp_path / "x.parquet")
    for ext in ("csv", "json", "xlsx", "parquet"):
        out = clean(load_table(spark, str(tmp_path / f"x.{ext}")))
        found = rows(out.select("tel", "montant"))
        assert found == [("0487654321", 41.3), ("0498765432", 2310.75)], ext


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "k long, v string")
    for fmt in ("csv", "parquet"):
        path = write_table(df, str(tmp_path / fmt), fmt)
        assert rows(load_table(spark, path, fmt)) == rows(df)


def test_a_run_that_is_written_again_stands_once(spark, tmp_path):
    store = str(tmp_path / "r")
    one = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "k string, n long, x double")
    two = spark.createDataFrame([("a", 1, 0.75), (None, 7, None)], "k string, n long, x double")
    write_reports({"t": one}, store, "20260101_000000")
    write_reports({"t": one}, store, "20260102_000000")
    write_reports({"t": two}, store, "20260102_000000")
    runs = {r["run_id"]: r["n_rows"] for r in reports.run_ids(spark, store, "t").collect()}
    assert runs == {"20260101_000000": 2, "20260102_000000": 2}
    back = read_reports(spark, store, "t", ["20260102_000000"]).drop("run_id")
    assert rows(back) == rows(two)
    found = {(r["k"], r["metric"]): (r["delta"], r["status"]) for r in
             compared_runs(spark, store, "t", "20260101_000000", "20260102_000000", ["k"]).collect()}
    assert found == {
        ("a", "n"): (0.0, "same"), ("a", "x"): (0.25, "changed"), ("b", "n"): (None, "removed"),
        ("b", "x"): (None, "removed"), (None, "n"): (None, "added"), (None, "x"): (None, "added"),
    }
    write_reports({"t": two.limit(0)}, store, "20260102_000000")
    assert read_reports(spark, store, "t", ["20260102_000000"]).count() == 0
    write_reports({"t": two.withColumn("later", F.lit(1))}, store, "20260103_000000")
    assert read_reports(spark, store, "t").filter("later is null").count() == 2
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            write_reports({"t": one}, store, bad)
