import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import Observation

from anemos.sources import readers


def rows(df, *names):
    return sorted(tuple(r[n] for n in ("ts", *names)) for r in df.collect())


def at(h, m=0):
    return datetime(2016, 1, 9, h, m)


def test_headers_that_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Spd,Dir\n2016-01-09 10:00,1,10\n2016-01-09 11:00,2,20\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/b.csv").write_text('﻿Time,Dir,Spd\n2016-01-09 12:00,30,3\n\n"2016-01-09 13:00","40","4"\n')
    (tmp_path / "deep/c.csv").write_text("Timestamp,Spd,Note,Spd\n2016-01-09 14:00,5,\"x, y\",55\n2016-01-09 15:00,6\n")
    (tmp_path / "other.txt").write_text("not,read\n")
    got = readers.read_csv(spark, str(tmp_path), strings=("Note",))
    assert set(got.columns) == {"ts", "Spd", "Dir", "Note", "Spd.1"}
    assert sorted((r["ts"], r["Spd"], r["Dir"], r["Note"], r["Spd.1"]) for r in got.collect()) == [(at(10), 1, 10, None, None), (at(11), 2, 20, None, None), (at(12), 3, 30, None, None), (at(13), 4, 40, None, None), (at(14), 5, None, "x, y", 55), (at(15), 6, None, None, None)]


def test_duplicates_name_their_files(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.csv").write_text("Timestamp,Spd\n2016-01-09 10:00,1\n")
    with pytest.raises(ValueError, match="one.csv and two.csv"):
        readers.read_csv(spark, str(tmp_path))
    assert readers.read_csv(spark, str(tmp_path), unique=False).count() == 2


def test_rejected_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Spd\n2016-01-09 10:00,1\nbroken,2\n2016-01-09 11:00,x\n")
    (tmp_path / "b.csv").write_text("Timestamp,Spd\n2016-13-09 10:00,1\n,3\n")
    seen = Observation("lines")
    got = readers.read_csv(spark, str(tmp_path), unique=False, keep_rejects=True, observation=seen)
    assert rows(readers.accepted(got), "Spd") == [(at(10), 1), (at(11), None)]
    assert (seen.get["lines"], seen.get["rejected"]) == (5, 3) and seen.get["example"]["_file"].endswith("a.csv") and seen.get["example"]["_line"] == "broken,2"
    assert sorted((r["file"].rsplit("/", 1)[-1], r["line"]) for r in readers.rejected(got).collect()) == [("a.csv", "broken,2"), ("b.csv", ",3"), ("b.csv", "2016-13-09 10:00,1")]
    assert rows(readers.read_csv(spark, str(tmp_path)), "Spd") == [(at(10), 1), (at(11), None)]


def test_logger_folder(spark, tmp_path):
    (tmp_path / "a.dat").write_text('"TOA5","x"\n"TIMESTAMP","RECORD","Spd"\n"TS","RN","m/s"\n"","","Avg"\n"2016-01-09 10:00:00",1,"NAN"\n"bad",1,2\n')
    (tmp_path / "b.dat").write_text('"TOA5","y","z"\n"TIMESTAMP","Note","RECORD","Dir","Spd"\n"TS","","RN","",""\n"","","","",""\n"2016-01-09 11:00:00","calm, cold",2,270,5.5\n')
    got = readers.read_campbell(spark, str(tmp_path), strings=("Note",), keep_rejects=True)
    assert rows(readers.accepted(got), "RECORD", "Spd", "Dir", "Note") == [(at(10), 1, None, None, None), (at(11), 2, 5.5, 270, "calm, cold")]
    assert [r["line"] for r in readers.rejected(got).collect()] == ['"bad",1,2']


def test_export_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Export of\n\nNotes: 5\nDate/Time\tSpd 80m\tDir\t\n2016-01-09 10:00\t5.5\t9999\t\n")
    (tmp_path / "b.txt").write_text("Date/Time\tDir\tTmp\n2016-01-09 11:00\t19999\t-3\n")
    assert rows(readers.read_windographer(spark, str(tmp_path)), "Spd 80m", "Dir", "Tmp") == [(at(10), 5.5, None, None), (at(11), None, 19999, -3)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.txt").write_text("nothing here\n")
    with pytest.raises(ValueError, match="Date/Time"):
        readers.read_windographer(spark, str(tmp_path / "none"))


def sheet(path, table):
    """A workbook of one sheet; text goes to shared strings, or inline where it starts with an i."""
    strings, body = [], []
    for i, row in enumerate(table, 1):
        cells = []
        for j, x in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if isinstance(x, str) and x.startswith("i"):
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(x)}</t></is></c>')
            elif isinstance(x, str):
                strings.append(x)
                cells.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            elif x is not None:
                cells.append(f'<c r="{ref}"><v>{x}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in strings)}</sst>")


def test_excel_folder(spark, tmp_path):
    day = (datetime(2016, 1, 9, 10) - datetime(1899, 12, 30)).total_seconds() / 86400
    sheet(tmp_path / "a.xlsx", [["Time", "Spd", "Note"], [day, 5.5, "a & b"], [day + 1 / 24, None, "inline"], [None, None, None]])
    sheet(tmp_path / "b.xlsx", [["When", "Dir", "Spd"], ["2016-01-09 12:00", 270, 6], ["total", 1, 2]])
    got = readers.read_excel(spark, str(tmp_path), strings=("Note",), keep_rejects=True)
    assert rows(readers.accepted(got), "Spd", "Dir", "Note") == [(at(10), 5.5, None, "a & b"), (at(11), None, None, "inline"), (at(12), 6, 270, None)]
    assert [(r["file"].rsplit("/", 1)[-1], r["line"]) for r in readers.rejected(got).collect()] == [("b.xlsx", "total,1,2")]


def test_flags_and_rules(spark, tmp_path):
    (tmp_path / "f.txt").write_text("Data Column\tFlag Name\tStart Time\tEnd Time\tTime Steps\nSpd\tIcing\t2016-01-09 10:00\t2016-01-09 11:00\t6\nDir\tTower\t09/01/2016 12:00\t\t1\n")
    got = readers.read_flags(spark, str(tmp_path / "f.txt"), day_first=True).orderBy("sensor").collect()
    assert [(r["sensor"], r["flag"], r["date_from"], r["date_to"]) for r in got] == [("Dir", "Tower", at(12), None), ("Spd", "Icing", at(10), at(11))]
    (tmp_path / "r.json").write_text('[{"rule": {"clean_out": []}}]')
    assert readers.read_rules(spark, str(tmp_path / "r.json")) == [{"rule": {"clean_out": []}}]
