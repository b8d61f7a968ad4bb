"""Members and sheets as partitions; odd archives, cells and headers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import catalogue
from ledgerline.sources import archives as A


def test_members_are_partitions_and_columns_go_by_name(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "﻿id,name\n1,\"a, \"\"b\"\"\nc\"\n2\n\n3,z,extra\n")
        z.writestr("dir/y.TXT", "name,id\nn,9\n")
        z.writestr("empty.csv", "")
        z.writestr("readme.md", "id,name\n7,no\n")
    (tmp_path / "none.csv").write_text("id,name\n8,no\n")
    df = A.csv_rows(spark, str(tmp_path), ["id", "name", "absent"], pack=1)
    assert A.csv_rows(spark, str(tmp_path), ["id"]).rdd.getNumPartitions() == 1
    assert df.rdd.getNumPartitions() == 2
    got = [(r.member, r.line, r.id, r.name, r.absent) for r in df.orderBy("member", "line").collect()]
    assert got == [("dir/y.TXT", 0, "9", "n", None), ("x.csv", 0, "1", 'a, "b"\nc', None), ("x.csv", 1, "2", None, None), ("x.csv", 2, None, None, None), ("x.csv", 3, "3", "z", None)]


def test_no_archives(spark, tmp_path):
    assert A.csv_rows(spark, str(tmp_path), ["id"]).collect() == [] and A.cells(spark, str(tmp_path)).collect() == []


def test_cells_of_odd_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(A.sheet_bytes([["t & <b>", None, 1.5], [], [None] * 27 + [2]]))
    space = A.MAIN[1:-1]
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{A.LINK[1:-3]}"><sheets><sheet name="One" r:id="r1"/><sheet name="Gone" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="/xl/s.xml"/><Relationship Id="r2" Target="missing.xml"/></Relationships>')
        z.writestr("xl/s.xml", f'<worksheet xmlns="{space}"><sheetData><row><c><v>7</v></c><c t="inlineStr"><is><t>in</t><t>line</t></is></c><c t="b"><v>1</v></c><c><f>A1</f></c></row><row r="5"><c r="B5" t="str"><v>x</v></c></row></sheetData></worksheet>')
    df = A.cells(spark, str(tmp_path), pack=1)
    assert df.rdd.getNumPartitions() == 2
    got = sorted((r.file[-6:], r.sheet, r.row, r.col, r.text, r.number) for r in df.collect())
    assert got == [("a.xlsx", "Sheet1", 0, 0, "t & <b>", None), ("a.xlsx", "Sheet1", 0, 2, "1.5", 1.5), ("a.xlsx", "Sheet1", 2, 27, "2", 2.0), ("b.xlsx", "One", 0, 0, "7", 7.0), ("b.xlsx", "One", 0, 1, "inline", None), ("b.xlsx", "One", 0, 2, "1", None), ("b.xlsx", "One", 4, 1, "x", None)]
    assert [A.column_number(x) for x in ("A1", "Z9", "AA7", "XFD1")] == [0, 25, 26, 16383]


@pytest.mark.parametrize(
    ("heads", "wanted"),
    [
        (["12/31/2026", "12/31/2027"], ["2026", "2027"]), (["3/31/2026", "6/30/2026"], ["2026Q1", "2026Q2"]), (["12/31/2026", "12/31/2026"], ["2026Q4", "2026Q4"]), (["FY26", "2027E"], ["2026", "2027"]),
        (["2Q26E", "Q3 '26", "2026Q4", "1/31/27"], ["2026Q2", "2026Q3", "2026Q4", "2027Q1"]), (["2026-12-31", "FY27"], ["2026Q4", "2027"]), (["x", "2026"], []),
    ],
)
def test_headers_as_a_set(spark, heads, wanted):
    rows = [("f", "s", 1, k + 1, h, float(h) if h.isdigit() else None) for k, h in enumerate(heads)] + [("f", "s", 2, 0, "EPS", None)]
    rows += [("f", "s", 2, k + 1, f"{k}", float(k)) for k in range(len(heads))]
    got = A.estimates(spark.createDataFrame(rows, A.CELLS)).orderBy("value").collect()
    assert [r.period for r in got] == wanted and {r.metric for r in got} <= {"EPS"}


def test_values_of_models(spark):
    given = {"$1,234.5": 1234.5, "(3%)": -3.0, "n/a": None, "NaN": None, "inf": None, "-2": -2.0}
    rows = [("f", "s", 0, 1, "2026", None), ("f", "s", 0, 2, "2027", None)] + [("f", "s", k + 1, 0, t, None) for k, t in enumerate(given)] + [("f", "s", k + 1, 1, t, None) for k, t in enumerate(given)]
    got = {r.metric: r.value for r in A.estimates(spark.createDataFrame(rows, A.CELLS)).collect()}
    assert got == {k: v for k, v in given.items() if v is not None}


def test_driver_opens_no_small_workbook(monkeypatch, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xlsx").write_bytes(A.sheet_bytes([[k]]))
    reader, opened, own = A._Cells(str(tmp_path), 1 << 20), [], A._open
    monkeypatch.setattr(A, "_open", lambda uri: (opened.append(uri), own(uri))[1])
    packs = reader.partitions()
    assert len(packs) == 1 and not opened
    assert [c[-2] for c in reader.read(packs[0])] == ["0", "1", "2"]
    monkeypatch.setattr(A, "PACK", 1)
    assert [p.name for pack in reader.partitions() for p in pack.parts] == ["Sheet1"] * 3


def test_driver_lists_no_file_of_folders(spark, tmp_path):
    """Folders of workbooks are parts of their own, listed by their task; so the driver holds one level only."""
    for k in range(6):
        (tmp_path / str(k % 2) / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / str(k % 2) / ("deep" if k > 3 else "") / f"{k}.xlsx").write_bytes(A.sheet_bytes([[k]]))
    (tmp_path / "top.xlsx").write_bytes(A.sheet_bytes([["t"]]))
    reader = A._Cells(str(tmp_path), 1)
    packs = reader.partitions()
    assert [p.file[len(str(tmp_path)) :] for pack in packs for p in pack.parts] == ["/0", "/1", "/top.xlsx"]
    assert sorted(c[-2] for pack in packs for c in reader.read(pack)) == ["0", "1", "2", "3", "4", "5", "t"]
    assert sorted(r.text for r in A.cells(spark, str(tmp_path)).collect()) == ["0", "1", "2", "3", "4", "5", "t"]


def test_models_are_dealt_over_folders(spark, monkeypatch):
    """The parts that the driver holds are folders, however many banks there are."""
    made, cells = [], A.cells
    monkeypatch.setattr(A, "cells", lambda spark, path, pack=A.PACK: (made.append(path), cells(spark, path, pack))[1])
    monkeypatch.setattr("ledgerline.plans.archives.FOLDERS", 3)
    catalogue.QUERIES["workbook_estimates"](spark, "/root/testdata/sf0.001")
    parts = [p for pack in A._Cells(made[0], 1).partitions() for p in pack.parts]
    assert len(parts) == 3 and all(p.member is None for p in parts)
