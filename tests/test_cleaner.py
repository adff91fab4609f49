"""The cleaner's scenarios on workbooks that the tests build."""

from __future__ import annotations

import json
import os

import pytest

from loomfield import model
from loomfield.errors import EngineError
from loomfield.plans import publish as P
from loomfield.plans import report as R
from loomfield.sources import xlsx

NUMBERS = [[float(i)] for i in range(1, 11)]
SHEETS = {
    "Data": [[" Full  Name ", "A B", "Code"], [" x ", "a\r\nb", "00123"], ["y", 5, "AB-12"], ["y ", 5, "AB-12"], ["Y", 5, "AB-12"], [None, 6, "12345678901234567890"], ["=A1+B1", True, "z"]],
    "Numbers": [["v", "w"], *[[r[0], 1] for r in NUMBERS], [1000.0, 2]],
    "Numeric head": [[1, 2], [3, 4]],
    "Same names": [["a", "a "], ["1", "2"]],
    "Merged": [["p", "q"], [" keep ", " keep "], [" keep ", " keep "]],
}


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    p = tmp_path_factory.mktemp("in") / "Study.XLSX"
    p.write_bytes(xlsx.write_workbook(SHEETS, {"Merged": ["A1:B1"]}, hidden=("Merged",)))
    return str(p)


@pytest.fixture(scope="module")
def frames(spark, book):
    cells, sheets = xlsx.read_cells(spark, book), xlsx.read_sheets(spark, book)
    return cells, sheets, R.cleaned_cells(cells, sheets), R.report(cells, sheets)


def test_read(frames):
    cells, sheets, *_ = frames
    assert [(r["sheet"], r["visibility"], r["n_rows"], r["merges"]) for r in sheets.orderBy("sheet_idx").collect()][-1] == ("Merged", "hidden", 3, ["A1:B1"])
    kinds = {(r["row_idx"], r["col_idx"]): r["kind"] for r in cells.where("sheet = 'Data'").collect()}
    assert kinds[7, 1] == "FORMULA" and kinds[7, 2] == "BOOL" and kinds[3, 2] == "NUMBER" and kinds[2, 3] == "TEXT"
    assert xlsx.used_range(cells, "A1:B2", "Data").count() == 4


def test_values(frames):
    _, _, (after, status, gone), _ = frames
    v = {(r["row_idx"], r["col_idx"]): r["formula"] or r["text"] for r in after.where("sheet = 'Data'").collect()}
    assert (v[1, 1], v[1, 2]) == ("Full Name", "A B")
    assert (v[2, 1], v[2, 2], v[2, 3]) == ("x", "a\nb", "00123")
    assert v[6, 3] == "12345678901234567890" and v[7, 1] == "=A1+B1"
    assert [(r["sheet"], r["row_idx"], r["retained"]) for r in gone.collect()] == [("Data", 4, 3)]  # equal after normalisation; "Y" stays
    assert {r["sheet"]: r["header_status"] for r in status.collect()} == {"Data": "CONFIRMED", "Numbers": "CONFIRMED", "Numeric head": "UNCERTAIN_HEADER", "Same names": "UNCERTAIN_HEADER", "Merged": "CONFIRMED"}
    assert after.where("sheet = 'Merged' and text = ' keep '").count() == 4


def test_report(frames):
    *_, report = frames
    assert tuple(report) == model.REPORT_SHEETS
    t = {k: f.collect() for k, f in report.items()}
    out = {(r["sheet"], r["col_idx"]): (r["flagged"], r["state"]) for r in t["Outliers"]}
    assert out["Numbers", 1] == (1, "flagged_not_modified")
    assert out["Data", 2] == (1, "flagged_not_modified")  # 5, 5, 5, 6: the upper fence is 5.625
    missing = {(r["sheet"], r["col_idx"]): (r["n"], r["missing_before"]) for r in t["Missing Values"]}
    assert missing["Data", 1] == (6, 1)
    codes = {r["code"] for r in t["Warnings"]}
    assert {"MERGED_CELLS_REVIEW", "FORMULAS_PRESERVED", "MIXED_TYPES_REVIEW", "OUTLIERS_FLAGGED_NOT_MODIFIED", "MISSING_VALUES_NOT_IMPUTED", "UNCERTAIN_HEADER", "IDENTIFIER_PRESERVED"} <= codes
    actions = {}
    for r in t["Cleaning Actions"]:
        actions[r["rule"]] = actions.get(r["rule"], 0) + r["n"]
    assert list(actions) == list(model.RULES) and actions["EXACT_DUPLICATE_ROW_REMOVAL"] == 1 and actions["NO_CROSS_SHEET_JOIN"] == 0
    assert any("joins_performed=0" in r["status"] for r in t["Merge Issues"])


def test_publish_rerun_collisions_and_replay(spark, book, tmp_path):
    folder = str(tmp_path / "out")
    first = P.clean_workbook(spark, book, folder)
    assert first["status"] == "success" and first["action"] == "create"
    with open(os.path.join(folder, P.LOG), encoding="utf-8") as f:
        log = json.load(f)
    assert set(log) == set(model.LOG_KEYS) and P.file_hash(book) == log["input"]["sha256"] == first["raw_sha256"]
    second = P.clean_workbook(spark, book, folder)
    assert second["action"] == "refresh" and second["report_sha256"] == first["report_sha256"]
    assert P.replay(spark, folder, first["raw_sha256"])["report_sha256"] == first["report_sha256"]
    cleaned = str(tmp_path / "Study.XLSX")
    with open(first["cleaned_xlsx_path"], "rb") as f, open(cleaned, "wb") as g:
        g.write(f.read())
    with pytest.raises(EngineError, match="OUTPUT_COLLISION_RAW_MISMATCH"):
        P.clean_workbook(spark, cleaned, folder)
    again = P.clean_workbook(spark, cleaned, str(tmp_path / "out2"))  # clean twice is clean once
    assert again["cleaned_sha256"] == first["cleaned_sha256"]
    with pytest.raises(EngineError, match="RAW_ARCHIVE_HASH_MISMATCH"):
        P.replay(spark, folder, "0" * 64)
    os.remove(os.path.join(folder, P.LOG))
    with pytest.raises(EngineError, match="OUTPUT_COLLISION_INVALID_STATE"):
        P.clean_workbook(spark, book, folder)
    with pytest.raises(EngineError, match="REPLAY_RAW_INPUT_MISSING"):
        P.replay(spark, folder, first["raw_sha256"])


def rewritten(raw: bytes, part: str, *changes: tuple[str, str]) -> bytes:
    book = xlsx.Workbook(raw)
    files = {n: book.zip.read(n) for n in book.zip.namelist()}
    for a, b in changes:
        assert a.encode() in files[part]
        files[part] = files[part].replace(a.encode(), b.encode())
    return xlsx._zipped(files)


def test_output_tree_and_envelope(spark, book, tmp_path):
    out = P.clean_workbook(spark, book, str(tmp_path / "Study"))
    found = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "Study") for d, _, names in os.walk(tmp_path / "Study") for f in names)
    assert found == ["Analysis/Study.XLSX", "Analysis/cleaning_log.json", "Analysis/data_quality_report.xlsx", "Scripts/clean.py", "Study_cleaned.xlsx"]
    assert all(os.path.isfile(out[k]) for k in out if k.endswith("_path"))
    assert {"code", "sheet", "message"} == set(out["warnings"][0])
    with open(out["report_xlsx_path"], "rb") as f:
        assert tuple(s for s, *_ in xlsx.Workbook(f.read()).sheets) == model.REPORT_SHEETS


def test_cleaned_workbook_keeps_what_isn_t_edited(spark, tmp_path):
    rows = [[], ["Name", "n"], [" x ", 1], ["x", 1], [], ["y", 2]]
    raw = xlsx.write_workbook({"One": rows, "Empty": [], "Hidden": [["p", "q"], ["=A1", 1]]}, hidden=("Hidden",), frozen_rows={"One": 2})
    raw = rewritten(raw, "xl/worksheets/sheet1.xml", ('<c r="A3" t=', '<c r="A3" s="7" t='), ('<row r="3">', '<row r="3" ht="30" customHeight="1">'), ("<sheetData>", '<cols><col min="1" max="1" width="40"/></cols><sheetData>'))
    (tmp_path / "b.xlsx").write_bytes(raw)
    out = P.clean_workbook(spark, str(tmp_path / "b.xlsx"), str(tmp_path / "b"))
    with open(out["cleaned_xlsx_path"], "rb") as f:
        cleaned = xlsx.Workbook(f.read())
    xml = cleaned.zip.read("xl/worksheets/sheet1.xml").decode()
    assert [x[:2] for x in cleaned.sheets] == [("One", "visible"), ("Empty", "visible"), ("Hidden", "hidden")]
    assert '<col min="1" max="1" width="40"/>' in xml and 'ht="30" customHeight="1"' in xml and '<c r="A3" s="7" t="inlineStr">' in xml and "frozen" in xml
    # another sheet has a formula, so the second x leaves an empty row and nothing moves
    assert {(c[3], c[4]): c[6] for c in cleaned.cells() if c[2] == "One" and c[5] != "BLANK"} == {(2, 1): "Name", (2, 2): "n", (3, 1): "x", (3, 2): "1", (6, 1): "y", (6, 2): "2"}
    assert [c[8] for c in cleaned.cells() if c[5] == "FORMULA"] == ["=A1"]


def test_removed_rows_move_up_where_no_address_is_bound():
    rows = [["a", "b"], ["x", 1.5], ["x", 1.5], ["y", True], [], ["z", "< & >"]]
    raw = xlsx.write_workbook({"S": rows})
    got = xlsx.edit_workbook(raw, {"S": {(6, 1): "z & <t>\r"}}, {"S": {3}})
    values = {(c[3], c[4]): c[6] for c in xlsx.Workbook(got).cells()}
    assert values == {(1, 1): "a", (1, 2): "b", (2, 1): "x", (2, 2): "1.5", (3, 1): "y", (3, 2): "TRUE", (5, 1): "z & <t>\r", (5, 2): "< & >"}
    assert xlsx.edit_workbook(got, {}, {}) == got
    bound = xlsx.edit_workbook(xlsx.write_workbook({"S": rows}, {"S": ["A6:A7"]}), {}, {"S": {3}})
    assert {c[3] for c in xlsx.Workbook(bound).cells() if c[5] != "BLANK"} == {1, 2, 4, 6}


def test_removed_formulas():
    raw = xlsx.write_workbook({"S": [["a"], ["=1+1"], ["=1+1"]]})
    got = xlsx.edit_workbook(raw, {}, {"S": {3}})
    assert [(c[3], c[8]) for c in xlsx.Workbook(got).cells() if c[5] == "FORMULA"] == [(2, "=1+1")]
    assert P.kept_structure(raw, got, {"S": {3}}) and not P.kept_structure(raw, got, {})
    shared = rewritten(raw, "xl/worksheets/sheet1.xml", ('<c r="A3"><f>', '<c r="A3"><f t="shared" ref="A3:A4" si="0">'))
    with pytest.raises(EngineError, match="RISKY_WORKBOOK_FEATURE"):
        xlsx.edit_workbook(shared, {}, {"S": {3}})


def test_moved_formulas():
    for formula, rows, columns, want in (
        ("A1+$B$2*C$3-$D4", 2, 1, "B3+$B$2*D$3-$D6"),
        ("SUM(A1:B2)", 1, 0, "SUM(A2:B3)"),
        ("LOG10(A1)&\"A1\"&'Sheet A1'!B2&Other!C3", 1, 1, "LOG10(B2)&\"A1\"&'Sheet A1'!C3&Other!D4"),
        ("SUM(A:B)+SUM($A:B)+SUM(1:2)+SUM($1:2)", 3, 2, "SUM(C:D)+SUM($A:D)+SUM(4:5)+SUM($1:5)"),
        ("Table1[A1]+rate_A1+A1B+TRUE", 5, 5, "Table1[A1]+rate_A1+A1B+TRUE"),
        ("A1", -1, 0, "#REF!"),
        ("XFD1", 0, 1, "#REF!"),
    ):
        assert xlsx.moved_formula(formula, rows, columns) == want


def test_shared_formulas(spark, tmp_path):
    """Filled-down formulas differ row by row, so no row is another's copy; one that reads alike everywhere is."""
    rows = [["name", "sum", "fixed"], *[["x", f"=A{i}", "=$A$1"] for i in range(2, 5)]]
    raw = xlsx.write_workbook({"S": rows})
    first, rest = ('<c r="B2"><f>A2</f>', '<c r="B2"><f t="shared" ref="B2:B4" si="0">A2</f>'), [(f'<c r="B{i}"><f>A{i}</f>', f'<c r="B{i}"><f t="shared" si="0"/>') for i in (3, 4)]
    shared = rewritten(raw, "xl/worksheets/sheet1.xml", first, *rest)
    assert [c[8] for c in xlsx.Workbook(shared).cells() if c[4] == 2 and c[3] > 1] == ["=A2", "=A3", "=A4"]
    (tmp_path / "s.xlsx").write_bytes(shared)
    cells, sheets = xlsx.read_cells(spark, str(tmp_path / "s.xlsx")), xlsx.read_sheets(spark, str(tmp_path / "s.xlsx"))
    assert R.cleaned_cells(cells, sheets)[2].count() == 0
    without = [[r[0], r[2]] for r in rows]
    (tmp_path / "t.xlsx").write_bytes(xlsx.write_workbook({"S": without}))
    cells, sheets = xlsx.read_cells(spark, str(tmp_path / "t.xlsx")), xlsx.read_sheets(spark, str(tmp_path / "t.xlsx"))
    assert R.cleaned_cells(cells, sheets)[2].count() == 2


def test_workbooks_of_a_folder_stay_apart(spark, tmp_path):
    """Sheets of one name in two workbooks: headers, copies and counts are each workbook's own."""
    (tmp_path / "a.xlsx").write_bytes(xlsx.write_workbook({"S": [["n", "m"], ["x", 1], ["y", 1]]}))
    (tmp_path / "b.xlsx").write_bytes(xlsx.write_workbook({"S": [[], ["n", "m"], ["x", 1], ["x", 1]]}))
    cells, sheets = xlsx.read_cells(spark, str(tmp_path)), xlsx.read_sheets(spark, str(tmp_path))
    _, status, gone = R.cleaned_cells(cells, sheets)
    name = lambda r: os.path.basename(r["workbook"])
    assert {name(r): r["header_row"] for r in status.collect()} == {"a.xlsx": 1, "b.xlsx": 2}
    assert [(name(r), r["row_idx"], r["retained"]) for r in gone.collect()] == [("b.xlsx", 4, 3)]
    frames = R.report(cells, sheets)
    assert [(name(r), r["duplicates_removed"], r["n_rows"]) for r in frames["Sheet Statistics"].collect()] == [("a.xlsx", 0, 3), ("b.xlsx", 1, 4)]
    assert frames["Missing Values"].count() == 4


def test_replay_script_needs_nothing_else(spark, book, tmp_path):
    import subprocess
    import sys

    out = P.clean_workbook(spark, book, str(tmp_path / "Study"))
    os.remove(out["cleaned_xlsx_path"])
    done = subprocess.run([sys.executable, "-I", out["replay_script_path"]], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert json.loads(done.stdout)["cleaned_sha256"] == out["cleaned_sha256"] == P.file_hash(out["cleaned_xlsx_path"])
    with open(out["raw_xlsx_path"], "ab") as f:
        f.write(b" ")
    bad = subprocess.run([sys.executable, "-I", out["replay_script_path"]], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert bad.returncode == 1 and "RAW_ARCHIVE_HASH_MISMATCH" in bad.stderr


def test_codes_of_failing_steps(spark, book, tmp_path, monkeypatch):
    for target, name, code in ((P.shutil, "copyfile", "RAW_ARCHIVE_COPY_FAILED"), (P, "report_workbook", "REPORT_GENERATION_FAILED"), (P.json, "dump", "LOG_GENERATION_FAILED")):
        with monkeypatch.context() as m:
            m.setattr(target, name, lambda *a, **k: 1 / 0)
            with pytest.raises(EngineError, match=code):
                P.clean_workbook(spark, book, str(tmp_path / "o"))
        assert os.listdir(tmp_path) == []
    raw = xlsx.write_workbook({"S": [["a"]]})
    chart = rewritten(raw, "xl/worksheets/sheet1.xml", ("<worksheet", "<chartsheet"), ("</worksheet", "</chartsheet"))
    with pytest.raises(EngineError, match="UNSUPPORTED_WORKBOOK_FEATURE"):
        list(xlsx.Workbook(chart).cells())


@pytest.mark.parametrize("swaps", [True, False])
def test_publish_over_a_last_output(tmp_path, monkeypatch, swaps):
    if not swaps:
        monkeypatch.setattr(P, "exchange", lambda a, b: False)
    folder = tmp_path / "o"
    for text in ("1", "2"):
        P.publish(str(folder), lambda s, t=text: open(os.path.join(s, "f"), "w").write(t), lambda s: True)  # noqa: SIM115
        assert (folder / "f").read_text() == text and os.listdir(tmp_path) == ["o"]


def test_failed_publish_keeps_the_last_output(tmp_path):
    folder = tmp_path / "o"
    folder.mkdir()
    (folder / "keep").write_text("1")
    for build, valid in ((lambda s: 1 / 0, lambda s: True), (lambda s: None, lambda s: False)):
        with pytest.raises((ZeroDivisionError, EngineError)):
            P.publish(str(folder), build, valid)
    assert os.listdir(tmp_path) == ["o"] and (folder / "keep").read_text() == "1"


def test_bad_inputs(spark, tmp_path):
    bad = tmp_path / "bad.xlsx"
    bad.write_bytes(b"no zip")
    locked = tmp_path / "locked.xlsx"
    locked.write_bytes(b"\xd0\xcf\x11\xe0 rest")
    csv = tmp_path / "x.csv"
    csv.write_text("a")
    for path, code in (("", "INPUT_PATH_REQUIRED"), (str(tmp_path / "none.xlsx"), "INPUT_NOT_FOUND"), (str(tmp_path), "INPUT_NOT_FILE"), (str(csv), "UNSUPPORTED_EXTENSION"), (str(bad), "INVALID_XLSX"), (str(locked), "ENCRYPTED_OR_PROTECTED_WORKBOOK")):
        with pytest.raises(EngineError, match=code):
            P.check_input(path)
    with pytest.raises(EngineError, match="OUTPUT_PARENT_UNWRITABLE"):
        P.publish(str(tmp_path / "no" / "where"), lambda s: None, lambda s: True)


def test_preview(spark, book):
    assert P.preview(spark, book).count() == 5


def test_sheets_that_are_not_joined_or_not_cleaned_are_warned_of(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "one.xlsx").write_bytes(xlsx.write_workbook({"S": [["n", "m"], ["x", 1]]}))
    (tmp_path / "two.xlsx").write_bytes(xlsx.write_workbook({"S": [["n", "m"], ["x", 1]], "T": [["n", "m"], ["x", 1]]}))
    cells, sheets = xlsx.read_cells(spark, str(tmp_path)), xlsx.read_sheets(spark, str(tmp_path))
    sheets = sheets.withColumn("merges", F.when(F.col("sheet") == "T", F.array(F.lit("A5:B5"))).otherwise(F.col("merges")))
    found = {(r["code"], os.path.basename(r["workbook"]), r["sheet"]) for r in R.report(cells, sheets)["Warnings"].collect()}
    assert {x for x in found if x[0] in ("NO_CROSS_SHEET_JOIN", "UNSUPPORTED_FEATURE_REVIEW")} == {("NO_CROSS_SHEET_JOIN", "two.xlsx", None), ("UNSUPPORTED_FEATURE_REVIEW", "two.xlsx", "T")}
