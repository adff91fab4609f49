from __future__ import annotations

import json

from loomfield.__main__ import main
from loomfield.sources import xlsx


def test_exit_codes(spark, tmp_path, capsys):
    for args in ([], ["clean"], ["clean", "a", "b"], ["other", "x"], ["clean", str(tmp_path / "none.xlsx")]):
        assert main(args) == 1
        assert json.loads(capsys.readouterr().out)["status"] == "error"


def test_journey_command(spark, tmp_path, capsys):
    (tmp_path / "Interview").mkdir()
    (tmp_path / "Interview" / "mapped-transcript.md").write_text("| # | Theme | Question | Response |\n|---|---|---|---|\n| 1 | usage | q | a \\| b |\n| 2 | x | q | a |\n", encoding="utf-8")
    assert main(["journey", str(tmp_path)]) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert len(out["files"]) == 5 and out["rejected"][0]["reason"] == "UNKNOWN_THEME"
    assert "| 1 | usage | q | a \\| b |" in (tmp_path / "Journey Map" / "extracted-usage.md").read_text(encoding="utf-8")


def test_questionnaire_workbook(spark, tmp_path):
    (tmp_path / "q.xlsx").write_bytes(xlsx.write_questionnaire([(1, "0. Warm-up", "q1", "a\nb"), (2, "4. Usage", "q2", "c")], "Title"))
    cells = xlsx.read_cells(spark, str(tmp_path / "q.xlsx"))
    assert [r["text"] for r in cells.where("row_idx = 4").orderBy("col_idx").collect()] == ["STT", "Giai đoạn", "Câu hỏi", "Mục tiêu / Chủ đề khai thác"]
    assert xlsx.used_range(cells, "A5:D32", "Questionnaire").where("kind <> 'BLANK'").count() == 8
    assert [json.loads(x)["values"] for x in xlsx.inspection(cells, "A5:D32", "Questionnaire")] == [[1.0, "0. Warm-up", "q1", "a\nb"], [2.0, "4. Usage", "q2", "c"]]


def test_questionnaire_looks():
    from xml.etree import ElementTree

    book = xlsx.Workbook(xlsx.write_questionnaire([(1, "0. Warm-up", "q1", "a"), (2, "4. Usage", "q2", "c")], "Title", "Source"))
    styles, sheet = ElementTree.fromstring(book.zip.read("xl/styles.xml")), ElementTree.fromstring(book.zip.read("xl/worksheets/sheet1.xml"))
    of = {c.get("r"): int(c.get("s")) for c in sheet.iter(f"{xlsx.MAIN}c")}
    xfs, fills = styles.find(f"{xlsx.MAIN}cellXfs"), styles.find(f"{xlsx.MAIN}fills")
    colour = lambda at: fills[int(xfs[of[at]].get("fillId"))].find(f".//{xlsx.MAIN}fgColor").get("rgb")
    assert (colour("A1"), colour("D4"), colour("B5"), colour("B6")) == ("FF17365D", "FF1F4E78", "FFE5E7EB", "FFFFD2B8")
    assert [c.get("width") for c in sheet.iter(f"{xlsx.MAIN}col")] == ["8", "23", "62", "44"] and [r.get("ht") for r in sheet.iter(f"{xlsx.MAIN}row")] == ["30", "20", None, "28", "46", "46"]
    assert sheet.find(f".//{xlsx.MAIN}sheetView").get("showGridLines") == "0" and len(xfs) == len({*of.values()}) + 1
