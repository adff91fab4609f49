"""Workbooks: a reader into the long cell relation, a plain writer, and edits in place, on zip and XML from the standard library.

Files are read as bytes by Spark, so any store that it reads will do; one workbook is one task's work.
Formulas stay text. Dates are numbers whose style has a date format. Unknown parts are ignored.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loomfield.errors import EngineError
from loomfield.model import CELLS, SHEETS

# Namespaces of the format and its built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


#: What of a formula isn't a reference: texts, names of sheets in quotes, names of tables' columns.
FIXED_PARTS = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*'|\[[^\]]*\])""")
REFERENCE = re.compile(r"(?<![\w.$])(?:(\$?)([A-Za-z]{1,3})(\$?)(\d{1,7})(?![\w.(!])|(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})(?![\w.(!])|(\$?)(\d{1,7}):(\$?)(\d{1,7})(?![\w.(!]))")


def moved_formula(formula: str, rows: int, columns: int) -> str:
    """A formula as it reads in a cell so many rows and columns away: relative references move, absolute ones stay, and one that leaves the sheet is #REF!."""

    def column(fixed: str, name: str) -> str | None:
        n = corner(f"{name}1")[1] + (0 if fixed else columns)
        return fixed + column_name(n) if 1 <= n <= 16_384 else None

    def row(fixed: str, digits: str) -> str | None:
        n = int(digits) + (0 if fixed else rows)
        return f"{fixed}{n}" if 1 <= n <= 1_048_576 else None

    def one(m: re.Match) -> str:
        if m[2]:
            parts = [column(m[1], m[2]), row(m[3], m[4])]
            return "#REF!" if None in parts else "".join(parts)
        parts = [column(m[5], m[6]), column(m[7], m[8])] if m[6] else [row(m[9], m[10]), row(m[11], m[12])]
        return "#REF!" if None in parts else ":".join(parts)

    return "".join(x if i % 2 else REFERENCE.sub(one, x) for i, x in enumerate(FIXED_PARTS.split(formula)))


def check_extension(path: str) -> None:
    if not path:
        raise EngineError("INPUT_PATH_REQUIRED")
    if not path.lower().endswith(".xlsx"):
        raise EngineError("UNSUPPORTED_EXTENSION", path.rpartition(".")[2], path)


def column_name(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def corner(address: str) -> tuple[int, int]:
    """Row and column, from 1."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", address).groups()
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return int(digits), n


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """(name, state, part) of the sheets, in their order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    part = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), s.get("state", "visible"), part(rels[s.get(f"{REL}id")])) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]


class Workbook:
    def __init__(self, raw: bytes, name: str = ""):
        if raw[:4] == b"\xd0\xcf\x11\xe0":
            raise EngineError("ENCRYPTED_OR_PROTECTED_WORKBOOK", source=name)
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
            self.sheets = sheet_parts(self.zip)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise EngineError("INVALID_XLSX", str(e), name) from e
        self.name = name
        names = set(self.zip.namelist())
        self.shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def _date_styles(self) -> set[int]:
        root = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
        xfs = root.find(f"{MAIN}cellXfs")
        return {i for i, x in enumerate([] if xfs is None else xfs) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def merges(self, part: str) -> list[str]:
        return [m.get("ref") for m in self._xml(part).iter(f"{MAIN}mergeCell")]

    def cells(self) -> Iterator[tuple]:
        for k, (sheet, _, part) in enumerate(self.sheets):
            boxes = [tuple(corner(x) for x in (m.split(":") * 2)[:2]) for m in self.merges(part)]
            found = [(corner(c.get("r")), c) for c in self._sheet(part).iter(f"{MAIN}c")]
            shared = {f.get("si"): (place, f.text) for place, c in found if (f := c.find(f"{MAIN}f")) is not None and f.get("t") == "shared" and f.text}
            for (row, col), c in found:
                kind, text, num, formula = self._value(c, (row, col), shared)
                merged = any(a[0] <= row <= b[0] and a[1] <= col <= b[1] for a, b in boxes)
                yield self.name, k, sheet, row, col, kind, text, num, formula, merged

    def _sheet(self, part: str) -> ElementTree.Element:
        root = self._xml(part)
        if root.tag != f"{MAIN}worksheet":
            raise EngineError("UNSUPPORTED_WORKBOOK_FEATURE", f"{part} isn't a table of cells", self.name)
        return root

    def _value(self, c: ElementTree.Element, place: tuple[int, int], shared: dict[str, tuple[tuple[int, int], str]]) -> tuple:
        """kind, text, number, formula. A formula that a cell shares is the first cell's, moved to its place."""
        f, v, t = c.find(f"{MAIN}f"), c.findtext(f"{MAIN}v"), c.get("t", "n")
        if f is not None and f.get("t") == "shared" and not f.text and f.get("si") in shared:
            (row, col), master = shared[f.get("si")]
            return "FORMULA", None, None, f"={moved_formula(master, place[0] - row, place[1] - col)}"
        if f is not None:
            return "FORMULA", None, None, f"={f.text or ''}"
        if t == "s" and v is not None:
            return "TEXT", self.shared[int(v)], None, None
        if t in ("inlineStr", "str"):
            s = "".join(x.text or "" for x in c.iter(f"{MAIN}t")) if t == "inlineStr" else v or ""
            return ("TEXT", s, None, None) if s else ("BLANK", None, None, None)
        if v is None:
            return "BLANK", None, None, None
        if t == "b":
            return "BOOL", "TRUE" if v == "1" else "FALSE", None, None
        if t == "e":
            return "ERROR", v, None, None
        if int(c.get("s", 0)) in self.dates:
            return "DATE", (datetime(1899, 12, 30) + timedelta(days=float(v))).isoformat(sep=" ", timespec="seconds"), float(v), None
        return "NUMBER", v, float(v), None


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cell relation of all workbooks under a path."""

    def parse(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"]):
                yield pd.DataFrame(list(Workbook(bytes(raw), name).cells()), columns=[x.split()[0] for x in CELLS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("path", "content").mapInPandas(parse, CELLS)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheets with visibility, used size and merged ranges."""

    def parse(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"]):
                book = Workbook(bytes(raw), name)
                used: dict[int, list[int]] = {}
                for c in book.cells():
                    if c[5] != "BLANK":
                        used[c[1]] = [max(a, b) for a, b in zip(used.get(c[1], [0, 0]), c[3:5])]
                yield pd.DataFrame([(name, k, s, state, *used.get(k, [0, 0]), book.merges(p)) for k, (s, state, p) in enumerate(book.sheets)], columns=[x.split()[0] for x in SHEETS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("path", "content").mapInPandas(parse, SHEETS)


def used_range(cells: DataFrame, address: str, sheet: str | None = None) -> DataFrame:
    """Cells of an A1-style range, of one sheet if named."""
    (r1, c1), (r2, c2) = (corner(x) for x in (address.split(":") * 2)[:2])
    rows = cells.where(f"row_idx BETWEEN {r1} AND {r2} AND col_idx BETWEEN {c1} AND {c2}")
    return rows if sheet is None else rows.where(rows.sheet == sheet)


@dataclass(frozen=True, order=True)
class Style:
    """How a cell looks; colours are RRGGBB."""

    fill: str = ""
    colour: str = ""
    bold: bool = False
    italic: bool = False
    size: int = 11
    border: str = ""
    across: str = ""
    down: str = ""
    wrap: bool = False


@dataclass
class Look:
    """Of a sheet: styles by (row, column), widths by column, heights by row, and whether it shows its grid."""

    styles: dict[tuple[int, int], Style]
    widths: dict[int, float]
    heights: dict[int, float]
    grid: bool = True


def _styles(used: list[Style]) -> str:
    """The part with the styles, numbered from 1; 0 is plain."""
    edge = lambda s: "".join(f'<{side} style="thin"><color rgb="FF{s.border}"/></{side}>' for side in ("left", "right", "top", "bottom")) if s.border else ""
    font = lambda s: f"<font>{'<b/>' * s.bold}{'<i/>' * s.italic}<sz val=\"{s.size}\"/>" + (f'<color rgb="FF{s.colour}"/>' if s.colour else "") + '<name val="Calibri"/></font>'
    # fixed values: the first two fills are none and gray
    fill = lambda s: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{s.fill}"/></patternFill></fill>' if s.fill else '<fill><patternFill patternType="none"/></fill>'
    place = lambda s: "<alignment" + (f' horizontal="{s.across}"' if s.across else "") + (f' vertical="{s.down}"' if s.down else "") + (' wrapText="1"' if s.wrap else "") + "/>"
    xfs = "".join(f'<xf numFmtId="0" fontId="{i}" fillId="{i + 1}" borderId="{i}" xfId="0" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1">{place(s)}</xf>' for i, s in enumerate(used, 1))
    n = len(used) + 1
    return (
        f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="{n}">{font(Style())}{"".join(map(font, used))}</fonts>'
        f'<fills count="{n + 1}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{"".join(map(fill, used))}</fills>'
        f'<borders count="{n}"><border/>{"".join(f"<border>{edge(s)}</border>" for s in used)}</borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="{n}"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>{xfs}</cellXfs></styleSheet>'
    )


def write_workbook(sheets: dict[str, list[list[object]]], merges: dict[str, list[str]] | None = None, hidden: tuple[str, ...] = (), frozen_rows: dict[str, int] | None = None, lists: dict[str, tuple[str, list[str]]] | None = None, formulas: bool = True, looks: dict[str, Look] | None = None) -> bytes:
    """A workbook of rows of values: text, numbers, booleans, None, and (unless `formulas` is off) formulas as text that begins with =. The same input gives the same bytes.

    frozen_rows: rows that stay in view, by sheet; lists: a range and the values that its cells may have, by sheet;
    looks: styles, widths and heights, by sheet.
    """
    used = sorted({s for look in (looks or {}).values() for s in look.styles.values()})
    place_of = {s: i + 1 for i, s in enumerate(used)}

    def cell(r: int, c: int, v: object, look: Look | None) -> str:
        style = look and look.styles.get((r, c))
        at = f'r="{column_name(c)}{r}"' + (f' s="{place_of[style]}"' if style else "")
        if v is None:
            return f"<c {at}/>" if style else ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v!r}</v></c>"
        if formulas and str(v).startswith("="):
            return f"<c {at}><f>{escape(str(v)[1:])}</f></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v)).replace(chr(13), "&#13;")}</t></is></c>'

    head, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', MAIN[1:-1]
    rel, pack = REL[1:-1], "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"{" state=" + chr(34) + "hidden" + chr(34) if n in hidden else ""}/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    if used:
        files["xl/styles.xml"] = head + _styles(used)
        files["[Content_Types].xml"] = files["[Content_Types].xml"].replace("</Types>", '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        files["xl/_rels/workbook.xml.rels"] = files["xl/_rels/workbook.xml.rels"].replace("</Relationships>", f'<Relationship Id="rIdS" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
    for k, (name, rows) in enumerate(sheets.items(), 1):
        look = (looks or {}).get(name)
        wide = max([len(r) for r in rows], default=0) if look is None else max([c for _, c in look.styles], default=0)
        height = lambda r, look=look: f' ht="{look.heights[r]}" customHeight="1"' if look and r in look.heights else ""
        body = "".join(f'<row r="{r}"{height(r)}>' + "".join(cell(r, c, v, look) for c, v in enumerate([*row, *[None] * (wide - len(row))], 1)) + "</row>" for r, row in enumerate(rows, 1))
        columns = "<cols>" + "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in sorted(look.widths.items())) + "</cols>" if look and look.widths else ""
        boxes = (merges or {}).get(name, [])
        joined = f'<mergeCells count="{len(boxes)}">' + "".join(f'<mergeCell ref="{b}"/>' for b in boxes) + "</mergeCells>" if boxes else ""
        n = (frozen_rows or {}).get(name, 0)
        lines = "" if look is None or look.grid else ' showGridLines="0"'
        view = f'<sheetViews><sheetView{lines} workbookViewId="0"><pane ySplit="{n}" topLeftCell="A{n + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if n else ""
        span, values = (lists or {}).get(name, ("", []))
        allowed = f'<dataValidations count="1"><dataValidation type="list" sqref="{span}"><formula1>{escape(chr(34) + ",".join(values) + chr(34))}</formula1></dataValidation></dataValidations>' if span else ""
        files[f"xl/worksheets/sheet{k}.xml"] = f'{head}<worksheet xmlns="{main}">{view}{columns}<sheetData>{body}</sheetData>{joined}{allowed}</worksheet>'
    return _zipped(files)


def _zipped(files: dict[str, str] | dict[str, bytes]) -> bytes:
    """The same files give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, content in files.items():
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


ROW = re.compile(r"<((?:\w+:)?)row(?=[\s/>])([^>]*?)(?:/>|>(.*?)</\1row>)", re.S)
CELL = re.compile(r"<((?:\w+:)?)c(?=[\s/>])([^>]*?)(?:/>|>(.*?)</\1c>)", re.S)
PLACE = re.compile(r"""(?<=\sr=["'])[^"']+""")
FORMULA = re.compile(r"<(?:\w+:)?f[\s/>]")
#: A formula that other cells take theirs from.
SHARED_FORMULA = re.compile(r"<(?:\w+:)?f\s[^>]*\bref=")
#: What is bound to addresses: rows above or within it don't move.
BOUND = re.compile(r"<(?:\w+:)?(?:f|mergeCells|autoFilter|tableParts|conditionalFormatting|dataValidations|hyperlinks|drawing|legacyDrawing|rowBreaks|extLst)[\s/>]")


def edit_workbook(raw: bytes, texts: dict[str, dict[tuple[int, int], str]], gone: dict[str, set[int]]) -> bytes:
    """The same workbook with some cells' texts replaced and some rows taken out, by sheet.

    Every other part stays byte for byte: styles, widths, names, visibility, merges, formulas,
    rows without values. An edited cell keeps its style, but not formats of parts of its text.
    Rows below one that goes move up where nothing in the workbook is bound to addresses;
    otherwise it stays as an empty row, so that no reference changes its meaning. A row with a
    formula that others share can't go.
    """
    book = zipfile.ZipFile(io.BytesIO(raw))
    files = {n: book.read(n) for n in book.namelist()}
    sheets = sheet_parts(book)
    sources = {part: files[part].decode("utf-8-sig") for _, _, part in sheets if files[part].lstrip()[:1] in (b"<", b"\xef")}
    if len(sources) < len(sheets):
        raise EngineError("RISKY_WORKBOOK_FEATURE", "a sheet isn't UTF-8")
    fixed = b"<definedName" in files["xl/workbook.xml"] or any(FORMULA.search(x) for x in sources.values())
    lost_formula = False
    for sheet, _, part in sheets:
        if not texts.get(sheet) and not gone.get(sheet):
            continue
        xml, lost = _edited(sources[part], texts.get(sheet, {}), gone.get(sheet, set()), not fixed and not BOUND.search(sources[part]))
        files[part], lost_formula = xml.encode(), lost_formula or lost
    if lost_formula and files.pop("xl/calcChain.xml", None):  # the order of calculation is found again on opening
        files["[Content_Types].xml"] = re.sub(rb"<Override[^>]*calcChain[^>]*/>", b"", files["[Content_Types].xml"])
        files["xl/_rels/workbook.xml.rels"] = re.sub(rb"<Relationship\s[^>]*calcChain[^>]*/>", b"", files["xl/_rels/workbook.xml.rels"])
    return _zipped(files)


def _edited(xml: str, texts: dict[tuple[int, int], str], gone: set[int], movable: bool) -> tuple[str, bool]:
    """(the sheet with its edits, whether a formula went)."""
    moved, lost = 0, False

    def emptied(m: re.Match) -> str:
        return f"<{m[1]}c{_without_kind(m[2])}/>"

    def cell(m: re.Match) -> str:
        place = PLACE.search(m[2])[0]
        attributes, text = m[2], texts.get(corner(place))
        if moved:
            row, col = corner(place)
            attributes = PLACE.sub(f"{column_name(col)}{row - moved}", attributes)
        if text is not None:
            return f'<{m[1]}c{_without_kind(attributes)} t="inlineStr"><{m[1]}is><{m[1]}t xml:space="preserve">{escape(text).replace(chr(13), "&#13;")}</{m[1]}t></{m[1]}is></{m[1]}c>'
        return m[0].replace(m[2], attributes, 1) if moved else m[0]

    def row(m: re.Match) -> str:
        nonlocal moved, lost
        attributes, body = m[2], m[3] or ""
        named = PLACE.search(attributes) or PLACE.search(body)
        if named is None:
            return m[0]
        r = int(re.search(r"\d+$", named[0])[0])
        if r in gone:
            if SHARED_FORMULA.search(body):
                raise EngineError("RISKY_WORKBOOK_FEATURE", f"row {r} has a formula that other rows share")
            lost = lost or bool(FORMULA.search(body))
            if movable:
                moved += 1
                return ""
            return f"<{m[1]}row{attributes}>{CELL.sub(emptied, body)}</{m[1]}row>"
        if moved:
            attributes = PLACE.sub(str(r - moved), attributes)
        return f"<{m[1]}row{attributes}>{CELL.sub(cell, body)}</{m[1]}row>"

    out = ROW.sub(row, xml)
    return (re.sub(r"<(?:\w+:)?dimension\s[^>]*/>", "", out) if moved else out), lost


def _without_kind(attributes: str) -> str:
    return re.sub(r"""\st=["'][^"']*["']""", "", attributes)


def write_questionnaire(rows: list[tuple[int, str, str, str]], title: str, source: str = "", sheet: str = "Questionnaire") -> bytes:
    """The questionnaire's workbook: a merged title and source, headers in the fourth row, which stays in view, a list of themes to choose from, and each theme in its colour."""
    from loomfield.model import THEME_COLOURS, THEMES

    # The sheet's colours, sizes and widths.
    title_look, source_look = Style(fill="17365D", colour="FFFFFF", bold=True, size=16, across="left", down="center"), Style(colour="666666", italic=True, size=10, across="left", down="center")
    head_look, edge = Style(fill="1F4E78", colour="FFFFFF", bold=True, border="D9E2F3", across="center", down="center", wrap=True), "D9E2F3"
    styles = {(1, c): title_look for c in range(1, 5)} | {(2, c): source_look for c in range(1, 5)} | {(4, c): head_look for c in range(1, 5)}
    for r, row in enumerate(rows, 5):
        styles |= {(r, 1): Style(border=edge, across="center", down="top"), (r, 2): Style(fill=THEME_COLOURS.get(row[1], "").lstrip("#"), border=edge, down="top", wrap=True)}
        styles |= {(r, c): Style(border=edge, down="top", wrap=True) for c in (3, 4)}
    look = Look(styles, {1: 8, 2: 23, 3: 62, 4: 44}, {1: 30, 2: 20, 4: 28} | {r: 46 for r in range(5, len(rows) + 5)}, grid=False)
    table = [[title], [source or None], [], ["STT", "Giai đoạn", "Câu hỏi", "Mục tiêu / Chủ đề khai thác"], *map(list, rows)]
    return write_workbook({sheet: table}, {sheet: ["A1:D1", "A2:D2"]}, frozen_rows={sheet: 4}, lists={sheet: (f"B5:B{len(rows) + 4}", list(THEMES))}, looks={sheet: look})


def inspection(cells: DataFrame, address: str, sheet: str, max_rows: int = 32, max_cols: int = 4) -> list[str]:
    """JSON lines of a range's values, one a row, at most so many rows and columns: for people to look at."""
    found = used_range(cells, address, sheet)
    (first, left), _ = (corner(x) for x in (address.split(":") * 2)[:2])
    some = found.where(f"row_idx < {first + max_rows} AND col_idx < {left + max_cols}")
    lines: dict[int, list] = {}
    for c in some.orderBy("row_idx", "col_idx").collect():
        row = lines.setdefault(c["row_idx"], [None] * max_cols)
        row[c["col_idx"] - left] = c["formula"] or (c["num"] if c["kind"] == "NUMBER" else c["text"])
    return [json.dumps({"row": r, "values": v}, ensure_ascii=False) for r, v in lines.items()]
