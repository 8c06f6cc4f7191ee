"""Spreadsheets: a reader as a Python data source and a writer for small review tables."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .snapshots import Store

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a partition: a partition reads past those before it, which is faster than making rows of them.
ROWS = 100_000
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def column_name(index: int) -> str:
    """0 is A, 26 is AA."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def column_index(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_part(z: zipfile.ZipFile, path: str, sheet: str | None) -> str:
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): targets[s.get(_REL)] for s in book.iterfind(".//m:sheet", _NS)}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"{path} has no sheet {sheet!r}: {list(sheets)}")
    target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    return "xl/" + target.lstrip("/").removeprefix("xl/")


def _elements(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of that name as they are read; each is forgotten before the next, and so is what lies between them."""
    name, open_ = f"{{{_NS['m']}}}{tag}", []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            open_.append(e)
            continue
        open_.pop()
        if e.tag == name:
            yield e
            e.clear()
            if open_:
                open_[-1].clear()


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iterfind(".//m:t", _NS))


def read_rows(path: str, sheet: str | None = None, first: int = 0, last: int | None = None, columns: list[int] | None = None) -> Iterator[list[str]]:
    """Cells of rows ``first`` up to ``last`` as text; gaps are empty, and so is what is not in ``columns``. An unknown
    sheet raises. One row is held at a time, and the shared strings once."""
    wanted = None if columns is None else set(columns)
    with zipfile.ZipFile(path) as z:
        part = _sheet_part(z, path, sheet)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = [sys.intern(_text(e)) for e in _elements(f, "si")]
        with z.open(part) as f:
            for n, row in enumerate(_elements(f, "row")):
                if last is not None and n >= last:
                    return
                if n < first:
                    continue
                cells: list[str] = []
                for c in row:
                    at = column_index(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    if wanted is not None and at not in wanted:
                        continue
                    value = c.findtext("m:v", "", _NS)
                    kind = c.get("t")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _text(c)
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    cells[at] = value
                yield cells


def row_count(path: str, sheet: str | None = None) -> int:
    """Rows of a sheet, by its stated size if it has one."""
    with zipfile.ZipFile(path) as z, z.open(_sheet_part(z, path, sheet)) as f:
        for _, e in ElementTree.iterparse(f, ("start",)):
            if e.tag == f"{{{_NS['m']}}}dimension" and (m := re.search(r":[A-Z]+(\d+)$", e.get("ref") or "")):
                return int(m[1])
            if e.tag == f"{{{_NS['m']}}}sheetData":
                break
    return sum(1 for _ in read_rows(path, sheet, columns=[]))


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("sheet", name).load(path)``: the first row names the
    columns, all of them text. The path must be readable from every executor. A partition has ``rowsPerPartition`` rows;
    ``columns`` (names, comma-separated) leaves the others unread."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _columns(self) -> list[tuple[int, str]]:
        head = next(read_rows(self.options["path"], self.options.get("sheet"), last=1), [])
        named = [n.strip() for n in self.options.get("columns", "").split(",") if n.strip()]
        if unknown := set(named) - set(head):
            raise ValueError(f"{self.options['path']} has no columns {sorted(unknown)}")
        return [(head.index(n), n) for n in named] or list(enumerate(head))

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for _, n in self._columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self.options, [i for i, _ in self._columns()])


class _Rows(InputPartition):
    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class _XlsxReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[int]):
        self.path, self.sheet, self.columns = options["path"], options.get("sheet"), columns
        self.size = int(options.get("rowsPerPartition", ROWS))

    def partitions(self) -> list[_Rows]:
        cuts = list(range(1, max(row_count(self.path, self.sheet), 2), self.size))
        # the last one has no end, whatever size the sheet says it has
        return [_Rows(a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        for r in read_rows(self.path, self.sheet, partition.first, partition.last, self.columns):
            yield tuple(r[i] if i < len(r) else "" for i in self.columns)


def _cell(value, at: str) -> str:
    if isinstance(value, (list, tuple)):
        value = " | ".join(str(v) for v in value if v not in (None, ""))
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{int(value) if value == int(value) else value}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def sheet_name(name: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"


def write_book(path: str, sheets: dict[str, DataFrame], most_rows: int = 100_000) -> None:
    """Review sheets for people: each table is checked to be small, then brought to the driver."""
    names = [sheet_name(n) for n in sheets]
    if len(set(names)) < len(names):
        raise ValueError(f"sheets of equal names: {names}")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for i, df in enumerate(sheets.values(), 1):
            rows = df.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{names[i - 1]} has more than {most_rows} rows: a sheet is for people")
            width = [max([len(c), *(len(str(r[k])) for r in rows[:200])], default=8) for k, c in enumerate(df.columns)]
            columns = "".join(f'<col min="{k}" max="{k}" width="{min(60, max(12, w + 2))}" customWidth="1"/>' for k, w in enumerate(width, 1))
            lines = [list(df.columns), *(list(r) for r in rows)]
            body = "".join(f'<row r="{n}">' + "".join(_cell(v, f"{column_name(k)}{n}") for k, v in enumerate(line)) + "</row>" for n, line in enumerate(lines, 1))
            last = f"{column_name(max(len(df.columns) - 1, 0))}{len(lines)}"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{_HEAD}<worksheet xmlns="{_NS["m"]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:{last}"/></worksheet>')
        ids = range(1, len(names) + 1)
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, names, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids) + "</Types>")
    if sheets:
        Store(next(iter(sheets.values())).sparkSession, path).write(path, packed.getvalue(), replace=True)
