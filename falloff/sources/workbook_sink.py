"""Writing .xlsx workbooks, one of each task: rows are streamed into the sheet's XML inside the zip, nothing is held but a row.

    workbook_sink.write(df, "/data/export")                      # one workbook a partition
    workbook_sink.write(df.coalesce(1), "/data/export")          # one workbook, if one task may write it
"""

from __future__ import annotations

import datetime
import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO, Any
from urllib.parse import quote
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format: rows of a sheet, characters of a cell, namespaces and types of its parts.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767
_SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_FROZEN = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
_FORBIDDEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]")


def column_name(k: int) -> str:
    """Letters of column ``k``, counted from 0."""
    name = ""
    while k >= 0:
        k, letter = divmod(k, 26)
        name, k = chr(65 + letter) + name, k - 1
    return name


def cell(value: Any, at: str) -> str:
    """XML of a cell: numbers and booleans as such, all else as text; nothing for null; numbers that aren't finite as text.

    Characters that XML forbids are written as the format's _xHHHH_. Text over 32,767 characters, which no workbook holds, is refused.
    """
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 2**53 or isinstance(value, float) and math.isfinite(value):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value)
    if len(text) > CELL_CHARS:
        raise ValueError(f"cell {at} has {len(text)} characters, a workbook's cell holds {CELL_CHARS}")
    text = escape(_FORBIDDEN.sub(lambda m: f"_x{ord(m.group()):04X}_", text)).replace("\r", "&#13;")
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def stream(out: IO[bytes], names: list[str], rows: Iterator[tuple], sheet_rows: int = SHEET_ROWS) -> tuple[int, int]:
    """A workbook of ``rows`` under a row of names, a further sheet for what one doesn't hold: (rows, sheets)."""
    letters = [column_name(k) for k in range(len(names))]
    line = lambda values, n: f'<row r="{n}">' + "".join(cell(v, f"{c}{n}") for v, c in zip(values, letters, strict=True)) + "</row>"
    total, sheets, row = 0, 0, next(rows, None)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        while row is not None or sheets == 0:
            sheets += 1
            with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'{_HEAD}<worksheet xmlns="{_SHEETS}">{_FROZEN}<sheetData>{line(names, 1)}'.encode())
                n = 2
                while row is not None and n <= sheet_rows:
                    sheet.write(line(row, n).encode())
                    total, n, row = total + 1, n + 1, next(rows, None)
                sheet.write(f'</sheetData><autoFilter ref="A1:{letters[-1] if letters else "A"}{n - 1}"/></worksheet>'.encode())
        every = range(1, sheets + 1)
        listed = "".join(f'<sheet name={quoteattr(f"Sheet{k}")} sheetId="{k}" r:id="rId{k}"/>' for k in every)
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_SHEETS}" xmlns:r="{_RELATIONS}"><bookViews><workbookView/></bookViews><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in every)
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        link = f'<Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/>'
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{link}</Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPES}.worksheet+xml"/>' for k in every)
        plain = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        main = f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>'
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{plain}{main}{kinds}</Types>')
    return total, sheets


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


@dataclass
class Written(WriterCommitMessage):
    """A task's workbook, in the folder of its job; none if the task had no rows."""

    name: str | None
    rows: int


class WorkbookWriter(DataSourceWriter):
    """Tasks write into a folder of the job's own under names of their own attempt; the commit moves what the job counts.

    An attempt that is lost or repeated leaves nothing behind, as only workbooks that were reported are moved and the folder goes.
    """

    def __init__(self, path: str, names: list[str], overwrite: bool, sheet_rows: int) -> None:
        self.path, self.names, self.overwrite, self.sheet_rows = path.rstrip("/"), names, overwrite, sheet_rows
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)

        def rows() -> Iterator[tuple]:
            yield tuple(first)
            yield from map(tuple, iterator)

        store, folder = _store(self.path)
        name = f"part-{uuid.uuid4().hex}.xlsx"
        store.create_dir(f"{folder}/_job-{self.job}", recursive=True)
        with store.open_output_stream(f"{folder}/_job-{self.job}/{name}", compression=None) as out:
            total, _ = stream(out, self.names, rows(), self.sheet_rows)
        return Written(name, total)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(pafs.FileSelector(folder)):
                if old.type == pafs.FileType.File and old.base_name.startswith("part-") and old.extension == "xlsx":
                    store.delete_file(old.path)
        for message in messages:
            if message is not None and message.name:
                store.move(f"{folder}/_job-{self.job}/{message.name}", f"{folder}/{message.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        if store.get_file_info(f"{folder}/_job-{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{folder}/_job-{self.job}")


class Workbook(DataSource):
    """``df.write.format("workbook")``: options path and sheet_rows."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], schema.names, overwrite, int(self.options.get("sheet_rows", SHEET_ROWS)))


def write(df: DataFrame, folder: str, overwrite: bool = False, sheet_rows: int = SHEET_ROWS) -> None:
    """The rows of ``df`` as workbooks in ``folder``, one of each partition that has rows; names in the first row of every sheet, which stays in sight and filters."""
    df.sparkSession.dataSource.register(Workbook)
    df.write.format("workbook").option("sheet_rows", sheet_rows).mode("overwrite" if overwrite else "append").save(folder)
