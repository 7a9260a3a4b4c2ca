"""Cells of questionnaire workbooks (.xlsx), in reading order."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from falloff.sources.files import listing, questionnaires

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def cells(content: bytes) -> Iterator[str]:
    """Texts of the cells of all sheets, row by row, trimmed, blank ones left out; numbers as they are written."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for sheet in sheets:
            for cell in ElementTree.fromstring(book.read(sheet)).iter(f"{_MAIN}c"):
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else value.text
                if text.strip():
                    yield text.strip()


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """(path, ord, text, error) of every questionnaire under ``root``; a workbook that can't be read is one row with its error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = list(cells(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError) as e:
                    yield pd.DataFrame({"path": [path], "ord": [0], "text": [None], "error": [type(e).__name__]})
                    continue
                yield pd.DataFrame({"path": path, "ord": range(len(found)), "text": found, "error": None})

    found = questionnaires(listing(spark, root, "*.[xX][lL][sS][xX]", content=True)).select("path", "content")
    return found.mapInPandas(rows, "path string, ord long, text string, error string")
