"""Registry tables (dBase III), read in ranges of records with column pruning."""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.sources import ranges

#: Fixed values of the layout: bytes of the first header and of a field's descriptor, the byte that ends descriptors, the mark of a deleted record.
HEADER, DESCRIPTOR, LAST, DELETED = 32, 32, 0x0D, b"*"


def layout(file: pa.NativeFile, length: int) -> tuple[int, int, int, list[tuple[str, int, int]]]:
    """Records that the header names, where they begin, their width, and each field's name and place in a record."""
    first = file.read(HEADER)
    if len(first) < HEADER:
        raise ValueError("no table header")
    rows, header, width = struct.unpack_from("<IHH", first, 4)
    if not HEADER < header <= max(length, HEADER + 1) or width < 1:
        raise ValueError("no table header")
    rest, at, place, fields = file.read(header - HEADER), 0, 1, []
    while at + DESCRIPTOR <= len(rest) and rest[at] != LAST:
        size = rest[at + 16]
        fields.append((rest[at : at + 11].split(b"\0")[0].decode("latin-1"), place, place + size))
        place, at = place + size, at + DESCRIPTOR
    return rows, header, width, fields


def decoded(content: bytes, width: int, places: dict[str, tuple[int, int]]) -> Iterator[tuple[int, dict[str, str]]]:
    """Number and fields of each record of ``content`` that isn't deleted; an incomplete last one is left out."""
    for k in range(len(content) // width):
        record = content[k * width : (k + 1) * width]
        if record[:1] != DELETED:
            yield k, {name: record[a:b].decode("latin-1").strip() for name, (a, b) in places.items()}


def parse(content: bytes, fields: Sequence[str] | None = None) -> Iterator[dict[str, str]]:
    """Records of a table in memory that aren't deleted, as strings of ``fields`` (all if None)."""
    rows, header, width, found = layout(pa.BufferReader(content), len(content))
    places = {f: (a, b) for f, a, b in found if fields is None or f in fields}
    yield from (r for _, r in decoded(content[header : header + rows * width], width, places))


def _count(file: pa.NativeFile, length: int) -> tuple[int, str | None]:
    rows, header, width, _ = layout(file, length)
    there = max(0, length - header) // width
    return min(rows, there), f"{rows} records named, {there} there" if there < rows else None


def dbf_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_dbf(spark: SparkSession, path: str, fields: Sequence[str], records: int = ranges.RECORDS, indexed: bool = False) -> DataFrame:
    """``fields`` of every table under ``path`` as stripped Latin-1 strings; with ``indexed`` also path and idx, the record's number.

    A table is read in ranges of ``records`` by as many tasks; of a record only the fields asked for are decoded. A field that a table lacks
    is null, deleted records are left out. A table cut short gives the records it has; that and files that aren't
    tables are told by a warning and by ``dbf_problems``.
    """
    wanted = list(fields)
    parts = ranges.split(dbf_files(spark, path), _count, records)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, begin, end in zip(batch["path"], batch["begin"], batch["end"], strict=True):
                if begin == end:
                    continue
                with ranges.opened(name) as file:
                    _, header, width, found = layout(file, file.size())
                    places = {f: (a, b) for f, a, b in found if f in wanted}
                    for at, stop in ranges.reads(begin, end):
                        file.seek(header + at * width)
                        kept = list(decoded(file.read((stop - at) * width), width, places))
                        data = {f: pd.Series([r.get(f) for _, r in kept], dtype=object) for f in wanted}
                        yield pd.DataFrame({"path": name, "idx": [at + k for k, _ in kept], **data} if indexed else data)

    for r in parts.where("error is not null").select("path", "error").distinct().limit(20).collect():
        warnings.warn(f"{r['path']}: {r['error']}", stacklevel=2)
    own = "path string, idx long, " if indexed else ""
    return parts.mapInPandas(rows, own + ", ".join(f"`{f}` string" for f in wanted))


def dbf_problems(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the tables under ``path`` that are cut short or can't be read."""
    return ranges.split(dbf_files(spark, path), _count).where(F.col("error").isNotNull()).select("path", "error").distinct()
