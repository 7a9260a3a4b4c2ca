"""Workbooks written by tasks, read back cell for cell."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from falloff.sources import workbook, workbook_sink

ROWS = [(1, 2.5, "plain", True), (None, None, None, None), (-7, 1e-9, " <a> & \"b\" ", False), (2**60, float("nan"), "two\nlines", None), (0, float("inf"), "bell\x07", True)]


def books(folder):
    return [f.read_bytes() for f in sorted(folder.glob("*.xlsx"))]


def test_cells_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "a long, b double, c string, d boolean").coalesce(1)
    workbook_sink.write(df, str(tmp_path / "out"))
    (book,) = books(tmp_path / "out")
    want = ["a", "b", "c", "d", "1", "2.5", "plain", "1", "-7", "1e-09", '<a> & "b"', "0", str(2**60), "nan", "two\nlines", "0", "inf", "bell_x0007_", "1"]
    assert list(workbook.cells(book)) == want
    assert zipfile.ZipFile(io.BytesIO(book)).testzip() is None


def test_a_workbook_for_each_task_and_no_row_lost(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name")).repartition(5)
    workbook_sink.write(df, str(tmp_path), sheet_rows=50)
    got = books(tmp_path)
    texts = [t for b in got for t in workbook.cells(b)]
    assert len(got) == 5 and sorted(t for t in texts if t[0] == "n" and t != "name") == sorted(f"n{k}" for k in range(1000))
    assert all(sum(n.startswith("xl/worksheets/") for n in zipfile.ZipFile(io.BytesIO(b)).namelist()) >= 4 for b in got)
    workbook_sink.write(df.limit(3), str(tmp_path))
    assert len(books(tmp_path)) > 5
    workbook_sink.write(df.where("id < 3").coalesce(1), str(tmp_path), overwrite=True)
    assert len(books(tmp_path)) == 1 and not list(tmp_path.glob("_job-*"))


def test_empty_tables_and_texts_too_long(spark, tmp_path):
    workbook_sink.write(spark.range(0), str(tmp_path / "none"))
    assert books(tmp_path / "none") == []
    with pytest.raises(Exception, match="32767"):
        workbook_sink.write(spark.range(1).select(F.repeat(F.lit("x"), 40_000).alias("t")), str(tmp_path / "long"))
    assert books(tmp_path / "long") == [] and not list((tmp_path / "long").glob("_job-*"))


def test_column_names():
    assert [workbook_sink.column_name(k) for k in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
