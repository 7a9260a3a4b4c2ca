import io
import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from falloff.operators import documents
from falloff.sources import files, gauge_csv, gauge_dbs, registry_dbf, state, workbook


def dbs(names, rows, minutes=1 / 60, magic=gauge_dbs.MAGIC, offset=0):
    n = len(names)
    head = bytearray(gauge_dbs.HEADER)
    head[:4] = magic
    struct.pack_into("<II", head, gauge_dbs.CHANNELS_AT, n, len(rows))
    struct.pack_into("<f", head, gauge_dbs.INTERVAL_AT, minutes)
    struct.pack_into("<I", head, gauge_dbs.DATA_AT, gauge_dbs.HEADER + 84 * n + offset)
    for tag, name in names:
        record = bytearray(84)
        record[: len(tag)] = tag.encode()
        record[16 : 16 + len(name)] = name.encode("latin-1")
        head += record
    return bytes(head) + b"".join(struct.pack(f"<I{n}f", i, *v) for i, v in rows)


def test_dbs_layout_and_names():
    names, rows, seconds = gauge_dbs.parse(dbs([("PA", "Pressure"), ("PB", "Pressure"), ("TT", ""), ("DT", "DateTime"), ("PB", "Pressure")], [(0, [1, 2, 3, 4, 5]), (5, [6, 7, 8, 9, 10])]))
    assert names == ["Pressure", "Pressure [PB]", "TT", "DateTime [DT]", "Pressure [PB] (2)"]
    assert rows["idx"].tolist() == [0, 5] and abs(seconds - 1) < 1e-6


@pytest.mark.parametrize("content", [b"", dbs([("A", "a")], [(0, [1])], magic=b"xxxx"), dbs([("A", "a")], [(0, [1])])[:-1], dbs([("A", "a")], [(0, [1])], offset=4), dbs([("A", "a")], [(0, [1])], minutes=math.nan), dbs([], [(0, [])])])
def test_dbs_failures(content):
    with pytest.raises(ValueError):
        gauge_dbs.parse(content)


def test_dbs_files_become_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.DBS").write_bytes(dbs([("PA", "Pressure")], [(i, [float(i)]) for i in (0, 1, 2, 5)]))
    (tmp_path / "two.dbs").write_bytes(b"broken")
    got = gauge_dbs.read_gauge_dbs(spark, str(tmp_path)).orderBy("path", "idx").collect()
    good = [r for r in got if r["error"] is None]
    assert [(r["idx"], round(r["t_s"], 4), r["channels"]["Pressure"]) for r in good] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 5, 5)]
    assert [r["error"] for r in got if r["error"]] == ["no gauge record"]


CSVS = {
    "mdy": ("Date/Time,Pressure (psi)\n01/02/2020 00:00:00,1\n01/02/2020 00:00:12,2\n01/03/2020 00:00:23,x\n", [0, 12, 86423]),
    "ms": ("Date,Time,Combined Flow Rate,Max Pressure\n1/2/2020,10:00:00:000,1,2\n1/2/2020,10:00:00:250,1,2\n1/2/2020,10:00:00:500,1,2\n", [0, 0.25, 0.5]),
    "garbage_time": ("Date,Time,Max Pressure\n1/2/2020,??,2\n1/2/2020,??,2\n", [0, 0]),
    "dayfirst": ("Date,Time,Pressure\n30/8/2020,10:00:00,1\n31/8/2020,10:00:00,1\n", [0, 86400]),
    "preamble": ("Site: x\nUnit y\nDate/Time,TZ,Pressure(psia)\n1/2/2020 0:00:00,A,5\n1/2/2020 0:00:05,A,5\n", [0, 5]),
    "reverse": ("Timestamp (MST),PRESS\n1/2/2020 0:00:09,1\n1/2/2020 0:00:04,2\n1/2/2020 0:00:00,3\n", [0, 4, 9]),
    "elapsed": ("DateTime,Delta(Hrs),Pressure\nbad,2.0,1\nbad,2.5,2\nbad,3.0,3\n", [0, 1800, 3600]),
}


def test_csv_shapes(spark, tmp_path):
    for name, (text, _) in CSVS.items():
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n1,2,3\n1,2,3,4\n")
    (tmp_path / "_quarantine").mkdir()
    (tmp_path / "_quarantine" / "old.csv").write_text(CSVS["mdy"][0])
    rows = gauge_csv.read_gauge_csv(spark, str(tmp_path)).withColumn("file", F.regexp_extract("path", r"([^/]+)\.csv$", 1)).cache()
    got = {}
    for r in rows.orderBy("idx").collect():
        got.setdefault(r["file"], []).append(r)
    assert set(got) == {*CSVS, "ragged"}
    for name, (_, seconds) in CSVS.items():
        assert [r["t_s"] for r in got[name]] == seconds, name
    assert [r["error"] for r in got["ragged"]] == ["rows are wider than the header"]
    assert [r["channels"].get("PRESS") for r in got["reverse"]] == [3, 2, 1]
    assert "Pressure (psi)" not in got["mdy"][2]["channels"]
    flow = gauge_csv.as_samples(rows.where("file = 'ms'")).orderBy("idx").collect()
    assert [(r["p"], r["rate"], r["volume"]) for r in flow] == [(2.0, 1.0, None)] * 3


def test_roles_and_headers():
    assert gauge_csv.roles(["Date", "Time", "Rate (bpm)", "Total Volume", "Casing Pressure"]) == {"date": 0, "time": 1, "bottom": None, "pressure": 4, "rate": 2, "volume": 3}
    assert gauge_csv.header_line([["x"], ["a", "b"], ["1", "2"], ["3", "4"]]) == 1
    assert gauge_csv.elapsed_unit("Elapsed (sec)") == 1 and gauge_csv.elapsed_unit("Delta(Hrs)") == 3600 and gauge_csv.elapsed_unit("delta") is None


def dbf(fields, records, cut_at=None):
    width = 1 + sum(n for _, n in fields)
    head = bytearray(32)
    struct.pack_into("<IHH", head, 4, len(records), 32 + 32 * len(fields) + 1, width)
    for name, n in fields:
        d = bytearray(32)
        d[: len(name)] = name.encode()
        d[11], d[16] = ord("C"), n
        head += d
    body = b"".join((b"*" if gone else b" ") + b"".join(v.encode("latin-1").ljust(n) for v, (_, n) in zip(values, fields, strict=True)) for gone, *values in records)
    return (bytes(head) + b"\x0d" + body)[:cut_at]


def test_dbf_prunes_and_skips_deleted(spark, tmp_path):
    content = dbf([("NAME", 10), ("API", 8)], [(False, "Wéll 1", "42-1"), (True, "gone", "x"), (False, "Well 2", "42-2")])
    assert list(registry_dbf.parse(content)) == [{"NAME": "Wéll 1", "API": "42-1"}, {"NAME": "Well 2", "API": "42-2"}]
    assert list(registry_dbf.parse(content[:-3], ["API"])) == [{"API": "42-1"}]
    (tmp_path / "t.dbf").write_bytes(content)
    got = registry_dbf.read_dbf(spark, str(tmp_path / "t.dbf"), ["API", "LAT"]).collect()
    assert [(r["API"], r["LAT"]) for r in got] == [("42-1", None), ("42-2", None)]


def xlsx(values):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>Well </t></r><r><t>Name</t></r></si></sst>')
        cells = "".join(f'<row><c t="inlineStr"><is><t>{v}</t></is></c></row>' if isinstance(v, str) else f"<row><c><v>{v}</v></c></row>" for v in values)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>0</v></c></row>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_questionnaires_to_answers(spark, tmp_path):
    (tmp_path / "W").mkdir()
    (tmp_path / "W" / "DFIT Questionnaire.xlsx").write_bytes(xlsx(["Alpha 1H", "Fluid density", "8.4 lbs/gal", "TVD of perfs", 11000, 10958]))
    (tmp_path / "W" / "broken questionnaire.xlsx").write_bytes(b"no zip")
    (tmp_path / "W" / "~$questionnaire.xlsx").write_bytes(b"lock")
    (tmp_path / "W" / "other.xlsx").write_bytes(xlsx([]))
    cells = workbook.read_cells(spark, str(tmp_path)).cache()
    assert [r["error"] for r in cells.where("error is not null").collect()] == ["BadZipFile"]
    got = documents.questionnaire(cells.where("error is null"), {"well": ["well name"], "density": ["fluid density"], "tvd": ["tvd"]}).collect()
    assert [(r["well"], r["formation"], r["density_ppg"], r["tvd_ft"]) for r in got] == [("Alpha 1H", None, 8.4, 10958.0)]
    assert files.listing(spark, str(tmp_path)).select("rel", "folder", "stem", "ext").where("stem = 'other'").collect()[0] == ("W/other.xlsx", "W", "other", "xlsx")


def test_state_tolerates_other_versions(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"test_id": "7", "contact_G": 3.5, "unknown": 1, "closure_scenario": "old", "status": "done", "step_status": {"isip": "done"}}')
    (tmp_path / "p" / "b.json").write_text("{broken")
    got = state.migrated(state.read_json(spark, str(tmp_path / "p"), state.PICKS), {"old": "C-A: clear"}).collect()
    assert [(r["test_id"], r["contact_G"], r["closure_scenario"], r["postclosure_scenario"], r["status"], r["step_status"]) for r in got] == [("7", 3.5, "C-A: clear", "", None, {"isip": "done"})]
    columns = {"test_id": "string", "te": "double", "note": "string"}
    assert state.read_log(spark, str(tmp_path / "none.csv"), columns).count() == 0
    state.write_log(spark.createDataFrame([("007", "1.5")], "test_id string, te string"), str(tmp_path / "log"))
    assert [tuple(r) for r in state.read_log(spark, str(tmp_path / "log"), columns).collect()] == [("007", 1.5, None)]
    state.write_json(spark.createDataFrame([("a", ["x"])], "rel string, keeps array<string>"), str(tmp_path / "ledger"))
    assert state.read_json(spark, str(tmp_path / "ledger"), state.LEDGER).select("keeps", "status").collect() == [(["x"], None)]


@pytest.mark.parametrize("names, date, time, pressure, rate, volume", [
    (["Date/Time", "Casing (psi)", "BHP", "Slurry (bpm)", "Volume Rate", "Stage Vol (bbl)"], 0, None, 2, 3, 5),
    (["Date", "Time (MST)", "WHP", "Flow"], 0, 1, 2, 3, None),
    (["Date/Time", "Time", "Bottom Gauge", "Press"], 0, None, 2, None, None),
    (["Rate time", "Date", "Pressure"], None, None, 2, 0, None),
    (["idx", "Total bbl", "x"], None, None, None, None, 1),
])
def test_roles_of_columns(names, date, time, pressure, rate, volume):
    at = gauge_csv.roles(names)
    assert (at["date"], at["time"], at["pressure"], at["rate"], at["volume"]) == (date, time, pressure, rate, volume)
    assert (at["bottom"] is not None) == any("bhp" in n.lower() or "bottom" in n.lower() for n in names)


def test_elapsed_columns_need_a_unit_and_must_rise():
    of = lambda name, *v: gauge_csv.elapsed_of(["a", name], [["", str(x)] for x in v])
    assert of("Delta(Hrs)", 1, "x", 1.5) == [3600.0, None, 5400.0] and of("Elapsed (MIN)", 0, 0, 2) == [0, 0, 120]
    assert of("Delta", 1, 2) is None and of("Elapsed (days)", 1, 2) is None and of("Delta Pressure(min)", 1, 2) is None
    assert of("Delta(s)", 2, 1) is None and of("Delta(s)", 1, 1) is None and of("Delta(s)", 1) is None


def test_one_reader_for_all_kinds(spark, tmp_path):
    from falloff.sources import gauge

    (tmp_path / "a.csv").write_text("Date/Time,Volume Rate,Casing (psi),BHP (kPa)\n1/2/2020 0:00:00,1,2,3\n1/2/2020 0:00:05,4,x,6\n")
    (tmp_path / "b.dbs").write_bytes(dbs([("PA", "WHP"), ("RA", "Pump rate")], [(0, [7, 8]), (2, [math.nan, 9])]))
    (tmp_path / "c.dbs").write_bytes(b"broken")
    rows = gauge.read_gauge(spark, str(tmp_path)).withColumn("test_id", F.regexp_extract("test_id", r"([^/]+)$", 1)).cache()
    got = [tuple(r) for r in gauge_csv.as_samples(rows).orderBy("test_id", "idx").collect()]
    assert [(a, b, round(t, 3), *x) for a, b, t, *x in got] == [("a.csv", 0, 0, 3, 1, None), ("a.csv", 1, 5, 6, 4, None), ("b.dbs", 0, 0, 7, 8, None), ("b.dbs", 1, 2, None, 9, None)]
    assert {(r["test_id"], r["p_is_bhp"]) for r in rows.collect()} == {("a.csv", True), ("b.dbs", False), ("c.dbs", None)}
    assert [(r["test_id"], r["samples"], r["error"], r["channels"]) for r in gauge.list_tests(rows).collect()] == [("a.csv", 2, None, ["BHP (kPa)", "Casing (psi)", "Volume Rate"]), ("b.dbs", 2, None, ["Pump rate", "WHP"]), ("c.dbs", 0, "no gauge record", [])]


def test_one_record_is_read_by_many_tasks(spark, tmp_path):
    rows = [(i % 700, [float(i), math.nan if i % 9 == 0 else float(-i)]) for i in range(1000)]
    (tmp_path / "a b%20").mkdir()
    (tmp_path / "a b%20" / "long one.dbs").write_bytes(dbs([("PA", "Pressure"), ("RA", "Rate")], rows))
    split, whole = (gauge_dbs.read_gauge_dbs(spark, str(tmp_path), samples=n) for n in (70, 10_000))
    assert split.select(F.spark_partition_id().alias("k")).distinct().count() > 3
    columns = ["idx", "t_s", "p", "rate", "channels", "error"]
    a, b = (sorted((tuple(r) for r in x.select(columns).collect()), key=lambda r: r[0]) for x in (split, whole))
    assert a == b and len(a) == 1000 and a[10][2:4] == (10.0, -10.0) and a[9][3] is None
    bare = gauge_dbs.read_gauge_dbs(spark, str(tmp_path), with_channels=False, samples=300)
    assert sorted((r["idx"], r["p"]) for r in bare.collect()) == [(r[0], r[2]) for r in a]
    assert bare.where("channels is not null").count() == 0


def test_one_table_is_read_by_many_tasks_and_a_short_one_warned_of(spark, tmp_path):
    content = dbf([("NAME", 10), ("API", 8)], [(i % 10 == 3, f"Well {i}", f"42-{i}") for i in range(500)])
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "t.dbf").write_bytes(content)
    rows = registry_dbf.read_dbf(spark, str(tmp_path / "whole"), ["API"], records=40, indexed=True)
    assert rows.select(F.spark_partition_id().alias("k")).distinct().count() > 3
    assert sorted((r["idx"], r["API"]) for r in rows.collect()) == [(i, f"42-{i}") for i in range(500) if i % 10 != 3]
    assert registry_dbf.dbf_problems(spark, str(tmp_path / "whole")).count() == 0
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "t.dbf").write_bytes(content[:-30])
    (tmp_path / "cut" / "no.dbf").write_bytes(b"nothing")
    with pytest.warns(UserWarning, match="500 records named, 498 there"):
        assert registry_dbf.read_dbf(spark, str(tmp_path / "cut"), ["NAME"]).count() == 448
    assert {r["path"].rsplit("/")[-1]: r["error"] for r in registry_dbf.dbf_problems(spark, str(tmp_path / "cut")).collect()} == {"t.dbf": "500 records named, 498 there", "no.dbf": "no table header"}
