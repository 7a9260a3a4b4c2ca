"""A folder tree of byte-built files scanned into groups, verdicts, copies and suggestions; the store; the ledger."""

import datetime
import io
import zipfile

import pytest
from test_sources import dbs

from falloff.operators import review
from falloff.plans import scan
from falloff.sources import state


def book(name):
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = "".join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in ("Well Name", name))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row>{cells}</row></sheetData></worksheet>')
    return out.getvalue()


def falloff_csv(hours, drop=900.0, rated=True):
    rows, n = ["DateTime,Pressure (psi)" + (",Rate (bpm),Volume (bbl)" if rated else "")], 200
    for k in range(n):
        t = datetime.datetime(2024, 1, 15) + datetime.timedelta(seconds=round(3600 * hours * k / (n - 1)))
        p = 3000 + 100 * k if k < 10 else 4000 - drop * (k - 9) / (n - 10)
        rows.append(f"{t:%m/%d/%Y %H:%M:%S},{p:.3f}" + (f",{5.0 if k < 10 else 0.0},{min(k, 10) * 2.0}" if rated else ""))
    return "\n".join(rows).encode()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    put = lambda rel, content: ((root / rel).parent.mkdir(parents=True, exist_ok=True), (root / rel).write_bytes(content))
    put("cust/padA/questionnaire.xlsx", book("Well A"))
    put("cust/padA/raw/long.csv", falloff_csv(30))
    put("cust/padA/raw/copy.csv", falloff_csv(30))
    put("cust/padA/more/short.csv", falloff_csv(10, rated=False))
    put("cust/padA/more/bad.dbs", b"broken")
    put("cust/padA/more/few.dbs", dbs([("PA", "Pressure")], [(i, [float(i)]) for i in range(10)]))
    put("cust/padB/Questionnaire B.xlsx", book("Well B"))
    put("cust/padB/flat.csv", falloff_csv(30, drop=10.0))
    put("cust/padB/same.csv", falloff_csv(30))
    put("cust/padB/_quarantine/gone.csv", falloff_csv(30))
    put("other/alone/tiny.csv", falloff_csv(0.5))
    return root


def by_path(out, root):
    return {r["path"].split("/root/", 1)[1]: r for r in out.collect()}


def test_tree_to_groups(spark, tree):
    got = by_path(scan.scan(spark, str(tree)), tree)
    assert {p: (r["group"], r["n_wells"], r["verdict"], r["suggested"]) for p, r in got.items()} == {
        "cust/padA/raw/copy.csv": ("cust/padA", 1, "likely_dfit", True), "cust/padA/raw/long.csv": ("cust/padA", 1, "duplicate", False), "cust/padA/more/short.csv": ("cust/padA", 1, "likely_dfit", False),
        "cust/padA/more/bad.dbs": ("cust/padA", 1, "load_error", False), "cust/padA/more/few.dbs": ("cust/padA", 1, "no_pressure", False),
        "cust/padB/flat.csv": ("cust/padB", 1, "flat", False), "cust/padB/same.csv": ("cust/padB", 1, "likely_dfit", True), "other/alone/tiny.csv": ("other/alone", 0, "too_short", False),
    }
    assert got["cust/padA/raw/long.csv"]["dup_of"].endswith("raw/copy.csv")
    assert {p: r["n_elsewhere"] for p, r in got.items() if r["n_elsewhere"]} == {"cust/padA/raw/copy.csv": 1, "cust/padA/raw/long.csv": 1, "cust/padB/same.csv": 2}
    assert got["cust/padA/more/bad.dbs"]["error"] == "no gauge record" and got["cust/padA/raw/copy.csv"]["shutin_source"] == "rate"
    assert got["cust/padA/more/short.csv"]["shutin_source"] == "pressure-peak"


def test_store_is_extended_not_redone(spark, tree, tmp_path, monkeypatch):
    asked, own = [], scan.profiles

    def watched(files):
        asked.append(sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()))
        return own(files)

    monkeypatch.setattr(scan, "profiles", watched)
    store = str(tmp_path / "store")
    few = by_path(scan.scan(spark, str(tree), store=store, named_only=True, limit=1), tree)
    assert {r["group"] for r in few.values()} == {"cust/padA"} and asked[-1] == ["bad.dbs", "copy.csv", "few.dbs", "short.csv"]
    first = by_path(scan.scan(spark, str(tree), store=store), tree)
    assert asked[-1] == ["flat.csv", "tiny.csv"]
    again = by_path(scan.scan(spark, str(tree), store=store), tree)
    assert asked[-1] == [] and again == first
    by_path(scan.scan(spark, str(tree), store=store, limit=1), tree)
    assert scan.stored(spark, store).count() == 6
    scan.scan(spark, str(tree), store=store, version=2)
    assert len(asked[-1]) == 6


def test_ledger_takes_the_latest(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert state.read_ledger(spark, path).count() == 0
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema = "rel string, keeps array<string>, status string, ts timestamp, files_sig string, extra int"
    state.append_actions(spark.createDataFrame([("a", ["x"], "decided", at(2), "s", 1), ("b", [], "none", at(1), "s", 1)], schema), path)
    state.append_actions(spark.createDataFrame([("a", [], "none", at(1), "s", 1), ("b", ["y"], "decided", at(3), "t", 1)], schema), path)
    got = sorted((r["rel"], r["status"], r["keeps"], r["files_sig"]) for r in state.read_ledger(spark, path).collect())
    assert got == [("a", "decided", ["x"], "s"), ("b", "decided", ["y"], "t")]
    state.compact_ledger(spark, path, str(tmp_path / "new"))
    assert sorted((r["rel"], r["status"], r["keeps"], r["files_sig"]) for r in state.read_ledger(spark, str(tmp_path / "new")).collect()) == got


def test_two_actions_resolve_by_time(spark):
    groups = spark.createDataFrame([("a", "1")], "rel string, files_sig string")
    before = spark.createDataFrame([], "rel string, status string, keeps array<string>, decided_sig string")
    actions = spark.createDataFrame([("a", "accept", ["x"], 2), ("a", "none", [], 1), ("a", "back", [], 3)], "rel string, action string, keeps array<string>, ts int")
    assert [tuple(r) for r in review.decide(before, actions, groups).collect()] == [("a", "decided", ["x"], "1")]
