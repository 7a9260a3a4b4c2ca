"""Operators on ordered records against numpy and plain loops, on analytic and random records."""

import numpy as np
import pytest

from falloff.operators import match
from falloff.operators import series as s


def frame(spark, tests, names):
    kinds = ", ".join(f"{n} {'long' if n in ('idx', 'i') else 'double'}" for n in names)
    return spark.createDataFrame([(k, *(None if v is None else (int(v) if n in ("idx", "i") else float(v)) for n, v in zip(names, row, strict=True))) for k, rows in tests.items() for row in rows], f"test_id long, {kinds}")


def by_test(df, order, *columns):
    out = {}
    for r in df.orderBy("test_id", order).collect():
        out.setdefault(r["test_id"], []).append(tuple(r[c] for c in columns))
    return out


def greedy(dt, p, step, rise):
    kept, last, low = [], None, np.inf
    for t, v in zip(dt, p, strict=True):
        if v is None or not np.isfinite(v):
            continue
        if last is not None and v > low + rise:
            return kept, len(kept)
        low = min(low, v)
        if last is None or v <= last - step:
            kept.append((t, v))
            last = v
    return kept, None


def test_resampling_as_a_plain_loop(spark):
    r = np.random.default_rng(1)
    tests = {}
    for k in range(40):
        p = 5000 - np.cumsum(r.normal(8, 25, 120))
        rows = [[i, i, v] for i, v in enumerate(p)]
        for i in r.integers(0, 120, 6):
            rows[i][2] = [None, float("nan")][i % 2]
        tests[k] = rows
    for step, rise in ((30.0, 30.0), (10.0, 80.0)):
        got = s.resample_increment(frame(spark, tests, ["idx", "dt", "p"]), step, rise).cache()
        rows = by_test(got, "i", "dt", "p")
        guard = {x["test_id"]: x["guarded_at"] for x in got.select("test_id", "guarded_at").distinct().collect()}
        for k, t in tests.items():
            kept, at = greedy([x[1] for x in t], [x[2] for x in t], step, rise)
            assert rows[k] == kept and guard[k] == at


def test_rolling_mean_is_a_convolution(spark):
    r = np.random.default_rng(2)
    tests = {k: [[i, v] for i, v in enumerate(r.random(n))] for k, n in enumerate((20, 40, 61))}
    for width in (1, 4, 15):
        got = by_test(s.rolling_mean(frame(spark, tests, ["idx", "rate"]), "rate", width, "mean"), "idx", "mean")
        for k, rows in tests.items():
            assert np.allclose([x[0] for x in got[k]], np.convolve([v for _, v in rows], np.ones(width) / width, "same"))


def test_derivatives_are_numpy_gradients(spark):
    t = np.cumsum(np.random.default_rng(3).uniform(5, 60, 80))
    p = 5000 - 1500 * (1 - np.exp(-t / 900))
    diag = s.g_diagnostics(frame(spark, {1: [[i, a, b] for i, (a, b) in enumerate(zip(t, p, strict=True))]}, ["i", "dt", "p"]), 300.0)
    got = np.array(by_test(diag, "i", "G", "dPdG", "GdPdG", "d2PdG2")[1], dtype=float).T
    d = t / 300
    g = 4 / np.pi * (4 / 3 * ((1 + d) ** 1.5 - d**1.5) - 4 / 3)
    y = -np.gradient(p, g)
    assert np.allclose(got[0], g) and np.allclose(got[1], y) and np.allclose(got[2], g * y) and np.allclose(got[3], np.gradient(y, g), rtol=1e-6)
    late = by_test(s.loglog_diagnostics(frame(spark, {1: [[i, a, b] for i, (a, b) in enumerate(zip(t, p, strict=True))]}, ["i", "dt", "p"])), "j", "dp", "tdpdt")[1]
    assert np.allclose([x[0] for x in late], p[0] - p) and np.allclose([x[1] for x in late], -t * np.gradient(p, t))


def curves(spark):
    g = np.linspace(0, 12, 241)
    clear, decline = 50 + (g - 5) ** 2, 100 * np.exp(-g / 3)
    inflect = 300 - (g + (g - 6) ** 3 / 3)
    rows = {k: [[i, a, b, a * b, c] for i, (a, b, c) in enumerate(zip(g, y, np.gradient(y, g), strict=True))] for k, y in enumerate((clear, decline, inflect))}
    return frame(spark, rows, ["i", "G", "dPdG", "GdPdG", "d2PdG2"])


def test_contacts_on_analytic_curves(spark):
    diag = curves(spark)
    least = {r["test_id"]: r["min_G"] for r in s.min_dpdg(diag).collect()}
    assert least[0] == pytest.approx(5) and least[1] == pytest.approx(12)
    clear = {r["test_id"]: r["contact_G"] for r in s.contact_clear(diag, s.min_dpdg(diag)).collect()}
    assert clear[0] == pytest.approx(5 + 5**0.5, abs=0.05) and 1 not in clear
    inflection = {r["test_id"]: r["contact_G"] for r in s.contact_inflection(diag).collect()}
    assert inflection[2] == pytest.approx(6, abs=0.1)


def test_late_line_gives_back_its_intercept(spark):
    t = np.logspace(1, 4, 200)
    diag = frame(spark, {1: [[i, a, 8000 + 20000 * a**-0.5] for i, a in enumerate(t)], 2: [[0, 1, 1]]}, ["i", "t", "p"])
    spans = spark.createDataFrame([(1, 10.0, 1e4, -0.5), (2, 0.0, 10.0, -0.5)], "test_id long, lo double, hi double, exponent double")
    got = {r["test_id"]: r["pore_pressure"] for r in s.pore_pressure(diag, spans).collect()}
    assert got[1] == pytest.approx(8000) and got[2] is None


def test_interpolation_is_numpys(spark):
    x, y = np.cumsum(np.random.default_rng(4).uniform(0.1, 1, 30)), np.random.default_rng(5).random(30)
    rows = frame(spark, {k: [[i, a, b] for i, (a, b) in enumerate(zip(x, y, strict=True))] for k in range(6)}, ["i", "G", "p"])
    at = [-1.0, x[0], 3.3, x[7], 9.1, 1e3]
    got = {r["test_id"]: r["p"] for r in s.interpolate_at(rows, spark.createDataFrame(list(enumerate(map(float, at))), "test_id long, at double"), "G", ["p"], "at").collect()}
    assert np.allclose([got[k] for k in range(6)], np.interp(at, x, y))


def test_fuzzy_names(spark):
    keyed = spark.createDataFrame([("SMITHRANCH14H",), ("SMITHRANCH24H",), ("JONESUNITA3",), ("JONESUNITB3X",)], "key string")
    names = spark.createDataFrame([("JONESUNITA3H",), ("SMITHRANCH34H",), ("UNKNOWNWELL",), ("JONESUNITA8",)], "key string")
    got = {r["key"]: (r["best"], r["score"], r["match"]) for r in match.fuzzy_match(names, keyed).collect()}
    assert got == {"JONESUNITA3H": ("JONESUNITA3", 0.957, "fuzzy")}
    alone = match.fuzzy_match(names, keyed.where("key = 'SMITHRANCH14H'")).collect()
    assert [(r["key"], r["match"]) for r in alone] == [("SMITHRANCH34H", "sibling")]
