"""Data of the six figures of an interpretation, for every test at once: curves, default axes and picked points as long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from falloff.functions import formulas as fx
from falloff.operators import series as s
from falloff.operators.segments import CHUNK, Segments
from falloff.plans import interpret
from falloff.plans.staging import staged

KEY = s.KEY

#: Rows of a curve at most, minutes about shut-in, hours kept after the last rate, upper ends of the pore-pressure axis.
MOST = 6000
SHUTIN_FROM, SHUTIN_TO = -5.0, 15.0
AFTER_RATE_H = 0.25
AXIS_END = {"tm12": 0.05, "tm1": 0.0025}


def log_bound(value: Column) -> Column:
    """Position of a value on a logarithmic slider; what is not above 1e-12 stands there."""
    return F.log10(F.greatest(value, F.lit(1e-12)))


def from_log_bound(position: Column) -> Column:
    return F.pow(F.lit(10.0), position)


def _thinned(rows: DataFrame, most: int, scans: Segments) -> DataFrame:
    """Every k-th row of what was kept of each test, by position, ``most`` at most; no test's rows are sorted in one task."""
    placed = scans.positions(scans.cut(rows)).drop(CHUNK)
    return placed.where(F.col("_pos") % F.greatest(F.ceil(F.col("_size") / most), F.lit(1)) == 0).drop("_size", "_pos")


def _long(rows: DataFrame, step: str, x: Column, ys: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("series"), x.cast("double").alias("x"), y.cast("double").alias("y")) for name, y in ys.items()])
    out = rows.select(KEY, F.lit(step).alias("step"), F.explode(pairs).alias("v")).select(KEY, "step", "v.*")
    return out.where(s.finite(F.col("x")) & s.finite(F.col("y")))


def _axis(picks: DataFrame) -> DataFrame:
    """(test_id, axis) of tests whose pore pressure is drawn: not those whose postclosure scenario leaves it out."""
    axis = F.coalesce(fx.postclosure_axis(F.col("postclosure_scenario")), "pp_axis", F.lit("tm12"))
    return picks.where(~F.coalesce(F.col("postclosure_scenario").startswith("PC-F"), F.lit(False))).select(KEY, axis.alias("axis"))


def inputs(samples: DataFrame, picks: DataFrame, alpha: float = 1.0, scans: Segments | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(picks, pumped, diag, late): what the figures of ``samples`` with ``picks`` are drawn from."""
    picks = interpret.with_all_picks(picks)
    pumped = staged(interpret.pumping(samples, picks, scans), "pumped")
    resampled = staged(interpret.falloff(samples, picks, pumped, scans), "resampled")
    return picks, pumped, staged(s.g_diagnostics(resampled, F.col("te"), alpha), "diagnostics"), staged(s.loglog_diagnostics(resampled), "late")


def pumping_rows(samples: DataFrame, scans: Segments) -> DataFrame:
    """Samples to a quarter of an hour after the last positive rate, all where there is none, with t_h."""
    last = samples.groupBy(KEY).agg((F.max_by("t_s", F.when(F.col("rate") > 0, F.col("idx"))) / 3600 + AFTER_RATE_H).alias("_end"))
    return scans.spread(samples.withColumn("t_h", F.col("t_s") / 3600), last).where(F.col("_end").isNull() | (F.col("t_h") <= F.col("_end")))


def curves(samples: DataFrame, picks: DataFrame, pumped: DataFrame, diag: DataFrame, late: DataFrame, most: int = MOST, scans: Segments | None = None) -> DataFrame:
    """(test_id, step, series, x, y) of the figures overview, isip, gfunction, tangent, loglog and porepressure.

    samples: test_id, idx, t_s, p, rate. picks: postclosure_scenario, pp_axis. pumped: t_shutin. diag and late: as ``series`` gives them.
    Overview is in hours, isip in minutes from shut-in, loglog only where both coordinates are positive. Points without finite
    coordinates are left out; a test without shut-in or falloff has only the figures that it supports.
    """
    scans = scans or Segments()
    overview = _thinned(pumping_rows(samples, scans), most, scans)
    near = scans.spread(samples, pumped.where(F.col("t_shutin").isNotNull()).select(KEY, "t_shutin")).withColumn("t_min", (F.col("t_s") - F.col("t_shutin")) / 60)
    near = _thinned(near.where((F.col("t_min") >= SHUTIN_FROM) & (F.col("t_min") <= SHUTIN_TO)), most, scans)
    t, dp, slope = F.col("t"), F.col("dp"), F.col("tdpdt")
    last = late.join(_axis(picks), KEY)
    parts = [
        _long(overview, "overview", F.col("t_h"), {"pressure": F.col("p"), "rate": F.col("rate")}),
        _long(near, "isip", F.col("t_min"), {"pressure": F.col("p")}),
        _long(diag, "gfunction", F.col("G"), {"pressure": F.col("p"), "dPdG": F.col("dPdG"), "d2PdG2": F.col("d2PdG2")}),
        _long(diag, "tangent", F.col("G"), {"pressure": F.col("p"), "GdPdG": F.col("GdPdG")}),
        _long(late, "loglog", t, {"dp": F.when((t > 0) & (dp > 0), dp), "tdpdt": F.when((t > 0) & (slope > 0), slope)}),
        _long(last, "porepressure", F.pow("t", fx.axis_exponent(F.col("axis"))), {"pressure": F.col("p")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def axes(samples: DataFrame, picks: DataFrame, pumped: DataFrame, diag: DataFrame, late: DataFrame, scans: Segments | None = None) -> DataFrame:
    """(test_id, step, axis, lo, hi): the ranges that figures show at first, exact percentiles.

    dP/dG runs from 0 to 1.5 of its 95th percentile, within 1 and 50; d2P/dG2 is scaled by G of 1 and more where there is such; the
    overview by the picked injection, else by the rates above 0.1, never beyond what is drawn.
    """
    scans = scans or Segments()
    at = lambda pick: F.max_by("t_h", F.when(F.col("idx") == F.col(pick), F.col("idx")))
    rows = samples.withColumn("t_h", F.col("t_s") / 3600)
    rows = scans.spread(rows, picks.select(KEY, "start_idx", "shutin_idx"))
    active = F.when(F.col("rate") > 0.1, F.col("idx"))
    per = rows.groupBy(KEY).agg(
        at("start_idx").alias("a"), at("shutin_idx").alias("z"), F.min_by("t_h", active).alias("_first"), F.max_by("t_h", active).alias("_last"),
        (F.max_by("t_h", F.when(F.col("rate") > 0, F.col("idx"))) + AFTER_RATE_H).alias("_end"),
    )
    span, picked = F.greatest(F.col("z") - F.col("a"), F.lit(AFTER_RATE_H)), F.col("a").isNotNull() & F.col("z").isNotNull()
    lo = F.when(picked, F.col("a") - 0.5 * span).when(F.col("_first").isNotNull(), F.greatest(F.lit(0.0), F.col("_first") - 0.2))
    hi = F.least(F.when(picked, F.col("z") + 2.0 * span).otherwise(F.col("_last") + 0.5), F.col("_end"))
    overview = per.select(KEY, F.lit("overview").alias("step"), F.lit("x").alias("axis"), lo.alias("lo"), hi.alias("hi")).where(F.col("lo").isNotNull())
    isip = pumped.where(F.col("t_shutin").isNotNull()).select(KEY, F.lit("isip").alias("step"), F.lit("x").alias("axis"), F.lit(-1.0).alias("lo"), F.lit(3.0).alias("hi"))

    good = lambda c: F.when(s.finite(F.col(c)), F.col(c))
    d2 = good("d2PdG2")
    late_d2 = F.when(F.col("G") >= 1, d2)
    told = diag.groupBy(KEY).agg(
        F.min(good("p")).alias("p0"), F.max(good("p")).alias("p1"), F.percentile(good("dPdG"), F.lit(0.95)).alias("d"), F.percentile(good("GdPdG"), F.lit(0.95)).alias("g"),
        F.coalesce(F.percentile(late_d2, F.lit(0.05)), F.percentile(d2, F.lit(0.05))).alias("q0"), F.coalesce(F.percentile(late_d2, F.lit(0.95)), F.percentile(d2, F.lit(0.95))).alias("q1"),
    )
    pad = 0.05 * F.greatest(F.col("p1") - F.col("p0"), F.lit(1.0))
    pad2 = 0.10 * F.greatest(F.col("q1") - F.col("q0"), F.lit(1e-9))
    one = lambda step, axis, a, b: F.struct(F.lit(step).alias("step"), F.lit(axis).alias("axis"), a.alias("lo"), b.alias("hi"))
    least = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) * 1.5, F.lit(1.0)))
    zero = F.lit(0.0)
    ranges = F.array(
        one("gfunction", "y", F.col("p0") - pad, F.col("p1") + pad), one("gfunction", "y2", zero, F.when(F.col("d").isNotNull(), F.least(least("d"), F.lit(50.0)))),
        one("gfunction", "y3", F.col("q0") - pad2, F.col("q1") + pad2), one("tangent", "y2", zero, least("g")),
    )
    found = told.select(KEY, F.explode(ranges).alias("v")).select(KEY, "v.*").where(F.col("hi").isNotNull())
    end = F.when(F.col("axis") == "tm12", AXIS_END["tm12"]).otherwise(AXIS_END["tm1"])
    shown = _axis(picks).join(late.select(KEY).distinct(), KEY).select(KEY, F.lit("porepressure").alias("step"), end.alias("hi"))
    shown = shown.select(KEY, "step", F.lit("x").alias("axis"), zero.alias("lo"), "hi")
    return reduce(DataFrame.unionByName, [overview, isip, found, shown])


def unphysical(late: DataFrame, spans: DataFrame) -> DataFrame:
    """(test_id, pore_pressure, least, unphysical): whether a pore pressure is not below all pressures of its window.

    ``spans``: test_id, lo, hi, exponent. Tests without two rows in their window are left out.
    """
    within = late.join(spans, KEY).where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")) & (F.col("t") > 0))
    least = within.groupBy(KEY).agg(F.min("p").alias("least"))
    return s.pore_pressure(late, spans).where(F.col("pore_pressure").isNotNull()).join(least, KEY).withColumn("unphysical", F.col("pore_pressure") >= F.col("least"))
