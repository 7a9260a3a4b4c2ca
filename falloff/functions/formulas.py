"""Column formulas of falloff interpretation. Any null input, or a guard that fails, gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the interpretation method: psi/ft per ppg, psi offsets and the rapid range.
PSI_PER_PPG_FT = 0.052
COMPLIANCE_OFFSET_PSI = 75.0
RAPID_OFFSET_PSI = 175.0
RAPID_RANGE_PSI = (100, 250)


def hydrostatic_head(ppg: Column, tvd_ft: Column) -> Column:
    return F.lit(PSI_PER_PPG_FT) * ppg * tvd_ft


def bottomhole_pressure(p: Column, is_bottomhole: Column, ppg: Column, tvd_ft: Column) -> Column:
    return F.when(is_bottomhole, p).otherwise(p + hydrostatic_head(ppg, tvd_ft))


def g_time(dt: Column, te: Column, alpha: float = 1.0) -> Column:
    """Dimensionless G-time of shut-in time dt after pumping for te, leak-off exponent 1 or 0.5."""
    d = F.when(te > 0, dt / te)
    if alpha == 1.0:
        g, g0 = (F.pow(1 + d, F.lit(1.5)) - F.pow(d, F.lit(1.5))) * (4.0 / 3.0), 4.0 / 3.0
    elif alpha == 0.5:
        g, g0 = (1 + d) * F.asin(F.pow(1 + d, F.lit(-0.5))) + F.sqrt(d), math.pi / 2
    else:
        raise ValueError("alpha is 1.0 or 0.5")
    return (g - g0) * (4.0 / math.pi)


def effective_pump_time(volume: Column, rate: Column) -> Column:
    """Seconds of pumping at the sustained rate that inject the volume (bbl, bbl/min); null unless positive."""
    te = F.when(rate > 0, volume / rate * 60.0)
    return F.when(te > 0, te)


def extrapolate(x: Column, y: Column, slope: Column, to: Column) -> Column:
    return y + slope * (to - x)


def shmin_compliance(contact_pressure: Column) -> Column:
    return contact_pressure - COMPLIANCE_OFFSET_PSI


def shmin_rapid(scenario: Column, apparent_isip: Column) -> Column:
    return F.when(scenario.startswith("C-D"), apparent_isip - RAPID_OFFSET_PSI)


def rapid_text(value: Column, verbose: bool = False) -> Column:
    lo, hi = RAPID_RANGE_PSI
    short = F.format_string("%d ±%d", F.bround(value, 0).cast("long"), F.lit((hi - lo) // 2))
    return F.when(value.isNotNull(), F.concat(short, F.lit(f" (ISIP − {lo}–{hi})")) if verbose else short)


def reference_isip(compliance: Column, tangent: Column) -> Column:
    """The one effective ISIP that every net pressure is taken from."""
    return F.coalesce(compliance, tangent)


def reference_source(compliance: Column, tangent: Column) -> Column:
    return F.when(compliance.isNotNull(), "compliance").when(tangent.isNotNull(), "tangent").otherwise("")


def span_seconds(lo: Column, hi: Column, exponent: float) -> Column:
    """(lo, hi) in seconds of a span on the axis t**exponent, exponent negative; null if hi is not positive."""
    end = F.when(lo > 0, F.pow(lo, F.lit(1.0 / exponent))).otherwise(F.lit(float("inf")))
    return F.when(hi > 0, F.struct(F.pow(hi, F.lit(1.0 / exponent)).alias("lo"), end.alias("hi")))


def postclosure_axis(scenario: Column) -> Column:
    """Reciprocal-time axis that a postclosure scenario asks for."""
    head = F.substring(scenario, 1, 4)
    return F.when(head.isin("PC-A", "PC-C", "PC-E"), "tm12").when(head == "PC-B", "tm1")


def axis_exponent(axis: Column) -> Column:
    return F.when(axis == "tm12", F.lit(-0.5)).otherwise(F.lit(-1.0))


def minutes_from(t_s: Column, origin_s: Column) -> Column:
    return (t_s - origin_s) / 60.0


def seconds_from(minutes: Column, origin_s: Column) -> Column:
    return minutes * 60.0 + origin_s


def numeric_entry(text: Column, current: Column) -> Column:
    """A typed number: blank clears, what is no number leaves the current value."""
    bare = F.trim(text)
    return F.when(bare == "", F.lit(None)).otherwise(F.coalesce(bare.try_cast("double"), current))
