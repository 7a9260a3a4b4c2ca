"""Operators on ordered records: one row for each sample, keyed by ``test_id`` and an explicit order column.

Each operator is windows and aggregates per test, so a corpus of tests is one job: tests are spread over tasks,
and the falloff is reduced to a few hundred rows before anything is computed from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from falloff.functions.formulas import g_time

KEY = "test_id"


def along(order: str = "idx", key: str = KEY) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def whole(key: str = KEY) -> WindowSpec:
    return Window.partitionBy(key)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def elapsed_seconds(rows: DataFrame, ts: str = "ts", order: str = "idx") -> DataFrame:
    """``t_s``: seconds since the first valid timestamp in row order; null where the timestamp is."""
    first = F.first(ts, ignorenulls=True).over(along(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_first", first).withColumn("t_s", F.expr(f"timestampdiff(MICROSECOND, _first, {ts}) / 1e6")).drop("_first")


def unreversed(rows: DataFrame, ts: str = "ts", order: str = "idx") -> DataFrame:
    """Rows of tests whose valid timestamps never rise, and are not all equal, in the opposite order."""
    before = F.last(ts, ignorenulls=True).over(along(order).rowsBetween(Window.unboundedPreceding, -1))
    step = rows.withColumn("_rises", F.col(ts) > before).withColumn("_falls", F.col(ts) < before)
    turned = ~F.coalesce(F.bool_or("_rises").over(whole()), F.lit(False)) & F.coalesce(F.bool_or("_falls").over(whole()), F.lit(False))
    last = F.max(order).over(whole())
    return step.withColumn("reversed", turned).withColumn(order, F.when(F.col("reversed"), last - F.col(order)).otherwise(F.col(order))).drop("_rises", "_falls")


def monotonic_prefix(rows: DataFrame, t: str = "t_s", order: str = "idx") -> DataFrame:
    """Rows before the first one whose time is less than the one before it."""
    drop = F.when(F.col(t) < F.lag(t).over(along(order)), F.col(order))
    return rows.withColumn("_drop", drop).withColumn("_cut", F.min("_drop").over(whole())).where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_drop", "_cut")


def resample_increment(rows: DataFrame, step: float | Column = 30.0, rise: float | Column | None = None, dt: str = "dt", p: str = "p", order: str = "idx") -> DataFrame:
    """(test_id, i, dt, p, n_raw, guarded_at): a row each time the pressure is ``step`` below the row kept last.

    Rows without a finite pressure are passed over; the first other one is kept. Nothing is kept from the first
    row on that rises more than ``rise`` (``step`` if not given) above all before it; guarded_at is then the
    number kept. A kept row is a new low, so windows cut each test to its lows before the guard, and only
    those are folded in order.
    """
    step = step if isinstance(step, Column) else F.lit(float(step))
    rise = step if rise is None else rise if isinstance(rise, Column) else F.lit(float(rise))
    counted = rows.withColumn("_n", F.count("*").over(whole())).withColumn("_step", step).withColumn("_rise", rise)
    good = counted.where(finite(F.col(p))).withColumn("_low", F.min(p).over(along(order).rowsBetween(Window.unboundedPreceding, -1)))
    good = good.withColumn("_cut", F.min(F.when(F.col(p) > F.col("_low") + F.col("_rise"), F.col(order))).over(whole()))
    lows = good.where((F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))) & (F.col("_low").isNull() | (F.col(p) < F.col("_low"))))
    per = lows.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(dt).cast("double").alias("dt"), F.col(p).cast("double").alias("p")))).alias("lows"),
        F.first("_n").alias("n_raw"), F.first("_step").alias("_step"), F.first("_cut").alias("_cut"),
    )
    none = F.filter("lows", lambda x: F.lit(False))
    kept = F.aggregate("lows", none, lambda acc, x: F.when((F.size(acc) == 0) | (x["p"] <= F.element_at(acc, -1)["p"] - F.col("_step")), F.concat(acc, F.array(x))).otherwise(acc))
    per = per.withColumn("kept", kept)
    guarded = F.when(F.col("_cut").isNotNull(), F.size("kept"))
    return per.select(KEY, "n_raw", guarded.alias("guarded_at"), F.posexplode("kept").alias("i", "k")).select(KEY, "i", "k.dt", "k.p", "n_raw", "guarded_at")


def gradient(rows: DataFrame, y: str, x: str, out: str, order: str = "i") -> DataFrame:
    """Second-order derivative on uneven spacing, one-sided at both ends; null where spacing is zero or a test has one row."""
    w = along(order)
    y0, y1, x0, x1 = F.lag(y).over(w), F.lead(y).over(w), F.lag(x).over(w), F.lead(x).over(w)
    hs, hd = F.col(x) - x0, x1 - F.col(x)
    inner = F.try_divide(hs * hs * y1 + (hd * hd - hs * hs) * F.col(y) - hd * hd * y0, hs * hd * (hd + hs))
    ends = F.when(x0.isNull(), F.try_divide(y1 - F.col(y), hd)).when(x1.isNull(), F.try_divide(F.col(y) - y0, hs))
    return rows.withColumn(out, F.when(x0.isNotNull() & x1.isNotNull(), inner).otherwise(ends))


def g_diagnostics(resampled: DataFrame, te: float | Column, alpha: float = 1.0) -> DataFrame:
    """(.., G, dPdG, GdPdG, d2PdG2), derivatives positive for a decline."""
    out = resampled.withColumn("G", g_time(F.col("dt"), te if isinstance(te, Column) else F.lit(float(te)), alpha))
    out = gradient(out, "p", "G", "dPdG").withColumn("dPdG", -F.col("dPdG")).withColumn("GdPdG", F.col("G") * F.col("dPdG"))
    return gradient(out, "dPdG", "G", "d2PdG2")


def loglog_diagnostics(resampled: DataFrame) -> DataFrame:
    """(test_id, j, t, p, dp, tdpdt) of the rows after shut-in, with their own index."""
    out = resampled.where(F.col("dt") > 0).select(KEY, F.col("dt").alias("t"), "p", (F.row_number().over(along("i")) - 1).alias("j"))
    first = F.first("p").over(along("j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return gradient(out, "p", "t", "_d", "j").select(KEY, "j", "t", "p", (first - F.col("p")).alias("dp"), (-F.col("t") * F.col("_d")).alias("tdpdt"))


def rolling_mean(rows: DataFrame, x: str, width: int, out: str, order: str = "idx") -> DataFrame:
    """Centred mean over ``width`` rows, as if zeros stood beyond the ends."""
    frame = along(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return rows.withColumn(out, F.sum(x).over(frame) / float(width))


def injection_window(rows: DataFrame, rate: str = "rate", threshold: float = 0.1, order: str = "idx") -> DataFrame:
    """(test_id, start_idx, shutin_idx) from the first row to one past the last above the threshold."""
    on = F.when(F.col(rate) > threshold, F.col(order))
    out = rows.groupBy(KEY).agg(F.min(on).alias("start_idx"), F.max(on).alias("_on"), F.max(order).alias("_end"))
    return out.where(F.col("start_idx").isNotNull()).select(KEY, "start_idx", F.least(F.col("_on") + 1, F.col("_end")).alias("shutin_idx"))


def main_cycle(rows: DataFrame, rate: str = "rate", volume: str = "volume", threshold: float = 0.1, order: str = "idx") -> DataFrame:
    """(test_id, start_idx, shutin_idx) of the stretch above the threshold that gains most volume, the first of equals."""
    w = along(order)
    on = F.coalesce(F.col(rate) > threshold, F.lit(False))
    out = rows.withColumn("_on", on).withColumn("_new", F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0))
    out = out.withColumn("_stretch", F.sum("_new").over(w)).withColumn("_next", F.lead(order).over(w)).withColumn("_next_v", F.lead(volume).over(w))
    ends = out.where("_on").groupBy(KEY, "_stretch").agg(
        F.min(order).alias("start_idx"), F.min_by(volume, order).alias("_v0"),
        F.max_by(F.coalesce("_next", order), order).alias("shutin_idx"), F.max_by(F.when(F.col("_next").isNull(), F.col(volume)).otherwise(F.col("_next_v")), order).alias("_v1"),
    )
    best = F.max_by(F.struct("start_idx", "shutin_idx"), F.struct(F.col("_v1") - F.col("_v0"), -F.col("start_idx")))
    return ends.groupBy(KEY).agg(best.alias("b")).select(KEY, "b.start_idx", "b.shutin_idx")


def max_sustained_rate(rows: DataFrame, window: DataFrame, rate: str = "rate", width: int = 15, order: str = "idx") -> DataFrame:
    """(test_id, qmax): peak of the rolling mean over [start, shut-in); a shorter stretch is smoothed by its own length."""
    seg = rows.join(window, KEY).where((F.col(order) >= F.col("start_idx")) & (F.col(order) < F.col("shutin_idx")))
    seg = rolling_mean(seg, rate, width, "_mean", order).withColumn("_size", F.count("*").over(whole()))
    short = F.when(F.col("_size") < width, F.struct(order, rate))
    per = seg.groupBy(KEY).agg(F.max(F.when(F.col("_size") >= width, F.col("_mean"))).alias("_long"), F.array_sort(F.collect_list(short)).alias("_short"))
    n = F.size("_short")
    # At most width - 1 rates: their rolling means by slices of the array.
    mean = lambda i: F.aggregate(F.slice("_short", F.greatest(i - F.floor(n / 2), F.lit(0)).cast("int") + 1, (F.least(i + F.floor((n - 1) / 2), n - 1) - F.greatest(i - F.floor(n / 2), F.lit(0)) + 1).cast("int")), F.lit(0.0), lambda a, x: a + x[rate]) / n
    return per.select(KEY, F.coalesce("_long", F.when(n > 0, F.array_max(F.transform(F.sequence(F.lit(0), n - 1), mean)))).alias("qmax"))


def injected_volume(rows: DataFrame, window: DataFrame, rate: str = "rate", volume: str = "volume", order: str = "idx") -> DataFrame:
    """(test_id, vinj_delta, vinj_integral, vinj, vinj_source, vinj_disagreement): volume channel against the integral of rate."""
    seg = rows.join(window, KEY)
    within = (F.col(order) >= F.col("start_idx")) & (F.col(order) < F.col("shutin_idx"))
    nxt = F.lead(rate).over(along(order)), F.lead("t_s").over(along(order)), F.lead(order).over(along(order))
    area = F.when(within & (nxt[2] < F.col("shutin_idx")), (F.col(rate) + nxt[0]) / 2 * (nxt[1] - F.col("t_s")) / 60.0)
    return volumes(seg.withColumn("_area", area), volume, order)


def volumes(seg: DataFrame, volume: str, order: str) -> DataFrame:
    """What ``injected_volume`` returns, from rows with their window and the area under the rate up to the next row."""
    per = seg.groupBy(KEY).agg(
        (F.max(F.when(F.col(order) == F.col("shutin_idx"), F.col(volume))) - F.max(F.when(F.col(order) == F.col("start_idx"), F.col(volume)))).alias("vinj_delta"),
        F.coalesce(F.sum("_area"), F.lit(0.0)).alias("vinj_integral"),
    )
    gap = F.when(F.col("vinj_delta") != 0, F.abs(F.col("vinj_delta") - F.col("vinj_integral")) / F.col("vinj_delta"))
    return per.withColumn("vinj", F.coalesce("vinj_delta", "vinj_integral")).withColumn("vinj_source", F.when(F.col("vinj_delta").isNotNull(), "volume_channel").otherwise("rate_integral")).withColumn("vinj_disagreement", gap)


def local_slope(rows: DataFrame, x: str, y: str, out: str, half: int = 4, order: str = "i") -> DataFrame:
    """Slope of the least-squares line through the rows up to ``half`` before and after; 0 where there are not two."""
    return rows.withColumn(out, F.coalesce(F.regr_slope(y, x).over(along(order).rowsBetween(-half, half)), F.lit(0.0)))


def tangent_at(rows: DataFrame, targets: DataFrame, x: str, y: str, at: str, half: int = 4, order: str = "i") -> DataFrame:
    """(test_id, anchor_x, anchor_y, slope) at the row nearest to each test's ``at`` on x, the first of equals (to 9 places)."""
    near = local_slope(rows, x, y, "_slope", half, order).join(targets.select(KEY, F.col(at).alias("_at")), KEY).where(F.col("_at").isNotNull() & F.col(x).isNotNull())
    best = F.min_by(F.struct(F.col(x).alias("anchor_x"), F.col(y).alias("anchor_y"), F.col("_slope").alias("slope")), F.struct(F.round(F.abs(F.col(x) - F.col("_at")), 9), F.col(order)))
    return near.groupBy(KEY).agg(best.alias("b")).select(KEY, "b.*")


def interpolate_at(rows: DataFrame, targets: DataFrame, x: str, ys: list[str], at: str, order: str = "i") -> DataFrame:
    """(test_id, *ys): linear interpolation at each test's ``at`` on a rising x, held beyond the ends."""
    w = along(order)
    out = rows.withColumn("_x1", F.lead(x).over(w))
    for y in ys:
        out = out.withColumn(f"_{y}1", F.lead(y).over(w))
    out = out.join(targets.select(KEY, F.col(at).alias("_at")), KEY).where(F.col("_at").isNotNull())
    inside = (F.col("_at") >= F.col(x)) & (F.col("_at") < F.col("_x1"))
    columns = []
    for y in ys:
        line = F.col(y) + (F.col("_at") - F.col(x)) * F.try_divide(F.col(f"_{y}1") - F.col(y), F.col("_x1") - F.col(x))
        below, above = F.min_by(y, x), F.max_by(y, x)
        columns.append(F.when(F.first("_at") < F.min(x), below).when(F.first("_at") >= F.max(x), above).otherwise(F.max(F.when(inside, line))).alias(y))
    return out.groupBy(KEY).agg(*columns)


def dips(diag: DataFrame, g_min: float = 1.0) -> DataFrame:
    """``diag`` with ``_ok``, rows that count for the minimum of dP/dG, and ``_dip``, those of them that are a dip."""
    w = along("i")
    y = F.col("dPdG")
    late = F.max(F.when(F.col("G") >= g_min, 1).otherwise(0)).over(whole()) == 1
    return diag.withColumn("_ok", y.isNotNull() & (~late | (F.col("G") >= g_min))).withColumn("_dip", F.col("_ok") & (y < F.lag("dPdG").over(w)) & (y <= F.lead("dPdG").over(w)))


def deepest(over: WindowSpec | None = None) -> Column:
    """(i, G, dPdG) of the deepest of a test's ``dips``, or of its least row: an aggregate, or a window over the test."""
    best = lambda flag: F.min_by(F.when(F.col(flag), F.struct("i", "G", "dPdG")), F.when(F.col(flag), F.struct("dPdG", "i")))
    found = [best("_dip"), best("_ok")]
    return F.coalesce(*found if over is None else [c.over(over) for c in found])


def min_dpdg(diag: DataFrame, g_min: float = 1.0) -> DataFrame:
    """(test_id, min_i, min_G, min_dPdG): the deepest dip of dP/dG beyond ``g_min``, or its least value there."""
    out = dips(diag, g_min).groupBy(KEY).agg(deepest().alias("b"))
    return out.where(F.col("b").isNotNull()).select(KEY, F.col("b.i").alias("min_i"), F.col("b.G").alias("min_G"), F.col("b.dPdG").alias("min_dPdG"))


def contact_clear(diag: DataFrame, least: DataFrame, rise: float = 0.10) -> DataFrame:
    """(test_id, contact_i, contact_G): the first row after the minimum that stands ``rise`` above it; none if it never does."""
    later = diag.join(least, KEY).where((F.col("i") > F.col("min_i")) & (F.col("dPdG") >= F.col("min_dPdG") * (1 + rise)))
    return later.groupBy(KEY).agg(F.min("i").alias("contact_i"), F.min_by("G", "i").alias("contact_G"))


def peaks(diag: DataFrame, g_min: float = 1.0) -> DataFrame:
    """``diag`` with ``_peak``: rows where d2PdG2 peaks, beyond ``g_min`` where a test gets there."""
    w = along("i")
    d2 = F.col("d2PdG2")
    late = F.max(F.when(F.col("G") >= g_min, 1).otherwise(0)).over(whole()) == 1
    return diag.withColumn("_peak", F.coalesce((d2 > F.lag("d2PdG2").over(w)) & (d2 >= F.lead("d2PdG2").over(w)) & (~late | (F.col("G") >= g_min)), F.lit(False)))


def contact_inflection(diag: DataFrame, seeds: DataFrame | None = None, g_min: float = 1.0) -> DataFrame:
    """(test_id, contact_i, contact_G): the flattest point of the decline, the one nearest ``seed_G`` or else the tallest."""
    found = peaks(diag, g_min).where("_peak")
    if seeds is None:
        key = F.struct(-F.col("d2PdG2"), "i")
    else:
        found = found.join(seeds.select(KEY, "seed_G"), KEY)
        key = F.struct(F.abs(F.col("G") - F.col("seed_G")), "i")
    return found.groupBy(KEY).agg(F.min_by(F.struct(F.col("i").alias("contact_i"), F.col("G").alias("contact_G")), key).alias("b")).select(KEY, "b.*")


def closure_departure(diag: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """(test_id, slope, closure_i, closure_G): where G dP/dG leaves the line through the origin that fits its early third."""
    n = F.count("*").over(whole())
    out = diag.withColumn("_lo", F.greatest(F.lit(1), F.floor(n / 20))).withColumn("_hi", F.greatest(F.lit(2), F.floor(n / 3))).withColumn("_last", n - 1)
    early = (F.col("i") >= F.col("_lo")) & (F.col("i") < F.col("_hi")) & (F.col("G") > 0) & F.col("GdPdG").isNotNull()
    fit = F.try_divide(F.sum(F.when(early, F.col("G") * F.col("GdPdG"))).over(whole()), F.sum(F.when(early, F.col("G") * F.col("G"))).over(whole()))
    out = out.withColumn("slope", F.when(F.sum(F.when(early, 1).otherwise(0)).over(whole()) >= 2, fit)).withColumn("_line", F.col("slope") * F.col("G"))
    leaves = (F.col("i") >= F.col("_hi")) & (F.col("_line") > 0) & (F.abs(F.col("GdPdG") - F.col("_line")) > tolerance * F.col("_line"))
    per = out.groupBy(KEY).agg(F.first("slope").alias("slope"), F.min(F.when(leaves, F.struct("i", "G"))).alias("b"), F.max_by("G", "i").alias("_g"), F.first("_last").alias("_last"))
    return per.select(KEY, "slope", F.coalesce("b.i", F.col("_last").cast("int")).alias("closure_i"), F.coalesce("b.G", "_g").alias("closure_G"))


def loglog_slope(diag: DataFrame, spans: DataFrame) -> DataFrame:
    """(test_id, slope): of log dp against log t over [lo, hi), rows with both positive, two at least."""
    rows = diag.join(spans, KEY).where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")) & (F.col("t") > 0) & (F.col("dp") > 0))
    return rows.groupBy(KEY).agg(F.when(F.count("*") >= 2, F.regr_slope(F.log10("dp"), F.log10("t"))).alias("slope"))


def pore_pressure(diag: DataFrame, spans: DataFrame) -> DataFrame:
    """(test_id, pore_pressure): intercept of the late line of p on t**exponent over [lo, hi], two rows at least.

    ``spans`` has test_id, lo, hi and exponent.
    """
    rows = diag.join(spans, KEY).where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")) & (F.col("t") > 0))
    return rows.groupBy(KEY).agg(F.when(F.count("*") >= 2, F.regr_intercept(F.col("p"), F.pow("t", F.col("exponent")))).alias("pore_pressure"))


def seed_windows(diag: DataFrame) -> DataFrame:
    """(test_id, loglog_lo, loglog_hi, pp_lo): where late-time windows start, of tests with over 6 rows."""
    per = diag.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("j", "t"))).alias("a")).where(F.size("a") > 6)
    t = lambda k: F.element_at("a", k)["t"]
    return per.select(KEY, t((F.size("a") * 0.6).cast("int") + 1).alias("loglog_lo"), t(F.lit(-1)).alias("loglog_hi"), F.least(t(F.lit(-1)) / 10, t(F.lit(-2))).alias("pp_lo"))


def decimate(rows: DataFrame, most: int = 6000, order: str = "idx") -> DataFrame:
    """Every k-th row, so that no test has more than ``most``."""
    step = F.greatest(F.ceil(F.count("*").over(whole()) / most), F.lit(1))
    return rows.withColumn("_step", step).where(F.col(order) % F.col("_step") == 0).drop("_step")


def axis_limits(rows: DataFrame, y: str) -> DataFrame:
    """(test_id, p05, p95, y_min, y_max) for default plot axes; exact percentiles."""
    return rows.where(F.col(y).isNotNull()).groupBy(KEY).agg(F.percentile(y, 0.05).alias("p05"), F.percentile(y, 0.95).alias("p95"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))
