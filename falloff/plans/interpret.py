"""Interpretation of a corpus of tests in one job: from samples and picks to stresses and pore pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from falloff.functions import formulas as fx
from falloff.operators import series as s
from falloff.operators.segments import Segments
from falloff.plans.staging import staged

KEY = s.KEY

#: Every pick that interpretation reads; a picks table may lack any but test_id.
PICKS = {
    "start_idx": "int", "shutin_idx": "int", "qmax_bpm": "double", "isip_x": "double", "isip_y": "double", "isip_slope": "double",
    "contact_G": "double", "closure_G": "double", "closure_scenario": "string", "postclosure_scenario": "string",
    "pp_lo": "double", "pp_hi": "double", "pp_axis": "string", "resample_step": "double",
}


def with_all_picks(picks: DataFrame, step: float = 30.0) -> DataFrame:
    """``picks`` with a null for each pick it lacks, and the default resampling step."""
    out = picks.select(KEY, *[(F.col(c) if c in picks.columns else F.lit(None)).cast(kind).alias(c) for c, kind in PICKS.items()])
    return out.withColumn("resample_step", F.coalesce("resample_step", F.lit(float(step))))


def with_bottomhole(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """``samples`` with p at bottomhole, from channels (test_id, is_bhp, mw_ppg, tvd_ft).

    Surface pressure takes the hydrostatic head of its fluid; where density or depth is null, or a test has no row in
    ``channels``, p is null, since it can't be told.
    """
    known = channels.select(KEY, "is_bhp", "mw_ppg", "tvd_ft")
    out = samples.join(known, KEY, "left").withColumn("p", fx.bottomhole_pressure(F.col("p"), F.col("is_bhp"), F.col("mw_ppg"), F.col("tvd_ft")))
    return out.select(samples.columns)


def inputs_ready(is_bhp: Column, ppg: Column, tvd_ft: Column) -> Column:
    """Whether a test's pressure can be told at bottomhole."""
    return F.coalesce(is_bhp, F.lit(False)) | (ppg.isNotNull() & tvd_ft.isNotNull())


def pumping(samples: DataFrame, picks: DataFrame, scans: Segments | None = None) -> DataFrame:
    """(test_id, t_shutin, qmax, vinj.., te): what the injection window gives."""
    ops = scans or s
    window = picks.where(F.col("start_idx").isNotNull() & F.col("shutin_idx").isNotNull()).select(KEY, "start_idx", "shutin_idx", "qmax_bpm")
    t0 = samples.join(window.select(KEY, F.col("shutin_idx").alias("idx"), "qmax_bpm"), [KEY, "idx"]).select(KEY, F.col("t_s").alias("t_shutin"), "qmax_bpm")
    out = t0.join(ops.max_sustained_rate(samples, window.drop("qmax_bpm")), KEY, "left").join(ops.injected_volume(samples, window.drop("qmax_bpm")), KEY, "left")
    out = out.withColumn("qmax", F.coalesce(F.when(F.col("qmax_bpm") != 0, F.col("qmax_bpm")), "qmax"))
    return out.withColumn("te", fx.effective_pump_time(F.col("vinj"), F.col("qmax"))).drop("qmax_bpm")


def falloff(samples: DataFrame, picks: DataFrame, pumped: DataFrame, scans: Segments | None = None) -> DataFrame:
    """Resampled pressure after shut-in with te of its test, of tests with a positive te and three rows at least."""
    per = pumped.where(F.col("te").isNotNull()).select(KEY, "t_shutin", "te").join(picks.select(KEY, "resample_step"), KEY)
    after = scans.spread(samples, per) if scans else samples.join(per, KEY)
    after = after.withColumn("dt", F.col("t_s") - F.col("t_shutin")).where(F.col("dt") >= 0)
    kept = (scans or s).resample_increment(after, F.col("resample_step"))
    return kept.withColumn("n_kept", F.count("*").over(s.whole())).where(F.col("n_kept") >= 3).join(pumped.select(KEY, "te"), KEY)


def interpret(samples: DataFrame, picks: DataFrame, alpha: float = 1.0, step: float = 30.0, channels: DataFrame | None = None, scans: Segments | None = None) -> DataFrame:
    """One row for each test of ``picks``: every derived value its picks support, null where they don't.

    ``samples`` has test_id, idx, t_s, p, rate, volume. All tests are computed together: each table below is keyed
    by test_id, and after resampling holds a few hundred rows a test. With ``channels`` p is first brought to bottomhole.
    With ``scans`` long records are scanned by many tasks each; without, a test's samples are one task's.
    """
    if channels is not None:
        samples = staged(with_bottomhole(samples, channels), "bottomhole")
    picks = with_all_picks(picks, step)
    pumped = staged(pumping(samples, picks, scans), "pumped")
    resampled = staged(falloff(samples, picks, pumped, scans), "resampled")
    diag = staged(s.g_diagnostics(resampled, F.col("te"), alpha), "diagnostics")
    late = s.loglog_diagnostics(resampled)
    has = resampled.select(KEY).distinct().withColumn("has_diag", F.lit(True))
    kept = resampled.groupBy(KEY).agg(F.first("n_kept").alias("n_resampled"), F.first("guarded_at").alias("guarded_at"))

    def method(at: str, name: str) -> DataFrame:
        curve = s.interpolate_at(diag, picks, "G", ["p", "dt"], at).select(KEY, F.col("p").alias(f"pressure_{name}"), F.col("dt").alias(f"closure_time_{name}"))
        line = s.tangent_at(diag, picks, "G", "p", at).select(KEY, fx.extrapolate(F.col("anchor_x"), F.col("anchor_y"), F.col("slope"), F.lit(0.0)).alias(f"eff_isip_{name}"))
        return curve.join(line, KEY)

    picks = picks.withColumn("variable_G", (F.col("contact_G") + F.col("closure_G")) / 2)
    axis = F.coalesce(fx.postclosure_axis(F.col("postclosure_scenario")), "pp_axis", F.lit("tm12"))
    skipped = F.coalesce(F.col("postclosure_scenario").startswith("PC-F"), F.lit(False))
    spans = picks.where(F.col("pp_lo").isNotNull() & F.col("pp_hi").isNotNull() & ~skipped).select(KEY, F.col("pp_lo").alias("lo"), F.col("pp_hi").alias("hi"), fx.axis_exponent(axis).alias("exponent"))

    out = picks.join(pumped, KEY, "left").join(has, KEY, "left").join(kept, KEY, "left")
    for at, name in (("contact_G", "compliance"), ("closure_G", "tangent"), ("variable_G", "variable")):
        out = out.join(method(at, name), KEY, "left")
    out = out.join(s.pore_pressure(late, spans), KEY, "left")
    out = out.withColumn("apparent_isip", fx.extrapolate(F.col("isip_x"), F.col("isip_y"), F.col("isip_slope"), F.col("t_shutin")))
    out = out.withColumn("shmin_compliance", fx.shmin_compliance(F.col("pressure_compliance"))).withColumn("shmin_tangent", F.col("pressure_tangent")).withColumn("shmin_variable", F.col("pressure_variable"))
    out = out.withColumn("shmin_rapid", fx.shmin_rapid(F.col("closure_scenario"), F.col("apparent_isip")))
    out = out.withColumn("reference", fx.reference_isip(F.col("eff_isip_compliance"), F.col("eff_isip_tangent")))
    out = out.withColumn("net_pressure_source", fx.reference_source(F.col("eff_isip_compliance"), F.col("eff_isip_tangent")))
    for name in ("compliance", "tangent", "variable", "rapid"):
        out = out.withColumn(f"net_pressure_{name}", F.col("reference") - F.col(f"shmin_{name}"))
    out = out.withColumn("complexity", F.col("apparent_isip") - F.col("reference")).withColumn("delta_closure", F.col("shmin_compliance") - F.col("shmin_tangent"))
    warnings = F.filter(
        F.array(
            F.when(F.col("vinj_disagreement") > 0.05, F.lit("volume and rate integral disagree")),
            F.when(F.col("te").isNull() & F.col("qmax").isNotNull(), F.lit("no positive pump time")),
            F.when(F.col("n_resampled") < 20, F.lit("few resampled points")),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("warnings", warnings)


RESULTS = [
    "test_id", "t_shutin", "qmax", "vinj", "te", "n_resampled", "apparent_isip", "contact_G", "closure_G", "pressure_compliance", "eff_isip_compliance", "shmin_compliance",
    "closure_time_compliance", "shmin_tangent", "eff_isip_tangent", "closure_time_tangent", "shmin_variable", "eff_isip_variable", "net_pressure_compliance",
    "net_pressure_tangent", "net_pressure_source", "complexity", "delta_closure", "pore_pressure",
]


def auto_picks(samples: DataFrame, alpha: float = 1.0, step: float = 30.0, isip_after_s: float = 60.0, scans: Segments | None = None) -> DataFrame:
    """Picks seeded from the data: main cycle, ISIP tangent, minimum, contact at the hump of dP/dG, departure, late window."""
    ops = scans or s
    window = staged(ops.main_cycle(samples), "window")
    base = with_all_picks(window, step)
    pumped = staged(pumping(samples, base, scans), "pumped")
    at = pumped.select(KEY, (F.col("t_shutin") + isip_after_s).alias("isip_at"))
    isip = ops.tangent_at(samples, at, "t_s", "p", "isip_at", half=30, order="idx").select(KEY, F.col("anchor_x").alias("isip_x"), F.col("anchor_y").alias("isip_y"), F.col("slope").alias("isip_slope"))
    resampled = staged(falloff(samples, base, pumped, scans), "resampled")
    diag = staged(s.g_diagnostics(resampled, F.col("te"), alpha), "diagnostics")
    many = F.col("n_kept") > 5
    hump = diag.where(many & F.col("dPdG").isNotNull()).groupBy(KEY).agg(F.max_by("G", F.struct(F.col("dPdG"), -F.col("i"))).alias("contact_G"))
    least = s.min_dpdg(diag.where(many)).select(KEY, F.col("min_G").alias("min_dpdg_G"))
    closure = s.closure_departure(diag).where(F.col("slope").isNotNull()).select(KEY, "closure_G")
    late = s.seed_windows(s.loglog_diagnostics(resampled)).select(KEY, F.col("loglog_lo").alias("pp_lo"), F.col("loglog_hi").alias("pp_hi"))
    return window.join(isip, KEY, "left").join(hump, KEY, "left").join(least, KEY, "left").join(closure, KEY, "left").join(late, KEY, "left").withColumn("resample_step", F.lit(float(step)))


def interpret_all(samples: DataFrame, alpha: float = 1.0, step: float = 30.0, scans: Segments | None = None) -> DataFrame:
    """Seed the picks of every test, then interpret with them."""
    samples = staged(samples, "samples")
    return interpret(samples, staged(auto_picks(samples, alpha, step, scans=scans), "picks"), alpha, step, scans=scans)
