"""Queries of the operators on ordered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.functions import formulas as fx
from falloff.operators import series as s
from falloff.plans.scenarios import scenario_contacts
from falloff.plans.staging import staged
from falloff.plans.views import PRELUDE, STEP, TE, samples

KEY = s.KEY


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.resample_increment(samples(spark, sf_dir).withColumn("dt", F.col("t_s")), STEP)


def _diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.g_diagnostics(_resampled(spark, sf_dir), TE)


def elapsed_seconds(spark, sf_dir):
    return s.elapsed_seconds(samples(spark, sf_dir).drop("t_s")).select(KEY, "idx", *_r("t_s"))


def reverse_detect(spark, sf_dir):
    """Odd tests are read backwards, and put right again."""
    rows = samples(spark, sf_dir).withColumn("idx", F.when(F.col(KEY) % 2 == 1, -F.col("idx")).otherwise(F.col("idx")))
    first = F.min("idx").over(s.whole())
    return s.unreversed(rows.withColumn("idx", F.col("idx") - first)).select(KEY, "idx", *_r("t_s"), "reversed")


def monotonic_prefix(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("t_s", F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("t_s")))
    return s.monotonic_prefix(rows).select(KEY, "idx", *_r("t_s"))


def resample_increment(spark, sf_dir):
    return _resampled(spark, sf_dir).select(KEY, "i", *_r("dt", "p"), F.col("n_raw").cast("long").alias("n_raw"))


def resample_guarded(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("dt", F.col("t_s"))
    return s.resample_increment(rows, 50.0, 150.0, p="noisy").select(KEY, "i", *_r("dt", "p"), F.col("guarded_at").cast("long").alias("guarded_at"))


def g_time_a1(spark, sf_dir):
    return samples(spark, sf_dir).select(KEY, "idx", F.round(fx.g_time(F.col("t_s"), F.lit(TE)), 6).alias("g"))


def g_time_a05(spark, sf_dir):
    return samples(spark, sf_dir).select(KEY, "idx", F.round(fx.g_time(F.col("t_s"), F.lit(TE), 0.5), 6).alias("g"))


def g_diagnostics(spark, sf_dir):
    out = _diag(spark, sf_dir)
    return out.select(KEY, "i", F.round("G", 6).alias("gt"), F.round("dPdG", 4).alias("dpdg"), F.round("GdPdG", 4).alias("gdpdg"), F.round("d2PdG2", 3).alias("d2"))


def loglog_deriv(spark, sf_dir):
    return s.loglog_diagnostics(_resampled(spark, sf_dir)).select(KEY, "j", *_r("t", "dp"), F.round("tdpdt", 4).alias("tdpdt"))


def rolling_mean_same(spark, sf_dir):
    return s.rolling_mean(samples(spark, sf_dir), "rate", 15, "mean").select(KEY, "idx", *_r("mean"))


def injection_window(spark, sf_dir):
    return s.injection_window(samples(spark, sf_dir))


def main_cycle(spark, sf_dir):
    return s.main_cycle(samples(spark, sf_dir))


def max_sustained_rate(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return s.max_sustained_rate(rows, s.main_cycle(rows)).select(KEY, *_r("qmax"))


def injected_volume(spark, sf_dir):
    rows = samples(spark, sf_dir)
    out = s.injected_volume(rows, s.main_cycle(rows))
    return out.select(KEY, *_r("vinj_delta", "vinj_integral", "vinj", "vinj_disagreement"), "vinj_source")


def local_slope(spark, sf_dir):
    return s.local_slope(_resampled(spark, sf_dir), "dt", "p", "slope").select(KEY, "i", F.round(F.col("slope") * 1000, 6).alias("slope"))


def min_dpdg(spark, sf_dir):
    return s.min_dpdg(_diag(spark, sf_dir)).select(KEY, "min_i", F.round("min_G", 6).alias("min_gt"), F.round("min_dPdG", 4).alias("min_y"))


def contact_clear(spark, sf_dir):
    diag = _diag(spark, sf_dir)
    return s.contact_clear(diag, s.min_dpdg(diag)).select(KEY, "contact_i", F.round("contact_G", 6).alias("contact_gt"))


def contact_inflection(spark, sf_dir):
    return s.contact_inflection(_diag(spark, sf_dir)).select(KEY, "contact_i", F.round("contact_G", 6).alias("contact_gt"))


def contact_inflection_seeded(spark, sf_dir):
    diag = _diag(spark, sf_dir)
    seeds = s.min_dpdg(diag).select(KEY, F.col("min_G").alias("seed_G"))
    return s.contact_inflection(diag, seeds).select(KEY, "contact_i", F.round("contact_G", 6).alias("contact_gt"))


def closure_departure(spark, sf_dir):
    return s.closure_departure(_diag(spark, sf_dir)).select(KEY, F.round("slope", 4).alias("slope"), F.col("closure_i").cast("long").alias("closure_i"), F.round("closure_G", 6).alias("closure_gt"))


def loglog_slope(spark, sf_dir):
    late = s.loglog_diagnostics(_resampled(spark, sf_dir))
    spans = s.seed_windows(late).select(KEY, F.col("loglog_lo").alias("lo"), F.col("loglog_hi").alias("hi"))
    return s.loglog_slope(late, spans).select(KEY, *_r("slope"))


def pore_pressure(spark, sf_dir):
    late = s.loglog_diagnostics(_resampled(spark, sf_dir))
    spans = s.seed_windows(late).select(KEY, F.col("loglog_lo").alias("lo"), F.col("loglog_hi").alias("hi"), F.lit(-0.5).alias("exponent"))
    return s.pore_pressure(late, spans).select(KEY, F.round("pore_pressure", 4).alias("pore_pressure"))


def seed_windows(spark, sf_dir):
    return s.seed_windows(s.loglog_diagnostics(_resampled(spark, sf_dir))).select(KEY, *_r("loglog_lo", "loglog_hi", "pp_lo"))


def interp_at(spark, sf_dir):
    diag = _diag(spark, sf_dir)
    at = diag.select(KEY).distinct().withColumn("at", F.col(KEY) % 14 + 0.5)
    return s.interpolate_at(diag, at, "G", ["p", "dt"], "at").select(KEY, F.round("p", 4).alias("p"), F.round("dt", 3).alias("dt"))


def nearest_tangent(spark, sf_dir):
    diag = _diag(spark, sf_dir)
    at = diag.select(KEY).distinct().withColumn("at", F.col(KEY) % 14 + 0.5)
    return s.tangent_at(diag, at, "G", "p", "at").select(KEY, F.round("anchor_x", 6).alias("x"), F.round("anchor_y", 4).alias("y"), F.round("slope", 4).alias("slope"))


def decimate(spark, sf_dir):
    return s.decimate(samples(spark, sf_dir), 20).select(KEY, "idx", *_r("t_s", "p"))


def axis_limits(spark, sf_dir):
    return s.axis_limits(_diag(spark, sf_dir), "dPdG").select(KEY, *[F.round(c, 3).alias(c) for c in ("p05", "p95", "y_min", "y_max")])


def span_to_seconds(spark, sf_dir):
    rows = _resampled(spark, sf_dir).where("dt > 0").groupBy(KEY).agg((1 / F.sqrt(F.max("dt"))).alias("a"), (1 / F.sqrt(F.min("dt"))).alias("b"))
    span = fx.span_seconds(F.col("a"), F.col("b"), -0.5)
    return rows.select(KEY, F.round(span["lo"], 3).alias("lo"), F.round(span["hi"], 3).alias("hi"))


def _scenarios(spark, sf_dir, refresh: bool):
    diag = staged(_diag(spark, sf_dir).select(KEY, "i", "G", "dPdG", "d2PdG2"), "scenario-diag")
    scenario = F.element_at(F.array(*map(F.lit, ("", "C-A: clear", "C-B: adequate", "C-C", "C-D"))), (F.col(KEY) % 5 + 1).cast("int"))
    picks = diag.select(KEY).distinct().select(KEY, scenario.alias("closure_scenario"), F.when(F.col(KEY) % 2 == 1, 2.0 + F.col(KEY) % 7).alias("min_dpdg_G"), F.lit(99.0).alias("contact_G"))
    return scenario_contacts(diag, picks, refresh).select(KEY, F.round("min_dpdg_G", 6).alias("min_gt"), F.round("contact_G", 6).alias("contact_gt"), "hint")


def scenario_contact(spark, sf_dir):
    return _scenarios(spark, sf_dir, False)


def scenario_reset(spark, sf_dir):
    return _scenarios(spark, sf_dir, True)


QUERIES = {f.__name__: f for f in (scenario_contact, scenario_reset, elapsed_seconds, reverse_detect, monotonic_prefix, resample_increment, resample_guarded, g_time_a1, g_time_a05, g_diagnostics, loglog_deriv, rolling_mean_same, injection_window, main_cycle, max_sustained_rate, injected_volume, local_slope, min_dpdg, contact_clear, contact_inflection, contact_inflection_seeded, closure_departure, loglog_slope, pore_pressure, seed_windows, interp_at, nearest_tangent, decimate, axis_limits, span_to_seconds)}

_FINAL = {
    "elapsed_seconds": "SELECT test_id, idx, round(t_s, 6) AS t_s FROM samples",
    "reverse_detect": "SELECT test_id, idx, round(t_s, 6) AS t_s, test_id % 2 = 1 AND count(*) OVER (PARTITION BY test_id) > 1 AS reversed FROM samples",
    "monotonic_prefix": """, z AS (SELECT test_id, idx, CASE WHEN event_type = 'error' THEN 0.0 ELSE t_s END AS t FROM samples),
y AS (SELECT *, lag(t) OVER (PARTITION BY test_id ORDER BY idx) AS t0 FROM z), c AS (SELECT test_id, min(idx) AS cut FROM y WHERE t < t0 GROUP BY test_id)
SELECT z.test_id, z.idx, round(z.t, 6) AS t_s FROM z LEFT JOIN c USING (test_id) WHERE cut IS NULL OR z.idx < cut""",
    "resample_increment": "SELECT rs.test_id, i, round(dt, 6) AS dt, round(p, 6) AS p, n_raw FROM rs JOIN (SELECT test_id, count(*) AS n_raw FROM samples GROUP BY test_id) USING (test_id)",
    "resample_guarded": """, wk AS (
  SELECT test_id, idx, t_s AS dt, noisy AS p, noisy AS last, noisy AS low, TRUE AS keep FROM samples WHERE idx = 0
  UNION ALL
  SELECT n.test_id, n.idx, n.t_s, n.noisy, CASE WHEN n.noisy <= w.last - 50.0 THEN n.noisy ELSE w.last END, least(w.low, n.noisy), n.noisy <= w.last - 50.0
  FROM wk w JOIN samples n ON n.test_id = w.test_id AND n.idx = w.idx + 1 WHERE n.noisy <= w.low + 150.0),
k AS (SELECT test_id, idx, dt, p, row_number() OVER (PARTITION BY test_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY test_id) AS kept FROM wk WHERE keep),
e AS (SELECT test_id, max(idx) AS reached FROM wk GROUP BY test_id), f AS (SELECT test_id, max(idx) AS final FROM samples GROUP BY test_id)
SELECT k.test_id, i::INTEGER AS i, round(dt, 6) AS dt, round(p, 6) AS p, CASE WHEN reached < final THEN kept END AS guarded_at FROM k JOIN e USING (test_id) JOIN f USING (test_id)""",
    "g_time_a1": f"SELECT test_id, idx, round(4 / pi() * (4.0 / 3 * (pow(1 + t_s / {TE}, 1.5) - pow(t_s / {TE}, 1.5)) - 4.0 / 3), 6) AS g FROM samples",
    "g_time_a05": f"SELECT test_id, idx, round(4 / pi() * ((1 + t_s / {TE}) * asin(pow(1 + t_s / {TE}, -0.5)) + sqrt(t_s / {TE}) - pi() / 2), 6) AS g FROM samples",
    "g_diagnostics": "SELECT test_id, i, round(gg, 6) AS gt, round(y, 4) AS dpdg, round(gy, 4) AS gdpdg, round(d2, 3) AS d2 FROM diag",
    "loglog_deriv": "SELECT test_id, j, round(t, 6) AS t, round(dp, 6) AS dp, round(tdpdt, 4) AS tdpdt FROM ldiag",
    "rolling_mean_same": "SELECT test_id, idx, round(sum(rate) OVER (PARTITION BY test_id ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15.0, 6) AS mean FROM samples",
    "injection_window": "SELECT test_id, min(idx) FILTER (WHERE rate > 0.1) AS start_idx, least(max(idx) FILTER (WHERE rate > 0.1) + 1, max(idx)) AS shutin_idx FROM samples GROUP BY test_id HAVING count(*) FILTER (WHERE rate > 0.1) > 0",
    "main_cycle": "SELECT * FROM win",
    "max_sustained_rate": "SELECT test_id, round(qmax, 6) AS qmax FROM qm",
    "injected_volume": "SELECT test_id, round(delta, 6) AS vinj_delta, round(integral, 6) AS vinj_integral, round(delta, 6) AS vinj, round(abs(delta - integral) / nullif(delta, 0), 6) AS vinj_disagreement, 'volume_channel' AS vinj_source FROM vin",
    "local_slope": "SELECT test_id, i, round(1000 * coalesce(regr_slope(p, dt) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 0), 6) AS slope FROM rs",
    "min_dpdg": "SELECT test_id, min_i, round(min_gg, 6) AS min_gt, round(min_y, 4) AS min_y FROM least_",
    "contact_clear": "SELECT d.test_id, min(i) AS contact_i, round(arg_min(gg, i), 6) AS contact_gt FROM diag d JOIN least_ USING (test_id) WHERE i > min_i AND y >= min_y * 1.1 GROUP BY d.test_id",
    "contact_inflection": """, pk AS (SELECT *, lag(d2) OVER w AS a, lead(d2) OVER w AS b FROM flags WINDOW w AS (PARTITION BY test_id ORDER BY i))
SELECT test_id, i AS contact_i, round(gg, 6) AS contact_gt FROM pk WHERE d2 > a AND d2 >= b AND (late = 0 OR gg >= 1) QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY d2 DESC, i) = 1""",
    "contact_inflection_seeded": """, pk AS (SELECT *, lag(d2) OVER w AS a, lead(d2) OVER w AS b FROM flags WINDOW w AS (PARTITION BY test_id ORDER BY i))
SELECT pk.test_id, i AS contact_i, round(gg, 6) AS contact_gt FROM pk JOIN least_ l USING (test_id) WHERE d2 > a AND d2 >= b AND (late = 0 OR gg >= 1) QUALIFY row_number() OVER (PARTITION BY pk.test_id ORDER BY abs(gg - min_gg), i) = 1""",
    "closure_departure": """, e AS (SELECT *, greatest(1, floor(n / 20)) AS lo, greatest(2, floor(n / 3)) AS hi FROM diag),
m AS (SELECT test_id, CASE WHEN count(*) >= 2 THEN sum(gg * gy) / nullif(sum(gg * gg), 0) END AS slope FROM e WHERE i >= lo AND i < hi AND gg > 0 AND gy IS NOT NULL GROUP BY test_id),
q AS (SELECT e.test_id, min(i) AS qi, arg_min(gg, i) AS qg FROM e JOIN m USING (test_id) WHERE i >= hi AND slope * gg > 0 AND abs(gy - slope * gg) > 0.1 * slope * gg GROUP BY e.test_id),
z AS (SELECT test_id, max(i) AS zi, arg_max(gg, i) AS zg FROM diag GROUP BY test_id)
SELECT z.test_id, round(slope, 4) AS slope, coalesce(qi, zi)::BIGINT AS closure_i, round(coalesce(qg, zg), 6) AS closure_gt FROM z LEFT JOIN m USING (test_id) LEFT JOIN q USING (test_id)""",
    "seed_windows": """, c AS (SELECT test_id, count(*) AS n FROM ldiag GROUP BY test_id HAVING count(*) > 6)
SELECT c.test_id, round(max(CASE WHEN j = floor(n * 0.6) THEN t END), 6) AS loglog_lo, round(max(t), 6) AS loglog_hi, round(least(max(t) / 10, max(CASE WHEN j = n - 2 THEN t END)), 6) AS pp_lo FROM c JOIN ldiag USING (test_id) GROUP BY c.test_id""",
    "interp_at": """, a AS (SELECT *, test_id % 14 + 0.5 AS at_, lead(gg) OVER w AS g1, lead(p) OVER w AS p1, lead(dt) OVER w AS t1 FROM diag WINDOW w AS (PARTITION BY test_id ORDER BY i))
SELECT test_id, round(CASE WHEN max(at_) >= max(gg) THEN arg_max(p, gg) WHEN max(at_) < min(gg) THEN arg_min(p, gg) ELSE max(CASE WHEN at_ >= gg AND at_ < g1 THEN p + (at_ - gg) * (p1 - p) / (g1 - gg) END) END, 4) AS p,
round(CASE WHEN max(at_) >= max(gg) THEN arg_max(dt, gg) WHEN max(at_) < min(gg) THEN arg_min(dt, gg) ELSE max(CASE WHEN at_ >= gg AND at_ < g1 THEN dt + (at_ - gg) * (t1 - dt) / (g1 - gg) END) END, 3) AS dt FROM a GROUP BY test_id""",
    "nearest_tangent": """, a AS (SELECT *, test_id % 14 + 0.5 AS at_, coalesce(regr_slope(p, gg) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 0) AS slope FROM diag)
SELECT test_id, round(gg, 6) AS x, round(p, 4) AS y, round(slope, 4) AS slope FROM a QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY abs(gg - at_), i) = 1""",
    "decimate": "SELECT test_id, idx, round(t_s, 6) AS t_s, round(p, 6) AS p FROM (SELECT *, ceil(count(*) OVER (PARTITION BY test_id) / 20.0)::BIGINT AS k FROM samples) WHERE idx % k = 0",
    "axis_limits": "SELECT test_id, round(quantile_cont(y, 0.05), 3) AS p05, round(quantile_cont(y, 0.95), 3) AS p95, round(min(y), 3) AS y_min, round(max(y), 3) AS y_max FROM diag WHERE y IS NOT NULL GROUP BY test_id",
    "span_to_seconds": "SELECT test_id, round(min(dt), 3) AS lo, round(max(dt), 3) AS hi FROM rs WHERE dt > 0 GROUP BY test_id",
}
_SCENARIO = """, pk AS (SELECT DISTINCT test_id, n, test_id % 5 AS scen, CASE WHEN test_id % 2 = 1 THEN 2.0 + test_id % 7 END AS given FROM diag),
mm AS (SELECT pk.*, CASE WHEN n >= 3 AND scen = 1 THEN coalesce({first}given, min_gg) WHEN n >= 3 AND scen = 2 THEN coalesce(given, min_gg) ELSE given END AS ming FROM pk LEFT JOIN least_ USING (test_id)),
nr AS (SELECT d.test_id, i AS mi, y AS my FROM diag d JOIN mm USING (test_id) WHERE scen = 1 AND d.n >= 3 QUALIFY row_number() OVER (PARTITION BY d.test_id ORDER BY round(abs(gg - ming), 9), i) = 1),
ca AS (SELECT d.test_id, arg_min(gg, i) AS c FROM diag d JOIN nr USING (test_id) WHERE i > mi AND y >= my * 1.1 GROUP BY d.test_id),
px AS (SELECT *, lag(d2) OVER w AS a, lead(d2) OVER w AS b FROM flags WINDOW w AS (PARTITION BY test_id ORDER BY i)),
cb AS (SELECT px.test_id, gg AS c FROM px JOIN mm USING (test_id) WHERE scen = 2 AND mm.n >= 3 AND d2 > a AND d2 >= b AND (late = 0 OR gg >= 1) QUALIFY row_number() OVER (PARTITION BY px.test_id ORDER BY abs(gg - ming), i) = 1)
SELECT mm.test_id, round(ming, 6) AS min_gt, CASE WHEN scen >= 3 THEN NULL ELSE round(coalesce(ca.c, cb.c, 99.0), 6) END AS contact_gt,
  CASE WHEN n >= 3 AND scen = 1 AND ca.c IS NULL THEN 'no rise after the minimum' WHEN n >= 3 AND scen = 2 AND cb.c IS NULL THEN 'no inflection' END AS hint
FROM mm LEFT JOIN ca USING (test_id) LEFT JOIN cb USING (test_id)"""
_FINAL["scenario_contact"] = _SCENARIO.replace("{first}", "")
_FINAL["scenario_reset"] = _SCENARIO.replace("{first}", "min_gg, ")
_SPANS = ", c AS (SELECT test_id, count(*) AS n FROM ldiag GROUP BY test_id HAVING count(*) > 6), sp AS (SELECT c.test_id, max(CASE WHEN j = floor(n * 0.6) THEN t END) AS lo, max(t) AS hi FROM c JOIN ldiag USING (test_id) GROUP BY c.test_id)\n"
_FINAL["loglog_slope"] = _SPANS + "SELECT l.test_id, round(CASE WHEN count(*) >= 2 THEN regr_slope(log10(dp), log10(t)) END, 6) AS slope FROM ldiag l JOIN sp USING (test_id) WHERE t >= lo AND t < hi AND dp > 0 GROUP BY l.test_id"
_FINAL["pore_pressure"] = _SPANS + "SELECT l.test_id, round(CASE WHEN count(*) >= 2 THEN regr_intercept(p, pow(t, -0.5)) END, 4) AS pore_pressure FROM ldiag l JOIN sp USING (test_id) WHERE t >= lo AND t <= hi GROUP BY l.test_id"

ORACLE_SQL = {name: PRELUDE + sql for name, sql in _FINAL.items()}
