"""Queries of figure data, and of the scans by chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.operators import series as s
from falloff.operators.segments import Segments
from falloff.plans import figures, series_queries
from falloff.plans.staging import staged
from falloff.plans.views import PUMPED, STEP, samples

KEY = s.KEY

#: Chunks of a few rows, so that every test of the views spans several.
CHUNKS = Segments(32)
MOST = 60


def _figures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Samples, picks and what is drawn from them; the postclosure scenario goes by the test's number."""
    rows = staged(samples(spark, sf_dir), "samples")
    scenario = F.element_at(F.array(*[F.lit(x) for x in ("PC-A: t", "PC-B: t", "PC-F: t", None)]), (F.col(KEY) % 4 + 1).cast("int"))
    picks = s.main_cycle(rows).withColumn("postclosure_scenario", scenario).withColumn("resample_step", F.lit(STEP))
    return rows, *figures.inputs(rows, picks, scans=CHUNKS)


def figure_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x of overview and isip in seconds here, so that both sides round whole microseconds."""
    out = figures.curves(*_figures(spark, sf_dir), most=MOST, scans=CHUNKS)
    seconds = F.when(F.col("step") == "overview", 3600).when(F.col("step") == "isip", 60).otherwise(1)
    return out.select(KEY, "step", "series", F.round(F.col("x") * seconds, 6).alias("x"), F.round("y", 3).alias("y"))


def figure_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = figures.axes(*_figures(spark, sf_dir), scans=CHUNKS)
    return out.select(KEY, "step", "axis", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def unphysical_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pore pressures over the seeded late window, on either axis by the test's number, against the least pressure there."""
    late = _figures(spark, sf_dir)[4]
    exponent = F.when(F.col(KEY) % 2 == 0, F.lit(-0.5)).otherwise(F.lit(-1.0))
    spans = s.seed_windows(late).select(KEY, F.col("pp_lo").alias("lo"), F.col("loglog_hi").alias("hi"), exponent.alias("exponent"))
    return figures.unphysical(late, spans).select(KEY, F.round("pore_pressure", 2).alias("pore_pressure"), F.round("least", 4).alias("least"), "unphysical")


def resample_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = CHUNKS.resample_increment(samples(spark, sf_dir).withColumn("dt", F.col("t_s")), STEP)
    return out.select(KEY, "i", F.round("dt", 6).alias("dt"), F.round("p", 6).alias("p"), F.col("n_raw").cast("long").alias("n_raw"))


def pumping_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main cycle, sustained rate and volume of every test, with stretches and frames that cross chunks."""
    rows = staged(samples(spark, sf_dir), "samples")
    window = staged(CHUNKS.main_cycle(rows), "window")
    out = window.join(CHUNKS.max_sustained_rate(rows, window), KEY).join(CHUNKS.injected_volume(rows, window), KEY)
    return out.select(KEY, "start_idx", "shutin_idx", F.round("qmax", 6).alias("qmax"), F.round("vinj_delta", 6).alias("vinj_delta"), F.round("vinj_integral", 6).alias("vinj_integral"))


QUERIES = {f.__name__: f for f in (figure_curves, figure_axes, unphysical_pressure, resample_by_chunks, pumping_by_chunks)}

_LATE = """
, scen AS (SELECT test_id, CASE test_id % 4 WHEN 1 THEN 'tm1' ELSE 'tm12' END AS axis FROM win WHERE test_id % 4 <> 2),
lastr AS (SELECT test_id, arg_max(t_s / 3600, idx) FILTER (WHERE rate > 0) + 0.25 AS e FROM samples GROUP BY test_id)
"""
ORACLE_SQL = {
    "figure_curves": PUMPED
    + _LATE
    + f""", ov AS (SELECT s.test_id, t_s / 3600 AS x, p, rate, row_number() OVER w - 1 AS o, count(*) OVER (PARTITION BY s.test_id) AS n
  FROM samples s JOIN lastr USING (test_id) WHERE e IS NULL OR t_s / 3600 <= e WINDOW w AS (PARTITION BY s.test_id ORDER BY idx)),
nr AS (SELECT s.test_id, (s.t_s - t_shutin) / 60 AS x, s.p, row_number() OVER w - 1 AS o, count(*) OVER (PARTITION BY s.test_id) AS n
  FROM samples s JOIN pump USING (test_id) WHERE (s.t_s - t_shutin) / 60 BETWEEN -5 AND 15 WINDOW w AS (PARTITION BY s.test_id ORDER BY idx)),
c AS (
  SELECT test_id, 'overview' AS step, 'pressure' AS series, x, p AS y FROM ov WHERE o % greatest(ceil(n / {MOST}.0), 1) = 0
  UNION ALL SELECT test_id, 'overview', 'rate', x, rate FROM ov WHERE o % greatest(ceil(n / {MOST}.0), 1) = 0
  UNION ALL SELECT test_id, 'isip', 'pressure', x, p FROM nr WHERE o % greatest(ceil(n / {MOST}.0), 1) = 0
  UNION ALL SELECT test_id, 'gfunction', 'pressure', gg, p FROM diag
  UNION ALL SELECT test_id, 'gfunction', 'dPdG', gg, y FROM diag
  UNION ALL SELECT test_id, 'gfunction', 'd2PdG2', gg, d2 FROM diag
  UNION ALL SELECT test_id, 'tangent', 'pressure', gg, p FROM diag
  UNION ALL SELECT test_id, 'tangent', 'GdPdG', gg, gy FROM diag
  UNION ALL SELECT test_id, 'loglog', 'dp', t, dp FROM ldiag WHERE dp > 0
  UNION ALL SELECT test_id, 'loglog', 'tdpdt', t, tdpdt FROM ldiag WHERE tdpdt > 0
  UNION ALL SELECT test_id, 'porepressure', 'pressure', pow(t, CASE axis WHEN 'tm12' THEN -0.5 ELSE -1 END), p FROM ldiag JOIN scen USING (test_id))
SELECT test_id, step, series, round(x * CASE step WHEN 'overview' THEN 3600 WHEN 'isip' THEN 60 ELSE 1 END, 6) AS x, round(y, 3) AS y FROM c WHERE x IS NOT NULL AND y IS NOT NULL""",
    "figure_axes": PUMPED
    + _LATE
    + """, az AS (SELECT w.test_id, a.t_s / 3600 AS a, z.t_s / 3600 AS z, greatest(z.t_s / 3600 - a.t_s / 3600, 0.25) AS span, e
  FROM win w JOIN lastr USING (test_id) JOIN samples a ON a.test_id = w.test_id AND a.idx = w.start_idx JOIN samples z ON z.test_id = w.test_id AND z.idx = w.shutin_idx),
q AS (SELECT test_id, min(p) AS p0, max(p) AS p1, quantile_cont(y, 0.95) AS d, quantile_cont(gy, 0.95) AS g,
  coalesce(quantile_cont(d2, 0.05) FILTER (WHERE gg >= 1), quantile_cont(d2, 0.05)) AS q0, coalesce(quantile_cont(d2, 0.95) FILTER (WHERE gg >= 1), quantile_cont(d2, 0.95)) AS q1 FROM diag GROUP BY test_id),
r AS (
  SELECT test_id, 'overview' AS step, 'x' AS axis, a - 0.5 * span AS lo, least(z + 2 * span, e) AS hi FROM az
  UNION ALL SELECT test_id, 'isip', 'x', -1, 3 FROM pump
  UNION ALL SELECT test_id, 'gfunction', 'y', p0 - 0.05 * greatest(p1 - p0, 1), p1 + 0.05 * greatest(p1 - p0, 1) FROM q
  UNION ALL SELECT test_id, 'gfunction', 'y2', 0, least(greatest(1.5 * d, 1), 50) FROM q WHERE d IS NOT NULL
  UNION ALL SELECT test_id, 'gfunction', 'y3', q0 - 0.1 * greatest(q1 - q0, 1e-9), q1 + 0.1 * greatest(q1 - q0, 1e-9) FROM q WHERE q1 IS NOT NULL
  UNION ALL SELECT test_id, 'tangent', 'y2', 0, greatest(1.5 * g, 1) FROM q WHERE g IS NOT NULL
  UNION ALL SELECT test_id, 'porepressure', 'x', 0, CASE axis WHEN 'tm12' THEN 0.05 ELSE 0.0025 END FROM scen WHERE test_id IN (SELECT test_id FROM ldiag))
SELECT test_id, step, axis, round(lo::DOUBLE, 4) AS lo, round(hi::DOUBLE, 4) AS hi FROM r""",
    "unphysical_pressure": PUMPED
    + """, c7 AS (SELECT test_id, count(*) AS n, max(t) AS hi FROM ldiag GROUP BY test_id HAVING count(*) > 6),
sp AS (SELECT c7.test_id, least(hi / 10, max(CASE WHEN j = n - 2 THEN t END)) AS lo, hi FROM c7 JOIN ldiag USING (test_id) GROUP BY c7.test_id, hi)
SELECT test_id, round(pp, 2) AS pore_pressure, round(least_p, 4) AS least, pp >= least_p AS unphysical FROM (
  SELECT l.test_id, regr_intercept(p, pow(t, CASE WHEN l.test_id % 2 = 0 THEN -0.5 ELSE -1 END)) AS pp, min(p) AS least_p FROM ldiag l JOIN sp USING (test_id) WHERE t >= lo AND t <= hi GROUP BY l.test_id HAVING count(*) >= 2)
WHERE pp IS NOT NULL""",
    "resample_by_chunks": series_queries.ORACLE_SQL["resample_increment"],
    "pumping_by_chunks": PUMPED + "SELECT w.test_id, start_idx, shutin_idx, round(qmax, 6) AS qmax, round(delta, 6) AS vinj_delta, round(integral, 6) AS vinj_integral FROM win w JOIN qm USING (test_id) JOIN vin USING (test_id)",
}
