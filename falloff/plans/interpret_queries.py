"""Queries of whole interpretations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.functions import formulas as fx
from falloff.operators import log
from falloff.operators import series as s
from falloff.plans import interpret as plan
from falloff.plans.views import PUMPED, STEP, samples, table

KEY = s.KEY

_ROUNDED = {
    "t_shutin": 3, "qmax": 4, "vinj": 4, "te": 3, "apparent_isip": 3, "contact_G": 4, "closure_G": 4, "pressure_compliance": 2, "eff_isip_compliance": 2, "shmin_compliance": 2,
    "closure_time_compliance": 1, "shmin_tangent": 2, "eff_isip_tangent": 2, "closure_time_tangent": 1, "shmin_variable": 3, "eff_isip_variable": 2,
    "net_pressure_compliance": 2, "net_pressure_tangent": 2, "complexity": 2, "delta_closure": 2, "pore_pressure": 2,
}
_PLAIN = ["test_id", "n_resampled", "net_pressure_source"]


def interpret_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.interpret_all(samples(spark, sf_dir), step=STEP)
    return out.select("test_id", F.col("n_resampled").cast("long").alias("n_resampled"), "net_pressure_source", *[F.round(c, n).alias(c) for c, n in _ROUNDED.items()])


def auto_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.auto_picks(samples(spark, sf_dir), step=STEP)
    return out.select("test_id", "start_idx", "shutin_idx", F.round("isip_x", 3).alias("isip_x"), F.round("isip_y", 3).alias("isip_y"), F.round(F.col("isip_slope") * 1000, 4).alias("isip_slope"), F.round("contact_G", 4).alias("contact_gt"), F.round("min_dpdg_G", 4).alias("min_gt"), F.round("closure_G", 4).alias("closure_gt"), F.round("pp_lo", 3).alias("pp_lo"), F.round("pp_hi", 3).alias("pp_hi"))


def complexity_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shmin + net pressure + complexity is the apparent ISIP, by every method."""
    out = plan.interpret_all(samples(spark, sf_dir), step=STEP).where(F.col("complexity").isNotNull())
    gap = lambda m: F.round(F.col(f"shmin_{m}") + F.col(f"net_pressure_{m}") + F.col("complexity") - F.col("apparent_isip"), 6) + 0.0
    return out.groupBy().agg(F.count("*").alias("tests"), F.max(F.abs(gap("compliance"))).alias("compliance"), F.max(F.abs(gap("tangent"))).alias("tangent"))


def hydrostatic_bhp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand in for gauges: retail price as pressure, size as mud weight and depth."""
    parts = table(spark, sf_dir, "part")
    ppg, tvd = F.when(F.col("p_size") % 7 != 0, 8.0 + F.col("p_size") / 10), F.col("p_size") * 200.0
    return parts.select("p_partkey", F.round(fx.hydrostatic_head(ppg, tvd), 6).alias("head"), F.round(fx.bottomhole_pressure(F.col("p_retailprice"), F.col("p_size") % 2 == 0, ppg, tvd), 6).alias("bhp"))


def pump_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    te = fx.effective_pump_time(F.col("l_extendedprice") - 1000, F.col("l_quantity") - 5)
    return lines.select("l_orderkey", "l_linenumber", F.round(te, 6).alias("te"))


def shmin_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities stand in for closure scenarios, prices for pressures; some picks are missing."""
    orders = table(spark, sf_dir, "orders")
    scenario = F.element_at(F.array(*[F.lit(x) for x in ("C-A: clear", "C-B: adequate", "C-C: none", "C-D: rapid", "")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    apparent = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    contact = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 0.9)
    compliance, tangent = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 0.95), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_totalprice") * 0.93)
    ref = fx.reference_isip(compliance, tangent)
    return orders.select(
        "o_orderkey", log.by_prefix(scenario, log.CLOSURE_QUALITY).alias("quality"), F.round(fx.shmin_compliance(contact), 4).alias("shmin_compliance"), F.round(fx.shmin_rapid(scenario, apparent), 4).alias("shmin_rapid"),
        fx.reference_source(compliance, tangent).alias("source"), F.round(ref - fx.shmin_compliance(contact), 4).alias("net"), F.round(apparent - ref, 4).alias("complexity"),
        fx.rapid_text(fx.shmin_rapid(scenario, apparent)).alias("rapid_text"),
    )


def postclosure_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    scenario = F.concat(F.lit("PC-"), F.substring(F.lit("ABCDEF"), (F.col("o_orderkey") % 6 + 1).cast("int"), F.lit(1)), F.lit(": text"))
    return orders.select("o_orderkey", fx.postclosure_axis(scenario).alias("axis"), F.round(F.pow(F.lit(4.0), fx.axis_exponent(fx.postclosure_axis(scenario))), 6).alias("x"))


def numeric_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    typed = F.when(F.col("c_custkey") % 4 == 0, " ").when(F.col("c_custkey") % 4 == 1, F.col("c_name")).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".5 ")))
    return cust.select("c_custkey", fx.numeric_entry(typed, F.col("c_acctbal")).alias("value"))


QUERIES = {f.__name__: f for f in (interpret_all, auto_picks, complexity_identity, hydrostatic_bhp, pump_time, shmin_methods, postclosure_axis, numeric_entry)}

_PICKED = (
    PUMPED
    + """, isl_ AS (
  SELECT s.test_id, s.t_s, s.p, s.idx, coalesce(regr_slope(s.p, s.t_s) OVER (PARTITION BY s.test_id ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING), 0) AS slope FROM samples s),
isip AS (
  SELECT i.test_id, i.t_s AS isip_x, i.p AS isip_y, i.slope AS isip_slope FROM isl_ i JOIN pump USING (test_id)
  QUALIFY row_number() OVER (PARTITION BY i.test_id ORDER BY round(abs(i.t_s - (t_shutin + 60)), 9), idx) = 1),
hump AS (SELECT test_id, gg AS contact FROM diag WHERE n > 5 AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY y DESC, i) = 1),
low AS (SELECT l.* FROM least_ l JOIN (SELECT DISTINCT test_id FROM diag WHERE n > 5) USING (test_id)),
e AS (SELECT *, greatest(1, floor(n / 20)) AS lo, greatest(2, floor(n / 3)) AS hi FROM diag),
m AS (SELECT test_id, sum(gg * gy) / nullif(sum(gg * gg), 0) AS slope FROM e WHERE i >= lo AND i < hi AND gg > 0 AND gy IS NOT NULL GROUP BY test_id HAVING count(*) >= 2),
q AS (SELECT e.test_id, arg_min(gg, i) AS qg FROM e JOIN m USING (test_id) WHERE i >= hi AND slope * gg > 0 AND abs(gy - slope * gg) > 0.1 * slope * gg GROUP BY e.test_id),
z AS (SELECT test_id, arg_max(gg, i) AS zg FROM diag GROUP BY test_id),
closing AS (SELECT m.test_id, coalesce(qg, zg) AS closure FROM m JOIN z USING (test_id) LEFT JOIN q USING (test_id) WHERE slope IS NOT NULL),
c6 AS (SELECT test_id, count(*) AS n FROM ldiag GROUP BY test_id HAVING count(*) > 6),
sp AS (SELECT c6.test_id, max(CASE WHEN j = floor(n * 0.6) THEN t END) AS lo, max(t) AS hi FROM c6 JOIN ldiag USING (test_id) GROUP BY c6.test_id)
"""
)
_METHOD = """, {m}_at AS (SELECT * FROM ({at}) WHERE a IS NOT NULL),
{m}_c AS (SELECT d.*, a, lead(gg) OVER w AS g1, lead(p) OVER w AS p1, lead(dt) OVER w AS t1, coalesce(regr_slope(p, gg) OVER (PARTITION BY d.test_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 0) AS sl
  FROM diag d JOIN {m}_at USING (test_id) WINDOW w AS (PARTITION BY d.test_id ORDER BY i)),
{m}_i AS (SELECT test_id, CASE WHEN max(a) >= max(gg) THEN arg_max(p, gg) WHEN max(a) < min(gg) THEN arg_min(p, gg) ELSE max(CASE WHEN a >= gg AND a < g1 THEN p + (a - gg) * (p1 - p) / (g1 - gg) END) END AS pr,
  CASE WHEN max(a) >= max(gg) THEN arg_max(dt, gg) WHEN max(a) < min(gg) THEN arg_min(dt, gg) ELSE max(CASE WHEN a >= gg AND a < g1 THEN dt + (a - gg) * (t1 - dt) / (g1 - gg) END) END AS ti FROM {m}_c GROUP BY test_id),
{m}_e AS (SELECT test_id, p + sl * (0 - gg) AS eff FROM {m}_c QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY round(abs(gg - a), 9), i) = 1)
"""
_ALL = (
    _PICKED
    + _METHOD.format(m="co", at="SELECT test_id, contact AS a FROM hump")
    + _METHOD.format(m="ta", at="SELECT test_id, closure AS a FROM closing")
    + _METHOD.format(m="va", at="SELECT test_id, (contact + closure) / 2 AS a FROM hump JOIN closing USING (test_id)")
    + """, pp AS (SELECT l.test_id, CASE WHEN count(*) >= 2 THEN regr_intercept(p, pow(t, -0.5)) END AS pore FROM ldiag l JOIN sp USING (test_id) WHERE t >= lo AND t <= hi GROUP BY l.test_id),
kept AS (SELECT test_id, count(*) AS n_resampled FROM rs GROUP BY test_id),
res AS (
  SELECT w.test_id, n_resampled, t_shutin, qmax, delta AS vinj, te, isip_y + isip_slope * (t_shutin - isip_x) AS apparent, contact, closure,
         co_i.pr AS cp, co_e.eff AS ce, co_i.ti AS ct, ta_i.pr AS tp, ta_e.eff AS te_, ta_i.ti AS tt, va_i.pr AS vp, va_e.eff AS ve, coalesce(co_e.eff, ta_e.eff) AS ref, pore
  FROM win w LEFT JOIN pump USING (test_id) LEFT JOIN isip USING (test_id) LEFT JOIN hump USING (test_id) LEFT JOIN closing USING (test_id) LEFT JOIN kept USING (test_id)
  LEFT JOIN co_i USING (test_id) LEFT JOIN co_e USING (test_id) LEFT JOIN ta_i USING (test_id) LEFT JOIN ta_e USING (test_id) LEFT JOIN va_i USING (test_id) LEFT JOIN va_e USING (test_id) LEFT JOIN pp USING (test_id))
"""
)

ORACLE_SQL = {
    "interpret_all": _ALL
    + """SELECT test_id, n_resampled, CASE WHEN ce IS NOT NULL THEN 'compliance' WHEN te_ IS NOT NULL THEN 'tangent' ELSE '' END AS net_pressure_source,
  round(t_shutin, 3) AS t_shutin, round(qmax, 4) AS qmax, round(vinj, 4) AS vinj, round(te, 3) AS te, round(apparent, 3) AS apparent_isip, round(contact, 4) AS "contact_G", round(closure, 4) AS "closure_G",
  round(cp, 2) AS pressure_compliance, round(ce, 2) AS eff_isip_compliance, round(cp - 75, 2) AS shmin_compliance, round(ct, 1) AS closure_time_compliance, round(tp, 2) AS shmin_tangent,
  round(te_, 2) AS eff_isip_tangent, round(tt, 1) AS closure_time_tangent, round(vp, 3) AS shmin_variable, round(ve, 2) AS eff_isip_variable, round(ref - (cp - 75), 2) AS net_pressure_compliance,
  round(ref - tp, 2) AS net_pressure_tangent, round(apparent - ref, 2) AS complexity, round(cp - 75 - tp, 2) AS delta_closure, round(pore, 2) AS pore_pressure FROM res""",
    "auto_picks": _PICKED
    + """SELECT w.test_id, w.start_idx, w.shutin_idx, round(isip_x, 3) AS isip_x, round(isip_y, 3) AS isip_y, round(isip_slope * 1000, 4) AS isip_slope, round(contact, 4) AS contact_gt, round(min_gg, 4) AS min_gt,
  round(closure, 4) AS closure_gt, round(sp.lo, 3) AS pp_lo, round(sp.hi, 3) AS pp_hi
FROM win w LEFT JOIN isip USING (test_id) LEFT JOIN hump USING (test_id) LEFT JOIN low USING (test_id) LEFT JOIN closing USING (test_id) LEFT JOIN sp USING (test_id)""",
    "complexity_identity": _ALL + "SELECT count(*) AS tests, 0.0::DOUBLE AS compliance, 0.0::DOUBLE AS tangent FROM res WHERE apparent IS NOT NULL AND ref IS NOT NULL",
    "hydrostatic_bhp": """SELECT p_partkey, round(0.052 * (8.0 + p_size / 10) * (p_size * 200.0), 6)::DOUBLE AS head, round(CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_retailprice + 0.052 * (8.0 + p_size / 10) * (p_size * 200.0) END, 6)::DOUBLE AS bhp FROM part WHERE p_size % 7 <> 0
UNION ALL SELECT p_partkey, NULL, CASE WHEN p_size % 2 = 0 THEN round(p_retailprice, 6) END FROM part WHERE p_size % 7 = 0""",
    "pump_time": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity - 5 > 0 AND l_extendedprice - 1000 > 0 THEN (l_extendedprice - 1000) / (l_quantity - 5) * 60.0 END, 6) AS te FROM lineitem",
    "shmin_methods": """WITH a AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'C-A' WHEN 1 THEN 'C-B' WHEN 2 THEN 'C-C' WHEN 3 THEN 'C-D' ELSE '' END AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS ap,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * 0.9 END AS co, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * 0.95 END AS ce, CASE WHEN o_orderkey % 2 <> 0 THEN o_totalprice * 0.93 END AS te FROM orders)
SELECT o_orderkey, CASE s WHEN 'C-A' THEN 'clear' WHEN 'C-B' THEN 'adequate' WHEN 'C-C' THEN 'no-contact' WHEN 'C-D' THEN 'rapid' ELSE '' END AS quality, round(co - 75, 4) AS shmin_compliance, round(CASE WHEN s = 'C-D' THEN ap - 175 END, 4) AS shmin_rapid,
  CASE WHEN ce IS NOT NULL THEN 'compliance' WHEN te IS NOT NULL THEN 'tangent' ELSE '' END AS source, round(coalesce(ce, te) - (co - 75), 4) AS net, round(ap - coalesce(ce, te), 4) AS complexity,
  CASE WHEN s = 'C-D' AND ap IS NOT NULL THEN printf('%.0f', ap - 175) || ' ±75' END AS rapid_text FROM a""",
    "postclosure_axis": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 2, 4) THEN 'tm12' WHEN o_orderkey % 6 = 1 THEN 'tm1' END AS axis, CASE WHEN o_orderkey % 6 IN (0, 2, 4) THEN 0.5 ELSE 0.25 END::DOUBLE AS x FROM orders",
    "numeric_entry": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN c_acctbal ELSE c_custkey + 0.5 END::DOUBLE AS value FROM customer",
}
