"""Deterministic views of the driver's tables as falloff records, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parameters that suit the views: pressure drop between kept rows, pump time in seconds.
STEP, TE = 200.0, 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a test: pressure falls from 20,000.00 by each value, clicks and views pump.

    Sums are of integer cents, so they don't depend on the order of addition. noisy rises again at errors.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    on = F.col("event_type").isin("click", "view")
    out = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value").withColumn("cents", cents)
    out = out.withColumn("t0", F.first("ts").over(w)).withColumn("idx", F.row_number().over(w) - 1)
    fall = F.sum("cents").over(w.rowsBetween(Window.unboundedPreceding, 0))
    pumped = F.sum(F.when(on, F.col("cents")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    noise = F.when(F.col("event_type") == "error", F.col("cents") * 3).otherwise(0)
    return out.select(
        F.col("user_id").alias("test_id"), "idx", "ts", "event_type", (F.expr("timestampdiff(MICROSECOND, t0, ts)") / 1e6).alias("t_s"),
        ((2000000 - fall) / 100.0).alias("p"), ((2000000 - fall + noise) / 100.0).alias("noisy"),
        F.when(on, F.col("value")).otherwise(0.0).alias("rate"), (pumped / 100.0).alias("volume"),
    )


#: The views and the chain of operators on them, for the SQL side.
_PUMPING = """
WITH RECURSIVE ev AS (
  SELECT user_id AS test_id, ts, event_id, event_type, value, round(value * 100)::BIGINT AS cents,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         first_value(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0
  FROM events),
samples AS (
  SELECT test_id, idx::INTEGER AS idx, ts, event_type, date_diff('microsecond', t0, ts) / 1e6 AS t_s,
         (2000000 - sum(cents) OVER w) / 100.0::DOUBLE AS p,
         (2000000 - sum(cents) OVER w + CASE WHEN event_type = 'error' THEN cents * 3 ELSE 0 END) / 100.0::DOUBLE AS noisy,
         CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0.0 END AS rate,
         sum(CASE WHEN event_type IN ('click', 'view') THEN cents ELSE 0 END) OVER w / 100.0::DOUBLE AS volume
  FROM ev WINDOW w AS (PARTITION BY test_id ORDER BY idx)),
onoff AS (SELECT *, CASE WHEN rate > 0.1 AND coalesce(lag(rate) OVER w, 0) <= 0.1 THEN 1 ELSE 0 END AS fresh, lead(idx) OVER w AS nidx, lead(volume) OVER w AS nv FROM samples WINDOW w AS (PARTITION BY test_id ORDER BY idx)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY test_id ORDER BY idx) AS k FROM onoff),
cyc AS (
  SELECT test_id, k, min(idx) AS start_idx, arg_min(volume, idx) AS v0, arg_max(coalesce(nidx, idx), idx) AS shutin_idx, arg_max(coalesce(nv, volume), idx) AS v1
  FROM isl WHERE rate > 0.1 GROUP BY test_id, k),
win AS (SELECT test_id, start_idx, shutin_idx FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY v1 - v0 DESC, start_idx) AS r FROM cyc) WHERE r = 1),
seg AS (
  SELECT s.*, w.start_idx, w.shutin_idx, count(*) OVER (PARTITION BY s.test_id) AS m, row_number() OVER (PARTITION BY s.test_id ORDER BY idx) - 1 AS o
  FROM samples s JOIN win w USING (test_id) WHERE idx >= start_idx AND idx < shutin_idx),
means AS (
  SELECT a.test_id, a.o, sum(b.rate) / least(15, max(a.m)) AS mean
  FROM seg a JOIN seg b ON a.test_id = b.test_id AND b.o BETWEEN a.o - floor(least(15, a.m) / 2) AND a.o + floor((least(15, a.m) - 1) / 2) GROUP BY a.test_id, a.o),
qm AS (SELECT test_id, max(mean) AS qmax FROM means GROUP BY test_id),
vin AS (
  SELECT w.test_id, b.volume - a.volume AS delta,
         (SELECT coalesce(sum((x.rate + z.rate) / 2 * (z.t_s - x.t_s) / 60), 0) FROM seg x JOIN seg z ON x.test_id = z.test_id AND z.o = x.o + 1 WHERE x.test_id = w.test_id) AS integral,
         b.t_s AS t_shutin
  FROM win w JOIN samples a ON a.test_id = w.test_id AND a.idx = w.start_idx JOIN samples b ON b.test_id = w.test_id AND b.idx = w.shutin_idx),
pump AS (SELECT v.*, q.qmax, CASE WHEN q.qmax > 0 AND v.delta / q.qmax > 0 THEN v.delta / q.qmax * 60 END AS te FROM vin v JOIN qm q USING (test_id))
"""

_CHAIN = """,
walk AS (
  SELECT test_id, k, dt, p, te, p AS last, p AS low, TRUE AS keep FROM src WHERE k = 0
  UNION ALL
  SELECT n.test_id, n.k, n.dt, n.p, n.te, CASE WHEN n.p <= w.last - {STEP} THEN n.p ELSE w.last END, least(w.low, n.p), n.p <= w.last - {STEP}
  FROM walk w JOIN src n ON n.test_id = w.test_id AND n.k = w.k + 1 WHERE n.p <= w.low + {STEP}),
rs AS (SELECT test_id, (row_number() OVER (PARTITION BY test_id ORDER BY k) - 1)::INTEGER AS i, dt, p, te FROM walk WHERE keep QUALIFY count(*) OVER (PARTITION BY test_id) >= {rows}),
gt AS (SELECT *, 4 / pi() * (4.0 / 3 * (pow(1 + dt / te, 1.5) - pow(dt / te, 1.5)) - 4.0 / 3) AS gg FROM rs),
n1 AS (
  SELECT *, lag(p) OVER w AS p0, lead(p) OVER w AS p1, gg - (lag(gg) OVER w) AS hs, (lead(gg) OVER w) - gg AS hd
  FROM gt WINDOW w AS (PARTITION BY test_id ORDER BY i)),
d1 AS (
  SELECT test_id, i, dt, p, gg, hs, hd,
         -(CASE WHEN hs IS NULL THEN (p1 - p) / nullif(hd, 0) WHEN hd IS NULL THEN (p - p0) / nullif(hs, 0)
           ELSE (hs * hs * p1 + (hd * hd - hs * hs) * p - hd * hd * p0) / nullif(hs * hd * (hs + hd), 0) END) AS y
  FROM n1),
n2 AS (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1, count(*) OVER (PARTITION BY test_id) AS n FROM d1 WINDOW w AS (PARTITION BY test_id ORDER BY i)),
diag AS (
  SELECT test_id, i, dt, p, gg, y, gg * y AS gy, n, y0, y1,
         CASE WHEN hs IS NULL THEN (y1 - y) / nullif(hd, 0) WHEN hd IS NULL THEN (y - y0) / nullif(hs, 0)
              ELSE (hs * hs * y1 + (hd * hd - hs * hs) * y - hd * hd * y0) / nullif(hs * hd * (hs + hd), 0) END AS d2
  FROM n2),
lpos AS (SELECT test_id, dt AS t, p, (row_number() OVER (PARTITION BY test_id ORDER BY i) - 1)::INTEGER AS j FROM rs WHERE dt > 0),
l1 AS (
  SELECT *, lag(p) OVER w AS p0, lead(p) OVER w AS p1, t - (lag(t) OVER w) AS hs, (lead(t) OVER w) - t AS hd, first_value(p) OVER w AS pf
  FROM lpos WINDOW w AS (PARTITION BY test_id ORDER BY j)),
ldiag AS (
  SELECT test_id, j, t, p, pf - p AS dp,
         -t * (CASE WHEN hs IS NULL THEN (p1 - p) / nullif(hd, 0) WHEN hd IS NULL THEN (p - p0) / nullif(hs, 0)
           ELSE (hs * hs * p1 + (hd * hd - hs * hs) * p - hd * hd * p0) / nullif(hs * hd * (hs + hd), 0) END) AS tdpdt
  FROM l1),
flags AS (
  SELECT *, max(CASE WHEN gg >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY test_id) AS late FROM diag),
dips AS (
  SELECT *, y IS NOT NULL AND (late = 0 OR gg >= 1) AS ok, coalesce(y IS NOT NULL AND (late = 0 OR gg >= 1) AND y < y0 AND y <= y1, FALSE) AS dip FROM flags),
least_ AS (
  SELECT test_id, min_i, min_gg, min_y FROM (
    SELECT test_id, i AS min_i, gg AS min_gg, y AS min_y, row_number() OVER (PARTITION BY test_id ORDER BY dip DESC, y, i) AS r FROM dips WHERE ok) WHERE r = 1)
"""


def _prelude(source: str, rows: int) -> str:
    return _PUMPING + ",\nsrc AS (" + source + ")" + _CHAIN.replace("{STEP}", str(STEP)).replace("{rows}", str(rows))


#: The whole record resampled, with one pump time for all tests.
PRELUDE = _prelude(f"SELECT test_id, idx AS k, t_s AS dt, p, {TE}::DOUBLE AS te FROM samples", 1)
#: What follows shut-in resampled, with each test's own pump time.
PUMPED = _prelude(
    """SELECT s.test_id, row_number() OVER (PARTITION BY s.test_id ORDER BY idx) - 1 AS k, s.t_s - t_shutin AS dt, p, te
  FROM samples s JOIN pump USING (test_id) WHERE te IS NOT NULL AND s.t_s >= t_shutin""",
    3,
)
