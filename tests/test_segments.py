"""Scans by chunks against the windows of ``series``, row for row, with chunks of a few rows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from falloff.operators import series as s
from falloff.operators.segments import Segments
from falloff.plans import interpret, views

SF = "/root/testdata/sf0.001"


def record(spark):
    """Tests with gaps in idx, nulls, NaN, equal and falling times, a reversed one and one of a single row."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(12):
        p, v, idx, n = 5000.0, 0.0, 0, 1 if k == 0 else int(r.integers(2, 160))
        for j in range(n):
            idx += int(r.integers(1, 4)) if k % 3 else 1
            p -= float(r.normal(8, 20))
            rate = float(max(0.0, r.normal(0.3, 1.0))) if r.random() < 0.9 else None
            v += rate or 0.0
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=(n - j if k == 5 else j) * 10)
            bad = r.random()
            rows.append((None if k == 11 else k, idx, None if bad < 0.05 else at, float(j) if r.random() < 0.98 else float(j) - 5, None if bad < 0.03 else float("nan") if bad < 0.05 else p, rate, v))
    return spark.createDataFrame(rows, "test_id long, idx long, ts timestamp, t_s double, p double, rate double, volume double").withColumn("dt", F.col("t_s"))


def close(a, b):
    if a is None or b is None or isinstance(a, (str, bool)):
        return a == b
    if isinstance(a, float):
        return (np.isnan(a) and np.isnan(b)) or np.isclose(a, b, rtol=1e-9, atol=1e-9)
    return a == b


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    order = lambda row: [(v is not None, str(v)) for v in (row.asDict().get(c) for c in ("test_id", "idx", "i", "ts"))]
    a, b = sorted(left.select(right.columns).collect(), key=order), sorted(right.collect(), key=order)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(close(u, v) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("size", [7, 60])
def test_chunks_do_not_show(spark, size):
    rows, by = record(spark).cache(), Segments(size)
    for name in ("elapsed_seconds", "unreversed", "monotonic_prefix", "main_cycle", "injection_window"):
        same(getattr(by, name)(rows), getattr(s, name)(rows))
    for step, rise in ((30.0, None), (10.0, 80.0), (F.lit(None).cast("double"), 50.0)):
        same(by.resample_increment(rows, step, rise), s.resample_increment(rows, step, rise))
    window = s.main_cycle(rows).where(F.col("test_id").isNotNull()).cache()
    width = 5 if size == 7 else 15
    same(by.max_sustained_rate(rows, window, width=width), s.max_sustained_rate(rows, window, width=width))
    same(by.injected_volume(rows, window), s.injected_volume(rows, window))
    targets = window.select("test_id", F.lit(31.2).alias("at"))
    clean = rows.where(s.finite(F.col("p")))
    same(by.tangent_at(clean, targets, "t_s", "p", "at", 3, "idx"), s.tangent_at(clean, targets, "t_s", "p", "at", 3, "idx"))


def test_empty_records(spark):
    rows = record(spark).where("false")
    assert Segments(5).resample_increment(rows).isEmpty() and Segments(5).main_cycle(rows).isEmpty() and Segments(5).unreversed(rows).isEmpty()


def test_a_frame_wider_than_a_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        Segments(5).haloed(record(spark).withColumn("_pos", F.col("idx")), 7, 7)


def test_interpretation_by_chunks(spark):
    samples = views.samples(spark, SF)
    same(interpret.interpret_all(samples, step=views.STEP, scans=Segments(40)).select(interpret.RESULTS), interpret.interpret_all(samples, step=views.STEP).select(interpret.RESULTS))


def test_one_long_record_is_many_tasks(spark):
    """One test of a million samples: no window of the plan is partitioned by the test alone over samples, and the chunks spread."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("test_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("dt"), (F.lit(1e6) - F.col("id") * 0.5 + F.pmod(F.hash("id"), F.lit(7))).alias("p"))
    by = Segments(50_000)
    kept = by.resample_increment(rows, 1000.0)
    assert kept.agg(F.count("*"), F.max("n_raw")).first()[0:2] == s.resample_increment(rows, 1000.0).agg(F.count("*"), F.max("n_raw")).first()[0:2]
    assert by.cut(rows).groupBy("_chunk").count().agg(F.count("*"), F.max("count")).first()[0:2] == (20, 50_000)
