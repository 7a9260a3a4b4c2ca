"""The scans of ``series`` over records too long for one task: each record is cut in chunks by its order column.

A chunk is scanned by itself; what a scan needs of the chunks before it (a least value, a last value, a count) is one row a chunk,
accumulated over the few chunks of a test and joined back by (test_id, chunk). No window and no join has a whole record in one task,
so a record of many million samples takes as many tasks as it has chunks. Results are those of ``series`` row for row; sums of doubles
may differ in their last bits.

Order columns are numbers, not null. Rows are grouped by test_id as windows do: a null test_id is one test.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from falloff.operators import series as s
from falloff.plans.staging import staged

KEY = s.KEY
CHUNK = "_chunk"


def _within(order: str) -> WindowSpec:
    return Window.partitionBy(KEY, CHUNK).orderBy(order)


def _earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _join(rows: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what ``per`` has for their chunk, nulls of test_id equal."""
    per = per.withColumnRenamed(KEY, "_k").withColumnRenamed(CHUNK, "_c")
    return rows.join(per, rows[KEY].eqNullSafe(per["_k"]) & rows[CHUNK].eqNullSafe(per["_c"]), how).drop("_k", "_c")


def _fold(lows: DataFrame, order: str) -> DataFrame:
    """(test_id, i, dt, p): rows a step below the one kept last; lows fall, and pass in order with one batch in memory."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple | None = None  # test, last kept, how many
        for batch in batches:
            if not len(batch):
                continue
            codes = pd.factorize(batch[KEY], use_na_sentinel=False)[0]
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(batch)]
            take, numbers = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                key = batch[KEY].iloc[a]
                same = state is not None and (state[0] == key or (pd.isna(state[0]) and pd.isna(key)))
                p, step = batch["p"].to_numpy()[a:b], float(batch["_step"].iloc[a])
                last, n, at = (state[1], state[2], 0) if same else (None, 0, 0)
                while at < b - a:
                    if last is not None:
                        at += int(np.searchsorted(-p[at:], step - last)) if step == step else b - a
                        if at >= b - a:
                            break
                    take.append(a + at)
                    numbers.append(n)
                    last, n, at = p[at], n + 1, at + 1
                state = (key, last, n)
            out = batch.iloc[take][[KEY, "dt", "p"]]
            yield out.assign(i=np.array(numbers, dtype="int32"))[[KEY, "i", "dt", "p"]]

    kind = lows.schema[KEY].dataType.simpleString()
    ordered = lows.select(KEY, order, "dt", "p", "_step").repartition(KEY).sortWithinPartitions(KEY, order)
    return ordered.mapInPandas(kept, f"{KEY} {kind}, i int, dt double, p double")


@dataclass(frozen=True)
class Segments:
    """The operators of ``series`` on chunks of ``size`` order values; pass it to ``interpret`` as ``scans``."""

    size: int = 200_000

    def cut(self, rows: DataFrame, order: str = "idx") -> DataFrame:
        return rows.withColumn(CHUNK, F.floor(F.col(order) / self.size))

    def spread(self, rows: DataFrame, per_test: DataFrame, order: str = "idx") -> DataFrame:
        """``rows`` of the tests in ``per_test`` with its columns, joined chunk by chunk so that no test is one task's."""
        rows = self.cut(rows, order)
        return _join(rows, rows.select(KEY, CHUNK).distinct().join(per_test, KEY)).drop(CHUNK)

    def previous(self, rows: DataFrame, columns: list[str], order: str = "idx") -> DataFrame:
        """``_prev``, a struct of ``columns`` of the row before, null at the first; needs ``cut``."""
        value = F.struct(*columns)
        per = rows.groupBy(KEY, CHUNK).agg(F.max_by(value, order).alias("_last")).select(KEY, CHUNK, F.lag("_last").over(s.along(CHUNK)).alias("_last"))
        w = _within(order)
        return _join(rows, per).withColumn("_prev", F.when(F.row_number().over(w) == 1, F.col("_last")).otherwise(F.lag(value).over(w))).drop("_last")

    def following(self, rows: DataFrame, columns: list[str], order: str = "idx") -> DataFrame:
        """``_next``, a struct of ``columns`` of the row after, null at the last; needs ``cut``."""
        value = F.struct(*columns)
        per = rows.groupBy(KEY, CHUNK).agg(F.min_by(value, order).alias("_first")).select(KEY, CHUNK, F.lead("_first").over(s.along(CHUNK)).alias("_first"))
        return _join(rows, per).withColumn("_next", F.coalesce(F.lead(value).over(_within(order)), F.col("_first"))).drop("_first")

    def between(self, rows: DataFrame, window: DataFrame, order: str = "idx") -> DataFrame:
        """Rows of each test from start_idx to shutin_idx with both, joined on the chunks that these reach; needs no pass over the rows first."""
        first, last = F.floor(F.col("start_idx") / self.size), F.floor(F.col("shutin_idx") / self.size)
        reached = window.where(F.col("start_idx") <= F.col("shutin_idx")).select(KEY, "start_idx", "shutin_idx", F.explode(F.sequence(first, last)).alias(CHUNK))
        return self.cut(rows, order).join(reached, [KEY, CHUNK]).where(F.col(order).between(F.col("start_idx"), F.col("shutin_idx")))

    def positions(self, rows: DataFrame, order: str = "idx") -> DataFrame:
        """``_pos``, each row's number in its test from 0 without gaps, and ``_size``, its test's rows; needs ``cut``."""
        per = rows.groupBy(KEY, CHUNK).agg(F.count("*").alias("_n"))
        per = per.select(KEY, CHUNK, F.coalesce(F.sum("_n").over(_earlier(s.along(CHUNK))), F.lit(0)).alias("_n"), F.sum("_n").over(s.whole()).alias("_size"))
        return _join(rows, per).withColumn("_pos", F.col("_n") + F.row_number().over(_within(order)) - 1).drop("_n")

    def elapsed_seconds(self, rows: DataFrame, ts: str = "ts", order: str = "idx") -> DataFrame:
        rows = self.cut(rows, order)
        valid = F.when(F.col(ts).isNotNull(), F.col(order))
        per = rows.groupBy(KEY, CHUNK).agg(F.min_by(ts, valid).alias("_f"), F.min(valid).alias("_o"))
        per = per.select(KEY, CHUNK, F.min_by("_f", "_o").over(s.whole()).alias("_first"))
        return _join(rows, per).withColumn("t_s", F.expr(f"timestampdiff(MICROSECOND, _first, {ts}) / 1e6")).drop("_first", CHUNK)

    def unreversed(self, rows: DataFrame, ts: str = "ts", order: str = "idx") -> DataFrame:
        rows = self.cut(rows, order)
        valid = F.when(F.col(ts).isNotNull(), F.col(order))
        per = rows.groupBy(KEY, CHUNK).agg(F.max_by(ts, valid).alias("_l")).select(KEY, CHUNK, F.last("_l", ignorenulls=True).over(_earlier(s.along(CHUNK))).alias("_l"))
        before = F.coalesce(F.last(ts, ignorenulls=True).over(_earlier(_within(order))), F.col("_l"))
        step = _join(rows, per).withColumn("_rises", F.col(ts) > before).withColumn("_falls", F.col(ts) < before).drop("_l")
        told = step.groupBy(KEY, CHUNK).agg(F.bool_or("_rises").alias("_r"), F.bool_or("_falls").alias("_f"), F.max(order).alias("_m"))
        no = F.lit(False)
        turned = ~F.coalesce(F.bool_or("_r").over(s.whole()), no) & F.coalesce(F.bool_or("_f").over(s.whole()), no)
        out = _join(step, told.select(KEY, CHUNK, turned.alias("reversed"), F.max("_m").over(s.whole()).alias("_m")))
        return out.withColumn(order, F.when(F.col("reversed"), F.col("_m") - F.col(order)).otherwise(F.col(order))).drop("_rises", "_falls", "_m", CHUNK)

    def monotonic_prefix(self, rows: DataFrame, t: str = "t_s", order: str = "idx") -> DataFrame:
        out = self.previous(self.cut(rows, order), [t], order).withColumn("_drop", F.when(F.col(t) < F.col("_prev")[t], F.col(order)))
        per = out.groupBy(KEY, CHUNK).agg(F.min("_drop").alias("_d")).select(KEY, CHUNK, F.min("_d").over(s.whole()).alias("_cut"))
        return _join(out, per).where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_prev", "_drop", "_cut", CHUNK)

    def resample_increment(self, rows: DataFrame, step: float | Column = 30.0, rise: float | Column | None = None, dt: str = "dt", p: str = "p", order: str = "idx") -> DataFrame:
        """As in ``series``. Only new lows meet in one task a test, where they pass in order, one batch in memory."""
        step = step if isinstance(step, Column) else F.lit(float(step))
        rise = step if rise is None else rise if isinstance(rise, Column) else F.lit(float(rise))
        rows = self.cut(rows.withColumn("_step", step).withColumn("_rise", rise), order)
        good = s.finite(F.col(p))
        per = rows.groupBy(KEY, CHUNK).agg(F.count("*").alias("_n"), F.min(F.when(good, F.col(p))).alias("_m"))
        per = per.select(KEY, CHUNK, F.sum("_n").over(s.whole()).alias("n_raw"), F.min("_m").over(_earlier(s.along(CHUNK))).alias("_m"))
        low = F.least(F.min(p).over(_earlier(_within(order))), F.col("_m"))
        found = _join(rows.where(good), per).withColumn("_low", low)
        risen = F.when(F.col(p) > F.col("_low") + F.col("_rise"), F.col(order))
        # Of what rises a chunk's first row is enough; with the new lows this is all that goes on.
        found = found.withColumn("_rose", F.coalesce(F.min(risen).over(Window.partitionBy(KEY, CHUNK)) == F.col(order), F.lit(False)))
        found = found.withColumn("_new", F.col("_low").isNull() | (F.col(p) < F.col("_low"))).where(F.col("_rose") | F.col("_new"))
        marked = staged(found.select(KEY, F.col(order), F.col(dt).cast("double").alias("dt"), F.col(p).cast("double").alias("p"), F.col("_step").cast("double").alias("_step"), "n_raw", "_rose", "_new"), "lows")
        tests = marked.groupBy(F.col(KEY).alias("_k")).agg(F.first("n_raw").alias("n_raw"), F.min(F.when(F.col("_rose"), F.col(order))).alias("_cut"))
        same = F.col(KEY).eqNullSafe(F.col("_k"))
        lows = marked.where("_new").drop("n_raw").join(tests, same).where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut")))
        out = _fold(lows, order).join(tests, same)
        return out.select(KEY, "i", "dt", "p", "n_raw", F.when(F.col("_cut").isNotNull(), F.count("*").over(s.whole()).cast("int")).alias("guarded_at"))

    def injection_window(self, rows: DataFrame, rate: str = "rate", threshold: float = 0.1, order: str = "idx") -> DataFrame:
        """As in ``series``, which aggregates only."""
        return s.injection_window(rows, rate, threshold, order)

    def main_cycle(self, rows: DataFrame, rate: str = "rate", volume: str = "volume", threshold: float = 0.1, order: str = "idx") -> DataFrame:
        """As in ``series``: a stretch that goes on in the next chunk is one, numbered over all chunks."""
        w = _within(order)
        value = F.struct(F.col(order).alias("o"), F.col(volume).alias("v"))
        out = self.cut(rows, order).withColumn("_on", F.coalesce(F.col(rate) > threshold, F.lit(False))).withColumn("_next", F.lead(value).over(w))
        out = out.withColumn("_new", F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0))
        per = out.groupBy(KEY, CHUNK).agg(F.sum("_new").alias("_n"), F.min_by("_on", order).alias("_a"), F.max_by("_on", order).alias("_z"), F.min_by(value, order).alias("_first"))
        by = s.along(CHUNK)
        per = per.withColumn("_same", F.when(F.col("_a") & F.coalesce(F.lag("_z").over(by), F.lit(False)), 1).otherwise(0))
        added = F.coalesce(F.sum(F.col("_n") - F.col("_same")).over(_earlier(by)), F.lit(0)) - F.col("_same")
        out = _join(out, per.select(KEY, CHUNK, added.alias("_add"), F.lead("_first").over(by).alias("_after")))
        out = out.withColumn("_stretch", F.col("_add") + F.sum("_new").over(w)).withColumn("_next", F.coalesce("_next", "_after"))
        next_o, next_v = F.col("_next")["o"], F.col("_next")["v"]
        ends = out.where("_on").groupBy(KEY, "_stretch").agg(
            F.min(order).alias("start_idx"), F.min_by(volume, order).alias("_v0"),
            F.max_by(F.coalesce(next_o, F.col(order)), order).alias("shutin_idx"), F.max_by(F.when(F.col("_next").isNull(), F.col(volume)).otherwise(next_v), order).alias("_v1"),
        )
        best = F.max_by(F.struct("start_idx", "shutin_idx"), F.struct(F.col("_v1") - F.col("_v0"), -F.col("start_idx")))
        return ends.groupBy(KEY).agg(best.alias("b")).select(KEY, "b.start_idx", "b.shutin_idx")

    def haloed(self, rows: DataFrame, before: int, after: int) -> DataFrame:
        """Rows with ``_pos`` in chunks of positions, those near an edge in the next chunk too, where ``_own`` is false."""
        if max(before, after) > self.size:
            raise ValueError("a frame reaches beyond the next chunk")
        chunk, within = F.floor(F.col("_pos") / self.size), F.col("_pos") % self.size
        to = F.array_compact(F.array(F.lit(0), F.when((within < after) & (chunk > 0), -1), F.when(within >= self.size - before, 1)))
        return rows.drop(CHUNK).withColumn("_to", F.explode(to)).withColumn("_own", F.col("_to") == 0).withColumn(CHUNK, chunk + F.col("_to")).drop("_to")

    def max_sustained_rate(self, rows: DataFrame, window: DataFrame, rate: str = "rate", width: int = 15, order: str = "idx") -> DataFrame:
        """As in ``series``; stretches shorter than ``width`` go to ``series`` itself."""
        seg = staged(self.between(rows.select(KEY, order, rate), window, order).where(F.col(order) < F.col("shutin_idx")).select(KEY, order, rate), "pumped-rows")
        placed = self.positions(self.cut(seg, order), order)
        before, after = width // 2, (width - 1) // 2
        mean = F.sum(rate).over(_within("_pos").rowsBetween(-before, after)) / float(width)
        peaks = self.haloed(placed.where(F.col("_size") >= width), before, after).withColumn("_mean", mean).where("_own").groupBy(KEY).agg(F.max("_mean").alias("qmax"))
        few = placed.where(F.col("_size") < width).select(KEY, order, rate)
        return peaks.unionByName(s.max_sustained_rate(few, window, rate, width, order))

    def injected_volume(self, rows: DataFrame, window: DataFrame, rate: str = "rate", volume: str = "volume", order: str = "idx") -> DataFrame:
        seg = self.following(self.between(rows, window, order), [rate, "t_s", order], order)
        within = (F.col(order) >= F.col("start_idx")) & (F.col(order) < F.col("shutin_idx"))
        nxt = F.col("_next")
        area = F.when(within & (nxt[order] < F.col("shutin_idx")), (F.col(rate) + nxt[rate]) / 2 * (nxt["t_s"] - F.col("t_s")) / 60.0)
        return s.volumes(seg.withColumn("_area", area), volume, order)

    def tangent_at(self, rows: DataFrame, targets: DataFrame, x: str, y: str, at: str, half: int = 4, order: str = "i") -> DataFrame:
        """As in ``series``: the nearest row is found by an aggregate, and only its neighbours enter the line."""
        goal = targets.select(KEY, F.col(at).alias("_at")).where(F.col("_at").isNotNull())
        placed = self.positions(self.cut(self.spread(rows, goal, order), order), order)
        near = placed.where(F.col(x).isNotNull())
        best = F.min_by(F.struct(F.col(x).alias("anchor_x"), F.col(y).alias("anchor_y"), F.col("_pos").alias("_p")), F.struct(F.round(F.abs(F.col(x) - F.col("_at")), 9), F.col(order)))
        found = near.groupBy(KEY).agg(best.alias("b")).select(KEY, "b.*")
        around = self.spread(placed.drop(CHUNK, "_size"), found, order).where(F.abs(F.col("_pos") - F.col("_p")) <= half)
        return around.groupBy(KEY).agg(F.first("anchor_x").alias("anchor_x"), F.first("anchor_y").alias("anchor_y"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))
