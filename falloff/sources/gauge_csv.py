"""Loosely formatted gauge exports: text files to ordered samples with elapsed seconds."""

from __future__ import annotations

import csv
import io
import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from falloff.functions import text as tx
from falloff.operators import series as s
from falloff.plans.staging import staged
from falloff.sources import ranges
from falloff.sources.files import listing

#: Words in column names that tell a channel's role, words that rule it out, and units of elapsed time in seconds.
PRESSURE, BOTTOMHOLE, RATE, VOLUME = ("press", "bhp", "whp", "psi"), ("bhp", "bottom"), ("rate", "bpm", "flow", "slurry"), ("vol", "bbl")
CLOCK, ELAPSED = ("date", "time"), ("delta", "elapsed")
NO_VOLUME, NO_CLOCK, NO_ELAPSED = ("rate",), ("rate", "vol", "press"), ("rate", "vol", "press", "temp")
UNITS = {"s": 1.0, "sec": 1.0, "secs": 1.0, "second": 1.0, "seconds": 1.0, "min": 60.0, "mins": 60.0, "minute": 60.0, "minutes": 60.0, "hr": 3600.0, "hrs": 3600.0, "hour": 3600.0, "hours": 3600.0}
PROBE = 20

ROWS = "path string, idx long, date string, time string, elapsed double, channels map<string,double>, p double, rate double, volume double, p_is_bhp boolean, error string"

COLUMNS = ["path", "idx", "date", "time", "elapsed", "channels", "p", "rate", "volume", "p_is_bhp", "error"]


def is_number(field: str) -> bool:
    try:
        float(field.strip())
    except ValueError:
        return False
    return True


def header_line(rows: list[list[str]]) -> int:
    """Of the first lines, the first of the commonest width that holds names rather than numbers; 0 if there is none."""
    widths = [sum(bool(f.strip()) for f in r) for r in rows[:PROBE]]
    common = Counter(w for w in widths if w).most_common(1)
    for k, r in enumerate(rows[:PROBE]):
        if common and widths[k] == common[0][0] and not any(is_number(f) for f in r if f.strip()):
            return k
    return 0


def roles(names: list[str]) -> dict[str, int | None]:
    """Columns of date, time of day, pressure (one at the bottom of the hole first), rate and volume: the first in the file whose
    name has a word of the role. A first clock that is named like a channel is none; a time of day counts only beside a date
    without one."""
    low = [n.strip().lower() for n in names]

    def first(words: tuple[str, ...], without: tuple[str, ...] = ()) -> int | None:
        return next((k for k, n in enumerate(low) if any(w in n for w in words) and not any(w in n for w in without)), None)

    date, bottom = first(CLOCK), first(BOTTOMHOLE)
    date = None if date is not None and any(w in low[date] for w in NO_CLOCK) else date
    alone = date is not None and "time" not in low[date]
    time = next((k for k, n in enumerate(low) if n.split("(")[0].strip() == "time"), None) if alone else None
    return {"date": date, "time": time, "bottom": bottom, "pressure": first(PRESSURE) if bottom is None else bottom, "rate": first(RATE), "volume": first(VOLUME, NO_VOLUME)}


def elapsed_unit(name: str) -> float | None:
    """Seconds of the unit in a name's first round brackets; null if there is none that is known."""
    inside = name.lower().partition("(")[2].partition(")")
    return UNITS.get(inside[0].strip()) if inside[1] else None


def elapsed_of(names: list[str], rows: list[list[str]]) -> list[float | None] | None:
    """Elapsed seconds of the rows from the first column that is named so, has a unit, never falls and rises at all."""
    for k, name in enumerate(n.lower() for n in names):
        unit = elapsed_unit(name)
        if unit is None or not any(w in name for w in ELAPSED) or any(w in name for w in NO_ELAPSED):
            continue
        values = [float(r[k]) if k < len(r) and is_number(r[k]) else math.nan for r in rows]
        known = [v for v in values if math.isfinite(v)]
        if len(known) >= 2 and known[-1] > known[0] and all(a <= b for a, b in pairwise(known)):
            return [v * unit if math.isfinite(v) else None for v in values]
    return None


def parse(content: bytes) -> Iterator[tuple]:
    """(idx, date, time, elapsed, channels, p, rate, volume, p_is_bhp, error) of a file; one row with an error if it can't be told apart into columns.

    A row wider than both header and first row of data is an error unless what stands above the true header explains it;
    short rows are filled up with nothing, a last field that is empty in every row is dropped.
    """
    rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))) if r]
    if len(rows) < 2:
        yield 0, *[None] * 8, "no rows"
        return
    head = 0
    if max(map(len, rows)) > max(len(rows[0]), len(rows[1])):
        head = header_line(rows)
        if head == 0 or max(len(r) for r in rows[head:]) > max(len(rows[head]), len(rows[min(head + 1, len(rows) - 1)])):
            yield 0, *[None] * 8, "rows are wider than the header"
            return
    names = [n.strip() for n in rows[head]]
    wide = max((len(r) for r in rows[head + 1 :]), default=0)
    if wide > len(names) and any(f.strip() for r in rows[head + 1 :] for f in r[len(names) :]):
        yield 0, *[None] * 8, "rows are wider than the header"
        return
    at = roles(names)
    date = at["date"] if at["date"] is not None else 0
    elapsed = elapsed_of(names, rows[head + 1 :])
    values = [k for k in range(len(names)) if k not in (date, at["time"])]
    for idx, r in enumerate(rows[head + 1 :]):
        r = [*r, *[""] * (len(names) - len(r))]
        channels = {names[k]: float(r[k]) for k in values if is_number(r[k])}
        p, rate, volume = (float(r[at[c]]) if at[c] is not None and is_number(r[at[c]]) else None for c in ("pressure", "rate", "volume"))
        yield idx, r[date].strip() or None, r[at["time"]].strip() or None if at["time"] is not None else None, elapsed[idx] if elapsed else None, channels, p, rate, volume, at["bottom"] is not None, None


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            held = []
            for row in parse(content):
                held.append((path, *row))
                if len(held) == 50_000:
                    yield pd.DataFrame(held, columns=COLUMNS)
                    held = []
            yield pd.DataFrame(held, columns=COLUMNS)


def timed(rows: DataFrame, key: str = "path") -> DataFrame:
    """``rows`` (from the parser) with ``ts`` and ``t_s``: per file, the order of day and month, dates with times where those
    parse more, descending files turned, and elapsed time where under half the rows have a date."""
    order = rows.groupBy(key).agg(tx.day_first("date").alias("_df"))
    both = F.concat_ws(" ", "date", tx.fixed_milliseconds(F.col("time")))
    out = rows.join(order, key).withColumn("_joint", F.when(F.col("time").isNotNull(), tx.parsed_time(both, F.col("_df")))).withColumn("_plain", tx.parsed_time(F.col("date"), F.col("_df")))
    w = s.whole(key)
    out = out.withColumn("ts", F.when((F.count("time").over(w) > 0) & (F.count("_joint").over(w) >= F.count("_plain").over(w)), F.col("_joint")).otherwise(F.col("_plain")))
    bad = F.count("ts").over(w) < 0.5 * F.count("*").over(w)
    out = out.withColumn("_bad", bad & (F.count("elapsed").over(w) >= 2))
    begin = F.first(F.when(F.col("_bad"), F.col("elapsed")), ignorenulls=True).over(s.along("idx", key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.col("elapsed") - begin).cast("decimal(18,6)"))
    out = out.withColumn("ts", F.when(F.col("_bad"), epoch).otherwise(F.col("ts")))
    out = out.withColumn("test_id", F.col(key)).drop("_df", "_joint", "_plain", "_bad", "date", "time", "elapsed")
    return s.elapsed_seconds(s.unreversed(out)).drop("reversed")


def read_gauge_csv(spark: SparkSession, root: str) -> DataFrame:
    """(path, idx, ts, t_s, channels, p, rate, volume, p_is_bhp, error, test_id) of every csv under ``root``; a file is parsed in one task."""
    found = listing(spark, root, "*.[cC][sS][vV]", content=True).select("path", "content")
    return timed(staged(found.mapInPandas(_rows, ROWS), "gauge-csv"))


def read_csv_files(files: DataFrame) -> DataFrame:
    """The same for given files (path), which tasks open themselves: nothing but these files is read."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with ranges.opened(path) as file:
                        content = file.read()
                except OSError as e:
                    yield pd.DataFrame([(path, 0, *[None] * 8, str(e))], columns=COLUMNS)
                    continue
                yield from _rows(iter([pd.DataFrame({"path": [path], "content": [content]})]))

    return timed(staged(files.select("path").mapInPandas(of, ROWS), "gauge-csv"))


def as_samples(rows: DataFrame) -> DataFrame:
    """(test_id, idx, t_s, p, rate, volume) of files that could be read; null where a file has no such channel."""
    return rows.where(F.col("error").isNull()).select("test_id", "idx", "t_s", "p", "rate", "volume")
