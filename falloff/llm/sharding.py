"""Sharding along a Hilbert curve: quantise metadata, order by curve index, cut runs of equal bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from falloff.llm.common import cut


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points whose coordinates (rows of ``axes``) lie in [0, 2**bits)."""
    x = [a.astype(np.int64) for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def ranks(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, rank): distinct values in their order, at the share of rows that stand before them, in 2**bits steps."""
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("value", F.floor(F.coalesce(before, F.lit(0)) * (1 << bits) / total).cast("int").alias("rank"))


def assign(docs: DataFrame, id: str = "doc_id", text: str = "text", dims: Sequence[str] = ("lang", "source"), shards: int = 16, bits: int = 5, whole: float = 0.02) -> DataFrame:
    """(id, size, text_crc32, law = "bytes", shard, slot, grown_shard = null) for every row.

    Size is the UTF-8 bytes of the text plus 1, null text 1. Rows are ordered by the Hilbert index of ``dims``
    (values by rank over all rows) and the logarithm of the size, and the order is cut where cumulated bytes
    reach equal shares. Equal texts take the place of their smallest row and are a unit: a unit goes to the shard where its
    middle falls. Shares stay equal where units are coarse: those of more than ``whole`` of a share (at most shards / whole
    of them) are set first, each in the shard of its middle or the nearest with room, and the runs of all others are cut to the room
    that is left, which keeps them around the same places of the curve. Only a unit larger than a share is cut, by rows.
    Slots count from 0 in each shard, the units set first before the rest, both along the curve.

    Texts never move: only ids, sizes, hashes and ranks are shuffled. Units are partially aggregated; the order is
    a range partitioning whose last key is the id, so no value, however frequent, lands in one task; positions
    are running sums inside partitions plus one offset for each partition. Null dims rank last. Rows that repeat an id are
    rows of their own; equal rows are interchangeable. An empty table gives an empty table. Extra columns are ignored, whatever their names.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    content = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(id).alias("id"), *[F.col(d).alias(f"d{k}") for k, d in enumerate(dims)], size.alias("size"), F.crc32(content.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(3), F.col(text)).alias("g"))
    slim = cut(slim, "shard-rows")
    names = [f"d{k}" for k in range(len(dims))]
    units = slim.groupBy("h", "g").agg(F.sum("size").alias("bytes"), F.min(F.struct("id", "size", *names)).alias("m")).select("h", "g", "bytes", "m.size", *[f"m.{d}" for d in names])
    for d in names:
        rank = ranks(slim, d, bits).select(F.col("value").alias("_v"), F.col("rank").alias(f"r{d}"))
        units = units.join(rank, F.col(d).eqNullSafe(F.col("_v")), "left").drop("_v")
    level = F.least(F.floor(F.log2(F.col("size").cast("double")) * 2), F.lit((1 << bits) - 1)).cast("int")
    units = units.select("h", "g", "bytes", _curve(bits)(F.array(*[f"r{d}" for d in names], level)).alias("at"))
    units = cut(units, "shard-units")

    total = slim.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    mode = F.when(F.col("bytes") > share, 2).when(F.col("bytes") > whole * share, 1).otherwise(0)
    rows = slim.select("id", "size", "crc", "h", "g").join(units.withColumn("mode", mode), ["h", "g"])
    keys = ["at", "h", "g", "id"]
    ran = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = f"id {dict(slim.dtypes)['id']}, size long, crc long, h long, g long, bytes long, mode int, pid int, " + ", ".join(f"{c} long" for c in (*_COUNTS, "unit_from")) + ", first_unit boolean"
    ran = cut(ran.select("id", "size", "crc", "h", "g", "bytes", "mode").mapInPandas(_running, schema), "shard-order")
    # One row for each partition: what stands before it, and where a unit that reaches into it began.
    flows = F.col("mode") != 1
    parts = ran.groupBy("pid").agg(
        F.count("*").alias("n"), F.sum("size").alias("b"), F.count(F.when(flows, 1)).alias("flow_n"), F.coalesce(F.sum(F.when(flows, F.col("size"))), F.lit(0)).alias("flow_b"),
        F.min_by(F.struct("h", "g"), "n_before").alias("first"), F.max_by(F.struct("h", "g", "unit_from", "first_unit"), "n_before").alias("last"),
    ).orderBy("pid").collect()
    offsets, sums, carried = [], [0, 0, 0, 0], None
    for p in parts:
        start = sums[3]
        if carried and carried[0] == (p["first"]["h"], p["first"]["g"]):
            start = carried[1]
        offsets.append((p["pid"], *sums, start))
        last = p["last"]
        carried = ((last["h"], last["g"]), start if last["first_unit"] else sums[3] + last["unit_from"])
        sums = [x + p[c] for x, c in zip(sums, ("n", "b", "flow_n", "flow_b"), strict=True)]
    offset = slim.sparkSession.createDataFrame(offsets or [(0, 0, 0, 0, 0, 0)], "pid int, n0 long, b0 long, fn0 long, fb0 long, u0 long")
    rows = ran.join(F.broadcast(offset), "pid").withColumns({"place": F.col("n0") + F.col("n_before"), "flow_place": F.col("fn0") + F.col("flow_n_before")})

    # At most shards / whole units are this large.
    large = rows.where("mode = 1").groupBy("h", "g").agg(F.min("place").alias("place"), F.min(F.col("b0") + F.col("b_before")).alias("start"), F.max("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    heads, load = settle([(u["start"] + u["bytes"] / 2, u["bytes"]) for u in large], share, shards)
    set_rows, placed = [0] * shards, []
    for i in sorted(range(len(large)), key=lambda i: large[i]["place"]):
        u, k = large[i], heads[i]
        placed.append((u["h"], u["g"], k, set_rows[k] - u["place"]))
        set_rows[k] += u["n"]
    head = slim.sparkSession.createDataFrame(placed or [(0, 0, -1, 0)], "h long, g long, head int, head_shift long").where("head >= 0")
    ends = np.cumsum(rooms(load, float(sums[3])))

    rows = rows.join(F.broadcast(head), ["h", "g"], "left")
    start = F.when(F.col("first_unit"), F.col("u0")).otherwise(F.col("fb0") + F.col("unit_from"))
    middle = F.when(F.col("mode") == 2, F.col("fb0") + F.col("flow_b_before") + F.col("size") / 2).otherwise(start + F.col("bytes") / 2)
    run = sum((F.when(middle >= float(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    rows = rows.withColumn("shard", F.coalesce("head", run).cast("int"))
    lows = {r["shard"]: r["low"] for r in rows.where("mode <> 1").groupBy("shard").agg(F.min("flow_place").alias("low")).collect()}
    shift = slim.sparkSession.createDataFrame([(k, set_rows[k] - lows.get(k, 0)) for k in range(shards)], "shard int, shift long")
    slot = F.when(F.col("mode") == 1, F.col("place") + F.col("head_shift")).otherwise(F.col("flow_place") + F.col("shift"))
    return rows.join(F.broadcast(shift), "shard").select(
        F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def settle(units: Sequence[tuple[float, int]], share: float, shards: int) -> tuple[list[int], list[float]]:
    """The shard of each unit (middle, bytes), the largest first: that of its middle, or the nearest with room, or with most room. And the loads."""
    load, out = [0.0] * shards, [0] * len(units)
    for i in sorted(range(len(units)), key=lambda i: (-units[i][1], units[i][0])):
        middle, size = units[i]
        home = min(int(middle / share), shards - 1)
        fit = [k for k in range(shards) if load[k] + size <= share]
        k = min(fit, key=lambda k: (abs(k - home), load[k])) if fit else min(range(shards), key=lambda k: (load[k], abs(k - home)))
        out[i] = k
        load[k] += size
    return out, load


def rooms(load: Sequence[float], total: float) -> list[float]:
    """How much of ``total`` each shard takes so that all come to one level, none under its load."""
    level, rest = 0.0, sorted(load)
    for n in range(len(rest), 0, -1):
        level = (total + sum(rest[:n])) / n
        if level >= rest[n - 1]:
            break
    return [max(0.0, level - x) for x in load]


def write(docs: DataFrame, plan: DataFrame, path: str, id: str = "doc_id") -> None:
    """Write ``docs`` as one folder for each shard, rows by slot, so that minima and maxima prune files.

    Rows that repeat an id go together to the place of one of them; a null id finds its place like any other. Columns named
    shard or slot are replaced. An empty table writes no file.
    """
    to = plan.select(F.col(id).alias("_id"), "shard", "slot").groupBy("_id").agg(F.min(F.struct("shard", "slot")).alias("_to"))
    out = docs.drop("shard", "slot").join(to, F.col(id).eqNullSafe(F.col("_id"))).select(*[c for c in docs.columns if c not in ("shard", "slot")], "_to.shard", "_to.slot")
    out.repartition("shard", F.floor(F.col("slot") / 500_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _curve(bits: int) -> Column:
    @F.pandas_udf("long")
    def index(axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.minimum(np.stack(axes.to_numpy()).T, (1 << bits) - 1), bits) if len(axes) else [], dtype="int64")

    return index


#: What stands before a row in its partition: rows and bytes of all, and of those in no unit that is set first.
_COUNTS = ("n_before", "b_before", "flow_n_before", "flow_b_before")


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running counts and bytes along a sorted partition, and where each unit began in it among what isn't set first."""
    pid, sums, unit, began, first = TaskContext.get().partitionId(), np.zeros(4, dtype=np.int64), None, 0, True
    for rows in batches:
        if not len(rows):
            continue
        size, flows = rows["size"].to_numpy(np.int64), (rows["mode"] != 1).to_numpy(np.int64)
        steps = np.stack([np.ones(len(rows), dtype=np.int64), size, flows, flows * size])
        after = sums[:, None] + np.cumsum(steps, axis=1)
        before = after - steps
        h, g = rows["h"].to_numpy(), rows["g"].to_numpy()
        new = np.empty(len(rows), dtype=bool)
        new[0] = unit != (h[0], g[0])
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        started = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
        begin = np.where(started >= 0, before[3][np.maximum(started, 0)], began)
        count = np.cumsum(new)  # units that began in this batch up to the row
        is_first = first & (count == (1 if unit is None else 0))
        yield rows.assign(pid=np.int32(pid), **dict(zip(_COUNTS, before, strict=True)), unit_from=begin, first_unit=is_first)
        first = bool(is_first[-1])
        unit, began, sums = (h[-1], g[-1]), begin[-1], after[:, -1]
