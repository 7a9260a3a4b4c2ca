"""Mixing sources to target weights: whole copies first, then Pareto order sampling of the rest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from falloff.llm.common import BROADCAST_BYTES, cut

#: Words are maximal runs of what is not an ASCII white-space character.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in code-point order, null last, take the weights in turn and share ``budget`` times all sizes; no
    target exceeds ``cap`` times its source's size. Raising a common level, sources reach their cap in the order of
    cap/weight, so one running sum over the sources finds which are capped; the others share what is left.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "at")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("w"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("w"), "at", "level"))).over(everything)
    return ranked.withColumn("first", first).select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("first.level") * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: int = 2, seed: int = 17, cell: int = 1000) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken = copies * size.

    A document's expected copies are its source's target over its size (times ``weight`` over the source's
    size-weighted mean weight, if a column of weights is named; null or negative weights count as 0), at most
    ``cap``. Its whole part is certain. What is then missing to the source's target is drawn as a sample of
    fixed size in words: documents in the order of (u / (1 - u)) / (p / (1 - p)), u uniform from a hash of id and
    text, p the fractional part of the expected copies. Whole cells of that order are taken while they fit; in
    the cell where the target falls, each document in turn is taken if it still fits, so a source misses its
    target by less than its smallest document left out there.

    Nothing gathers a source: sums are by (source, cell) with partial aggregation, a source having one cell for
    each ``cell`` documents, so only the cell where the target falls, of about that many rows, is walked. Per
    source, per cell and per walked row tables are broadcast only when they measure under 8 MB; beyond that they
    are joined. Reruns agree. Null text has size 0; a document of size 0 takes 0 words. Null sources are one
    source. Rows that repeat id and text are taken or left together. An empty table gives an empty table.
    Columns named size, source_size, target, copies or taken are replaced.
    """
    rows = docs.drop("size", "source_size", "target", "copies", "taken").withColumn("size", word_count(F.col(text)))
    given = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = rows.withColumn("_w", given).withColumn("_id", F.col(id).cast("string")).withColumn("_row", F.xxhash64(F.col(text)))
    narrow = cut(rows.select("_id", "_row", F.col(source).alias(source), "size", "_w"), "mix-sizes")

    per = narrow.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("_wsum"), F.count("*").alias("_n"))
    per = cut(per, "mix-sources")
    goal = targets(per.select("source", "source_size"), weights, budget, float(cap)).alias("g").join(per.alias("p"), F.col("g.source").eqNullSafe(F.col("p.source")))
    goal = cut(goal.select(F.col("g.source").alias("_source"), "g.source_size", "target", "_wsum", "_n"), "mix-targets")
    placed = _place(narrow, goal, source, cap, seed, cell)
    words = F.sum("size").alias("_words"), F.sum(F.col("size") * F.col("_whole")).alias("_sure"), F.max("target").alias("target")
    sums = placed.groupBy(F.col(source).alias("_s"), F.col("_cell").alias("_c")).agg(*words)
    by = Window.partitionBy("_s")
    gap = F.max("target").over(by) - F.sum("_sure").over(by)
    run = F.sum(F.when(F.col("_c").isNotNull(), F.col("_words"))).over(by.orderBy(F.col("_c").asc_nulls_first()))
    room = gap - run + F.col("_words")
    cells = sums.withColumn("_room", room).where(F.col("_c").isNotNull() & (F.col("_room") > 0)).select("_s", "_c", "_room", (F.col("_room") >= F.col("_words")).alias("_full"))
    cells = cut(cells, "mix-cells")

    edge = _with_cells(placed, cells.where(~F.col("_full")), source).where(F.col("_room").isNotNull())
    edge = edge.groupBy("_s", "_c", "_room", "_key", "_id", "_row").agg(F.sum("size").alias("_words"))
    picks = cut(edge.groupBy("_s", "_c").applyInPandas(_walk, "_pid string, _prow long"), "mix-picks")

    out = _with_cells(_place(rows, goal, source, cap, seed, cell), cells, source)
    out = out.join(_small(picks), F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_row") == F.col("_prow")) & ~F.col("_full"), "left")
    more = F.when(F.col("_full") | F.col("_pid").isNotNull(), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("_whole") + more).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[c for c in rows.columns if not c.startswith("_")], "source_size", "target", "copies", "taken")


def _place(rows: DataFrame, goal: DataFrame, source: str, cap: int, seed: int, cell: int) -> DataFrame:
    """Certain copies, and for what is drawn its key of order in (0, 1) and its cell."""
    out = rows.join(_small(goal), F.col(source).eqNullSafe(F.col("_source")))
    rate = F.when(F.col("_wsum") > 0, F.least(F.col("target") * F.col("_w") / F.col("_wsum"), F.lit(float(cap)))).otherwise(0.0)
    out = out.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate").cast("int"))
    p = F.col("_rate") - F.col("_whole")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("_row")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    odds = (u / (1 - u)) * ((1 - p) / p)
    drawn = (p > 0) & (F.col("_whole") < cap) & (F.col("size") > 0)
    out = out.withColumn("_key", F.when(drawn, odds / (1 + odds)))
    return out.withColumn("_cell", F.floor(F.col("_key") * F.ceil(F.col("_n") / cell)).cast("long"))


def _with_cells(rows: DataFrame, cells: DataFrame, source: str) -> DataFrame:
    return rows.join(_small(cells), F.col(source).eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")), "left")


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast only if it is measured to be within the bound."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.count("*") * 16 * len(df.columns) + F.coalesce(F.sum(sum(wide, F.lit(0))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one cell, in order, every document that still fits."""
    rows = rows.sort_values(["_key", "_id", "_row"], kind="stable")
    room, taken = float(rows["_room"].iloc[0]), []
    for words in rows["_words"].to_numpy():
        taken.append(words <= room)
        room -= words * (words <= room)
    chosen = rows[np.array(taken, dtype=bool)]
    return pd.DataFrame({"_pid": chosen["_id"], "_prow": chosen["_row"]})
