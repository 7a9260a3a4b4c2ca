"""Answers from questionnaires: cells under labels, densities and depths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from falloff.functions import text as tx


def label_of(cell: Column, labels: Sequence[str]) -> Column:
    """The longest of ``labels`` (lower case) that begins a cell; null if none does."""
    known = F.array(*[F.lit(x) for x in sorted(labels, key=lambda x: (-len(x), x))])
    return F.get(F.filter(known, lambda x: F.startswith(F.lower(F.trim(cell)), x)), F.lit(0))


def answer_blocks(cells: DataFrame, labels: Sequence[str], key: str = "path") -> DataFrame:
    """(key, label, answers): the cells after a label, in order, up to the next; a label that comes again appends.

    ``cells`` has key, ord and text. Cells before the first label belong to none.
    """
    own = cells.withColumn("_own", label_of(F.col("text"), labels))
    last = F.last("_own", ignorenulls=True).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    under = own.withColumn("label", last).where(F.col("label").isNotNull())
    answers = F.transform(F.array_sort(F.collect_list(F.when(F.col("_own").isNull(), F.struct("ord", "text")))), lambda x: x["text"])
    return under.groupBy(key, "label").agg(answers.alias("answers"))


def first_answer(answers: Column) -> Column:
    """The first answer that isn't blank."""
    return F.get(F.filter(answers, lambda x: F.trim(x) != ""), F.lit(0))


def density_of(answers: Column) -> Column:
    """The first usable density of a block, in pounds per gallon."""
    return F.get(F.filter(F.transform(answers, tx.density_ppg), lambda x: x.isNotNull()), F.lit(0))


def depth_of(answers: Column) -> Column:
    """True vertical depth of a block: a labelled cell in range, else the second of exactly two bare footages."""
    labelled = F.filter(F.transform(answers, tx.labelled_depth), lambda x: x.isNotNull())
    bare = F.filter(F.transform(answers, tx.bare_depth), lambda x: x.isNotNull())
    return F.coalesce(F.get(labelled, F.lit(0)), F.when(F.size(bare) == 2, F.get(bare, F.lit(1))))


def questionnaire(cells: DataFrame, labels: dict[str, Sequence[str]], key: str = "path") -> DataFrame:
    """(key, well, formation, density_ppg, tvd_ft) of each document; ``labels`` names the blocks of each, first choice first."""
    every = sorted({x for some in labels.values() for x in some})
    blocks = answer_blocks(cells, every, key)
    under = lambda x: F.max(F.when(F.col("label") == x, F.col("answers")))
    wide = blocks.groupBy(key).agg(*[under(x).alias(f"_{k}") for k, x in enumerate(every)])
    of = {x: F.col(f"_{k}") for k, x in enumerate(every)}
    pick = lambda name, rule: F.coalesce(F.lit(None), *[rule(of[x]) for x in labels.get(name, ())])
    return wide.select(key, pick("well", first_answer).alias("well"), pick("formation", first_answer).alias("formation"), pick("density", density_of).alias("density_ppg"), pick("tvd", depth_of).alias("tvd_ft"))
