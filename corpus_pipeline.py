"""The corpus pipeline: language, lines, near duplicates, mixture, pieces; each stage written as Parquet and read again.

The stages that send text to Python shorten the session's Arrow batches (``short_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.llm import langid, lines, mixing, ngram_join, pieces
from falloff.llm.common import cut, drop_cut, short_batches
from falloff.llm.queries import vocabulary


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars counted anew where it is one of them."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without text or letters, or told with a score under 0.4, go.

    Whole texts are read, slice by slice; repeated rows stay or go together; other columns are kept, whatever their names.
    """
    short_batches(spark)
    return langid.keep_known(docs).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source.

    A null text stays null, one of such lines alone becomes empty; repeated rows lose the same lines; very long texts are split by lines
    like others; columns named like the operator's own are given back as they were.
    """
    return _columns(lines.drop_boilerplate(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, and every other document."""
    short_batches(spark)
    return ngram_join.keep_first(docs).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice.

    Rows that repeat id and text are taken alike; a very long text is one document with its size in words; one without
    words is as often there as its source's certain copies say; a null source is a source. Other columns are kept, whatever their names.
    """
    out = mixing.mix(docs).where(F.col("copies") > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, part, n_chars, n_ids, ids, exact): the pieces of every document, a giant one in parts in order.

    Repeated rows are encoded each; a null text has one part with null ids; other columns are left out.
    """
    short_batches(spark)
    return pieces.encode(docs, vocabulary()).select("doc_id", "part", "n_chars", "n_ids", "ids", "exact")


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("pieces", tokens),
]

#: Hashes of the mixture and of pieces aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
