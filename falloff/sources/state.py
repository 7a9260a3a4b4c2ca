"""Persisted state: picks and decisions as JSON, the results log as CSV, with missing and unknown columns tolerated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PICKS = "test_id string, start_idx long, shutin_idx long, qmax_bpm double, isip_x double, isip_y double, isip_slope double, contact_G double, closure_G double, min_dpdg_G double, closure_scenario string, postclosure_scenario string, pp_lo double, pp_hi double, pp_axis string, resample_step double, step_status map<string,string>, status string"
LEDGER = "rel string, keeps array<string>, status string, ts timestamp, files_sig string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents under ``path`` by ``schema``: unknown keys dropped, missing ones null, those that can't be read left out."""
    known = StructType.fromDDL(schema)
    rows = spark.read.schema(known.add("_corrupt", "string")).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def migrated(picks: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Picks of older versions: old scenario labels by their new names, an explicit "done" is no status, null scenarios are blank."""
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")
    new = lambda c: F.coalesce(F.try_element_at(named, F.col(c)), F.col(c), F.lit(""))
    return picks.withColumn("closure_scenario", new("closure_scenario")).withColumn("postclosure_scenario", new("postclosure_scenario")).withColumn("status", F.when(F.col("status") != "done", F.col("status")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_actions(actions: DataFrame, path: str) -> None:
    """Add timed actions (rel, keeps, status, files_sig, and ts if they have it, else now) to a ledger.

    Each call writes a folder of its own, so appends at the same time lose nothing and nothing is rewritten.
    """
    timed = actions if "ts" in actions.columns else actions.withColumn("ts", F.current_timestamp())
    timed.write.json(f"{path.rstrip('/')}/{uuid.uuid4().hex}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The latest action on each group (rel): by ts, the greater status and keeps of equal times; empty if there is no ledger.

    Unknown columns are dropped, missing ones null; rows that can't be read are left out.
    """
    known = StructType.fromDDL(LEDGER)
    if not there(spark, path):
        return spark.createDataFrame([], known)
    rows = spark.read.schema(known.add("_corrupt", "string")).option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rest = ["status", "keeps", "files_sig"]
    last = F.max_by(F.struct("ts", *rest), F.struct("ts", *rest)).alias("last")
    return rows.where(F.col("_corrupt").isNull() & F.col("rel").isNotNull()).groupBy("rel").agg(last).select("rel", "last.keeps", "last.status", "last.ts", "last.files_sig")


def compact_ledger(spark: SparkSession, path: str, to: str) -> None:
    """Write a ledger's latest actions as one new ledger; the old one is left as it is."""
    append_actions(read_ledger(spark, path), to)


def there(spark: SparkSession, path: str) -> bool:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)


def read_log(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The log's ``columns`` (name: type); those the file lacks are null, test_id stays a string; empty if there is no log."""
    rows = spark.read.option("header", "true").csv(path) if there(spark, path) else spark.createDataFrame([], "test_id string")
    value = lambda c, kind: F.col(f"`{c}`").try_cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    return rows.select(*[value(c, kind).alias(c) for c, kind in columns.items()])


def write_log(log: DataFrame, path: str) -> None:
    """One CSV folder with a header, put in place by the commit protocol."""
    log.write.mode("overwrite").option("header", "true").csv(path)
