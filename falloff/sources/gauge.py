"""Gauge records of any known kind under a folder, as one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.sources.gauge_csv import read_gauge_csv
from falloff.sources.gauge_dbs import read_gauge_dbs

COLUMNS = ["test_id", "path", "idx", "ts", "t_s", "p", "rate", "volume", "p_is_bhp", "channels", "error"]


def read_gauge(spark: SparkSession, root: str) -> DataFrame:
    """Samples of every .csv and .dbs file under ``root``, told apart by extension; a file that can't be read is one row with its error."""
    return read_gauge_csv(spark, root).select(COLUMNS).unionByName(read_gauge_dbs(spark, root).select(COLUMNS))


def list_tests(rows: DataFrame) -> DataFrame:
    """(test_id, samples, seconds, error, channels) of each file of ``read_gauge``, by test_id: what there is to choose from."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("channels")))))
    return rows.groupBy("test_id").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("samples"), F.max("t_s").alias("seconds"), F.first("error", ignorenulls=True).alias("error"), names.alias("channels")).orderBy("test_id")
