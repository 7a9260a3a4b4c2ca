"""Incremental ingestion: new gauge files of a folder become samples, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from falloff.sources import gauge_csv

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_gauge_csv(spark: SparkSession, root: str, out: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Read every csv that is or comes under ``root`` and write samples (test_id, idx, t_s, p, rate, volume) under ``out``.

    A file is whole in one batch, so its times are told from all its rows. A batch that is run again after a failure
    writes its own folder anew; read ``out`` with its partition column ``batch``. Ends when all files there are read.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(root)
    rows = files.select("path", "content").mapInPandas(gauge_csv._rows, gauge_csv.ROWS)

    def write(batch: DataFrame, id: int) -> None:
        kept = batch.persist()  # each window reads the parsed rows
        gauge_csv.as_samples(gauge_csv.timed(kept)).write.mode("overwrite").parquet(f"{out}/batch={id}")
        kept.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
