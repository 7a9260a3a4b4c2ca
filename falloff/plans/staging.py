"""Tables between the steps of a long plan, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back, so that later steps neither repeat nor re-plan what made it."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="falloff-")  # only where no folder is set, as in tests
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
