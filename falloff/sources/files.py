"""Listings of folders of files, as DataFrames; contents are read only where a plan asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are the tool's own and never hold records.
PRUNED = ("_triage", "_quarantine")


def listing(spark: SparkSession, root: str, pattern: str | None = None, content: bool = False) -> DataFrame:
    """(path, rel, folder, stem, ext, length[, content]) of all files under ``root``; rel and folder are below it.

    Files in pruned folders, in folders that end in " DFIT plots" and lock files ("~$..") are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    rel = F.regexp_replace("path", rf"^.*?\Q{top}\E/", "")
    files = reader.load(root).withColumn("rel", rel)
    name = F.element_at(F.split("rel", "/"), -1)
    files = files.withColumn("folder", F.regexp_replace("rel", "/?[^/]*$", "")).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).withColumn("ext", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))
    own = F.exists(F.split("folder", "/"), lambda x: x.isin(*PRUNED) | x.endswith(" DFIT plots"))
    columns = ["path", "rel", "folder", "stem", "ext", "length", *(["content"] if content else [])]
    return files.where(~own & ~name.startswith("~$")).select(columns)


def questionnaires(files: DataFrame) -> DataFrame:
    """The workbooks of a listing that are questionnaires by name."""
    return files.where((F.col("ext") == "xlsx") & F.contains(F.lower("stem"), F.lit("questionnaire")))
