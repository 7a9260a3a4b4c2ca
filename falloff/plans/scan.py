"""A folder of gauge files to reviewed groups: listed, hashed, each different content parsed once and remembered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.operators import corpus, documents, review
from falloff.operators import series as s
from falloff.plans.staging import staged
from falloff.sources import ranges, state, workbook
from falloff.sources.files import listing, questionnaires
from falloff.sources.gauge_csv import read_csv_files
from falloff.sources.gauge_dbs import read_dbs_files

#: Raised when profiles change their meaning; older ones in a store are then not used.
PROFILE_VERSION = 1
#: Bytes of the head and of the tail that a signature covers, and the size up to which there is no tail.
HEAD, WHOLE = 256 << 10, 512 << 10
PROFILE = "sig string, error string, rows long, duration_hr double, p_max double, unit_guess string, p_at_shutin double, post_shutin_hr double, drop double, decline_fraction double, shutin_source string, injection_min double, dropped long, verdict string"


def signatures(files: DataFrame) -> DataFrame:
    """``sig`` of files (path, length): size and a hash of head and tail; one of its own for a file that can't be read."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    with ranges.opened(path) as file:
                        size = file.size()
                        digest = hashlib.blake2b(file.read(HEAD), digest_size=16)
                        if size > WHOLE:
                            file.seek(size - HEAD)
                            digest.update(file.read(HEAD))
                    found.append(f"{size}:{digest.hexdigest()}")
                except OSError:
                    found.append(f"error:{path}")
            yield batch.assign(sig=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(of, f"{schema}, sig string")


def profiles(files: DataFrame) -> DataFrame:
    """The profile of each file (path, length, ext, sig) under its sig; one that can't be parsed has the verdict ``load_error``.

    Shut-in is that of the main pumping cycle where a file has rate and volume, of the last pumping where it has rate only, else
    the pressure maximum.
    """
    columns = ["test_id", "idx", "t_s", "p", "rate", "volume", "error"]
    csv, dbs = files.where(F.col("ext") == "csv"), files.where(F.col("ext") == "dbs")
    rows = staged(read_csv_files(csv).select(columns).unionByName(read_dbs_files(dbs, with_channels=False).select(columns)), "scan-samples")
    bad = rows.where(F.col("error").isNotNull()).groupBy("test_id").agg(F.min("error").alias("error"))
    good = rows.where(F.col("error").isNull()).drop("error")
    by = good.groupBy("test_id").agg(F.count("volume").alias("volumes"))
    told = good.join(by, "test_id")
    windows = s.main_cycle(told.where("volumes > 0")).unionByName(s.injection_window(told.where("volumes = 0")))
    own = corpus.file_profile(good, windows)
    out = files.select("sig", F.col("path").alias("test_id")).join(bad, "test_id", "left").join(own, "test_id", "left")
    out = out.withColumn("verdict", F.when(F.col("error").isNotNull() | F.col("verdict").isNull(), "load_error").otherwise(F.col("verdict")))
    return out.select([F.col(f"`{c.split()[0]}`").cast(c.split()[1]) for c in PROFILE.split(", ")])


def stored(spark: SparkSession, store: str, version: int = PROFILE_VERSION) -> DataFrame:
    """Profiles that a store holds for ``version``, one for each signature; empty if there is no store."""
    path = f"{store.rstrip('/')}/profiles"
    if not state.there(spark, path):
        return spark.createDataFrame([], PROFILE)
    return spark.read.schema(f"{PROFILE}, version int").parquet(path).where(F.col("version") == version).drop("version").dropDuplicates(["sig"])


def profiled(files: DataFrame, store: str | None = None, version: int = PROFILE_VERSION) -> DataFrame:
    """Profiles of the signatures of ``files`` (path, length, ext, sig): those in the store as they are, the others parsed, one file for
    each, and added to the store. Nothing in a store is overwritten, so a smaller scan takes nothing from it; unreadable files aren't kept."""
    spark = files.sparkSession
    first = files.groupBy("sig").agg(F.min_by(F.struct("path", "length", "ext"), "path").alias("f")).select("sig", "f.*")
    if store is None:
        return staged(profiles(first), "scan-profiles")
    known = stored(spark, store, version)
    fresh = staged(first.join(known, "sig", "left_anti"), "scan-fresh")
    made = staged(profiles(fresh), "scan-profiles")
    made.where(~F.startswith("sig", F.lit("error:"))).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{store.rstrip('/')}/profiles")
    return made.unionByName(staged(known.join(first.select("sig"), "sig", "left_semi"), "scan-known"))


def scan(spark: SparkSession, root: str, labels: dict[str, Sequence[str]] | None = None, store: str | None = None, named_only: bool = False, limit: int | None = None, version: int = PROFILE_VERSION) -> DataFrame:
    """One row for each .csv and .dbs file under ``root``, in groups by well: group, path, sig, n_wells, duplicate, dup_of, n_elsewhere,
    first_elsewhere, the profile with its verdict, and suggested, the group's keeper.

    A group is the highest folder that holds files of one well by its questionnaires (``labels`` as for ``documents.questionnaire``; a
    questionnaire that can't be read counts as a well of its own). ``named_only`` and ``limit`` choose groups before any data file is opened.
    Then files are hashed, and one file of each content is parsed that ``store`` doesn't know yet. Copies in a group are ``duplicate``
    of the first path; copies in other groups are counted. A file that can't be read has a signature of its own and the verdict ``load_error``.
    An empty folder gives an empty table.
    """
    found = listing(spark, root)
    data = found.where(F.col("ext").isin("csv", "dbs"))
    papers = questionnaires(found).select("path", F.col("folder").alias("rel"))
    answers = documents.questionnaire(workbook.read_cells(spark, root).where("error is null"), labels or {"well": ["well name"]}).select("path", F.col("well").alias("name"))
    slashed = F.when(F.col("rel") == "", "").otherwise(F.concat(F.lit("/"), F.col("rel")))
    names = corpus.subtree_names(papers.join(answers, "path", "left").withColumn("rel", slashed)).withColumn("folder", F.regexp_replace("folder", "^/", ""))
    names = staged(names, "scan-names")
    roots = corpus.well_roots(data.select(F.col("folder").alias("rel")), names)
    grouped = data.join(roots.withColumnRenamed("rel", "folder"), "folder").select(F.col("root").alias("group"), "path", "length", "ext")
    groups = roots.select(F.col("root").alias("rel")).distinct().join(names.withColumnRenamed("folder", "rel"), "rel", "left").na.fill(0, ["n_wells"])
    shown = staged(review.listed_groups(groups, named_only, limit), "scan-groups")
    files = staged(signatures(grouped.join(shown.select(F.col("rel").alias("group")), "group", "left_semi")), "scan-files")
    out = review.scan(files, profiled(files, store, version), shown)
    copies = corpus.same_bytes_elsewhere(files).select("path", "group", "n_elsewhere", "first_elsewhere")
    out = out.join(copies, ["path", "group"], "left").na.fill(0, ["n_elsewhere"])
    verdict = F.when(F.col("duplicate"), "duplicate").otherwise(F.col("verdict"))
    return out.withColumn("verdict", verdict)
