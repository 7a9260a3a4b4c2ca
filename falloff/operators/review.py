"""Reviews of groups of files: which groups are shown, what is kept, what becomes of the keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from falloff.operators import corpus, log

#: Fixed value: panels on one page of a review.
PER_PAGE = 8


def under(path: Column, ancestor: Column) -> Column:
    """Whether ``path`` is ``ancestor`` or anything below it; the empty path is above all."""
    return (ancestor == "") | (path == ancestor) | path.startswith(F.concat(ancestor, F.lit("/")))


def strictly_under(path: Column, ancestor: Column) -> Column:
    return under(path, ancestor) & (path != ancestor)


def subfolder(folder: Column, group: Column) -> Column:
    """``folder`` as seen from the folder of its group; empty for that folder itself."""
    return F.when(folder == group, "").when(group == "", folder).when(under(folder, group), F.substr(folder, F.length(group) + 2))


def listed_groups(groups: DataFrame, named_only: bool = False, limit: int | None = None) -> DataFrame:
    """Groups (rel, n_wells) of a scan in the order of rel.

    ``named_only`` keeps those with a questionnaire; ``limit``, for trial scans, keeps the first ones before any file is read.
    """
    shown = (groups.where(F.coalesce("n_wells", F.lit(0)) >= 1) if named_only else groups).orderBy("rel")
    return shown if limit is None else shown.limit(limit)


def scan(files: DataFrame, profiles: DataFrame, groups: DataFrame, named_only: bool = False, limit: int | None = None) -> DataFrame:
    """One row for each file of the groups shown: its profile, its copies, and whether it is the suggested keeper.

    files: group, path, sig. profiles: sig, verdict, post_shutin_hr, once for each signature, so equal bytes are profiled
    once. groups: rel, n_wells. A file whose signature has no profile has the verdict ``load_error``.
    """
    shown = listed_groups(groups, named_only, limit).select(F.col("rel").alias("group"), "n_wells")
    rows = corpus.dedup_in_group(files.join(shown, "group")).join(profiles, "sig", "left").withColumn("verdict", F.coalesce("verdict", F.lit("load_error")))
    best = corpus.suggested_keeper(rows.where(~F.col("duplicate"))).select("group", F.col("path").alias("_best"))
    return rows.join(best, "group", "left").withColumn("suggested", F.coalesce(F.col("path") == F.col("_best"), F.lit(False))).drop("_best")


def pages(files: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """``page`` and ``panel`` of each file of a group (both from 0, by path), and the group's ``n_pages``."""
    at = F.row_number().over(Window.partitionBy("group").orderBy("path")) - 1
    out = files.withColumn("_at", at).withColumn("page", F.floor(F.col("_at") / per_page)).withColumn("panel", (F.col("_at") % per_page).cast("long"))
    return out.withColumn("n_pages", F.max("page").over(Window.partitionBy("group")) + 1).drop("_at")


def seeded_keeps(groups: DataFrame, decisions: DataFrame, in_progress: DataFrame, suggested: DataFrame) -> DataFrame:
    """(rel, keeps, seed): what a reviewer sees chosen at first.

    A current decision's keeps, even none; else those of an unfinished review; else the suggested file. groups: rel,
    files_sig. decisions: rel, status, keeps, decided_sig. in_progress: rel, keeps. suggested: group, path.
    """
    said = decisions.select("rel", "status", "decided_sig", F.col("keeps").alias("_said"))
    begun = in_progress.select("rel", F.col("keeps").alias("_begun"))
    first = suggested.select(F.col("group").alias("rel"), F.array("path").alias("_first"))
    out = groups.join(said, "rel", "left").join(begun, "rel", "left").join(first, "rel", "left")
    current = F.coalesce(corpus.current_status(F.col("status"), F.col("decided_sig"), F.col("files_sig")), F.lit("")) != ""
    none = F.array().cast("array<string>")
    keeps = F.when(current, F.coalesce("_said", none)).otherwise(F.coalesce("_begun", "_first", none))
    seed = F.when(current, "decision").when(F.col("_begun").isNotNull(), "in_progress").when(F.col("_first").isNotNull(), "suggested").otherwise("none")
    return out.select("rel", keeps.alias("keeps"), seed.alias("seed"))


def decide(decisions: DataFrame, actions: DataFrame, groups: DataFrame) -> DataFrame:
    """``decisions`` (rel, status, keeps, decided_sig) after actions (rel, action, keeps, and ts where a group has several).

    Of the actions on a group that record anything the last by ts counts, of equal ones the greater. ``accept`` records its keeps, unless there are none; ``none`` records no keeps; ``unsure`` keeps what is chosen. Anything
    else, and actions on groups that aren't there, record nothing. Decisions carry the signature of the group's files.
    """
    status = F.when((F.col("action") == "accept") & (F.size("keeps") > 0), "decided").when(F.col("action") == "none", "none").when(F.col("action") == "unsure", "unsure")
    made = actions.join(groups.select("rel", F.col("files_sig").alias("decided_sig")), "rel").withColumn("status", status).where(F.col("status").isNotNull())
    keeps = F.when(F.col("status") == "none", F.array().cast("array<string>")).otherwise(F.array_sort("keeps"))
    order = ["ts"] if "ts" in actions.columns else []
    made = made.withColumn("keeps", keeps).groupBy("rel").agg(F.max_by(F.struct("status", "keeps", "decided_sig"), F.struct(*order, "status", "keeps")).alias("m")).select("rel", "m.*")
    return decisions.select(made.columns).join(made, "rel", "left_anti").unionByName(made)


def provenance(moves: DataFrame, outcomes: DataFrame, groups: DataFrame) -> DataFrame:
    """(dest, rel, well, basin, basin_source, path, status, dst, message): what became of every file meant to be kept.

    moves: rel, src, dst, kind. outcomes: src, status, message. A keep without an outcome is ``unknown``. A destination fed by
    several groups has rows of each.
    """
    keeps = moves.where(F.col("kind") == "keep").select("rel", F.col("src").alias("path"), "dst")
    done = outcomes.select(F.col("src").alias("path"), "status", "message")
    out = keeps.join(done, "path", "left").join(groups.select("rel", "well", "basin", "basin_source"), "rel", "left").withColumn("dest", F.regexp_replace("dst", "/[^/]*$", ""))
    state = F.coalesce("status", F.lit("unknown"))
    return out.select("dest", "rel", "well", "basin", "basin_source", "path", state.alias("status"), F.when(state == "delivered", F.col("dst")).alias("dst"), F.when(state.isin("failed", "skipped"), F.col("message")).alias("message"))


def failures(moves: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(kind, src, dst, error): moves that failed; empty if none did."""
    return moves.join(outcomes.where(F.col("status") == "failed").select("src", F.col("message").alias("error")), "src").select("kind", "src", "dst", "error")


def queue(entries: DataFrame, picks: DataFrame) -> DataFrame:
    """Entries (test_id, csv, dbs) with their status by picks (test_id, status, steps, postclosure_scenario, active_source),
    label, sources at hand (CSV before DBS) and the one to open: the saved one if it is there, else the first."""
    saved = picks.select("test_id", F.col("status").alias("_said"), F.col("steps").alias("_steps"), F.col("postclosure_scenario").alias("_post"), F.lower("active_source").alias("_active"))
    out = entries.join(saved, "test_id", "left")
    sources = F.filter(F.array(F.when(F.col("csv").isNotNull(), "CSV"), F.when(F.col("dbs").isNotNull(), "DBS")), lambda x: x.isNotNull())
    out = out.withColumn("status", log.status(F.col("_said"), F.col("_steps"), F.col("_post"))).withColumn("sources", sources).withColumn("display_label", F.replace(F.col("test_id").cast("string"), F.lit("/"), F.lit(" / ")))
    own = F.filter("sources", lambda x: F.lower(x) == F.col("_active"))
    source = F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at("sources", F.lit(1)))
    out = out.withColumn("source", source).withColumn("data_path", F.when(F.col("source") == "CSV", F.col("csv")).when(F.col("source") == "DBS", F.col("dbs")))
    return out.drop("_said", "_steps", "_post", "_active")
