"""Operators on collections of files: profiles, duplicates, folder trees, destinations and plans of moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from falloff.functions import text as tx
from falloff.operators import series as s
from falloff.plans.staging import staged

#: Fixed values of the profile's verdict.
MIN_SAMPLES, MIN_HOURS, MIN_DROP_PSI, MIN_AFTER_HOURS, MIN_DECLINE, MIN_DIFFS, KPA_ABOVE, PSI_ABOVE, KPA_PER_PSI = 50, 1.0, 50.0, 4.0, 0.6, 10, 40000.0, 100.0, 6.895


def file_profile(rows: DataFrame, windows: DataFrame | None = None, key: str = "test_id") -> DataFrame:
    """One row for each file of ``rows`` (test_id, idx, t_s, p): measures, unit guess and verdict.

    Times that are null are left out, then everything from the first step back in time. Shut-in is that of
    ``windows`` (test_id, start_idx, shutin_idx) where there is one, else the first pressure maximum.
    """
    total = rows.groupBy(key).agg(F.count("*").alias("n_all"), F.sum(F.when(s.finite(F.col("p")), 1).otherwise(0)).alias("n_finite"), F.sum(F.when(F.col("t_s").isNull(), 1).otherwise(0)).alias("no_time"))
    good = s.monotonic_prefix(rows.where(F.col("t_s").isNotNull())).withColumn("p", F.when(s.finite(F.col("p")), F.col("p")))
    if windows is not None:
        good = good.join(windows.select(key, F.col("shutin_idx").alias("_shut"), F.col("start_idx").alias("_start")), key, "left")
    else:
        good = good.withColumn("_shut", F.lit(None).cast("int")).withColumn("_start", F.lit(None).cast("int"))
    peak = F.min_by("idx", F.when(F.col("p").isNotNull(), F.struct(-F.col("p"), "idx"))).over(s.whole(key))
    good = good.withColumn("shut", F.coalesce("_shut", peak))
    after = (F.col("idx") >= F.col("shut")) & F.col("p").isNotNull()
    post = good.where(after).withColumn("diff", F.col("p") - F.lag("p").over(s.along("idx", key)))
    post = post.groupBy(key).agg(F.min("p").alias("p_low"), F.count("*").alias("n_post"), F.avg(F.when(F.col("diff").isNotNull(), F.when(F.col("diff") <= 0, 1.0).otherwise(0.0))).alias("declining"))
    at = lambda c, i: F.max(F.when(F.col("idx") == F.col(i), F.col(c)))
    per = good.groupBy(key).agg(
        F.count("p").alias("rows"), F.count("*").alias("kept"), F.max_by("t_s", "idx").alias("t1"), F.min_by("t_s", "idx").alias("t0"), F.max("p").alias("p_max"),
        at("p", "shut").alias("p_at_shutin"), at("t_s", "shut").alias("t_shut"), at("t_s", "_start").alias("t_start"), F.first("_shut").alias("_shut"),
    )
    out = total.join(per, key, "left").join(post, key, "left")
    out = out.withColumn("duration_hr", (F.col("t1") - F.col("t0")) / 3600.0).withColumn("post_shutin_hr", F.greatest((F.col("t1") - F.col("t_shut")) / 3600.0, F.lit(0.0))).withColumn("drop", F.col("p_at_shutin") - F.col("p_low"))
    out = out.withColumn("decline_fraction", F.when(F.col("n_post") > MIN_DIFFS, F.col("declining"))).withColumn("shutin_source", F.when(F.col("_shut").isNotNull(), "rate").otherwise("pressure-peak"))
    out = out.withColumn("injection_min", (F.col("t_shut") - F.col("t_start")) / 60.0).withColumn("unit_guess", unit_guess(F.col("p_max"))).withColumn("dropped", F.col("n_all") - F.col("no_time") - F.col("kept"))
    out = out.withColumn("verdict", verdict(F.col("n_finite"), F.col("duration_hr"), F.col("drop"), F.col("unit_guess"), F.col("post_shutin_hr"), F.col("decline_fraction")))
    return out.select(key, "rows", "duration_hr", "p_max", "unit_guess", "p_at_shutin", "post_shutin_hr", "drop", "decline_fraction", "shutin_source", "injection_min", "dropped", "verdict")


def unit_guess(p_max: Column) -> Column:
    return F.when(p_max > KPA_ABOVE, "kPa").when(p_max > PSI_ABOVE, "psi").otherwise("")


def verdict(n_finite: Column, hours: Column, drop: Column, unit: Column, after_hours: Column, decline: Column) -> Column:
    least = F.when(unit == "kPa", MIN_DROP_PSI * KPA_PER_PSI).otherwise(MIN_DROP_PSI)
    return F.when(n_finite < MIN_SAMPLES, "no_pressure").when(hours.isNull() | (hours < MIN_HOURS), "too_short").when(drop.isNull() | (drop < least), "flat").when(after_hours.isNull() | (after_hours < MIN_AFTER_HOURS), "short_falloff").when(decline.isNull() | (decline < MIN_DECLINE), "noisy").otherwise("likely_dfit")


def suggested_keeper(profiles: DataFrame, group: str = "group") -> DataFrame:
    """(group, path): of each group's likely records, the one with the longest falloff, the first path of equals."""
    likely = profiles.where(F.col("verdict") == "likely_dfit")
    return likely.groupBy(group).agg(F.min_by("path", F.struct(-F.col("post_shutin_hr"), "path")).alias("path"))


def content_signature(files: DataFrame, content: str = "content") -> DataFrame:
    """``sig``: size and a hash of the content; equal signatures stand for equal bytes."""
    return files.withColumn("sig", F.concat(F.octet_length(content).cast("string"), F.lit(":"), F.sha2(F.col(content).cast("binary"), 256)))


def dedup_in_group(files: DataFrame) -> DataFrame:
    """``duplicate`` and ``dup_of``: files of a group with the signature of a smaller path there."""
    low = files.groupBy("group", "sig").agg(F.min("path").alias("_low"))
    out = files.join(low, ["group", "sig"])
    return out.withColumn("duplicate", F.col("path") != F.col("_low")).withColumn("dup_of", F.when(F.col("duplicate"), F.col("_low"))).drop("_low")


def same_bytes_elsewhere(files: DataFrame) -> DataFrame:
    """(path, group, same_bytes_as): how many files, and the first, of other groups have the same signature."""
    by = files.groupBy("sig", "group").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    every = by.groupBy("sig").agg(F.sum("n").alias("all_n"), F.slice(F.array_sort(F.collect_list(F.struct("first", "group"))), 1, 2).alias("firsts"))
    out = files.join(by.select("sig", "group", "n"), ["sig", "group"]).join(every, "sig").withColumn("n_elsewhere", F.col("all_n") - F.col("n")).where("n_elsewhere > 0")
    other = F.filter("firsts", lambda x: x["group"] != F.col("group"))
    return out.select("path", "group", "n_elsewhere", F.element_at(other, 1)["first"].alias("first_elsewhere"))


def files_fingerprint(files: DataFrame) -> DataFrame:
    """(group, files_sig): hash of a group's signatures, the same for the same files in any order.

    Signatures are hashed in 65,536 parts by the head of their content hash, then the parts, so that no row holds a group.
    """
    part = F.substring(F.substring_index("sig", ":", -1), 1, 4)
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = files.groupBy("group", part.alias("_part")).agg(digest("sig").alias("_sig"))
    return parts.groupBy("group").agg(digest(F.concat_ws(":", "_part", "_sig")).alias("files_sig"))


def ancestors(paths: DataFrame, rel: str = "rel") -> DataFrame:
    """``folder``: one row for each folder from the first segment of ``rel`` down to ``rel`` itself, with its depth."""
    parts = F.split(rel, "/")
    out = paths.select("*", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    return out.withColumn("folder", F.array_join(F.slice(F.split(rel, "/"), F.lit(1), F.col("depth")), "/"))


def subtree_names(docs: DataFrame, rel: str = "rel", name: str = "name") -> DataFrame:
    """(folder, n_wells): distinct names of the documents in and under each folder; one that can't be read is its own name."""
    label = F.coalesce(F.nullif(F.regexp_replace(F.trim(F.lower(name)), r"\s+", " "), F.lit("")), F.concat(F.lit("?"), F.col("path")))
    return ancestors(docs.withColumn("_label", label), rel).groupBy("folder").agg(F.count_distinct("_label").alias("n_wells"))


def well_roots(folders: DataFrame, names: DataFrame) -> DataFrame:
    """(rel, root): the highest folder above ``rel`` that still holds one well only, below any that holds more; else itself."""
    up = ancestors(folders.select("rel").distinct()).where(F.col("folder") != F.col("rel")).join(names, "folder", "left").withColumn("n", F.coalesce("n_wells", F.lit(0)))
    stop = up.where("n > 1").groupBy("rel").agg(F.max("depth").alias("stop"))
    one = up.where("n = 1").join(stop, "rel", "left").where(F.col("stop").isNull() | (F.col("depth") > F.col("stop")))
    best = one.groupBy("rel").agg(F.min_by("folder", "depth").alias("_root"))
    return folders.select("rel").distinct().join(best, "rel", "left").select("rel", F.coalesce("_root", "rel").alias("root"))


def group_document(docs: DataFrame, rel: str = "rel") -> DataFrame:
    """(folder, path): of the documents in and under a folder, the shallowest, the first path of equals."""
    depth = F.size(F.split("path", "/"))
    return ancestors(docs, rel).groupBy("folder").agg(F.min_by("path", F.struct(depth, "path")).alias("path"))


def entries(files: DataFrame) -> DataFrame:
    """(test_id, folder, csv, dbs) from data files (folder, stem, ext, path): one entry for each stem of a folder.

    At the root an entry is its stem, alone in a folder it is the folder, else folder and stem. Of entries with
    one id the deeper folder's wins, the later of equals, and ``shadowed`` counts the others.
    """
    pair = files.where(F.col("ext").isin("csv", "dbs")).groupBy("folder", "stem").agg(F.min(F.when(F.col("ext") == "csv", F.col("path"))).alias("csv"), F.min(F.when(F.col("ext") == "dbs", F.col("path"))).alias("dbs"))
    alone = F.count("*").over(Window.partitionBy("folder")) == 1
    named = pair.withColumn("test_id", F.when(F.col("folder") == "", F.col("stem")).when(alone, F.col("folder")).otherwise(F.concat_ws("/", "folder", "stem")))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    order = Window.partitionBy("test_id").orderBy(depth.desc(), F.desc("folder"), F.desc("stem"))
    ranked = named.withColumn("_r", F.row_number().over(order)).withColumn("shadowed", F.count("*").over(Window.partitionBy("test_id")) - 1)
    return ranked.where("_r = 1").select("test_id", "folder", "csv", "dbs", "shadowed")


def attach_document(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """``document``: the first document of the entry's folder, else of its parent."""
    first = docs.groupBy("folder").agg(F.min("path").alias("path"), F.count("*").alias("n_docs"))
    parent = F.regexp_replace("folder", "/?[^/]*$", "")
    own = entries.join(first.withColumnsRenamed({"path": "_own", "n_docs": "_own_n"}), "folder", "left").withColumn("_parent", parent)
    up = first.withColumnsRenamed({"folder": "_parent", "path": "_up", "n_docs": "_up_n"})
    out = own.join(up, "_parent", "left")
    return out.withColumn("document", F.coalesce("_own", "_up")).withColumn("several", F.coalesce("_own_n", "_up_n") > 1).drop("_own", "_up", "_own_n", "_up_n", "_parent")


def basin_of(groups: DataFrame, by_formation: DataFrame, by_customer: DataFrame, default: str = "Unknown") -> DataFrame:
    """``basin`` and ``basin_source`` from lookups (key, basin): formation first, then customer, else the default.

    A formation that is listed counts even if it is listed as the default; a customer only if it is not.
    """
    f = by_formation.select(F.col("key").alias("_f"), F.col("basin").alias("_fb"))
    c = by_customer.select(F.col("key").alias("_c"), F.col("basin").alias("_cb"))
    out = groups.join(f, tx.normal_formation(F.col("formation")) == F.col("_f"), "left").join(c, tx.first_segment(F.col("rel")) == F.col("_c"), "left")
    known = F.col("_cb").isNotNull() & (F.col("_cb") != default)
    basin = F.when(F.col("_fb").isNotNull(), F.col("_fb")).when(known, F.col("_cb")).otherwise(default)
    return out.withColumn("basin", basin).withColumn("basin_source", F.when(F.col("_fb").isNotNull(), "formation").when(known, "customer").otherwise("default")).drop("_f", "_fb", "_c", "_cb")


def exclusion(n_wells: Column, decided_sig: Column, files_sig: Column) -> Column:
    return F.when(n_wells != 1, "ambiguous_well").when(decided_sig.isNull() | (decided_sig == "") | (decided_sig != files_sig), "stale_decision")


def current_status(status: Column, decided_sig: Column, files_sig: Column) -> Column:
    """A decision's status, if it was taken on the files as they are."""
    return F.when((decided_sig == files_sig) & (decided_sig != ""), status).otherwise("")


def plan_moves(groups: DataFrame, decisions: DataFrame, files: DataFrame, out: str, root: str) -> DataFrame:
    """(rel, src, dst, kind): keep, questionnaire and quarantine moves of every group whose decision can be applied.

    groups: rel, n_wells, files_sig, basin, well, questionnaire. decisions: rel, status, keeps, decided_sig. files: rel, path.
    """
    plan = groups.join(decisions, "rel").where(~F.col("status").isin("", "unsure")).where(exclusion(F.col("n_wells"), F.col("decided_sig"), F.col("files_sig")).isNull())
    plan = plan.withColumn("dest", F.concat_ws("/", F.lit(out), "basin", "well"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    keep = plan.select("rel", "dest", F.explode("keeps").alias("src")).select("rel", "src", F.concat_ws("/", "dest", base("src")).alias("dst"), F.lit("keep").alias("kind"))
    papers = plan.where((F.size("keeps") > 0) & F.col("questionnaire").isNotNull()).select("rel", F.col("questionnaire").alias("src"), F.concat_ws("/", "dest", base("questionnaire")).alias("dst"), F.lit("questionnaire").alias("kind"))
    rest = files.join(plan.select("rel", "keeps"), "rel").where(~F.array_contains("keeps", F.col("path"))).select("rel", F.col("path").alias("src"), F.concat(F.lit(f"{root}/_quarantine/"), F.col("path")).alias("dst"), F.lit("quarantine").alias("kind"))
    return keep.unionByName(papers).unionByName(rest)


def plan_warnings(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """(rel, reason): decided groups that are not planned, and decisions without a group."""
    decided = decisions.where(~F.col("status").isin("", "unsure"))
    excluded = decided.join(groups, "rel").select("rel", exclusion(F.col("n_wells"), F.col("decided_sig"), F.col("files_sig")).alias("reason")).where(F.col("reason").isNotNull())
    return excluded.unionByName(decided.join(groups, "rel", "left_anti").select("rel", F.lit("unknown_group").alias("reason")))


def _numbers_taken(names: DataFrame) -> DataFrame:
    """(stem, n): numbers that ``names`` (name) take: a name itself is 1 of its own stem, one ending in " (n)" is n of the stem before."""
    end = r"^(.*) \(([2-9]|[1-9][0-9]{1,8})\)((?:\.[^./]*)?)$"
    own = names.select(F.col("name").alias("stem"), F.lit(1).alias("n"))
    counted = names.where(F.col("name").rlike(end)).select(
        F.concat(F.regexp_extract("name", end, 1), F.regexp_extract("name", end, 3)).alias("stem"), F.regexp_extract("name", end, 2).cast("int").alias("n")
    )
    return own.unionByName(counted).distinct()


def _numbered(stem: Column, n: Column) -> Column:
    """``stem`` for 1, else with " (n)" before its extension."""
    head, tail = F.regexp_replace(stem, r"(\.[^./]*)?$", ""), F.regexp_extract(stem, r"(\.[^./]*)$", 1)
    return F.when(n == 1, stem).otherwise(F.concat(head, F.lit(" ("), n.cast("string"), F.lit(")"), tail))


def _offered(open_: DataFrame, taken: DataFrame) -> DataFrame:
    """``open_`` (src, stem, ..) with ``to``: for the r-th source of a stem, in order, the r-th name that is not taken."""
    ranked = open_.withColumn("_r", F.row_number().over(Window.partitionBy("stem").orderBy("src")))
    numbers = _numbers_taken(taken).join(open_.select("stem").distinct(), "stem", "left_semi")
    # A taken number with g free ones below it moves every rank above g on by one.
    below = F.col("n") - F.row_number().over(Window.partitionBy("stem").orderBy("n")) + 1
    both = ranked.withColumn("_moves", F.lit(0)).unionByName(numbers.select("stem", below.alias("_r"), F.lit(1).alias("_moves")), allowMissingColumns=True)
    on = F.sum("_moves").over(Window.partitionBy("stem").orderBy("_r", F.desc("_moves")).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_n", (F.col("_r") + on).cast("int")).where(F.col("_moves") == 0)
    return placed.withColumn("to", _numbered(F.col("stem"), F.col("_n"))).drop("_r", "_moves", "_n")


def separate_destinations(moves: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Moves with one destination each, and ``skipped`` where ``existing`` (path) is given.

    Of the sources for one destination the first keeps it. The others get their folder's name before it, and a number where that is
    taken too: by another move, as planned or as renamed, or by a path of ``existing``. Renaming is repeated over both until nothing
    clashes; each round settles one name at least of every clash. A move whose planned destination exists is skipped and keeps it.
    """
    moves = moves.dropDuplicates(["src", "dst"])
    if existing is not None:
        there = existing.select(F.col("path").alias("dst")).distinct().withColumn("_there", F.lit(True))
        moves = moves.join(there, "dst", "left").withColumn("skipped", F.when(F.col("_there"), F.lit("destination exists"))).drop("_there")
    names = [c for c in moves.columns if c not in ("src", "dst")]
    out = names + ["src", "dst"]
    stands = F.col("skipped").isNotNull() if existing is not None else F.lit(False)
    parts, head, base = F.split("src", "/"), F.regexp_extract("dst", "^(.*/)?", 0), F.regexp_extract("dst", "[^/]*$", 0)
    ranked = moves.withColumn("_first", stands | (F.row_number().over(Window.partitionBy("dst").orderBy("src")) == 1))
    ranked = staged(ranked.withColumn("stem", F.concat(head, F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.lit(" - "), base)), "destinations")
    done = ranked.where("_first").select(out)
    taken = done.select(F.col("dst").alias("name"))
    if existing is not None:
        taken = taken.unionByName(existing.select(F.col("path").alias("name")))
    left = ranked.where("NOT _first").select(*names, "src", "stem")
    while not left.isEmpty():
        given = _offered(left, taken).withColumn("_wins", F.row_number().over(Window.partitionBy("to").orderBy("stem", "src")) == 1)
        given = staged(given, "destinations")
        won = given.where("_wins").select(*names, "src", F.col("to").alias("dst"))
        done = done.unionByName(won)
        taken = taken.unionByName(won.select(F.col("dst").alias("name")))
        left = given.where("NOT _wins").select(*names, "src", "stem")
    return done


def merge_keeps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel, path, status, message): for each kept file the better outcome of two runs, the newer of equals."""
    rank = F.when(F.col("status") == "delivered", 2).when(F.col("status").isin("failed", "skipped"), 1).otherwise(0)
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1))).withColumn("_rank", rank)
    best = F.max_by(F.struct("status", "message"), F.struct("_rank", "_run"))
    return both.groupBy("rel", "path").agg(best.alias("b")).select("rel", "path", "b.*")


def review_progress(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """(total, decided, first_open): how far a review is; groups in the order of rel."""
    listed = groups.join(decisions, "rel", "left").withColumn("open", F.coalesce(current_status(F.col("status"), F.col("decided_sig"), F.col("files_sig")), F.lit("")) == "")
    return listed.agg(F.count("*").alias("total"), F.sum(F.when(F.col("open"), 0).otherwise(1)).alias("decided"), F.min(F.when(F.col("open"), F.col("rel"))).alias("first_open"))
