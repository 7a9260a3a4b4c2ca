"""Record linkage: names against registry tables, exactly and by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from falloff.functions import text as tx
from falloff.operators import similar
from falloff.plans.staging import staged


def keyed_registry(wells: DataFrame) -> DataFrame:
    """(key, ..): wells under each name they go by: title, name and number both ways, location; null and empty ones out."""
    title, name, number, place = (F.coalesce(c, F.lit("")) for c in ("title", "name", "number", "location"))
    keys = F.array(tx.normal_name(title), tx.normal_name(F.concat(name, number)), tx.normal_name(F.concat(number, name)), tx.normal_name(place))
    return wells.withColumn("key", F.explode(F.array_distinct(F.filter(keys, lambda k: k != ""))))


def ambiguous_pick(keyed: DataFrame) -> DataFrame:
    """(key, label, n_labels): the least label under a key, and how many there are."""
    return keyed.groupBy("key").agg(F.min("label").alias("label"), F.count_distinct("label").alias("n_labels"))


def exact_match(names: DataFrame, directional: DataFrame, wells: DataFrame) -> DataFrame:
    """(name, key, label, source): directional records before wells; names too generic match nothing."""
    keyed = names.withColumn("key", tx.normal_name(F.col("name")))
    d = ambiguous_pick(directional).select("key", F.col("label").alias("_d"), F.col("n_labels").alias("_dn"))
    w = ambiguous_pick(wells).select("key", F.col("label").alias("_w"), F.col("n_labels").alias("_wn"))
    out = keyed.join(d, "key", "left").join(w, "key", "left")
    blank, generic = F.col("key").isNull() | (F.col("key") == ""), tx.generic_name(F.col("key"))
    source = F.when(blank, "no-well-name").when(generic, "name-too-generic").when(F.col("_d").isNotNull(), "directional-exact").when(F.col("_w").isNotNull(), "wells-exact").otherwise("no-match")
    label = F.when(~blank & ~generic, F.coalesce("_d", "_w"))
    n = F.when(~blank & ~generic, F.when(F.col("_d").isNotNull(), F.col("_dn")).otherwise(F.col("_wn")))
    text = F.when(n > 1, F.concat(label, F.lit(" ("), n.cast("string"), F.lit(" candidates)"))).otherwise(label)
    return out.select("name", "key", text.alias("label"), source.alias("source"))


def best_alike(names: DataFrame, keyed: DataFrame, least: float = 0.92, margin: float = 0.03, block: int = 3, far: float = 0.85, closest: int = 5) -> DataFrame:
    """(key, best, score, digits): the registry key that each name (key) is taken for, by ratio of matching blocks.

    A name is held against the keys that begin with the same ``block`` characters; if there are none, against the ``closest`` keys
    of the whole registry whose ratio to it, seen from the key, is ``far`` at least (of equal ones the later by code point). The best must
    score ``least`` and lead every other by ``margin``. digits says whether the digits differ only by what one lacks.

    Pairs come from ``similar.candidates``, complete above a ratio and without comparing all of a block. First that ratio is ``least``:
    names with none so near are done, and so are those with a runner-up too near. A name is decided there if no pair below could be its
    runner-up or, without a block, among its closest; the others are searched again with lower ratios, the last of them ``far``. Null and empty names match nothing; repeated ones count once.
    """
    names = names.select("key").where("key <> ''").distinct()
    keys = keyed.select(F.col("key").alias("other")).where("other <> ''").distinct()
    starts = keys.select(F.substring("other", 1, block).alias("_b")).distinct().withColumn("blocked", F.lit(True))
    open_ = names.withColumn("_b", F.substring("key", 1, block)).join(starts, "_b", "left").select("key", "_b", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    done = []
    for ratio in sorted({least, max(far, least - margin), far}, reverse=True):
        pairs = similar.ratios(similar.candidates(open_, keys, ratio)).join(open_, "key").where(~F.col("blocked") | F.startswith("other", F.col("_b")))
        by = Window.partitionBy("key")
        seen = pairs.withColumn("rank", F.when(~F.col("blocked"), F.row_number().over(by.orderBy(F.desc("back"), F.desc("other"))))).withColumn("sure", F.sum(F.when(F.col("back") >= ratio, 1).otherwise(0)).over(by))
        seen = seen.where(F.col("blocked") | ((F.col("rank") <= closest) & (F.col("back") >= far)))
        first = F.row_number().over(by.orderBy(F.desc("there"), "other"))
        top = seen.withColumn("r", first).withColumn("unsure", F.max(~F.col("blocked") & (F.col("back") < ratio) & (F.col("sure") < closest) & (F.col("there") >= least - margin)).over(by))
        two = top.where("r <= 2").groupBy("key").agg(
            F.max(F.when(F.col("r") == 1, F.struct("other", "there", "digits"))).alias("b"), F.max(F.when(F.col("r") == 2, F.col("there"))).alias("second"), F.max("unsure").alias("unsure")
        )
        two = staged(two.where(F.col("b.there") >= least), "alike")
        leads = F.col("second").isNull() | (F.col("b.there") - F.col("second") >= margin)
        later = F.lit(ratio > far) & (F.col("unsure") | leads & (F.col("b.there") - margin < ratio) & F.lit(ratio > least - margin))
        settled = leads & ~later
        done.append(two.where(settled).select("key", F.col("b.other").alias("best"), F.col("b.there").alias("score"), F.col("b.digits").alias("digits")))
        left = two.where(later).select("key")
        if ratio == far or not left.take(1):
            break
        open_ = staged(open_.join(left, "key"), "alike-open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fuzzy_match(names: DataFrame, keyed: DataFrame, least: float = 0.92, margin: float = 0.03, block: int = 3) -> DataFrame:
    """(key, best, score, match): the key each name is taken for (``best_alike``), its score to three places; where digits were
    replaced the match is a ``sibling``, else ``fuzzy``."""
    found = best_alike(names, keyed, least, margin, block)
    return found.select("key", "best", F.round("score", 3).alias("score"), F.when(F.col("digits"), "fuzzy").otherwise("sibling").alias("match"))


def _pick(records: DataFrame, key: str, label: str = "label") -> DataFrame:
    """The record of the least label under each key, and n, how many different labels are there."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(label, *[c for c in rest if c != label])).alias("r"), F.count_distinct(label).alias("n")).select(key, "r.*", "n")


def resolve(names: DataFrame, directional: DataFrame, wells: DataFrame) -> DataFrame:
    """(name, db_name, label, operator, surf_lat, surf_lon, btmh_lat, btmh_lon, source, score) for every different name.

    directional: label, operator, name, lat, lon (bottomhole). wells: api, label, operator, title, name, number, location, lat, lon (surface);
    ``keyed_registry`` says under which keys a well goes. A chain: blank and generic names are told at once; exact keys,
    directional before wells, come from joins; only the different keys still unmatched go to ``best_alike``, and all are joined
    back. Where a key's records have several labels the least is taken and the source says how many there were. A directional
    record's surface place is its well's by api key; a well's bottomhole is the directional record of its api key with the same label, else
    the least label, the larger number of candidates being told. A sibling, whose digits differ, keeps the surface place
    and gets no bottomhole. Null labels count as empty; equal records under one label are ordered by their other columns.
    """
    dirs = directional.select(F.coalesce("label", F.lit("")).alias("label"), "operator", "name", "lat", "lon").withColumn("key", tx.normal_name(F.col("name"))).withColumn("api", tx.api_key(F.col("label")))
    d_by_key = _pick(dirs.where("key <> ''").drop("api"), "key")
    well = wells.select("api", F.coalesce("label", F.lit("")).alias("label"), "operator", "title", "name", "number", "location", "lat", "lon")
    w_by_key = _pick(keyed_registry(well).drop("number", "location"), "key")
    place = well.where("api <> ''").groupBy("api").agg(F.min_by(F.struct(F.col("lat").alias("surf_lat"), F.col("lon").alias("surf_lon")), F.struct("label", "title", "lat", "lon")).alias("p"))

    asked = names.select("name").distinct().withColumn("key", tx.normal_name(F.col("name")))
    blank = F.col("name").isNull() | (F.trim("name") == "")
    asked = asked.withColumn("said", F.when(blank, "no-well-name").when(F.col("key").isNull() | tx.generic_name(F.col("key")), "name-too-generic"))
    keys = staged(asked.where("said is null").select("key").distinct(), "resolve-keys")
    d_keys, w_keys = d_by_key.select("key"), w_by_key.select("key")
    d_exact = keys.join(d_keys, "key", "left_semi").select("key", F.col("key").alias("found"), F.lit("directional-exact").alias("how"), F.lit(1.0).alias("score"))
    rest = keys.join(d_keys, "key", "left_anti")
    w_exact = rest.join(w_keys, "key", "left_semi").select("key", F.col("key").alias("found"), F.lit("wells-exact").alias("how"), F.lit(1.0).alias("score"))
    alike = best_alike(rest.join(w_keys, "key", "left_anti"), d_keys.union(w_keys)).join(d_keys.select(F.col("key").alias("best"), F.lit(True).alias("_d")), "best", "left")
    how = F.concat(F.when(F.col("_d"), "directional").otherwise("wells"), F.when(F.col("digits"), "-fuzzy").otherwise("-sibling"))
    found = d_exact.unionByName(w_exact).unionByName(alike.select("key", F.col("best").alias("found"), how.alias("how"), F.round("score", 3).alias("score")))

    sibling = F.endswith("how", F.lit("-sibling"))
    by_d = found.where(F.startswith("how", F.lit("directional"))).join(d_by_key.withColumnRenamed("key", "found"), "found").withColumn("api", tx.api_key(F.col("label"))).join(place, "api", "left")
    by_d = by_d.select("key", F.col("name").alias("db_name"), "label", "operator", "p.surf_lat", "p.surf_lon", F.when(~sibling, F.col("lat")).alias("btmh_lat"), F.when(~sibling, F.col("lon")).alias("btmh_lon"), "how", "score", "n")
    by_w = found.where(F.startswith("how", F.lit("wells"))).join(w_by_key.withColumnRenamed("key", "found"), "found")
    holes = dirs.where("api is not null").select(F.col("api").alias("_api"), F.col("label").alias("d_label"), "lat", "lon")
    chosen = by_w.select("key", "label", "api").where(F.col("api") != "").join(holes, F.col("api") == F.col("_api")).groupBy("key").agg(
        F.min_by(F.struct("lat", "lon"), F.struct(F.col("d_label") != F.col("label"), "d_label", "lat", "lon")).alias("h"), F.max(F.col("d_label") == F.col("label")).alias("same"), F.count_distinct("d_label").alias("d_n")
    )
    by_w = by_w.join(chosen, "key", "left").withColumn("n", F.greatest("n", F.when(~sibling & ~F.col("same"), F.col("d_n")).otherwise(0)))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), "name")
    by_w = by_w.select("key", title.alias("db_name"), "label", "operator", F.col("lat").alias("surf_lat"), F.col("lon").alias("surf_lon"), F.when(~sibling, F.col("h.lat")).alias("btmh_lat"), F.when(~sibling, F.col("h.lon")).alias("btmh_lon"), "how", "score", "n")
    all_ = by_d.unionByName(by_w)
    suffix = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" candidates)"))).otherwise("")
    out = asked.join(all_, "key", "left").withColumn("source", F.coalesce("said", F.concat("how", suffix), F.lit("no-match")))
    return out.select("name", "db_name", "label", "operator", "surf_lat", "surf_lon", "btmh_lat", "btmh_lon", "source", "score")


def located_rows(entries: DataFrame, documents: DataFrame, directional: DataFrame, wells: DataFrame) -> DataFrame:
    """One row for each entry (test_id, document) with what its questionnaire's well name resolves to (``resolve``).

    documents: path, well, error. An entry without a document is ``no-questionnaire``, one whose document couldn't be read
    ``questionnaire-error``. Each different name is resolved once.
    """
    papers = documents.select(F.col("path").alias("document"), "well", "error", F.lit(True).alias("_read"))
    out = entries.select("test_id", "document").join(papers, "document", "left")
    early = F.when(F.col("document").isNull(), "no-questionnaire").when(F.col("_read").isNull() | F.col("error").isNotNull(), "questionnaire-error")
    out = out.withColumn("_early", early).withColumn("well_name", F.when(early.isNull(), F.col("well")))
    found = resolve(out.where("_early is null").select(F.col("well_name").alias("name")), directional, wells).withColumnRenamed("name", "_name")
    out = out.join(found, F.col("_early").isNull() & F.col("well_name").eqNullSafe(F.col("_name")), "left")
    return out.select("test_id", "well_name", "db_name", "label", "operator", "surf_lat", "surf_lon", "btmh_lat", "btmh_lon", F.coalesce("_early", "source").alias("source"), "score")


def surface_of_directional(directional: DataFrame, wells: DataFrame) -> DataFrame:
    """Directional records with the surface place of the well of the same api key, the first label of several."""
    place = wells.withColumn("api_key", tx.api_key(F.col("label"))).groupBy("api_key").agg(F.min_by(F.struct("lat", "lon"), "label").alias("p"))
    return directional.withColumn("api_key", tx.api_key(F.col("label"))).join(place, "api_key", "left").select(*directional.columns, F.col("p.lat").alias("surface_lat"), F.col("p.lon").alias("surface_lon"))


def bottomhole_of_well(wells: DataFrame, directional: DataFrame) -> DataFrame:
    """Wells with the label of the directional record of the same api key: that of the same label, else the least."""
    d = directional.select(tx.api_key(F.col("label")).alias("api_key"), F.col("label").alias("d_label"))
    both = wells.withColumn("api_key", tx.api_key(F.col("label"))).join(d, "api_key", "left")
    pick = F.min_by("d_label", F.struct(F.col("d_label") != F.col("label"), "d_label"))
    return both.groupBy("label").agg(pick.alias("bottomhole"))
