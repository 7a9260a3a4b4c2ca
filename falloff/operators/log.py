"""The results log: status of a test, inferred steps, rows, keyed upsert, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six steps, and the meaning of a postclosure scenario's prefix.
STEPS = ("overview", "isip", "gfunction", "tangent", "loglog", "porepressure")


def pore_pressure_skipped(postclosure: Column) -> Column:
    return F.coalesce(postclosure.startswith("PC-F"), F.lit(False))


def status(explicit: Column, steps: Column, postclosure: Column) -> Column:
    """new, in_progress, skipped or done, from the map of step states; a test without picks has no map."""
    auto = pore_pressure_skipped(postclosure)
    state = lambda k: F.try_element_at(steps, F.lit(k))
    any_step, all_in, user_skip = F.lit(False), F.lit(True), F.lit(False)
    for k in STEPS:
        own = auto if k == "porepressure" else F.lit(False)
        any_step = any_step | F.coalesce(state(k).isNotNull(), F.lit(False))
        all_in = all_in & (own | F.coalesce(state(k).isin("done", "skipped"), F.lit(False)))
        user_skip = user_skip | (~own & F.coalesce(state(k) == "skipped", F.lit(False)))
    return F.when(steps.isNull(), "new").when(explicit == "skipped", "skipped").when(~any_step, "new").when(~all_in, "in_progress").when(user_skip, "skipped").otherwise("done")


def inferred_steps(picks: dict[str, Column]) -> Column:
    """Map of the steps whose defining picks are there, each ``done``; keys of ``picks`` are the steps."""
    pairs = F.filter(F.array(*[F.when(present, F.struct(F.lit(k).alias("key"), F.lit("done").alias("value"))) for k, present in picks.items()]), lambda x: x.isNotNull())
    return F.map_from_entries(pairs)


def step_gate(step: Column, closure: Column, postclosure: Column) -> Column:
    """What must be chosen before going on from a step; null if nothing."""
    blank = lambda c: c.isNull() | (c == "")
    return F.when((step == "gfunction") & blank(closure), "closure scenario").when((step == "loglog") & blank(postclosure), "postclosure scenario")


def upsert(log: DataFrame, rows: DataFrame, key: str = "test_id") -> DataFrame:
    """``log`` with ``rows`` in place of its rows of the same key, and those of new keys; columns as in ``log``."""
    kept = log.join(rows.select(key), key, "left_anti").select(log.columns)
    return kept.unionByName(rows, allowMissingColumns=True).select(log.columns)


def orphans(log: DataFrame, entries: DataFrame, key: str = "test_id") -> DataFrame:
    return log.join(entries.select(key), key, "left_anti")


def queue_progress(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.sum(F.when(F.col("status").isin("done", "skipped"), 1).otherwise(0)).alias("finished"))


def next_new(entries: DataFrame, current: int) -> DataFrame:
    """(ord): the next entry after ``current`` that is new, around the end; entries have ord from 0."""
    total = entries.agg(F.count("*").alias("n"))
    turn = F.pmod(F.col("ord") - current - 1, F.col("n"))
    return entries.join(F.broadcast(total)).where(F.col("status") == "new").agg(F.min_by("ord", turn).alias("ord"))


#: Quality and trend by the prefix of a scenario.
CLOSURE_QUALITY = {"C-A": "clear", "C-B": "adequate", "C-C": "no-contact", "C-D": "rapid"}
POSTCLOSURE_TREND = {"PC-A": "linear", "PC-B": "false-radial", "PC-C": "mixed", "PC-D": "mixed", "PC-E": "none", "PC-F": "none"}


def by_prefix(scenario: Column, words: dict[str, str]) -> Column:
    """The word of the prefix that ``scenario`` has; empty if it has none."""
    out = F.lit("")
    for head, word in words.items():
        out = F.when(scenario.startswith(head), word).otherwise(out)
    return out


def low_confidence(postclosure: Column) -> Column:
    return F.when(postclosure.startswith("PC-E") | postclosure.startswith("PC-F"), "low").otherwise("")


def log_row(results: DataFrame) -> DataFrame:
    """The log's 45 columns from interpretation results; what ``results`` lacks of a test's description is null.

    Descriptions are file, well_name, formation, status, interpreter, review_date, is_bhp, tvd_ft, mw_ppg, t_start_inj, notes;
    pressures count as WHP where is_bhp is false. Times in seconds go to minutes; orientation, fluid and play are left to the reader.
    """
    has = lambda c, kind: (F.col(c) if c in results.columns else F.lit(None)).cast(kind)
    closure, post = F.coalesce("closure_scenario", F.lit("")), F.coalesce("postclosure_scenario", F.lit(""))
    minutes = {f"closure_time_{m}_min": F.col(f"closure_time_{m}") / 60.0 for m in ("compliance", "tangent", "variable")}
    columns = {
        "file": has("file", "string"), "test_id": F.col("test_id"), "well_name": has("well_name", "string"), "formation": has("formation", "string"), "status": has("status", "string"),
        "interpreter": has("interpreter", "string"), "review_date": has("review_date", "date"), "orientation": F.lit(""), "fluid_type": F.lit(""), "play": F.lit(""),
        "pressure_source": F.when(has("is_bhp", "boolean"), "BHP").when(~has("is_bhp", "boolean"), "WHP"), "tvd": has("tvd_ft", "double"), "fluid_density": has("mw_ppg", "double"), "t_start_inj": has("t_start_inj", "double"),
        "t_shutin": F.col("t_shutin"), "te": F.col("te"), "Vinj": F.col("vinj"), "max_rate": F.col("qmax"), "apparent_ISIP": F.col("apparent_isip"), "effective_ISIP": F.col("eff_isip_compliance"),
        "closure_scenario": closure, "closure_quality": by_prefix(closure, CLOSURE_QUALITY), "contact_pressure": F.col("pressure_compliance"), "Shmin_compliance": F.col("shmin_compliance"),
        "Shmin_tangent": F.col("shmin_tangent"), "tangent_Gc": F.col("closure_G"), "postclosure_scenario": post, "postclosure_trend": by_prefix(post, POSTCLOSURE_TREND),
        "pore_pressure": F.col("pore_pressure"), "pp_axis": has("pp_axis", "string"), "pp_confidence": low_confidence(post), "net_pressure_compliance": F.col("net_pressure_compliance"),
        "net_pressure_tangent": F.col("net_pressure_tangent"), "delta_closure": F.col("delta_closure"), "notes": has("notes", "string"), "effective_ISIP_tangent": F.col("eff_isip_tangent"),
        "effective_ISIP_variable": F.col("eff_isip_variable"), "Shmin_variable": F.col("shmin_variable"), "Shmin_rapid": F.col("shmin_rapid"), "net_pressure_variable": F.col("net_pressure_variable"), **minutes,
        "net_pressure_isip_source": F.col("net_pressure_source"), "near_wellbore_complexity": F.col("complexity"),
    }
    return results.select(*[value.alias(name) for name, value in columns.items()])
