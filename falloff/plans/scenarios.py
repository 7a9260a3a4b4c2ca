"""Contact picks that follow from a closure scenario, for all tests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from falloff.operators import series as s

KEY = s.KEY


def _is(*heads: str) -> Column:
    return F.coalesce(F.substring("closure_scenario", 1, 3).isin(*heads), F.lit(False))


def _found(diag: DataFrame, picks: DataFrame, refresh: bool, rise: float = 0.10) -> DataFrame:
    """``picks`` after their scenario, as ``scenario_contacts`` has them, with ``_n``, ``_low`` and ``_hump`` of their tests.

    Rows of ``diag`` are sorted once and meet their pick in one join; what each rule looks up are windows over the test, so
    that a task holds one copy of its tests, whatever the number of rules.
    """
    rows = s.peaks(s.dips(diag.select(KEY, "i", "G", "dPdG", "d2PdG2"))).withColumn("_n", F.count("*").over(s.whole())).withColumn("_low", s.deepest(s.whole())["G"])
    ruled = _is("C-A", "C-B") & F.coalesce(F.col("_n") >= 3, F.lit(False))
    anew = F.col("_low") if refresh else F.lit(None)
    picked = F.when(_is("C-A"), F.coalesce(anew, "min_dpdg_G", "_low")).otherwise(F.coalesce("min_dpdg_G", "_low"))

    rows = rows.join(picks.select(KEY, "closure_scenario", "min_dpdg_G"), KEY).withColumn("_at", picked)
    apart = F.abs(F.col("G") - F.col("_at"))
    rows = rows.withColumn("_from", F.min_by(F.struct("i", "dPdG"), F.when(ruled & _is("C-A"), F.struct(F.round(apart, 9), "i"))).over(s.whole()))
    risen = ruled & _is("C-A") & (F.col("i") > F.col("_from.i")) & (F.col("dPdG") >= F.col("_from.dPdG") * (1 + rise))
    per = rows.groupBy(KEY).agg(
        F.first("_n").alias("_n"), F.first("_low").alias("_low"),
        F.max_by("G", F.when(F.col("dPdG").isNotNull(), F.struct(F.col("dPdG"), -F.col("i")))).alias("_hump"),
        F.min_by("G", F.when(risen, F.col("i"))).alias("_clear"),
        F.min_by("G", F.when(ruled & _is("C-B") & F.col("_peak"), F.struct(apart, "i"))).alias("_bend"),
    )
    out = picks.join(per, KEY, "left").withColumn("_ruled", ruled)
    out = out.withColumn("min_dpdg_G", F.when(F.col("_ruled"), picked).otherwise(F.col("min_dpdg_G"))).withColumn("_contact", F.when(_is("C-A"), F.col("_clear")).otherwise(F.col("_bend")))
    missed = F.col("_ruled") & F.col("_contact").isNull()
    hint = F.when(missed & _is("C-A"), "no rise after the minimum").when(missed, "no inflection")
    contact = F.when(_is("C-C", "C-D"), F.lit(None)).otherwise(F.coalesce("_contact", "contact_G"))
    return out.withColumn("contact_G", contact).withColumn("hint", hint).drop("_clear", "_bend", "_ruled", "_contact")


def scenario_contacts(diag: DataFrame, picks: DataFrame, refresh: bool = False) -> DataFrame:
    """``picks`` (test_id, closure_scenario, min_dpdg_G, contact_G) after their scenario was chosen, with ``hint``.

    By the scenario's prefix: C-A takes the first rise after the row nearest to the minimum pick, C-B the inflection nearest
    to it, C-C and C-D have no contact; a blank one leaves all as it is. A minimum that isn't picked yet is suggested
    first; ``refresh`` suggests that of C-A anew. Where a rule finds nothing the contact stays and ``hint`` says so.
    Tests with fewer than three diagnostic rows stay as they are.
    """
    return _found(diag, picks, refresh).drop("_n", "_low", "_hump")


def reset_contacts(diag: DataFrame, picks: DataFrame) -> DataFrame:
    """``picks`` as their scenario would suggest them anew, with ``hint``; what was dragged by hand is given up.

    A blank scenario takes the minimum of dP/dG and its hump again, where a test has more than five diagnostic rows; C-A its
    minimum and contact; C-B its contact, the minimum stays where there is one; C-C and C-D lose the contact.
    """
    out = _found(diag, picks, refresh=True)
    blank = (F.coalesce("closure_scenario", F.lit("")) == "") & F.coalesce(F.col("_n") > 5, F.lit(False))
    for pick, new in (("min_dpdg_G", "_low"), ("contact_G", "_hump")):
        out = out.withColumn(pick, F.when(blank, F.coalesce(new, pick)).otherwise(F.col(pick)))
    return out.drop("_n", "_low", "_hump")


def move_isip(samples: DataFrame, picks: DataFrame, edits: DataFrame, half: int = 30) -> DataFrame:
    """``picks`` (isip_x, isip_y, isip_slope) after edits (test_id, kind, x, y, slope), one a test.

    ``anchor`` snaps to the sample nearest to x and fits the slope of its neighbours; ``body`` moves the line and keeps its
    slope, ``end`` turns it about its anchor; a line that isn't there yet is taken from the edit. Other kinds change nothing.
    """
    snapped = s.tangent_at(samples, edits.where("kind = 'anchor'").select(KEY, "x"), "t_s", "p", "x", half=half, order="idx").withColumnRenamed("slope", "slope_fit")
    out = picks.join(edits, KEY, "left").join(snapped, KEY, "left")
    body, end, snap = (F.coalesce(F.col("kind") == k, F.lit(False)) for k in ("body", "end", "anchor"))
    new = {
        "isip_x": F.when(snap, F.col("anchor_x")).when(body, F.col("x")).when(end, F.coalesce("isip_x", "x")),
        "isip_y": F.when(snap, F.col("anchor_y")).when(body, F.col("y")).when(end, F.coalesce("isip_y", "y")),
        "isip_slope": F.when(snap, F.col("slope_fit")).when(body, F.coalesce("isip_slope", "slope")).when(end, F.col("slope")),
    }
    return out.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in picks.columns])


def set_picks(picks: DataFrame, edits: DataFrame, names: tuple[str, ...] = ("min_dpdg_G", "contact_G", "closure_G", "closure_slope")) -> DataFrame:
    """``picks`` with the values of ``edits`` (test_id and any of ``names``) where they aren't null."""
    given = [c for c in names if c in edits.columns]
    new = edits.select(KEY, *[F.col(c).alias(f"_{c}") for c in given])
    return picks.join(new, KEY, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in picks.columns])
