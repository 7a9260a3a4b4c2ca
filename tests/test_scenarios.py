"""Rules of closure scenarios read a test's diagnostic rows once, whatever their number."""

from pyspark.sql import functions as F

from falloff.operators import series as s
from falloff.plans import catalogue, scenarios

SF = "/root/testdata/sf0.001"
PICKS = "test_id long, closure_scenario string, min_dpdg_G double, contact_G double"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _diag(spark, tests=6, rows=40):
    at = spark.range(tests * rows).select((F.col("id") / rows).cast("long").alias("test_id"), (F.col("id") % rows).cast("int").alias("i"))
    at = at.withColumn("G", 0.5 + F.col("i") * 0.25)
    return at.withColumn("dPdG", 500 + 30 * F.cos(F.col("G") * (1 + F.col("test_id") / 5))).withColumn("d2PdG2", F.sin(F.col("G") * (2 + F.col("test_id") / 3)))


def _picks(spark):
    heads = ("C-A: clear", "C-B: adequate", "C-C", "", None, "C-A: clear")
    return spark.createDataFrame([(k, head, None if k % 2 else 4.0, 99.0) for k, head in enumerate(heads)] + [(77, "C-A: clear", 3.0, 99.0)], PICKS)


def test_contacts_read_diagnostics_once(spark):
    assert _plan(scenarios.scenario_contacts(_diag(spark), _picks(spark))).count("Range (") == 1


def test_query_of_contacts_resamples_once(spark):
    assert not [f for f in catalogue.QUERIES["scenario_contact"](spark, SF).inputFiles() if "events.parquet" in f]


def test_contacts_as_each_rule_alone(spark):
    diag = _diag(spark).localCheckpoint()
    got = {r.test_id: r for r in scenarios.scenario_contacts(diag, _picks(spark)).collect()}
    assert len(got) == 7
    low = {r.test_id: r.min_G for r in s.min_dpdg(diag).collect()}
    assert got[0].min_dpdg_G == 4.0 and got[1].min_dpdg_G == low[1] and got[5].min_dpdg_G == low[5]
    of = lambda k: [r for r in diag.where(F.col("test_id") == k).orderBy("i").collect()]
    for k in (0, 5):
        near = min(of(k), key=lambda r: (round(abs(r.G - got[k].min_dpdg_G), 9), r.i))
        assert got[k].contact_G == next((r.G for r in of(k) if r.i > near.i and r.dPdG >= near.dPdG * 1.1), 99.0)
    seeds = spark.createDataFrame([(1, low[1])], "test_id long, seed_G double")
    assert got[1].contact_G == s.contact_inflection(diag, seeds).first().contact_G
    assert got[2].contact_G is None and got[3].contact_G == got[4].contact_G == 99.0
    assert (got[77].min_dpdg_G, got[77].contact_G, got[77].hint) == (3.0, 99.0, None)


def test_two_picks_of_one_test_keep_their_own_rule(spark):
    picks = spark.createDataFrame([(1, "C-A: clear", 4.0, 99.0), (1, "C-B: adequate", 4.0, 99.0)], PICKS)
    diag = _diag(spark).localCheckpoint()
    got = {r.closure_scenario: r.contact_G for r in scenarios.scenario_contacts(diag, picks).collect()}
    alone = {r.closure_scenario: r.contact_G for k in range(2) for r in scenarios.scenario_contacts(diag, picks.where(F.col("closure_scenario") == ("C-A: clear", "C-B: adequate")[k])).collect()}
    assert scenarios.scenario_contacts(diag, picks).count() == 2
    assert got == alone


def test_reset_reads_diagnostics_once(spark):
    diag, picks = _diag(spark), _picks(spark)
    assert _plan(scenarios.reset_contacts(diag, picks)).count("Range (") == 1
    assert _plan(scenarios.scenario_contacts(diag, picks, refresh=True)).count("Range (") == 1
    assert not [f for f in catalogue.QUERIES["scenario_reset"](spark, SF).inputFiles() if "events.parquet" in f]


def test_reset_gives_blank_scenarios_minimum_and_hump(spark):
    diag = _diag(spark).localCheckpoint()
    got = {r.test_id: r for r in scenarios.reset_contacts(diag, _picks(spark)).collect()}
    low = {r.test_id: r.min_G for r in s.min_dpdg(diag).collect()}
    for k in (3, 4):
        hump = max((r for r in diag.where(F.col("test_id") == k).collect()), key=lambda r: (r.dPdG, -r.i)).G
        assert (got[k].min_dpdg_G, got[k].contact_G) == (low[k], hump)
    assert got[0].min_dpdg_G == low[0]
    short = {r.test_id: r for r in scenarios.reset_contacts(diag.where("i < 5"), _picks(spark)).collect()}
    assert (short[3].min_dpdg_G, short[3].contact_G, short[4].contact_G) == (None, 99.0, 99.0)
