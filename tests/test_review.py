"""Reviews and picks on small made-up groups and tests."""

from falloff.operators import review
from falloff.plans import interpret, scenarios

PICKS = "test_id int, closure_scenario string, min_dpdg_G double, contact_G double"


def _diag(spark):
    """Seven rows a test: dP/dG falls to a minimum at G = 3, then rises to a hump at G = 5."""
    curve = [9.0, 7.0, 5.0, 2.0, 4.0, 8.0, 6.0]
    return spark.createDataFrame([(t, i, float(i), 100.0 - i, v, 0.0) for t in (1, 2, 3) for i, v in enumerate(curve)], "test_id int, i int, G double, p double, dPdG double, d2PdG2 double")


def test_blank_scenario_is_seeded_anew(spark):
    picks = spark.createDataFrame([(1, None, 0.5, 0.7), (2, "C-D", 1.5, 2.5), (9, "", 0.5, 0.7)], PICKS)
    got = {r.test_id: (r.min_dpdg_G, r.contact_G) for r in scenarios.reset_contacts(_diag(spark), picks).collect()}
    low = {r.test_id: r.min_G for r in scenarios.s.min_dpdg(_diag(spark)).collect()}
    hump = max(_diag(spark).where("test_id = 1 AND dPdG IS NOT NULL").collect(), key=lambda r: (r.dPdG, -r.i)).G
    assert got == {1: (low[1], hump), 2: (1.5, None), 9: (0.5, 0.7)}


def test_isip_line_moves_by_kind(spark):
    samples = spark.createDataFrame([(t, i, float(i), 500.0 - 2.0 * i) for t in (1, 2, 3, 4) for i in range(20)], "test_id int, idx int, t_s double, p double")
    picks = spark.createDataFrame([(t, 1.0, 2.0, -9.0) for t in (1, 2, 3, 4)], "test_id int, isip_x double, isip_y double, isip_slope double")
    edits = spark.createDataFrame([(1, "anchor", 6.4, 0.0, 0.0), (2, "body", 7.0, 8.0, 5.0), (3, "end", 7.0, 8.0, 5.0)], "test_id int, kind string, x double, y double, slope double")
    got = {r.test_id: tuple(round(v, 6) for v in r[1:]) for r in scenarios.move_isip(samples, picks, edits).collect()}
    assert got == {1: (6.0, 488.0, -2.0), 2: (7.0, 8.0, -9.0), 3: (1.0, 2.0, 5.0), 4: (1.0, 2.0, -9.0)}


def test_set_picks_leaves_what_is_not_given(spark):
    picks = spark.createDataFrame([(1, "C-A", 1.0, 2.0), (2, "C-B", 3.0, 4.0)], PICKS)
    edits = spark.createDataFrame([(1, 5.0)], "test_id int, contact_G double")
    assert sorted(tuple(r) for r in scenarios.set_picks(picks, edits).collect()) == [(1, "C-A", 1.0, 5.0), (2, "C-B", 3.0, 4.0)]


def test_accepting_nothing_records_nothing(spark):
    schema = "rel string, status string, keeps array<string>, decided_sig string"
    before = spark.createDataFrame([("a", "unsure", ["x"], "1")], schema)
    groups = spark.createDataFrame([("a", "2"), ("b", "3")], "rel string, files_sig string")
    actions = spark.createDataFrame([("a", "accept", []), ("b", "none", ["y"])], "rel string, action string, keeps array<string>")
    got = sorted(tuple(r) for r in review.decide(before, actions, groups).select("rel", "status", "keeps", "decided_sig").collect())
    assert got == [("a", "unsure", ["x"], "1"), ("b", "none", [], "3")]


def test_pressure_without_fluid_is_unknown(spark):
    samples = spark.createDataFrame([(t, 0, 100.0) for t in (1, 2, 3, 4)], "test_id int, idx int, p double")
    channels = spark.createDataFrame([(1, True, None, None), (2, False, 10.0, 1000.0), (3, False, None, 1000.0)], "test_id int, is_bhp boolean, mw_ppg double, tvd_ft double")
    got = {r.test_id: r.p for r in interpret.with_bottomhole(samples, channels).collect()}
    assert got == {1: 100.0, 2: 620.0, 3: None, 4: None}
