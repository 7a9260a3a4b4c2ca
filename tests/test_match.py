"""Similar names and the chain of resolving against plain loops."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest

from falloff.operators import match, similar


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def plain_best(key, keys):
    """The rule in a loop: the block of the first three characters, else the five closest of all; least score and margin."""
    block = [k for k in keys if k[:3] == key[:3]] or get_close_matches(key, keys, n=5, cutoff=0.85)
    scored = sorted(((ratio(key, k), k) for k in block), key=lambda t: -t[0])
    if not scored or scored[0][0] < 0.92 or (len(scored) > 1 and scored[0][0] - scored[1][0] < 0.03):
        return None
    return scored[0][1], scored[0][0]


def some_keys(seed, n):
    rng = random.Random(seed)
    words = ["FAIR", "VIEW", "COX", "BERRY", "IC", "STATE", "UNIT", "NORTH", "LARGE", "RING", "HX", "A", "Q"]
    return sorted({"".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) + str(rng.randrange(1, 400)) for _ in range(n)})


def changed(key, rng):
    s = list(key)
    for _ in range(rng.randrange(1, 4)):
        k, how = rng.randrange(len(s)), rng.randrange(4)
        if how == 0:
            s[k] = rng.choice("XZ7")
        elif how == 1 and len(s) > 4:
            del s[k]
        elif how == 2:
            s.insert(k, rng.choice("XZ7"))
        else:
            s[0] = rng.choice("YZW")
    return "".join(s)


def test_equals_plain_loop_on_2000_keys(spark):
    keys, rng = some_keys(1, 2400)[:2000], random.Random(2)
    names = sorted({changed(k, rng) for k in rng.sample(keys, 500)} - set(keys))
    got = match.best_alike(spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "key string"), spark.createDataFrame([(k,) for k in [*keys, keys[0], "", None]], "key string"))
    got = {r["key"]: (r["best"], r["score"]) for r in got.collect()}
    want = {n: b for n in names if (b := plain_best(n, keys))}
    assert got == want
    assert sum(not any(k[:3] == n[:3] for k in keys) for n in want) > 20


@pytest.mark.parametrize("least", [0.92, 0.85, 0.7])
def test_candidates_are_complete(spark, least):
    keys = some_keys(3, 250)
    names = [changed(k, random.Random(i)) for i, k in enumerate(keys)]
    names = [n for n in names if len(n) > 3]
    got = {tuple(r) for r in similar.candidates(spark.createDataFrame([(n,) for n in names], "key string"), spark.createDataFrame([(k,) for k in keys], "other string"), least).collect()}
    assert {(n, k) for n in set(names) for k in keys if max(ratio(n, k), ratio(k, n)) >= least} <= got


def registry(spark):
    directional = spark.createDataFrame([
        ("42-001-00011-00", "op1", "Fairview State 2H", 1.0, 2.0), ("42-001-00011-01", "op1", "Fairview State 2H", 3.0, 4.0), ("42-001-00012-00", "op2", "Berry IC 11-159HC", 5.0, 6.0), ("42-001-00099-05", "op9", None, 7.0, 8.0),
    ], "label string, operator string, name string, lat double, lon double")
    wells = spark.createDataFrame([
        ("00100011", "42-001-00011-00", "op1", "FAIRVIEW ST 2", "Fairview", "2", "", 10.0, 20.0), ("00100012", "42-001-00012-00", "op2", "Berry", "Berry", "1", None, 11.0, 21.0),
        ("00100099", "42-001-00099-00", "op3", None, "Northland Unit", "7", "", 12.0, 22.0), ("00100098", "42-001-00098-00", "op3", "Northland Unit 7", "x", "y", "", 13.0, 23.0),
    ], "api string, label string, operator string, title string, name string, number string, location string, lat double, lon double")
    return directional, wells


def test_resolve_chain(spark):
    asked = [None, "  ", "12H", "A-1", "fairview state #2h", "Fairveiw State 2H", "Berry IC 15-159HC", "Northland Unit 7", "Xairview State 2H", "nothing of the kind"]
    got = {r["name"]: r for r in match.resolve(spark.createDataFrame([(a,) for a in asked], "name string"), *registry(spark)).collect()}
    assert len(got) == len(asked)
    told = {k: (r["label"], r["source"], r["surf_lat"], r["btmh_lat"]) for k, r in got.items()}
    assert told[None] == told["  "] == (None, "no-well-name", None, None)
    assert told["12H"] == told["A-1"] == (None, "name-too-generic", None, None)
    assert told["fairview state #2h"] == ("42-001-00011-00", "directional-exact (2 candidates)", 10.0, 1.0)
    assert told["Xairview State 2H"] == ("42-001-00011-00", "directional-fuzzy (2 candidates)", 10.0, 1.0)
    assert told["Berry IC 15-159HC"] == ("42-001-00012-00", "directional-sibling", 11.0, None)
    assert told["Northland Unit 7"] == ("42-001-00098-00", "wells-exact (2 candidates)", 13.0, None)
    assert told["nothing of the kind"] == (None, "no-match", None, None)
    assert got["Berry IC 15-159HC"]["score"] == round(ratio("BERRYIC15159HC", "BERRYIC11159HC"), 3)


def test_a_well_takes_the_hole_of_its_label_or_the_least(spark):
    directional, wells = registry(spark)
    got = match.resolve(spark.createDataFrame([("7 Northland Unit",)], "name string"), directional, wells.where("label <> '42-001-00098-00'")).first()
    assert (got["source"], got["db_name"], got["btmh_lat"]) == ("wells-exact", "Northland Unit", 7.0)
    more = directional.union(spark.createDataFrame([("42-001-00099-03", "o", None, 9.0, 9.0)], directional.schema))
    got = match.resolve(spark.createDataFrame([("7 Northland Unit",)], "name string"), more, wells.where("label <> '42-001-00098-00'")).first()
    assert (got["source"], got["btmh_lat"]) == ("wells-exact (2 candidates)", 9.0)


def test_rows_of_entries(spark):
    entries = spark.createDataFrame([("a", "p1"), ("b", None), ("c", "p2"), ("d", "p3"), ("e", "gone")], "test_id string, document string")
    papers = spark.createDataFrame([("p1", "Fairview State 2H", None), ("p2", None, "BadZipFile"), ("p3", None, None)], "path string, well string, error string")
    got = {r["test_id"]: (r["well_name"], r["source"]) for r in match.located_rows(entries, papers, *registry(spark)).collect()}
    assert got == {"a": ("Fairview State 2H", "directional-exact (2 candidates)"), "b": (None, "no-questionnaire"), "c": (None, "questionnaire-error"), "d": (None, "no-well-name"), "e": (None, "questionnaire-error")}
