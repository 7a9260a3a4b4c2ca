"""Destinations of moves: one each, none on a path that exists, whatever is renamed to what."""

import random

from falloff.operators import corpus


def settled(spark, moves, existing):
    frame = spark.createDataFrame(moves, "src string, dst string, kind string")
    there = spark.createDataFrame([(x,) for x in existing], "path string") if existing is not None else None
    return {(r["src"], r["kind"]): (r["dst"], r.asDict().get("skipped")) for r in corpus.separate_destinations(frame, there).collect()}


def test_folder_then_number_then_next_free_number(spark):
    moves = [("a/f/x.csv", "o/x.csv", "k"), ("b/f/x.csv", "o/x.csv", "k"), ("c/f/x.csv", "o/x.csv", "k"), ("d/f/x.csv", "o/x.csv", "k")]
    got = settled(spark, moves, ["o/f - x (2).csv", "o/f - x (4).csv"])
    assert [got[m[0], "k"][0] for m in moves] == ["o/x.csv", "o/f - x.csv", "o/f - x (3).csv", "o/f - x (5).csv"]


def test_existing_destination_is_skipped(spark):
    got = settled(spark, [("a/x.csv", "o/x.csv", "k"), ("b/y.csv", "o/y.csv", "k"), ("c/x.csv", "o/x.csv", "k")], ["o/x.csv"])
    assert got["a/x.csv", "k"] == ("o/x.csv", "destination exists") and got["c/x.csv", "k"] == ("o/x.csv", "destination exists")
    assert got["b/y.csv", "k"] == ("o/y.csv", None)


def test_names_renamed_onto_each_other_settle(spark):
    """Two stems reach one name: "f - x" numbered 2, and "f - x (2)" as it stands."""
    moves = [(f"{k}/f/x.csv", "o/x.csv", "k") for k in "abc"] + [(f"{k}/f/x (2).csv", "o/x (2).csv", "k") for k in "abc"]
    got = settled(spark, moves, None)
    assert len({d for d, _ in got.values()}) == len(moves)


def test_random_plans_never_share_a_path(spark):
    r = random.Random(3)
    bases = ["x.csv", "x (2).csv", "x (3).csv", "f - x.csv", "f - x (2).csv", "noext", "g.v.csv"]
    for _ in range(4):
        moves = list({(f"{r.randrange(9)}/{r.choice('fg')}/{b}", f"o{r.randrange(2)}/{b}", "k") for b in r.choices(bases, k=60)})
        existing = {f"o{r.randrange(2)}/{r.choice(['', 'f - ', 'g - '])}{r.choice(bases)}" for _ in range(8)}
        frame = spark.createDataFrame(moves, "src string, dst string, kind string")
        rows = corpus.separate_destinations(frame, spark.createDataFrame([(x,) for x in existing], "path string")).collect()
        assert len(rows) == len(moves)
        moved = [x["dst"] for x in rows if x["skipped"] is None]
        assert len(set(moved)) == len(moved) and not set(moved) & existing
        planned = {d for _, d, _ in moves}
        assert planned - existing <= set(moved)


def test_no_moves(spark):
    assert settled(spark, [], None) == {}
