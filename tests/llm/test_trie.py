"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from falloff.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, x long, pos long"


def brute(convs):
    """Nodes of {conv_id: [(role, text)]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for prefix, members in nodes.items():
        below = [q for q in nodes if q[: len(prefix)] == prefix]
        has_child = {q[:-1] for q in nodes if q}
        ends = sorted(c for c in members if len(convs[c]) == len(prefix))
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(1 for q in nodes if q and q[:-1] == prefix), sum(q not in has_child for q in below),
            sum((len(nodes[q]) - 1) * words(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def plain_order(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}


def plain_rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def some_rows(seed, n=120, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([None, t, t, t, 1]), rng.choice(["user", None, "assistant"]), rng.choice([None, "", "a b", "a  b\tc", "é d", "x" * 40][: 3 + texts])))
    rows += [(None, 0, "user", "lost"), *rows[:5]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 9) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed,bits", [(1, trie.BITS), (2, 2), (3, 1)])
def test_equals_plain_trie(spark, seed, bits):
    rows = some_rows(seed)
    ids, turns = trie.rebuild(trie.ordered(frame(spark, rows)))
    got = sorted((tuple(r) for r in trie.build(ids, turns, bits).collect()), key=repr)
    assert got == brute(plain_rebuild(plain_order(rows)))


def test_long_conversation_over_many_ranges(spark):
    rows = [(5, t, "user", f"w{t % 3}") for t in range(4000)] + [(6, t, "user", f"w{t % 3}") for t in range(3000)] + [(9, 0, "user", "w0")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = trie.ordered(frame(spark, rows))
        out = trie.build(turns.select("conv_id"), turns)
        assert out.count() == 4001
        at = {r["depth"]: r for r in out.where("depth in (1, 3000, 3001, 4000)").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [at[d]["n_convs"] for d in (1, 3000, 3001, 4000)] == [3, 2, 1, 1]
    assert at[1]["saved_tokens"] == 2 + 2999 and at[3001]["saved_tokens"] == 0 and at[1]["n_leaves"] == 1


def test_no_turns_and_no_rows(spark):
    assert trie.build(frame(spark, []).select("conv_id"), trie.ordered(frame(spark, []))).count() == 0
    ids = spark.createDataFrame([(4,), (3,), (3,)], "conv_id long")
    (root,) = trie.build(ids, trie.ordered(frame(spark, []))).collect()
    assert tuple(root) == (3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())


def test_query_equals_plain_trie(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_prefix_trie(spark, sf).collect()), key=repr)
    assert got == brute(plain_rebuild(plain_order(rows)))
