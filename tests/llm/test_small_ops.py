"""Line dedup, mixing, sharding, Hamming search and pieces against brute force on small fixtures."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from falloff.llm import hamming, lines, mixing, pieces, sharding
from falloff.llm.queries import vocabulary


# Line dedup

def brute_lines(rows, ratio=0.05, min_pages=3):
    pages, count = {}, {}
    for _, host, text in rows:
        if text is not None:
            pages.setdefault(host, set()).add(text)
    for host, texts in pages.items():
        for t in texts:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                count[host, line] = count.get((host, line), 0) + 1
    bad = {k for k, n in count.items() if n >= min_pages and n > ratio * len(pages[k[0]])}
    out = []
    for id, host, text in rows:
        if text is None:
            out.append((id, None, 0, 0))
            continue
        split = text.split("\n")
        kept = [x for x in split if (host, x.strip(" ")) not in bad]
        out.append((id, "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out, key=str)


def test_lines_as_brute_force(spark):
    r = random.Random(4)
    rows = []
    for k in range(200):
        host = r.choice(["a", "a", "b", None])
        own = [f"line {r.randrange(10_000)}" for _ in range(r.randrange(0, 6))]
        own += ["menu", " menu ", "", "footer"][: r.randrange(0, 5)]
        rows.append((k, host, None if k % 50 == 7 else "\n".join(own)))
    rows += [rows[0], (500, "c", "menu\nmenu"), (501, "c", "menu"), (502, "c", "menu\nx"), (503, "d", "menu"), (504, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit("x"))
    got = lines.drop_boilerplate(docs)
    assert sorted(((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in got.collect()), key=str) == brute_lines(rows)
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


# Mixing

def test_targets_fill_up_under_their_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # 2415 words by 5:2:1:5; a and c stop at twice their size, the rest is shared by 2:5 until the null source stops too.
    assert got["a"] == 200 and got["c"] == 20 and got[None] == 1000
    assert abs(sum(got.values()) - 1.5 * 1610) < 1e-6


def test_mix_comes_near_targets_and_reruns_agree(spark):
    r = random.Random(8)
    rows = [(k, " ".join(["w"] * r.randrange(0, 60)), r.choice(["a"] * 8 + ["b", "c", None])) for k in range(3000)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, "w " * 700, "b"), rows[5], rows[5], (None, "w w w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    one, two = ([tuple(x) for x in mixing.mix(docs.repartition(n)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()] for n in (3, 7))
    assert sorted(one, key=str) == sorted(two, key=str) and len(one) == len(rows)
    by = {}
    for _, source, size, source_size, target, copies, taken in one:
        assert 0 <= copies <= 2 and taken == copies * size and taken <= 2 * size
        x = by.setdefault(source, [0, 0, source_size, target])
        x[0], x[1] = x[0] + size, x[1] + taken
    for size, taken, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 60 and target <= 2 * size
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_prefers_heavier_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2 * 3 + 1).alias("quality"))
    got = mixing.mix(docs, weight="quality", budget=0.3).groupBy("quality").agg(F.sum("copies").alias("n")).collect()
    n = {r["quality"]: r["n"] for r in got}
    assert abs(sum(n.values()) - 1200) <= 1 and 3 < n[4] / n[1] < 5.5


# Sharding

def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    points = np.array(np.meshgrid(side, side, side)).reshape(3, -1)
    at = sharding.hilbert_index(points, 4)
    assert sorted(at) == list(range(16**3))
    walk = points[:, np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards_are_equal_in_bytes_and_keep_equal_texts(spark):
    r = random.Random(5)
    texts = ["ä" * r.randrange(0, 900) + str(k) for k in range(1500)]
    rows = [(k, r.choice(texts), r.choice(["en", "de", None]), r.choice(["x", "y", "z"])) for k in range(4000)] + [(9000 + k, "copy " * 300, "en", "x") for k in range(400)] + [(99_000, None, None, None), (99_001, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"shard": F.lit("a"), "size": F.lit(None), "h": F.lit(1), "mode": F.lit(2)})
    got = {x["doc_id"]: x for x in sharding.assign(docs).collect()}
    assert len(got) == len(rows)
    load, slots, homes = [0] * 16, [[] for _ in range(16)], {}
    for id, text, *_ in rows:
        x, raw = got[id], (text or "").encode()
        assert x["size"] == len(raw) + 1 and x["text_crc32"] == zlib.crc32(raw) and x["law"] == "bytes" and x["grown_shard"] is None
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        homes.setdefault(text, set()).add(x["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) < 1.05 * sum(load) / 16 and min(load) > 0.95 * sum(load) / 16
    assert all(len(h) == 1 for t, h in homes.items() if t != "copy " * 300)


def test_shards_of_nothing_and_of_one_text(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert sharding.assign(spark.createDataFrame([], schema)).count() == 0
    same = sharding.assign(spark.createDataFrame([(k, "same", "en", "a") for k in range(160)], schema)).groupBy("shard").count().collect()
    assert len(same) == 16 and all(9 <= r["count"] <= 11 for r in same)


def test_coarse_units_stay_near_their_place_and_shares_equal(spark):
    r = random.Random(12)
    rows = [(k, "x" * r.choice([5, 20, 40, 3000, 9000]) + str(k), r.choice(["en", "de", "fr", "es"]), r.choice("abcdefgh")) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, load = {x["doc_id"]: x for x in sharding.assign(docs, whole=0.01).collect()}, [0] * 16
    for x in got.values():
        load[x["shard"]] += x["size"]
    assert max(load) - min(load) <= 0.02 * sum(load) / 16
    langs = [len({lang for k, _, lang, _ in rows if got[k]["shard"] == s}) for s in range(16)]
    assert sum(langs) / 16 < 2.6  # four, were units dealt out anywhere


def test_settling_and_rooms():
    assert sharding.settle([(5, 4), (6, 4), (95, 9), (94, 2)], 10, 10) == ([0, 0, 9, 8], [8, 0, 0, 0, 0, 0, 0, 0, 2, 9])
    assert sharding.settle([(1, 10), (1, 10), (1, 10)], 10, 2)[1] == [20, 10]
    assert sharding.rooms([0, 4, 9], 5) == [4.5, 0.5, 0.0] and sharding.rooms([1, 1], 0) == [0, 0]


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(k % 90, f"text {k}", r, None) for k, r in enumerate(["en", "de"] * 50)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("slot", F.lit("clash"))
    plan = sharding.assign(docs)
    sharding.write(docs, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(x["doc_id"]), x["text"]) for x in back.collect()) == sorted((str(a), b) for a, b, *_ in rows)
    sharding.write(docs.limit(0), plan.limit(0), str(tmp_path / "none"))


# Exact top-k search

def test_search_as_brute_force(spark):
    r = np.random.default_rng(6)
    codes = r.integers(0, 1 << 16, (700, 4))
    codes[:120] = codes[0]  # a group of copies
    codes[120:200] = codes[120] ^ (1 << r.integers(0, 16, (80, 1)))
    rows = [(k, [int(x) for x in c]) for k, c in enumerate(codes)] + [(5000, None), (None, [1, 2, 3, 4]), (3, [int(x) for x in codes[3]])]
    df = spark.createDataFrame(rows, "vec_id long, code array<int>")
    got = {}
    clash = df.withColumns({"shard": F.lit("a"), "salt": F.lit(None), "block": F.lit(3), "query_id": F.lit(1)})
    for x in hamming.search(clash, clash.where("vec_id % 20 = 0"), k=7, shard_codes=200, block=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["distance"], x["vec_id"]))
    for q in range(0, 700, 20):
        d = np.bitwise_count((codes ^ codes[q]).astype(np.uint16)).sum(axis=1)
        best = sorted((int(d[k]), k) for k in range(700) if k != q)[:7]
        assert sorted(got[q]) == [(i + 1, *b) for i, b in enumerate(best)]
    assert len(got) == 35
    assert hamming.search(df.limit(0), df, k=3).count() == 0 and hamming.search(df, df.limit(0), k=3).count() == 0


def test_sign_codes(spark):
    rows = [(1, [0.5, -1.0] * 32), (2, None), (3, [1.0] * 3), (4, [float("nan")] + [1.0] * 63), (5, [0.0] * 64), (6, [None] + [1.0] * 63)]
    got = {r["id"]: r["c"] for r in spark.createDataFrame(rows, "id long, v array<float>").select("id", hamming.sign_code(F.col("v"), 64).alias("c")).collect()}
    assert got == {1: [0xAAAA] * 4, 2: None, 3: None, 4: None, 5: [0] * 4, 6: None}


# Pieces

@pytest.fixture(scope="module")
def known():
    return vocabulary()


def whole(known, text):
    """Every position's best path over the whole text, without cuts or chunks."""
    return known.viterbi(" " + text)


TEXTS = ["", " ", "plain words and more", "  spaces   in  runs  ", "line\n\nfeeds\n", "ünïcödé 中文 текст", "▁ kept", "emoji 😀😀 here", "x" * 300, "a\tb\0c", "1234567890 0.5%", "word" * 200 + " tail"]


def test_pieces_equal_the_whole_lattice_and_decode_exactly(known):
    for t in TEXTS:
        ids = known.encode(t)
        assert ids.tolist() == whole(known, t) and known.decode(ids) == t
        assert known.worth[ids].sum() == known._best(" " + t)[0][-1]


def test_stretches_for_the_library_have_exact_sums(known):
    assert known.exact * -known.unknown <= 1 << 24 < (known.exact + 1) * -known.unknown
    t = "\u4e7f" * 9 + "\u30fd" * (known.exact - 20) + " end" + "\u30fd" * 20_000
    assert known.encode(t).tolist() == whole(known, t)


def test_giant_documents_in_chunks_equal_the_whole(spark, known):
    r = random.Random(9)
    giants = ["".join(r.choice([" alpha", " beta", "\n", "  ", "ßé", "longword" * 9, " 中文", "▁"]) for _ in range(400)) for _ in range(3)] + ["z" * 1500, " " * 1100]
    rows = [(k, t) for k, t in enumerate(TEXTS + giants)] + [(100, None), (101, giants[0]), (101, giants[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = pieces.encode(docs, known, chunk=130)
    got = {}
    for x in parts.collect():
        assert x["exact"]
        got.setdefault((x["doc_id"], x["copy"], x["page"]), []).append((x["part"], x["ids"], x["n_chars"]))
    assert len(got) == len(rows)
    for (id, *_), found in got.items():
        text = dict(rows)[id]
        if text is None:
            assert found == [(0, None, 0)]
            continue
        found.sort(key=lambda p: p[0])
        ids = [i for _, x, _ in found for i in x]
        assert ids == whole(known, text) and sum(n for *_, n in found) == len(text)
        assert known.decode(np.array(ids)) == text
    sums = {x["doc_id"]: x for x in pieces.digests(parts).collect()}
    for id, text in rows[:-3]:
        ids = np.array(whole(known, text), dtype=np.int64)
        x = sums[id]
        assert (x["n_ids"], x["sum_ids"], x["dot_ids"], x["n_chars"]) == (len(ids), ids.sum(), np.dot(ids, np.arange(1, len(ids) + 1)), len(text))
    assert pieces.encode(docs.limit(0), known).count() == 0


def test_giant_documents_without_an_id_keep_their_rows(spark, known):
    text = " alpha beta" * 200
    rows = [(None, text), (None, text), (None, text + "x"), (1, text), (None, "alpha")]
    parts = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), known, chunk=130)
    got = sorted(((x["doc_id"], x["n_chars"], x["n_ids"], x["exact"]) for x in pieces.digests(parts).collect()), key=str)
    assert got == sorted(((i, len(t), len(known.encode(t)), True) for i, t in rows), key=str)


def test_steps_of_rank_one_are_their_matrices_and_combine_alike(known):
    r = random.Random(4)
    t = "".join(r.choice([" alpha", " beta", "\n", "  ", "ßé", "longword" * 9, " 中文", "q" * 40]) for _ in range(60))
    L, size = known.longest, 50
    chunks = [(t[a : a + size + L], min(size, len(t) - a)) for a in range(0, len(t), size)]
    steps, ranks = [], set()
    for text, n in chunks:
        s = known.summary(text, n)
        m, w = pieces._read(s["m"], s["w"], L)
        ranks.add(w is None)
        plain = np.stack([known._ends(text, n, [None] * k + [0]) for k in range(L)])
        assert ((pieces.plus(m[:, None], w[None, :]) if w is not None else m) == plain).all()
        steps.append(((m, w), plain))
    assert ranks == {True, False}
    start = np.full(L, pieces.NEVER)
    start[0] = 0
    v, left, right = start, steps[0][0], steps[-1][0]
    for step, plain in steps:
        assert (pieces.through(v, step) == pieces.plus(v[:, None], plain).max(axis=0)).all()
        v = pieces.through(v, step)
    for step, _ in steps[1:]:
        left = pieces.product(left, step)
    for step, _ in reversed(steps[:-1]):
        right = pieces.product(step, right)
    assert (pieces.through(start, left) == v).all() and (pieces.through(start, right) == v).all()
    assert v[0] == known._best(t)[0][-1]


def test_scan_in_blocks_as_one_product_after_the_other(spark, known):
    r = random.Random(5)
    L, rows, want = known.longest, [], {}
    for page, n in ((7, 1), (8, 30), (-9, 95)):
        t = "".join(r.choice([" alpha", " beta", "\n", "ßé", "longword" * 9, "q" * 40]) for _ in range(n * 12))
        v = np.full(L, pieces.NEVER)
        v[0] = 0
        for k in range(n):
            s = known.summary(t[k * 40 : k * 40 + 40 + L], 40)
            want[page, k] = v.tobytes()
            v = pieces.through(v, pieces._read(s["m"], s["w"], L))
            rows.append((page, k, bytearray(s["m"]), s["w"] and bytearray(s["w"])))
    steps = spark.createDataFrame(rows, "page long, k long, m binary, w binary")
    assert {(x["page"], x["k"]): bytes(x["v"]) for x in pieces.scan(steps, L, block=4).collect()} == want
