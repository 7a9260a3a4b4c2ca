"""Language-model scores against plain counting, byte by byte and bit by bit."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from falloff.llm import lm, mixer, queries


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)]


def plain_scores(docs, train, w):
    """{id: (tokens, known, base, score)} by dictionaries."""
    data = {i: b"".join(x + b" " for x in plain_words(t)) + b"\n" for i, t in docs}
    counts = Counter()
    for i, d in data.items():
        if train(i):
            padded = b"\n" * 5 + d
            counts.update((k, padded[j - k : j], padded[j]) for j in range(5, len(padded)) for k in range(6))
    seen = Counter()
    for (k, ctx, byte), n in counts.items():
        for level in range(9):
            seen[k, ctx, level, byte >> (8 - level)] += n
    words = Counter(x for i, t in docs if train(i) for x in [*plain_words(t), b"\n"])
    total, out = sum(words.values()), {}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for i, t in docs:
        padded, both = b"\n" * 5 + data[i], [0.0, 0.0]
        for j in range(5, len(padded)):
            byte = padded[j]
            for level in range(8):
                bit, so_far = byte >> (7 - level) & 1, byte >> (8 - level)
                x, two = [], []
                for k in range(6):
                    ctx = padded[j - k : j]
                    one, every = seen[k, ctx, level + 1, byte >> (7 - level)], seen[k, ctx, level, so_far]
                    x.append(math.log((one + mixer.PRIOR) / (every - one + mixer.PRIOR)))
                    two.append(every)
                top = max([k for k in range(6) if two[k] > 0], default=0)
                a = top * 4 + min(int(math.log2(max(two[top], 1))), 3)
                b = level * 4 + min(int(math.log2(two[3] + 1)), 3)
                z = max(-16, min(16, sum((w.a[k][a] + w.b[k][b]) * x[k] for k in range(6))))
                place = (max(-8.0, min(8.0, z if bit else -z)) + 8) * 2
                low = min(int(place), 31)
                row = w.ones[(1 << level) | so_far] / w.all[(1 << level) | so_far]
                one = row[low] * (1 - place + low) + row[low + 1] * (place - low)
                p = sigmoid(z)
                both[0] += math.log2(p)
                both[1] += math.log2(0.5 * p + 0.5 * (one if bit else 1 - one))
        mine = [*plain_words(t), b"\n"]
        out[i] = len(mine), sum(words[x] > 0 for x in mine), sum(math.log10((words[x] + 1) / (total + len(words) + 1)) for x in mine), (np.logaddexp2(*both) - 1) * math.log10(2), len(data[i])
    return out, total


def some_docs(seed=5, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "Öl", "a", "tion", "of\tthe", "x" * 30, "b\nc", "wh", "12"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, docs[0][1]), (n + 4, "never seen words")]


def some_weights():
    rng = np.random.default_rng(2)
    w = mixer.Weights.start()
    w.a += rng.normal(size=w.a.shape) * 0.05
    w.b += rng.normal(size=w.b.shape) * 0.05
    w.ones *= rng.uniform(0.8, 1, size=w.ones.shape)
    return w


def test_equals_plain_counting(spark):
    docs, w = some_docs(), some_weights()
    want, total = plain_scores(docs, lambda i: i % 3 != 1, w)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, fold int, part int").repartition(5)
    got = lm.score(df, F.col("doc_id") % 3 != 1, part=100, weights=w).collect()
    assert len(got) == len(docs)
    for r in got:
        tokens, known, base, score, size = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["n_bytes"], r["held_out"]) == (tokens, known, total, size, r["doc_id"] % 3 == 1)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-5)
        assert r["bits_per_byte"] == pytest.approx(-score / math.log10(2) / size, rel=1e-5)


def test_probabilities_of_all_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    data = np.frombuffer(bytes(rng.integers(97, 103, 400, dtype=np.uint8)), dtype=np.uint8)
    keys = np.unique(mixer.grams(data) & ~np.uint64(255))
    keys = np.sort(np.concatenate([keys | np.uint64(b) for b in range(256)]))
    slots = mixer.Slots(keys)
    n = np.where((keys & np.uint64(255)) < 103, rng.integers(0, 5, len(keys)), 0).astype(float)
    near = np.bincount(slots.near, weights=n, minlength=65536)
    w = some_weights()
    z = mixer.mixed(w, *slots.inputs(n, near))
    for bits in mixer.log2p(w, z, *slots.bits()):
        assert np.allclose((2.0**bits).reshape(-1, 256).sum(axis=1), 1)


def test_slices_lose_nothing(monkeypatch):
    text = "\t".join(t or "" for _, t in some_docs()).encode() + b" " + b"y" * 300
    whole = list(lm.slices(text))
    monkeypatch.setattr(lm, "SLICE", 50)
    parts = list(lm.slices(text))
    assert len(parts) > 10 and len(whole) == 1
    assert [w for ws, _ in parts for w in ws] == whole[0][0]
    assert np.array_equal(lm.joined([d for _, d in parts])[0], lm.joined([whole[0][1]])[0])


def test_packing():
    for x in (np.zeros(0, dtype=np.uint64), np.array([1, 2**47, 5], dtype=np.uint64)):
        assert np.array_equal(lm.unpack(lm.pack(x), np.uint64), x)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty, F.lit(True)).count() == 0
    (r,) = lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), F.lit(None).cast("boolean")).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0) and r["score"] < 0


def test_query_learns(spark):
    rows = queries.op13_context_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["n_bytes"] * r["bits_per_byte"] for r in held) / sum(r["n_bytes"] for r in held) < 3.0
    again = {r["doc_id"]: r["score"] for r in queries.op13_context_mixing(spark, "/root/testdata/sf0.001").collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-9) for r in rows)
