import math

import numpy as np

from falloff.llm import hnsw


def brute(rows, cosine=0.95):
    ids, unit = [], []
    for id, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ids.append(id)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, id in enumerate(ids):
        low[find(i)] = min(low.get(find(i), id), id)
    return sorted((id, links[i], low[find(i)], id == low[find(i)]) for i, id in enumerate(ids))


def cloud(seed=2):
    r = np.random.default_rng(seed)
    x = [r.normal(size=24) for _ in range(250)]
    for _ in range(6):  # clusters, one of them large
        c = r.normal(size=24)
        x += [c + r.normal(size=24) * 0.14 for _ in range(25)]
    c = r.normal(size=24)
    x += [c + r.normal(size=24) * 0.05 for _ in range(200)]
    x += [x[0]] * 30 + [x[1] * 1e-30, x[2] * 1e30]
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    n = len(rows)
    return [*rows, (n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] * 24), (n + 3, [None] + [1.0] * 23), (n + 4, []), (n + 5, [1.0]), (n + 6, [float("inf")] + [1.0] * 23)]


def test_links_as_brute_force(spark):
    rows = cloud()
    got = hnsw.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=120, min_shards=2, block_rows=90)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty_table_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert hnsw.link(spark.createDataFrame([], schema)).count() == 0
    got = hnsw.link(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.01])], schema)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == ["(2, 1, 2, True)", "(4, 1, 2, False)", "(4, 1, 2, False)", "(None, 0, None, False)"]


def test_beams_widen_until_the_audit_passes():
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x[:600], degree=4, beam=4)
    pairs = set()
    for q, v, good in hnsw.near(graph, x[600:], 0.95, beam=1, audit=300):
        if good.ndim == 1:
            pairs |= set(zip(q[good].tolist(), v[good].tolist(), strict=True))
        else:
            a, b = np.nonzero(good)
            pairs |= set(zip(q[a].tolist(), v[b].tolist(), strict=True))
    truth = set(zip(*(k.tolist() for k in np.nonzero(x[600:] @ x[:600].T >= 0.95)), strict=True))
    assert pairs == truth
