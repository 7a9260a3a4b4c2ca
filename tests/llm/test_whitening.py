"""Whitening against one eigendecomposition of the whole covariance."""

import numpy as np
import pytest

from falloff.llm import queries, whitening


def plain(x, k):
    n, mean = len(x), x.mean(axis=0)
    e, v = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    order = np.argsort(-e)[:k]
    return (x - mean) @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def table(out, k):
    rows = out.orderBy("id", "component").collect()
    return np.array([r["whitened"] for r in rows]).reshape(-1, k), rows


@pytest.mark.parametrize("whole", [True, False])
def test_equals_one_decomposition(spark, whole):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)) * np.linspace(3, 1, 12) * 50 + 1000
    x = np.floor(x).astype(int) if whole else x
    kind = "long" if whole else "double"
    one = 1 if whole else 1.0
    bad = [(None, None), (5, [one] * 11 + [None]), (6, [one] * 11), *([] if whole else [(7, [1.0] * 11 + [float("nan")]), (8, [float("inf")] * 12)])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + bad, f"id long, v array<{kind}>").repartition(37)
    df = df.selectExpr("id", "v", "1 as n", "2 as vector", "3 as component")
    got, rows = table(whitening.whiten(df, "id", "v", 5), 5)
    want, explained = plain(x.astype(float), 5)
    assert len(got) == len(want) and rows[0]["n"] == 700
    got *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-8
    assert np.allclose([r["explained"] for r in rows[:5]], explained, rtol=1e-10)
    assert rows[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in rows}) == 1
    if whole:
        s = x.sum(axis=0)
        assert [rows[5 * i]["deviation"] for i in range(700)] == [int(((700 * v - s) ** 2).sum()) for v in x]
    else:
        assert {r["deviation"] for r in rows} == {None}


def test_merge_loses_no_dimension():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 7)) + 9
    parts = [whitening.State.of(x[a:b]) for a, b in ((0, 1), (1, 4), (4, 40), (40, 90))]
    state = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    whole = whitening.State.of(x)
    assert state.n == 90 and np.allclose(state.values, whole.values) and len(state.values) == 7
    assert np.allclose((state.vectors.T * state.values**2) @ state.vectors, (whole.vectors.T * whole.values**2) @ whole.vectors)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [3, 4])], [(1, [3, 4]), (1, [3, 4])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "id long, v array<long>"), "id", "v").count() == 0


def test_flat_direction_overflow_repeats_and_null_id(spark):
    rows = [(1, [0, 5]), (1, [0, 5]), (None, [10**10, 5]), (4, [3 * 10**10, 5])]
    got = whitening.whiten(spark.createDataFrame(rows, "id long, v array<long>"), "id", "v").collect()
    assert sorted((r["id"] is None, r["id"], r["component"]) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 4, 1), (True, None, 1)]
    assert {(r["id"], r["deviation"]) for r in got} == {(1, None), (None, 0), (4, None)}  # the null id's row is the mean


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    src = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in src], dtype=float)).astype(int) + 100000
    rows = queries.op12_whitening(spark, sf).orderBy("vec_id", "component").collect()
    got, (want, explained) = np.array([r["whitened"] for r in rows]).reshape(-1, 8), plain(x.astype(float), 8)
    got *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-6 and rows[0]["identity_error"] < 1e-9
    s = x.sum(axis=0)
    assert [rows[8 * i]["deviation"] for i in range(len(x))] == [int(((len(x) * v - s) ** 2).sum()) for v in x]
