import math
import random

import numpy as np
import pytest

from meridion.llm import topk
from meridion.llm.common import materialise


def table(spark, rows, parts=3):
    schema = "vec_id long, embedding array<float>, score string, uid int"
    return materialise(spark.createDataFrame([(i, v, "s", 1) for i, v in rows], schema).repartition(parts), "vectors") if rows else spark.createDataFrame([], schema)


def brute(rows, k=20):
    ok = [(n, i, [math.floor(64 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, m) for m, j, v in ok if m != n)[:k]
            out += [(i, r + 1, None if null else j, -score) for r, (score, null, j, _) in enumerate(s)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["normal", "ties", "large", "clustered"])
def test_search(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "CELLS", 500)
    r = random.Random(4)
    make = {"normal": lambda: [r.gauss(0, 0.15) for _ in range(16)], "ties": lambda: [r.choice([0.0, 0.02, -0.02]) for _ in range(4)], "large": lambda: [r.gauss(0, 4000) for _ in range(6)], "clustered": lambda: [0.3 + r.gauss(0, 0.01) for _ in range(16)]}[kind]
    rows = [(i, make()) for i in range(1, 300)]
    rows += [(None, make()), (400, None), (420, [0.1, None]), (440, [float("nan"), 1.0]), (460, [float("inf")]), (480, []), (500, [0.5]), (20, make()), (2000, make()), (2000, make())]
    got = topk.search(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert [tuple(x) for x in topk.search(table(spark, rows)).collect()] == brute(rows)
    assert topk.search(table(spark, [])).collect() == []
    assert topk.search(table(spark, [(20, [1.0])])).collect() == []


def test_bounds_prove_early(spark):
    r = np.random.default_rng(1)
    v = np.floor(64 * r.normal(0, 0.125, (2000, 64))).astype(np.int64)
    index = topk.ImpactIndex(v)
    a, b = index.possible(v[:50], np.arange(50), 20)
    assert len(a) < 50 * 2000 * 0.2
    exact = v[:50] @ v.T
    np.fill_diagonal(exact, -10**9)
    for i in range(50):
        assert set(np.argsort(-exact[i], kind="stable")[:20]) <= set(b[a == i])


def test_many_rows_against_brute_force():
    """Several tiles of rows and of queries, a floor that is carried along, copies and ties."""
    r = np.random.default_rng(5)
    v = np.floor(64 * r.normal(0, 0.125, (12_000, 64))).astype(np.int8)
    v[3000:3100], v[9000:11000:2] = v[20], np.floor(r.normal(0, 1, (1000, 64)))
    own = np.arange(0, 12_000, 20)
    index = topk.ImpactIndex(v)
    a, b, score = index.best(v[own], own, 20)
    exact = v[own].astype(np.float64) @ v.T.astype(np.float64)
    exact[np.arange(len(own)), own] = -np.inf
    want = np.argsort(-exact, axis=1, kind="stable")[:, :20]
    assert (a == np.repeat(np.arange(len(own)), 20)).all() and (b == want.ravel()).all()
    assert (score == np.take_along_axis(exact, want, 1).ravel()).all()
    assert len(index.possible(v[own[:256]], own[:256], 20)[0]) < 256 * 12_000 * 0.05


def test_copies_and_narrow_types(spark, monkeypatch):
    """More copies of a vector than a query takes, in several blocks and shards, and a null id among them."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    r = random.Random(6)
    for size in (0.3, 40.0, 900.0):
        many, few = [[r.gauss(0, size) for _ in range(5)] for _ in range(2)]
        rows = [(i, many if i % 2 else few if i % 3 else [r.gauss(0, size) for _ in range(5)]) for i in range(160)]
        rows += [(None, many), (None, few), (40, many), (40, many), (60, few)]
        assert sorted(map(tuple, topk.search(table(spark, rows)).collect()), key=str) == brute(rows)
