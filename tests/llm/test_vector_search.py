"""Vector search against brute force: exact scores and ties, recall, pigeonhole completeness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import vector_search as V


def brute(ids, x, q, k):
    scores = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
    return [(int(ids[i]), scores[i]) for i in order]


@pytest.mark.parametrize("scaled,block", [(False, 32768), (True, 300)])
def test_recall_and_exact_scores(spark, monkeypatch, scaled, block):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32).astype(float)
    if scaled:
        x *= rng.uniform(0.5, 3, size=(1500, 1))
    x[100:160] = x[100]
    ids = rng.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in V.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want, found = brute(ids, x, q, 20), sorted(got[int(ids[q])])
        assert [r for r, _, _ in found] == list(range(1, 21))
        at = {int(i): j for j, i in enumerate(ids)}
        for _, v, s in found:
            assert s == pytest.approx(float(x[at[v]] @ x[q]), rel=1e-12, abs=1e-12)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({v for v, _ in want} & {v for _, v, _ in found})
        total += 20
    assert hits / total >= 0.93


def test_index_returns_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (400, 5)).astype(np.uint16)
    codes[50:90] = codes[50] ^ (1 << rng.integers(0, 16, (40, 5))).astype(np.uint16)
    for width in (1, 2):
        index = V.MultiIndex(codes, width)
        for radius in (0, 1, 3, 4, 5, 9, 14, 33, 80):
            for q in range(0, 90, 9):
                d = np.bitwise_count(codes ^ codes[q]).sum(axis=1, dtype=int)
                assert index.within(codes[q], radius).tolist() == np.flatnonzero(d <= radius).tolist()


def test_probes_touch_few_rows_though_neighbours_are_far():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rotations = V.learn_rotations(V.lift(x, 1.0))
    index, radius = V.MultiIndex(V.encode(V.lift(x, 1.0), rotations), V.SUBSTRING), V._radius(x, 1.0, rotations, 20)
    asked = V.encode(np.hstack([x[:50], np.zeros((50, 1))]), rotations)
    assert np.mean([len(index.probed(code, radius)) for code in asked]) < 0.2 * len(x)


def test_other_columns_and_a_large_group_of_one_vector(spark):
    same = [[0.6, 0.8, 0.0]] * 300
    rows = [(i, v, 1.5, "x") for i, v in enumerate(same)] + [(300, [0.0, 0.0, 1.0], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, `query.id` string")
    got = V.search(df, F.col("vec_id") == 300).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i + 1, i, 0.0) for i in range(20)]


def test_odd_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (40, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (1, [0.9, 0.1]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in V.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)] or got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert V.search(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert V.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []
