"""Mixing against a plain weighted fair queue; edge cases."""

import hashlib
import random

import pytest

from folio.llm import mixing as M


def plain(rows):
    """size, target and taken by row index."""
    sizes = [len((t or "").encode().split()) for _, _, t in rows]
    keys = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    total = {k: sum(n for n, (_, s, _) in zip(sizes, rows) if s == k) for k in keys}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    budget = 1.5 * sum(sizes)
    full, target = set(), {}
    while True:
        rest = budget - sum(2 * total[k] for k in full)
        left = sum(weight[k] for k in keys if k not in full)
        target = {k: 2.0 * total[k] if k in full else rest * weight[k] / left for k in keys}
        over = {k for k in keys if k not in full and target[k] > 2 * total[k]}
        if not over:
            break
        full |= over
    copies = []
    for i, k in enumerate(keys):
        mine = [(hashlib.md5((M.SHUFFLE_SEED + str(d if d is not None else "")).encode()).hexdigest(), d if d is not None else -1, sizes[j], j) for j, (d, s, _) in enumerate(rows) if s == k]
        upto = 0
        for _, _, n, j in sorted(mine):
            upto += n
            if n:
                copies += [(upto / target[k], i, 0, j), ((upto + total[k]) / target[k], i, 1, j)]
    taken, spent = [0] * len(rows), 0
    for _, _, _, j in sorted(copies):
        spent += sizes[j]
        if spent > budget:
            break
        taken[j] += sizes[j]
    return sizes, [target[s] for _, s, _ in rows], taken


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_plain_queue(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "hot"] if seed == 1 else ["x", "y"]
    rows = [(i, rng.choice([*names, "hot"]) if seed == 1 else rng.choice(names), rng.choice([None, "", "w " * rng.randrange(0, 60)])) for i in range(150)]
    df = spark.createDataFrame([(d, s, t, 7) for d, s, t in rows], "doc_id long, source string, text string, size long")
    got = {r.doc_id: (r.size, r.target, r.copies * r.size) for r in M.mix(df).collect()}
    sizes, targets, taken = plain(rows)
    for i in range(len(rows)):
        assert got[i][0] == sizes[i] and got[i][1] == pytest.approx(targets[i]) and got[i][2] == taken[i]
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(t // n if n else 1 for n, t in zip(sizes, taken))


def test_edge_cases(spark):
    schema = "doc_id long, source string, text string"
    assert M.mix(spark.createDataFrame([], schema)).collect() == []
    empty = spark.createDataFrame([(1, "a", None), (2, None, "")], schema)
    assert {(r.size, r.target, r.copies) for r in M.mix(empty).collect()} == {(0, 0.0, 0)}
    twice = spark.createDataFrame([(1, "a", "x y z"), (1, "a", "x y z"), (None, "a", "q")], schema)
    assert sum(r.copies * r.size for r in M.mix(twice).collect()) <= 1.5 * 7
