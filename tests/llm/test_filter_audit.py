"""The filter audit against running every order of the filters."""

import random
from itertools import permutations

import numpy as np
import pytest

from folio.llm import filter_audit as A

DOCS = "doc_id long, source string, text string, part string, good long, digest long, fails string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """All rows by (part, order, step)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    judged = []
    for d, s, t in docs:
        t = t or ""
        ws = t.encode().split()
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": bool(set(t) & set("#$%&*|")), "E": d is not None and d > first[t],
        }
        judged.append((s or "", fails, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in judged}:
        mine = [x[1:] for x in judged if x[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                share[f] += len(gone)
                failing = [x for x in mine if x[0][f]]
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(x[0].values()) == 1 for x in failing), sum(x[1] for x in gone), sum(x[2] for x in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_orders(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "b", "word", "Big", "x#", "é"]) + str(rng.randrange(n)) for _ in range(rng.choice([0, 10, 199, 200, 260]))) for n in (3, 50, 2000) for _ in range(12)]
    docs = [(rng.choice([None, rng.randrange(90)]), rng.choice(["s", "t", "", None]), rng.choice([None, *texts])) for _ in range(150)]
    labels = [(rng.choice([None, rng.randrange(90)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    df = spark.createDataFrame([(*d, "p", 1, 2, "f") for d in docs], DOCS)
    found = A.audit(df, spark.createDataFrame(labels, LABELS)).collect()
    expected = plain(docs, labels)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in found} == expected and len(found) == len(expected)


def test_bit_counts_are_exact():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 64, 1000, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert A.bit_counts(words).tolist() == [int((words >> i & 1).sum()) for i in range(32)]
    assert A.bit_counts(np.full(5000, 0xFFFFFFFF, np.uint32)).tolist() == [5000] * 32


def test_edge_cases(spark):
    labels = spark.createDataFrame([], LABELS)
    assert A.audit(spark.createDataFrame([], DOCS), labels).collect() == []
    long = "w " * 500_000
    df = spark.createDataFrame([(1, None, long, "p", 1, 2, "f"), (1, "", long, "p", 1, 2, "f"), (2, None, long, "p", 1, 2, "f")], DOCS)
    rows = {(r.filter_order, r.step): r for r in A.audit(df, labels).collect()}
    assert len(rows) == 600
    last = rows["EBACD", 1]
    assert (last.part, last.kept, last.removed, last.unique_fails) == ("", 2, 1, 0)
