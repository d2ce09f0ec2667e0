"""SimHash against brute force: fingerprints by plain counting, components by all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import simhash_dedup as S


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, codes):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, d in enumerate(ids)}


def corpus():
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [rng.choice("alpha Beta gamma delta épsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
    return [*texts, texts[0], None, "", "  \t", "one", "ONE", "one two three", "a b c d", "a b c d e", "x\x0by\x1cz"]


def test_fingerprints_match_plain_counting():
    for t in [*corpus(), "w " * 70000]:
        assert S.fingerprint(t) & (1 << 64) - 1 == plain(t)


@pytest.mark.parametrize("chunk", [8192, 3])
def test_components_match_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = [(100 - i, t, "x") for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    assert got == classes([r[0] for r in rows], [plain(r[1]) for r in rows])
    stay = S.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(got.values()))


def test_link_group_joins_dense_and_sparse_codes():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    codes = {rng.getrandbits(64) for _ in range(50)}
    while len(codes) < 400:
        c = centre
        for _ in range(rng.randrange(1, 7)):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    codes = sorted(codes)
    parent = {c: c for c in codes} | dict(S.link_group(codes))
    want = classes(codes, codes)
    assert all(S_root(parent, c) == want[c] for c in codes)


def S_root(parent, c):
    while parent[c] != c:
        c = parent[c]
    return c


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert S.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    twice = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (2, None), (None, "same words here")], schema)
    assert sorted(map(str, (tuple(r) for r in S.near_duplicates(twice).select("doc_id", "component_id").collect()))) == sorted(map(str, [(1, 1), (1, 1), (2, 2), (None, 1)]))
    assert S.one_of_each(twice).where(F.col("doc_id") == 1).count() == 1
    odd = [(5, "alpha beta"), (5, "gamma delta"), (5, "gamma delta"), (None, "eta"), (None, "eta"), (None, "theta iota"), (9, "alpha beta"), (None, "alpha beta")]
    stay = sorted(((r.doc_id or 0), r.text) for r in S.one_of_each(spark.createDataFrame(odd, schema)).collect())
    assert stay == [(0, "eta"), (0, "theta iota"), (5, "alpha beta"), (5, "gamma delta")]
