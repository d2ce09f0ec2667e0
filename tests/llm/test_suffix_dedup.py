"""Suffix dedup against brute force over all strings; merging of front-coded runs against sorted()."""

import random
from collections import Counter

import numpy as np
import pytest

from folio.llm import anchors as A
from folio.llm import suffix_dedup as S


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans, last = [], False
        for i, g in enumerate(gone):
            if g and not last:
                spans.append([i, i])
            if g:
                spans[-1][1] = i + 1
            last = g
        out.append((spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(rng.randrange(window - 3, 3 * window)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [word(rng.randrange(0, window)), s[a : a + rng.randrange(1, len(s))]]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "xyxyxyxyxy" * window, "q" * (window - 1), "z" * window, "z" * (window + 1), None, "", word(5)]
    return texts


@pytest.mark.parametrize("chunk", [16384, 3])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "BUCKET", 7)
    texts = corpus(chunk, 20)
    docs = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)], "doc_id long, text string, row int, kept string").repartition(5)
    got = {r.doc_id: ([[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in S.deduplicate(docs, 20, 4).collect()}
    assert got == dict(enumerate(brute(texts, 20)))


def test_production_window_and_repeated_rows(spark):
    texts = corpus(9, 200)[:15]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept)) for r in S.deduplicate(docs).collect())
    assert got == sorted((i is None, i or 0, k) for (i, _), (_, k) in zip(rows, brute([t for _, t in rows], 200)))
    assert S.deduplicate(docs.where("false")).collect() == []
    clean = S.cleaned_documents(docs)
    assert clean.columns == ["doc_id", "text"] and clean.count() == len(rows)


def test_runs_merge_in_order_with_common_prefixes():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        runs, every = [], []
        for _ in range(k):
            items = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))), b"", (0, 0, 0, 0, 1, 0)) for _ in range(rng.randrange(1, 30)))
            runs.append(S.write_run(items))
            every += [x[0] for x in items]
        merged = list(S.merge_runs(runs))
        assert [m[1] for m in merged] == sorted(every)
        for a, b in zip(merged, merged[1:]):
            assert b[0] == S.common_prefix(a[1], b[1])


def test_anchors_cover_every_window_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    items = rng.integers(0, 3, 5000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*A.anchors(items, 20, 4))]
    assert whole[3].sum() == 4981 and (np.cumsum(whole[3]) - whole[3] == whole[2]).all()
    for h, at, first, n in zip(*whole):
        assert first <= at + 0 and at + 4 <= first + 20 + n - 1 and n <= 17


def test_pairs_and_blocks_agree():
    rng = random.Random(8)
    draw = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    for _ in range(60):
        texts = sorted((b"key" + draw(rng.randrange(4, 12)), draw(rng.randrange(0, 8))) for _ in range(rng.randrange(2, 30)))
        group = [(S.common_prefix(texts[i - 1][0], t[0]) if i else 0, *t, ()) for i, t in enumerate(texts)]
        spans = []
        for few in (0, 99):
            own = [[] for _ in group]
            for i, before, after in S.repeated(group, 3, 9, few):
                own[i].append((-before, after))
            spans.append([A.merged(x) for x in own])
        assert spans[0] == spans[1]


def test_columns_of_any_name_are_carried(spark):
    long = "x1 y2 z3 " * 40
    rows = [(1, long, "mine", 1.5, "dot", None), (2, "b" + long, "yours", None, None, 7), (3, None, "k", 2.5, "", 1)]
    schema = "doc_id long, text string, kept string, spans double, `a.b` string, n_chars int"
    out = S.cleaned_documents(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "kept", "spans", "a.b", "n_chars"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, "", "mine", 1.5, "dot", 0), (2, "b", "yours", None, None, 1), (3, None, "k", 2.5, "", None)]
    again = S.deduplicate(spark.createDataFrame(rows, schema)).collect()
    assert {(r.doc_id, bytes(r.kept), r["a.b"]) for r in again} == {(1, b"", "dot"), (2, b"b", None), (3, b"", "")}


def test_a_very_long_text(spark):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    docs = spark.createDataFrame([(1, body), (2, "zz" + body[700_000:700_300] + "zz")], "doc_id long, text string")
    got = {r.doc_id: (len(r.kept), [(s.start, s.end) for s in r.spans]) for r in S.deduplicate(docs).collect()}
    assert got == {1: (1_299_700, [(700_000, 700_300)]), 2: (4, [(2, 302)])}
