"""Substring dedup against brute force over all windows; the automaton against plain substring search."""

import random

import pytest

from folio.llm import substring_dedup as S


def brute(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((d is None, d or 0, len(w), sum(gone), kept))
    return sorted(out)


def corpus(seed, window):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("ab Ab é ß, x.").strip() or "q" for _ in range(n)]
    shared = [words(rng.randrange(window - 2, 3 * window)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += words(rng.randrange(0, window)) + s[a : a + rng.randrange(1, len(s))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(70, rows[3][1]), (71, "again " * 3 * window), (72, "again " * 3 * window), (73, None), (74, ""), (75, "w " * (window - 1)), (None, rows[3][1])]
    return [*rows, (5, rows[5][1]), (5, rows[6][1]), (8, rows[70 - 10][1])]


@pytest.mark.parametrize("chunk", [1024, 3])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = corpus(chunk, 8)
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, kept string").repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in S.deduplicate(docs, 8, 4).collect())
    assert got == brute(rows, 8)


def test_production_window_and_empty_table(spark):
    rows = corpus(4, 50)[:25]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in S.deduplicate(docs).collect())
    assert got == brute(rows, 50)
    assert S.deduplicate(docs.where("false")).collect() == []


def test_automaton_finds_all_common_windows():
    rng = random.Random(1)
    for _ in range(200):
        seqs = [[rng.choice("abc") for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 5))]
        query = [rng.choice("abc") for _ in range(30)]
        automaton = S.SuffixAutomaton()
        for s in seqs:
            automaton.add(s)
        held = {tuple(s[i : i + 4]) for s in seqs for i in range(len(s) - 3)}
        gone = set()
        for i in range(27):
            if tuple(query[i : i + 4]) in held:
                gone |= set(range(i, i + 4))
        assert {x for a, b in automaton.matches(query, 4) for x in range(a, b)} == gone


def test_context_covered_by_two_others_is_still_reference():
    w = list(range(84))
    shard = [(0, 0, w[:50]), (1, 1, w[34:]), (2, 2, w), (3, 3, w[10:60]), (4, 4, w[10:60] + ["x"])]
    gone = {}
    for doc, a, b in S.match_shard(shard, 50):
        gone.setdefault(doc, set()).update(range(a, b))
    assert gone == {2: set(w), 3: set(range(50)), 4: set(range(50))}


def test_windows_of_covered_documents_match_brute_force(spark):
    rows = []
    for k in range(60):
        w = [f"{k}.{i}" for i in range(12)]
        rows += [(4 * k + i, " ".join(w[a:b])) for i, (a, b) in enumerate([(0, 8), (4, 12), (0, 12), (2, 10)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in S.deduplicate(docs, 8, 4).collect())
    assert got == brute(rows, 8)


def test_a_very_long_text_and_other_columns(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words), "mine", 1), (2, "a " + " ".join(words[90_000:90_070]) + " b", None, 2), (3, None, "x", 3)]
    out = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, kept int"))
    assert out.columns == ["doc_id", "text", "a.b", "spans", "n_words", "n_removed", "kept"]
    got = {r.doc_id: (r.n_words, r.n_removed, r["a.b"]) for r in out.collect()}
    assert got == {1: (150_000, 0, "mine"), 2: (72, 70, None), 3: (0, 0, "x")}


@pytest.mark.parametrize("chunk,most", [(2, 1), (1, 2)])
def test_windows_of_common_anchors_match_brute_force(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "MOST", most)
    rows = corpus(5, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in S.deduplicate(docs, 8, 4).collect())
    assert got == brute(rows, 8)
