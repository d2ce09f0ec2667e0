"""Phrase mining against counting every phrase."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.llm import phrase_mining as P

SCHEMA = "doc_id long, lang string, text string, words string, n long, phrase string"


def plain(docs, least, top):
    """All rows, by counting phrases one by one."""
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(ws)
            for i in range(len(ws)):
                for j in range(i + 1, min(i + 5, len(ws)) + 1):
                    counts[lang, tuple(ws[i:j])] += 1
    held = {k: n for k, n in counts.items() if n >= least}
    inner = {(lang, p[i:j]) for (lang, p), n in held.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * n >= 100 * held[lang, p[i:j]]}
    out = []
    for (lang, p), a in held.items():
        if len(p) > 1 and (lang, p) not in inner:
            cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    rows = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(rows)


@pytest.mark.parametrize(("seed", "shard", "hot", "flush"), [(1, 1 << 21, 1 << 20, 1 << 20), (2, 50, 40, 64), (3, 20, 5, 500), (4, 300, 1, 100)])
def test_matches_counting(spark, seed, shard, hot, flush):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "ü", "É", "x.y", "cat", "sat", "on", "mat", "z\x00", "tab\there"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    docs = []
    for _ in range(200):
        words = [rng.choice(vocabulary[: rng.choice([3, 13])]) + rng.choice(["", "", "", ",", "\n", "!"]) for _ in range(rng.randrange(0, 40))]
        docs.append((rng.choice(["en", "de", None, "und"]), rng.choice([None, passage, passage, " ".join(words), " ".join(words)])))
    df = spark.createDataFrame([(1, lang, text, "w", 3, "p") for lang, text in docs], SCHEMA).repartition(3)
    found = P.collocations(df, least=5, top=40, shard=shard, hot_from=hot, flush=flush)
    assert sorted(map(tuple, found.collect())) == plain(docs, 5, 40)


def test_scores_beyond_64_bits(spark):
    rows = [(10**13 + i, 10**16 + 7 * i, 10**14 + i, 3 * 10**14 + i) for i in range(5)]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long").select(F.expr(P.SCORE).alias("s")).collect()
    assert [r.s for r in found] == [1000 * a * n // (le * r) for a, n, le, r in rows]


def test_edge_cases(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    empty = spark.createDataFrame([(1, None, None, "", 1, ""), (2, "en", "", "", 1, ""), (3, "en", " .\t!", "", 1, "")], SCHEMA)
    assert P.collocations(empty, least=1).collect() == []
    long = spark.createDataFrame([(1, "en", "foo bar " * 200_000, "", 1, "")], SCHEMA)
    assert sorted(map(tuple, P.collocations(long, least=100).collect())) == plain([("en", "foo bar " * 200_000)], 100, 2000)
