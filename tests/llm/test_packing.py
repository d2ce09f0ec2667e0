"""Packing: exact bin contents, dominance against an exact solver, ids against the tokenizers library."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np

from folio.llm import packing as P


def expand(groups):
    return [[x for x, t in items for _ in range(t)] for n, items in groups for _ in range(n)]


def best(items, cap):
    @lru_cache(None)
    def go(rest, room):
        if not rest:
            return 0
        found = 99
        for i, x in enumerate(rest):
            if i and rest[i - 1] == x:
                continue
            left = rest[:i] + rest[i + 1 :]
            found = min(found, go(left, room - x) if x <= room else 1 + go(left, cap - x))
        return found

    return go(tuple(sorted(items, reverse=True)), 0)


def test_plans_hold_each_piece_once_and_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for trial in range(150):
        cap = rng.choice([10, 12, 20])
        items = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 9))]
        counts = {x: items.count(x) for x in set(items)}
        rest = dict(counts)
        fixed = P.reduce_by_dominance(rest, cap)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + best(left, cap) == best(items, cap)
        bins = expand(fixed) + expand(P.best_fit(rest, cap))
        assert sorted(x for b in bins for x in b) == sorted(items)
        assert all(0 < sum(b) <= cap for b in bins)
        assert len(bins) <= best(items, cap) + 1


def test_large_instance_is_close_to_the_bound():
    rng = random.Random(4)
    counts = {x: rng.randrange(1, 3000) for x in range(1, 1025)}
    placed = P.plan(counts)
    total = sum(x * n for x, n in counts.items())
    used = 1 + max(s + (counts[x] - r if i + 1 == len(v) else v[i + 1][0] - r - 1) // m for x, v in placed.items() for i, (r, s, m, _) in enumerate(v))
    assert used <= 1.01 * max(-(-total // 1024), sum(n for x, n in counts.items() if x > 512))
    assert sum(map(len, placed.values())) < 20_000


def test_documents_are_packed_whole(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["wörd", "a", "Token,", "12 3", "\n\n", "x" * 30]) for _ in range(rng.randrange(0, 3000))) for _ in range(40)]
    texts += [None, "", "same", "same", "tail <|endoftext|> text", "é ß 漢字 🙂" * 5]
    rows = [(i, t, 7, 9) for i, t in enumerate(texts)] + [(2, texts[2], 7, 9), (2, texts[3], 7, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset int")
    got = P.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for k, n in enumerate(P.cut(len(ids))):
            want.append((i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    ids = P.token_pieces(docs).where("doc_id = 45").first()
    assert ids.ids == [*tokenizer.encode(texts[45], add_special_tokens=False).ids, 2]
    assert P.pack_documents(docs.where("false")).collect() == []


def test_ids_of_very_long_texts_equal_the_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "a " + "\n" * 1_200_000 + "b", "ab " * 700_000, "!" * 300_000, " \t" * 600_000 + "x", "é" * 200_000):
        assert P.token_ids(text, P.default_vocabulary()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_very_long_text_is_packed_whole(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "x")], "doc_id long, text string")
    got = P.pack_documents(docs).where("doc_id = 1").collect()
    assert sum(r.length for r in got) == 1_000_001 and max(r.length for r in got) == 1024
