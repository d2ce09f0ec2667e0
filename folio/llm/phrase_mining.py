"""Phrase collocation mining on a weighted de Bruijn graph of word grams, one graph per language.

``A-Z`` is lower-cased, texts are split at ``.,;:!?`` and line breaks into pieces and those at spaces and tabs into words.
Nodes are grams of ``LONGEST - 1`` words, edges the grams of ``LONGEST`` words that join them; a gram at the end of a piece
is shorter. Only these longest grams are counted, the flow through a node gives the count of the shorter phrase: the sum of
its out-edges, plus the grams that end there with the piece. A node whose flow leaves by one edge alone is unary, and a path
of such nodes is one row: its longest gram, from which length on it holds, and the count.

Tasks read texts and gather the grams of ``FLUSH`` words at a time, each distinct one with its count, as one binary row per
shard: a word list and places in it. The shard is chosen by a gram's first two words, so that all flows of a node meet in
one shard and nothing has to be shuffled again for the shorter phrases. Where both words are ``hot`` (over ``HOT`` occurrences
in a language, and among the ``MOST_HOT`` most frequent ones) the third counts too, and so on, which spreads the grams of the
commonest words over many shards; phrases of hot words alone are then summed over the shards. A shard has about ``SHARD``
grams, however large the corpus is. Equal copies of a passage add up before the shuffle, once a flush.

Phrases of at least ``least`` occurrences are few; scores, the cut with the lowest one, and the drop of phrases inside longer
ones that are as frequent, are joins over them. As a count can't grow with the phrase, it is enough to look at phrases longer by
one word. Scores are exact: products in decimals of 38 digits.

Nulls: a null text is empty, a null lang is ``und``. Repeated rows count each. Ties of a score go to the shorter first part,
those of a rank to the more frequent phrase, then to UTF-8 order. Texts may have any length. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import keep, slices, table

LONGEST = 5
LEAST = 100
TOP = 2000
FLUSH = 1 << 20
SHARD = 1 << 21
HOT = 1 << 20
MOST_HOT = 1 << 16
UNKNOWN = "und"
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
#: A byte that UTF-8 never has stands for the separators.
_CUT = b"\xff"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + SEPARATORS.encode(), bytes(range(97, 123)) + _CUT * len(SEPARATORS))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; ``_CUT`` stands between pieces."""
    return (text or "").encode().translate(_TABLE).replace(_CUT, b" " + _CUT + b" ").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""
    kinds = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                del found[_CUT]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "word": [w.decode() for w in found], "n": list(found.values())}, schema=kinds)
            held.clear()

        for b in slices(batches):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > FLUSH // 4:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _packed(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sum of the weights of each."""
    order = np.lexsort(rows.T[::-1])
    rows, weights = rows[order], weights[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(1)
    starts = np.flatnonzero(first)
    return rows[starts], np.add.reduceat(weights, starts) if len(rows) else weights


def _grams(ids: np.ndarray) -> np.ndarray:
    """The longest gram from each word on, filled up with 0 behind the end of its piece; 0 in ``ids`` ends a piece."""
    held = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    out = np.lib.stride_tricks.sliding_window_view(held, LONGEST)[: len(ids)]
    out = out[out[:, 0] > 0]
    return np.where(np.minimum.accumulate(out > 0, axis=1), out, 0)


def _shards(grams: np.ndarray, codes: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The shard of each gram, by its first two words and the hot ones' followers."""
    code = codes[grams[:, 0]]
    goes_on = hot[grams[:, 0]]
    for i in range(1, grams.shape[1]):
        mixed = (code ^ (codes[grams[:, i]] + np.uint64(i))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        code = np.where(goes_on, mixed, code) if i > 1 else mixed
        goes_on = goes_on & hot[grams[:, i]]
    return (code % np.uint64(n)).astype(np.int64)


_BLOBS = "shard int, lang string, words binary, grams binary, weights binary"


def gathered_grams(docs: DataFrame, shards: int, hot: set[tuple[str, str]], flush: int = FLUSH) -> DataFrame:
    """Distinct longest grams with their counts, of a flush at a time: a row per flush, language and shard."""
    kinds = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("grams", pa.binary()), ("weights", pa.binary())])
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, dict[bytes, int]] = {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        sizes: Counter = Counter()

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            grams = _grams(np.concatenate(held.pop(lang)))
            words = list(places.pop(lang))
            del sizes[lang]
            grams, weights = _packed(grams, np.ones(len(grams), np.int64))
            salt = zlib.crc32(lang.encode())
            codes = np.array([0, *(zlib.crc32(w, salt) for w in words[1:])], np.uint64)
            codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            is_hot = np.array([False, *((lang, w.decode()) in known.value for w in words[1:])])
            shard = _shards(grams, codes, is_hot, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                used, inner = np.unique(grams[part], return_inverse=True)
                ends = len(used) > 0 and used[0] == 0
                inner = inner.reshape(-1, LONGEST) + (0 if ends else 1)
                own = b" ".join(words[i] for i in used[1 if ends else 0 :])
                small = np.uint16 if len(used) < 65_535 else np.uint32
                row = [int(shard[part[0]])], [lang], [own], [small().itemsize.to_bytes(1, "little") + inner.astype(small).T.tobytes()], [zlib.compress(weights[part].tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, kinds, strict=True)], schema=kinds)

        for b in slices(batches):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                found = words_of(text)
                if lang not in places:
                    numbers = count()
                    places[lang] = defaultdict(numbers.__next__)
                    places[lang][_CUT]
                held[lang].append(np.fromiter(map(places[lang].__getitem__, found), np.int32, len(found)))
                held[lang].append(np.zeros(1, np.int32))
                sizes[lang] += len(found) + 1
                if sizes[lang] >= flush:
                    yield from out(lang)
            while sum(sizes.values()) >= 2 * flush:
                yield from out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from out(lang)

    return docs.mapInArrow(run, _BLOBS)


def _unpacked(words: bytes, grams: bytes, weights: bytes, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Grams as places in ``numbers``, which learns new words; 0 ends a piece."""
    own = np.array([0, *(numbers[w] for w in words.split(b" "))], np.int32)
    kind = np.uint16 if grams[0] == 2 else np.uint32
    return own[np.frombuffer(grams, kind, offset=1).reshape(LONGEST, -1).T], np.frombuffer(zlib.decompress(weights), np.int64)


def paths(grams: np.ndarray, weights: np.ndarray, hot: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, int, int, bool]]:
    """(words, from, to, count, whole): unary paths of the shard's graph.

    Every phrase made of the first ``from`` to ``to`` words has that count; ``whole`` is false if other shards may have more of
    it. Paths below ``least`` are left out if they are whole. Phrases of one word are not given.
    """
    grams, weights = _packed(grams, weights)
    # The flow of every prefix: the sum of its out-edges and of the grams that end with it.
    levels = []
    for k in range(LONGEST, 1, -1):
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:, :k] != grams[:-1, :k]).any(1)
        starts = np.flatnonzero(first)
        flow = np.add.reduceat(weights, starts) if len(starts) else weights
        full = grams[starts, k - 1] > 0
        levels.append((k, starts[full], flow[full]))
    after: dict[int, int] = {}
    found: dict[int, tuple[int, int]] = {}
    for k, starts, flow in levels:
        # A phrase of hot words alone has grams in other shards, which its first words did not choose.
        part = hot[grams[starts, :k]].all(1) & (k < LONGEST)
        due = np.flatnonzero((flow >= least) | part)
        now: dict[int, tuple[int, int]] = {}
        for j in due:
            at, n, whole = int(starts[j]), int(flow[j]), not part[j]
            # The only out-edge of a unary node begins at the same row and bears the same flow.
            if whole and at in found and found[at][1] == n:
                now[at] = (found[at][0], n)
                del found[at]
            else:
                now[at] = (k, n)
            if not whole:
                yield grams[at, :k], k, k, n, False
                del now[at]
        for at, (to, n) in found.items():
            yield grams[at, :to], after[at], to, n, True
        found, after = now, {**dict.fromkeys(now, k)}
    for at, (to, n) in found.items():
        yield grams[at, :to], after[at], to, n, True


def phrase_paths(blobs: DataFrame, hot: set[tuple[str, str]], least: int, shards: int, shard_size: int = SHARD) -> DataFrame:
    """(lang, phrase, first, last, n, whole): the paths of all shards, each shard in one task."""
    kinds = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int64()), ("whole", pa.bool_())])
    known = blobs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, parts, buffered = None, None, [], 0

        def fresh() -> dict[bytes, int]:
            numbers = count()
            out = defaultdict(numbers.__next__)
            out[_CUT]
            return out

        def out() -> Iterator[pa.RecordBatch]:
            words = [w.decode() for w in list(numbers)[1:]]
            hot_words = np.array([False, *((key[1], w) in known.value for w in words)])
            rows = list(paths(np.concatenate([g for g, _ in parts]), np.concatenate([w for _, w in parts]), hot_words, least))
            parts.clear()
            for i in range(0, len(rows), 50_000):
                some = rows[i : i + 50_000]
                phrases = [" ".join(words[x - 1] for x in g) for g, *_ in some]
                yield pa.RecordBatch.from_pydict(
                    {"lang": [key[1]] * len(some), "phrase": phrases, "first": [r[1] for r in some], "last": [r[2] for r in some], "n": [r[3] for r in some], "whole": [r[4] for r in some]}, schema=kinds
                )

        for b in slices(batches):
            for shard, lang, words, grams, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (shard, lang):
                    if key is not None:
                        yield from out()
                    key, numbers, buffered = (shard, lang), fresh(), 0
                parts.append(_unpacked(words, grams, weights, numbers))
                buffered += len(parts[-1][0])
                if buffered > shard_size:  # copies of many flushes add up
                    merged = _packed(np.concatenate([g for g, _ in parts]), np.concatenate([w for _, w in parts]))
                    parts[:] = [merged]
                    buffered = max(0, len(merged[0]) - shard_size)
        if key is not None:
            yield from out()

    sent = blobs.repartition(shards, "shard", "lang").sortWithinPartitions("shard", "lang")
    return sent.mapInArrow(run, "lang string, phrase string, first int, last int, n long, whole boolean")


def phrase_counts(docs: DataFrame, least: int = LEAST, shard: int = SHARD, hot_from: int = HOT, flush: int = FLUSH) -> tuple[DataFrame, DataFrame]:
    """Kept tables (lang, words, phrase, n) of all phrases of 1 to LONGEST words with ``least`` occurrences, and (lang, n) of all words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    docs = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))
    singles = keep(word_counts(docs), "words")
    totals = keep(singles.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    most = singles.where(F.col("n") > hot_from).orderBy(F.desc("n"), "lang", "word").limit(MOST_HOT)
    hot = {(r.lang, r.word) for r in most.collect()}
    shards = max(1, math.ceil((totals.agg(F.sum("total")).first()[0] or 0) / shard))
    found = keep(phrase_paths(gathered_grams(docs, shards, hot, flush), hot, least, shards, shard), "paths")
    length = F.explode(F.sequence("first", "last"))
    whole = found.where("whole").select("lang", length.alias("words"), "phrase", "n").withColumn("phrase", F.expr("substring_index(phrase, ' ', words)"))
    part = found.where("NOT whole").groupBy("lang", F.col("last").alias("words"), "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ones = singles.where(F.col("n") >= least).select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), "n")
    return keep(whole.unionByName(part).unionByName(ones), "phrases"), totals


#: floor(1000 * a * n / (l * r)), exact for counts up to 17 digits.
SCORE = "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD, hot_from: int = HOT, flush: int = FLUSH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases."""
    counts, totals = phrase_counts(docs, least, shard, hot_from, flush)
    several = counts.where("words > 1")
    inner = several.where("words > 2").select("lang", "n", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    open_ = several.join(inner, ["lang", "phrase", "n"], "left_anti")
    cuts = open_.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    known = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.withColumnRenamed("n", "a").join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(totals.withColumnRenamed("total", "n"), "lang")
    scored = cuts.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_GRAMS = "\nUNION ALL ".join(f"SELECT lang, {k} AS words, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM p WHERE i + {k - 1} <= len(ws)" for k in range(1, LONGEST + 1))
ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
p AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
s AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE words > 1),
x AS (SELECT lang, a, unnest([array_to_string(ws[1:b], ' ') FOR b IN range(2, words)] || list_transform(range(2, words), lambda b: array_to_string(ws[b:words], ' '))
             || CASE WHEN words = 5 THEN [array_to_string(ws[2:3], ' '), array_to_string(ws[3:4], ' '), array_to_string(ws[2:4], ' ')] WHEN words = 4 THEN [array_to_string(ws[2:3], ' ')] ELSE [] END) AS phrase FROM s),
o AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = s.lang AND x.phrase = s.phrase AND 100 * x.a >= 100 * s.a)),
k AS (SELECT lang, phrase, a, ws, words, unnest(range(1, words)) AS k FROM o),
c AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, t.n, CAST(CAST(1000 AS HUGEINT) * k.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT lang, phrase, a, n, min(score) AS score, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r FROM c GROUP BY ALL)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b) WHERE rank <= {TOP}
"""

QUERIES = {"op12_phrase_mining": op12_phrase_mining}
SQL = {"op12_phrase_mining": ORACLE}
