"""Filter interaction audit: what every subset of five filters lets through, from truth-table words.

Filters, by what fails a document: A under ``MIN_WORDS`` words; B distinct words under ``MIN_DISTINCT_PERCENT`` of all; C
``[A-Z]`` over ``MAX_CAPITAL_PERCENT`` of all code points; D any character of ``SYMBOLS``; E the text of a smaller doc_id.
A document's failures choose one of 32 words of 32 bits: bit s says whether it survives the subset s of the filters. Counting
every bit over all words, in carry-save adders over arrays of words, tells the survivors of all subsets by part and label;
each order, step and share follows from these 32 numbers.

Null text is empty (no words: A fails, B and C don't), null source and the empty one are the part ``''``. A document is good
or toxic if any row of ``labels`` with its doc_id says 1; null doc_ids have no labels, are no copies and make none. Repeated
rows of one doc_id count each, and are no copies of one another. Texts may have any length. An empty table gives no rows.
Other columns are ignored, whatever their names.

One pass reads the texts and leaves some 50 bytes a document in a kept table; groups of copies and labels are joined to it
as kept tables of one row a key, so that a hot text is split by the adaptive join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import WORD_PATTERN, keep, map_rows, table

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = "#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SUBSETS = 1 << len(FILTERS)
_CAPITALS = bytes(range(65, 91))
#: By failing filters: the word whose bit s is set if the subset s holds none of them.
SURVIVAL = np.array([sum(1 << s for s in range(_SUBSETS) if not s & fails) for fails in range(_SUBSETS)], np.uint32)


def failures(text: str | None) -> tuple[int, bytes]:
    """Bits of the failed ones of A to D, and a digest of the text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    failed = (n < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITAL_PERCENT * len(text), any(c in text for c in SYMBOLS))
    return sum(f << i for i, f in enumerate(failed)), hashlib.sha256(raw).digest()[:16]


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits, by carry-save adders.

    Three words of one weight become their sum bits, of the same weight, and their carries, of twice the weight, until
    each weight has two words at most.
    """
    counts, weight = np.zeros(32, np.int64), 1
    places = np.arange(32, dtype=np.uint32)
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, rest])
        counts += weight * ((words[:, None] >> places) & 1).sum(0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails): one row per document of (doc_id, source, text), a narrow step."""
    kinds = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("fails", pa.int32())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [failures(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "part": b["part"], "digest": [d for _, d in found], "fails": [f for f, _ in found]}

    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id long, part string, digest binary, fails int", kinds)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, fails): every document with all five failures and its labels."""
    rows = keep(judged(docs), "judged")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = keep(first.where("first < last").select("digest", "first"), "copied")
    flags = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = keep(flags.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "flags")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    both = rows.join(copied, "digest", "left").join(flags, "doc_id", "left")
    fails = F.col("fails") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.select("part", flag("good"), flag("toxic"), fails.alias("fails"))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, everyone, good, toxic): arrays of the survivors of each of the 32 subsets, from ``labelled`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b["part"].dictionary_encode()
            good, toxic = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
            group = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + good * 2 + toxic
            words = SURVIVAL[b["fails"].to_numpy()]
            order = np.argsort(group, kind="stable")
            ids, starts = np.unique(group[order], return_index=True)
            counts = [bit_counts(w) for w in np.split(words[order], starts[1:])] if len(ids) else []
            names = parts.dictionary.to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [names[i // 4] for i in ids for _ in range(_SUBSETS)],
                    "good": [bool(i & 2) for i in ids for _ in range(_SUBSETS)],
                    "toxic": [bool(i & 1) for i in ids for _ in range(_SUBSETS)],
                    "subset": list(range(_SUBSETS)) * len(ids),
                    "n": np.concatenate(counts) if counts else [],
                },
                schema=pa.schema([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("subset", pa.int32()), ("n", pa.int64())]),
            )

    counted = rows.mapInArrow(run, "part string, good boolean, toxic boolean, subset int, n long")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    sums = counted.groupBy("part", "subset").agg(F.sum("n").alias("n"), total(F.col("good")).alias("g"), total(F.col("toxic")).alias("t"))
    listed = F.sort_array(F.collect_list(F.struct("subset", "n", "g", "t")))
    return sums.groupBy("part").agg(listed.alias("s")).select("part", F.col("s.n").alias("everyone"), F.col("s.g").alias("good"), F.col("s.t").alias("toxic"))


def _bits(letters: Column) -> Column:
    """The subset of the letters that stand in a string."""
    bit = lambda i, c: F.when(F.contains(letters, F.lit(c)), F.lit(1 << i)).otherwise(0)
    return sum((bit(i, c) for i, c in enumerate(FILTERS)), F.lit(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; 600 rows a part."""
    found = survivors(labelled(docs, labels))
    found = found.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    found = found.withColumn("now", _bits(F.substring("filter_order", F.lit(1), F.col("step"))))
    found = found.withColumn("own", _bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", F.col("now") - F.col("own"))
    at = lambda array, subset: F.get(array, subset)
    removed = lambda array: F.get(F.col(array), F.col("before")) - F.get(F.col(array), F.col("now"))
    everyone, own, full = F.col("everyone"), F.col("own"), _SUBSETS - 1
    # A subset without the filter stands before it in |s|! (4 - |s|)! of all orders.
    weights = F.array(*[F.lit(w) for w in (24, 6, 4, 6, 24)])
    share = lambda s: F.get(weights, F.bit_count(s)) * (at(everyone, s) - at(everyone, s + own))
    without = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(own) == 0)
    shapley = F.aggregate(without, F.lit(0).cast("long"), lambda acc, s: acc + share(s))
    return found.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), at(everyone, F.col("now")).alias("kept"), removed("everyone").alias("removed"),
        (at(everyone, F.lit(0)) - at(everyone, own) - removed("everyone")).alias("redundant"), (at(everyone, full - own) - at(everyone, F.lit(full))).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


_CHECKS = "n_words < {w}, 100 * n_distinct < {d} * n_words, 100 * n_capitals > {c} * n_chars, has_symbol, again".format(w=MIN_WORDS, d=MIN_DISTINCT_PERCENT, c=MAX_CAPITAL_PERCENT)
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD_PATTERN}') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS again FROM d),
f AS (SELECT doc_id, part, again, len(ws) AS n_words, len(list_distinct(ws)) AS n_distinct, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(text) AS n_chars,
             length(translate(text, '{SYMBOLS}', '')) < length(text) AS has_symbol FROM w),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, [{_CHECKS}] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM x GROUP BY ALL),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS own FROM o, i),
y AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS failed, len(list_filter(o[1:step - 1], lambda q: fails[q])) > 0 AS gone, len(list_filter(fails, lambda q: q)) AS n_fails FROM g, s),
z AS (SELECT part, o, step, own, CAST(sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN failed AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda q: 'ABCDE'[q]), '') AS filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
SQL = {"op13_filter_audit": ORACLE}
