"""Substring dedup: words under windows that a smaller document holds too go, by suffix automata.

Reference text is cut into shards by anchors (see ``anchors``): two equal windows of ``WINDOW`` words have the same
anchor, so all text that a window must be looked up in stands in the contexts of one anchor value. Contexts that are
equal as a whole are settled by their smallest doc_id. For the others a suffix automaton is built over the reference
shard, the contexts of one anchor in the order of their doc_ids: a document's context is streamed through the automaton
of all smaller documents for its matching statistics, its maximal spans of at least ``WINDOW`` words are recorded, and
only then, and only if it holds a new window, is the automaton extended by it. The shards hold the whole corpus
together, which has no size bound, so they are not broadcast but meet their documents in the shuffle. No automaton grows
with the data: a shard of more than ``CHUNK`` contexts is met as pairs of chunks, and an anchor with more than ``MOST``
chunks of contexts has its windows looked up one by one by their 128-bit digests, which spreads them over all tasks.

Windows are judged on the input. Null text has no words; rows without a doc_id lose nothing and take nothing from
others. Rows of one doc_id are the same document and take nothing from each other. Texts may have any length; empty tables
give empty results. Other columns are carried; only ``spans``, ``n_words``, ``n_removed`` and ``kept`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.anchors import in_chunks, keyed, merged, shared_contexts, split_by_size, window_digests, with_spans, word_items
from folio.llm.common import WORD_PATTERN, keep, map_columns, map_rows, named, table

WINDOW = 50
GRAM = 16
#: Differing contexts of an anchor that meet in one automaton, and chunks that are met as pairs: a context has MOST copies at most.
CHUNK = 1024
MOST = 16
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class SuffixAutomaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, state: int, above: int, word: object) -> int:
        """Split off the part of ``state`` that is one longer than ``above``."""
        new = len(self.next)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(self.length[above] + 1)
        self.link[state] = new
        while above >= 0 and self.next[above].get(word) == state:
            self.next[above][word] = new
            above = self.link[above]
        return new

    def add(self, words: list) -> None:
        """Extend by one more sequence."""
        last = 0
        for w in words:
            known = self.next[last].get(w)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._copy(known, last, w)
                continue
            new, above = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            while above >= 0 and w not in self.next[above]:
                self.next[above][w] = new
                above = self.link[above]
            if above >= 0:
                state = self.next[above][w]
                self.link[new] = state if self.length[state] == self.length[above] + 1 else self._copy(state, above, w)
            last = new

    def matches(self, words: list, least: int) -> list[tuple[int, int]]:
        """The spans of ``words`` covered by substrings of at least ``least`` words that the sequences hold.

        A span ends where the window of ``least`` words that ends there is not held, so spans may overlap, and one span
        over all words says that the sequences hold every window.
        """
        state, length, spans = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            if length >= least:
                if spans and spans[-1][1] == i:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - length, i + 1))
        return spans


def match_shard(contexts: list[tuple[int, tuple, list]], least: int) -> Iterator[tuple[tuple, int, int]]:
    """For (doc, payload, words) of one anchor: the spans that smaller documents hold, as (payload, start, end)."""
    automaton = None
    contexts.sort(key=lambda c: c[0])
    at = 0
    while at < len(contexts):
        upto = at
        while upto < len(contexts) and contexts[upto][0] == contexts[at][0]:
            upto += 1
        fresh = []
        for _, payload, words in contexts[at:upto]:
            spans = automaton.matches(words, least) if automaton else []
            for a, b in spans:
                yield payload, a, b
            if spans != [(0, len(words))]:
                fresh.append(words)
        if upto < len(contexts):
            automaton = automaton or SuffixAutomaton()
            for words in fresh:
                automaton.add(words)
        at = upto


def duplicated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int | None = None) -> DataFrame:
    """(doc, row, a, b): word spans of ``anchors.keyed`` rows under windows that a smaller document holds too."""
    rows, group = keyed(docs.where("doc_id IS NOT NULL")), group or CHUNK
    contexts = shared_contexts(rows, word_items, window, gram)
    classes = keep(contexts.groupBy("hash", "digest").agg(F.min("doc").alias("least")), "classes")
    several = classes.groupBy("hash").agg(F.count("*").alias("of"), F.min("least").alias("low"))
    several = keep(several.where("of > 1").select("hash", "of"), "several")
    settled = keep(contexts.join(classes, ["hash", "digest"]), "settled")
    alike = settled.where("doc > least").select(
        "doc", "row", F.col("first").alias("a"), (F.col("first") + F.col("windows") + window - 1).alias("b")
    )
    members = settled.where("doc = least").join(several, "hash")
    grouped, common = split_by_size(members.select("hash", "digest", "of", "doc", "row", "first", "windows", F.lit(False).alias("known")), MOST * group)
    grouped = in_chunks(grouped, group)
    asking = lambda m, *c: rows.join(m.groupBy("doc", "row").agg(F.collect_set(F.struct(*c, "first", "windows")).alias("want")), ["doc", "row"])
    key = ["hash", "i", "j"]
    names = [*key, "doc", "row", "first", "words"]

    def send(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {c: [] for c in names}
            for doc, row, text, want in zip(b["doc"], b["row"], b["text"], b["want"], strict=True):
                words = (text or "").encode().split()
                for x in want:
                    held = b" ".join(words[x["first"] : x["first"] + x["windows"] + window - 1])
                    for c, v in zip(names, (x["hash"], x["i"], x["j"], doc, row, x["first"], held), strict=True):
                        out[c].append(v)
            yield out

    def match(batches: Iterator[dict]) -> Iterator[dict]:
        held: list = []
        now = None
        for b in batches:
            out: list = []
            for *at, doc, row, first, words in zip(*(b[c] for c in names), strict=True):
                if at != now:
                    out += match_shard(held, window)
                    held, now = [], at
                held.append((doc, (doc, row, first), words.split()))
            yield spans(out)
        yield spans(list(match_shard(held, window)))

    def spans(found: list) -> dict:
        return {
            "doc": [p[0] for p, _, _ in found], "row": [p[1] for p, _, _ in found],
            "a": [p[2] + a for p, a, _ in found], "b": [p[2] + b for p, _, b in found],
        }

    kinds = [("hash", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("words", pa.binary())]
    sent = map_rows(asking(grouped, *key), send, "hash long, i int, j int, doc long, row long, first int, words binary", pa.schema(kinds))
    span = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
    differing = map_rows(
        sent.repartition(*key).sortWithinPartitions(*key), match, "doc long, row long, a int, b int", span
    )
    found = alike.union(differing)
    if several.where(F.col("of") > MOST * group).isEmpty():
        return found
    windows = window_digests(asking(common, "known"), word_items, window)
    least = windows.groupBy("key").agg(F.min("doc").alias("least"))
    single = windows.join(least, "key").where("doc > least").select("doc", "row", "a", (F.col("a") + window).alias("b"))
    return found.union(single)


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int | None = None) -> DataFrame:
    """``docs`` with spans, the removed word ranges (start, end), n_words, and kept, the words that stay, joined by one space."""
    marked = with_spans(docs, duplicated_spans(docs, window, gram, group))
    given = docs.columns
    added = ("spans", "n_words", "n_removed", "kept")
    columns = [c for c in given if c not in added]
    index = given.index("text")
    schema = docs.select(*map(named, columns)).schema
    schema = schema.add("spans", SPANS).add("n_words", "long").add("n_removed", "long").add("kept", "string")

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        spans, total, removed, kept = [], [], [], []
        for text, own in zip(arrays[index].to_pylist(), arrays[-1].to_pylist(), strict=True):
            words = (text or "").encode().split()
            cut = merged([(x["a"], x["b"]) for x in own or ()])
            edges = [0, *(x for s in cut for x in s), len(words)]
            stay = [w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z]]
            spans.append([{"start": a, "end": z} for a, z in cut])
            total.append(len(words))
            removed.append(len(words) - len(stay))
            kept.append(b" ".join(stay).decode())
        made = [pa.array(spans, span), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return [*(x for x, c in zip(arrays, given, strict=False) if c in columns), *made]

    return map_columns(marked, run, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document's words."""
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS ws FROM documents),
x AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, doc_id, i, n, word, CASE WHEN i + {WINDOW - 1} <= n THEN
        string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) END AS gram FROM x),
f AS (SELECT gram, min(doc_id) AS first FROM g WHERE gram IS NOT NULL GROUP BY gram),
m AS (SELECT r, i, word, coalesce(first < doc_id, false) AS hit FROM g LEFT JOIN f USING (gram)),
c AS (SELECT r, i, word, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL = {"op3_substring_dedup": ORACLE}
