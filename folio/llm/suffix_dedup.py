"""Suffix-array dedup: bytes under repeated strings of ``WINDOW`` bytes go, by a distributed merge sort of suffixes.

The suffixes that are sorted begin at anchors (see ``anchors``): two equal strings have the same anchor at the same
place, and it occurs at least twice, so no other suffix can take part. Contexts of an anchor that are equal as a whole
are settled by count. The differing ones are exchanged as sorted, front-coded runs of suffixes, one for each task and
bucket, and a bucket's runs are combined by a loser tree: a suffix comes with its common prefix with its predecessor in
the run, which is the last one output, and nodes keep common prefixes with winners, so known prefixes are never compared
again. Beside the sorted suffixes stand the reversed texts before the anchors. A string that begins l bytes before an
anchor repeats exactly if another suffix shares its first ``WINDOW`` - l bytes and another text before it its first l,
both in one context: for few contexts each pair's common lengths tell, for many the blocks of both sorted orders do.

No group grows with the data: an anchor with more than ``CHUNK`` differing contexts (a common passage in ever other
surroundings) has its strings counted one by one by their 128-bit digests, which spreads them over all tasks.

Strings are judged on the input. Null text is empty. Repeated rows are documents of their own, so all of their long
texts repeat; ties need no order, as all copies of a string go. Texts may have any length, empty tables give empty
results, and other columns are carried; only ``spans`` and ``kept`` are replaced by ``deduplicate``.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.anchors import byte_items, keyed, merged, shared_contexts, split_by_size, window_digests, with_spans
from folio.llm.common import keep, map_columns, map_rows, named, table, with_length

WINDOW = 200
GRAM = 64
#: Differing contexts of an anchor that are sorted as one group.
CHUNK = 16384
#: Contexts of one exchanged bucket, about.
BUCKET = 20_000
#: Up to so many contexts of an anchor, pairs are looked at one by one.
FEW = 24
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Bytes of the anchor at the head of each exchanged suffix.
KEY_SIZE = 8
_ITEM = struct.Struct("<HHBqqqBB")  # common prefix, own bytes, known, doc, row, anchor's place in the document, windows, at


def group_key(anchor: int) -> bytes:
    return struct.pack(">q", anchor)


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix of two strings that share their first ``at`` bytes."""
    end = min(len(a), len(b))
    step = 32
    while at < end:
        if a[at : at + step] == b[at : at + step]:
            at = min(at + step, end)
        elif step > 1:
            step //= 2
        else:
            return at
    return end


def write_run(items: list[tuple[bytes, bytes, tuple]]) -> bytes:
    """A front-coded run of sorted (suffix, reversed text before it, payload)."""
    out, last = [], b""
    for suffix, before, payload in items:
        shared = common_prefix(last, suffix)
        own = suffix[shared:]
        out += (_ITEM.pack(shared, len(own), *payload), own, before)
        last = suffix
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes, tuple]]:
    """(common prefix with the one before, suffix, reversed text before it, payload) in order."""
    at, last = 0, b""
    while at < len(run):
        shared, n, *payload = _ITEM.unpack_from(run, at)
        at += _ITEM.size
        last = last[:shared] + run[at : at + n]
        before = run[at + n : at + n + payload[-1]]
        at += n + payload[-1]
        yield shared, last, before, tuple(payload)


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, tuple]]:
    """All runs' items in order, each with its common prefix with the item output before, by a loser tree."""
    readers = [read_run(r) for r in runs]
    heads = [next(r, None) for r in readers]
    shared = [0] * len(runs)
    size = 1
    while size < len(runs):
        size *= 2

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's common prefix becomes that with the winner."""
        x, y = heads[a] if a < len(runs) else None, heads[b] if b < len(runs) else None
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(x[1], y[1], shared[a])
        if x[1][n : n + 1] <= y[1][n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * size
    level = list(range(size))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            winner, loser = play(level[i], level[i + 1])
            losers[(size + level[i]) // (2 * size // len(level))] = loser
            up.append(winner)
        level = up
    winner = level[0]
    while winner < len(runs) and heads[winner] is not None:
        yield (shared[winner], *heads[winner][1:])
        heads[winner] = following = next(readers[winner], None)
        if following is not None:
            shared[winner] = following[0]
        node = (size + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated(group: list[tuple[int, bytes, bytes, tuple]], skip: int, window: int, few: int = FEW) -> Iterator[tuple[int, int, int]]:
    """For sorted contexts of one anchor: (item, bytes before the anchor, bytes from it on) that repeat another's."""
    n = len(group)
    right = [0] + [g[0] - skip for g in group[1:]]
    if n <= few:
        for i in range(n):
            here = 1 << 30
            for j in range(i + 1, n):
                here = min(here, right[j])
                left = common_prefix(group[i][2], group[j][2])
                if here + left >= window:
                    yield i, left, here
                    yield j, left, here
        return
    order = sorted(range(n), key=lambda i: group[i][2])
    left = np.array([-1] + [common_prefix(group[a][2], group[b][2]) for a, b in zip(order, order[1:], strict=False)])
    ends = np.array([len(group[i][2]) for i in order])
    rights = np.array([-1, *right[1:]])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for before in range(int(ends.max()) + 1):
        by_right = np.cumsum(rights < window - before)
        by_left = np.cumsum(left < before)[place]
        long = (ends >= before)[place]
        at = np.flatnonzero(long)
        _, inverse, counts = np.unique(by_right[at] * (n + 1) + by_left[at], return_inverse=True, return_counts=True)
        for i in at[counts[inverse] > 1].tolist():
            yield i, before, window - before


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int | None = None) -> DataFrame:
    """(doc, row, a, b): byte spans of ``anchors.keyed`` rows under strings of ``window`` bytes that start elsewhere too."""
    rows, group = keyed(docs), group or CHUNK
    contexts = shared_contexts(rows, byte_items, window, gram)
    first = F.min(F.struct("doc", "row", "first", "windows", "at")).alias("one")
    classes = keep(contexts.groupBy("hash", "digest").agg(F.count("*").alias("n"), first), "classes")
    alike = contexts.join(classes.where("n > 1").select("hash", "digest"), ["hash", "digest"])
    alike = alike.select("doc", "row", F.col("first").alias("a"), (F.col("first") + F.col("windows") + window - 1).alias("b"))
    several = keep(classes.groupBy("hash").agg(F.count("*").alias("of")).where("of > 1"), "several")
    buckets = 1 + (several.agg(F.sum("of")).first()[0] or 0) // BUCKET
    members = classes.join(several, "hash").select("hash", "digest", "of", (F.col("n") > 1).alias("known"), "one.*")
    grouped, common = split_by_size(members, group)
    asking = lambda m: rows.join(m.groupBy("doc", "row").agg(F.collect_list(F.struct("hash", "known", "first", "windows", "at")).alias("want")), ["doc", "row"])

    def runs(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            by_bucket = defaultdict(list)
            for doc, row, text, want in zip(b["doc"], b["row"], b["text"], b["want"], strict=True):
                data = (text or "").encode()
                for x in want:
                    key = group_key(x["hash"])
                    begin, anchor = x["first"], x["first"] + x["at"]
                    suffix = key + data[anchor : begin + x["windows"] + window - 1]
                    payload = (x["known"], doc, row, anchor, x["windows"], x["at"])
                    by_bucket[xxhash.xxh3_64_intdigest(key) % buckets].append((suffix, data[begin:anchor][::-1], payload))
            out = sorted(by_bucket.items())
            for _, items in out:
                items.sort()
            yield {"bucket": [k for k, _ in out], "run": [write_run(items) for _, items in out]}

    def merge(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[bytes] = []
        now = None
        for b in batches:
            for bucket, run in zip(b["bucket"], b["run"], strict=True):
                if bucket != now and held:
                    yield found(held)
                    held = []
                now = bucket
                held.append(run)
        if held:
            yield found(held)

    def found(held: list[bytes]) -> dict:
        out: dict = {"doc": [], "row": [], "a": [], "b": []}
        alike: list = []

        def close() -> None:
            spans = defaultdict(list)
            if len(alike) > 1 and not all(g[3][0] for g in alike):
                for i, before, after in repeated(alike, KEY_SIZE, window):
                    if not alike[i][3][0]:
                        anchor = alike[i][3][3]
                        spans[i].append((anchor - before, anchor + after))
            for i, own in spans.items():
                for a, z in merged(own):
                    for name, v in (("doc", alike[i][3][1]), ("row", alike[i][3][2]), ("a", a), ("b", z)):
                        out[name].append(v)
            alike.clear()

        for item in merge_runs(held):
            if item[0] < KEY_SIZE:
                close()
            alike.append(item)
        close()
        return out

    exchanged = map_rows(asking(grouped), runs, "bucket long, run binary", pa.schema([("bucket", pa.int64()), ("run", pa.binary())]))
    span = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
    differing = map_rows(
        exchanged.repartition("bucket").sortWithinPartitions("bucket"), merge, "doc long, row long, a int, b int", span
    )
    found_spans = alike.union(differing)
    if several.where(F.col("of") > group).isEmpty():
        return found_spans
    windows = window_digests(asking(common), byte_items, window)
    twice = windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    single = windows.join(twice, "key").where("NOT known").select("doc", "row", "a", (F.col("a") + window).alias("b"))
    return found_spans.union(single)


def cut_out(data: bytes, spans: list) -> tuple[list[tuple[int, int]], bytes]:
    """The spans joined, and what the data holds outside them."""
    cut = merged([(x["a"], x["b"]) for x in spans])
    edges = [0, *(x for s in cut for x in s), len(data)]
    return cut, b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int | None = None) -> DataFrame:
    """``docs`` with spans, the removed byte ranges (start, end), and kept, the bytes that stay; both replace such columns."""
    marked = with_spans(docs, repeated_spans(docs, window, gram, group))
    given = docs.columns
    columns = [c for c in given if c not in ("spans", "kept")]
    index = given.index("text")
    schema = docs.select(*map(named, columns)).schema.add("spans", SPANS).add("kept", "binary")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        spans, kept = [], []
        for text, own in zip(arrays[index].to_pylist(), arrays[-1].to_pylist(), strict=True):
            cut, left = cut_out((text or "").encode(), own or ())
            spans.append([{"start": a, "end": z} for a, z in cut])
            kept.append(left)
        return [*(x for x, c in zip(arrays, given, strict=False) if c in columns), pa.array(spans, span), pa.array(kept, pa.binary())]

    return map_columns(marked, run, schema)


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """All documents with the repeated bytes out of their texts; characters cut in two go too. n_chars follows the text.

    All columns are those of ``docs``, whatever their names; texts that lose nothing stay as they are, null ones too.
    """
    typed = docs.withColumn("text", F.col("text").cast("string"))
    index = docs.columns.index("text")

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        *columns, found = arrays
        if found.null_count < len(found):
            pairs = zip(columns[index].to_pylist(), found.to_pylist(), strict=True)
            columns[index] = pa.array([cut_out(t.encode(), own)[1].decode("utf-8", "ignore") if own else t for t, own in pairs], pa.string())
        return columns

    return with_length(map_columns(with_spans(typed, repeated_spans(typed)), run, typed.schema), docs)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document's bytes."""
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, c * 500 AS base, substring(h, 1000 * c + 1, {1000 + 2 * WINDOW - 2}) AS h
      FROM (SELECT r, h, unnest(range(0, (len(h) + 999) // 1000)) AS c FROM d)),
x AS (SELECT r, base, h, unnest(range(0, least(500, len(h) // 2))) AS j FROM p),
g AS (SELECT r, base + j AS i, substring(h, 2 * j + 1, 2) AS byte,
             CASE WHEN 2 * j + {2 * WINDOW} <= len(h) THEN md5(substring(h, 2 * j + 1, {2 * WINDOW})) END AS gram FROM x),
f AS (SELECT gram FROM g WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) > 1),
m AS (SELECT r, i, byte, f.gram IS NOT NULL AS hit FROM g LEFT JOIN f USING (gram)),
c AS (SELECT r, i, byte, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM c),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
             coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
SQL = {"op4_suffix_dedup": ORACLE}
