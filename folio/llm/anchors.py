"""Content-defined anchors: equal windows of two texts have the same anchor at the same place.

A window's anchor is its k-gram with the smallest hash, the leftmost among equals, so it depends on the window's content
alone. Windows with the same anchor position form a run; the text that a run's windows cover is the anchor's context.
Two equal windows therefore lie in contexts of one anchor value. Both exact-substring operators use this to leave out
text whose anchors occur once, to settle equal contexts by their digest, and to bring together only contexts that share
an anchor but differ. Texts of any length are worked through in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import by_place, keep, map_rows, place_of

#: Positions fit into the low bits of a sort key; longer texts are read in blocks of this many positions.
_BITS = 20
_BLOCK = 1 << _BITS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive items (k a power of two, items uint64), by doubling."""
    h = _mixed(items * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    m = 1
    while m < k:
        h = _mixed(h[:-m] * np.uint64(0xA0761D6478BD642F) + h[m:])
        m *= 2
    return h


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a) - w + 1
    full = np.full(-(-len(a) // w) * w, np.iinfo(a.dtype).max, a.dtype)
    full[: len(a)] = a
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(items: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (hash, position of the k-gram, first window, number of windows) for the runs of a text's windows."""
    windows = len(items) - window + 1
    width = window - k + 1
    for base in range(0, max(windows, 0), _BLOCK - width):
        count = min(windows - base, _BLOCK - width)
        hashes = gram_hashes(items[base : base + count + window - 1].astype(np.uint64), k)
        keys = (hashes >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        at = (_sliding_min(keys, width) & np.uint64(_BLOCK - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        yield hashes[at[first]], at[first] + base, first + base, np.diff(np.append(first, count))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching half-open spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


# --- the Spark side ---------------------------------------------------------------------------------------------------


def byte_items(text: str | None) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
    """A text's UTF-8 bytes, and a function for the bytes of a range."""
    data = (text or "").encode()
    return np.frombuffer(data, np.uint8), lambda a, b: data[a:b]


def word_items(text: str | None) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
    """Hashes of a text's words, and a function for the words of a range, joined by spaces."""
    words = (text or "").encode().split()
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter(map(hashed, words), np.uint64, len(words)), lambda a, b: b" ".join(words[a:b])


def keyed(docs: DataFrame) -> DataFrame:
    """doc, row and text: the id (null as the smallest long) and a hash of id and text, which together name a row's content."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))


def shared_contexts(rows: DataFrame, items: Callable, window: int, k: int) -> DataFrame:
    """(hash, digest, doc, row, first, windows, at) of all anchors whose value occurs at least twice, kept.

    The context covers windows first..first+windows-1, at is the anchor's place in it. Hashes alone are counted first,
    so that the wider rows of anchors that occur once are dropped at the join.
    """

    def values(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [h for t in b["text"] for h, *_ in anchors(items(t)[0], window, k)]
            yield {"hash": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)}

    def contexts(batches: Iterator[dict]) -> Iterator[dict]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            parts: list[list] = [[] for _ in range(7)]
            for doc, row, text in zip(b["doc"], b["row"], b["text"], strict=True):
                array, part = items(text)
                for h, at, first, n in anchors(array, window, k):
                    ends = (first + n + window - 1).tolist()
                    digests = [digest(part(x, y)) for x, y in zip(first.tolist(), ends, strict=True)]
                    own = (h.view(np.int64), np.array(digests, np.uint64).view(np.int64), np.full(len(h), doc), np.full(len(h), row), first, n, at - first)
                    for p, x in zip(parts, own, strict=True):
                        p.append(x)
            names = ("hash", "digest", "doc", "row", "first", "windows", "at")
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int16, np.int16)
            yield {c: np.concatenate([np.zeros(0, t), *p]).astype(t) for c, p, t in zip(names, parts, kinds, strict=True)}

    one = map_rows(rows.select("text"), values, "hash long", pa.schema([("hash", pa.int64())]))
    shared = keep(one.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared")
    schema = [("hash", pa.int64()), ("digest", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("windows", pa.int16()), ("at", pa.int16())]
    every = map_rows(
        rows, contexts, "hash long, digest long, doc long, row long, first int, windows short, at short", pa.schema(schema)
    )
    return keep(every.join(shared, "hash"), "contexts")


def split_by_size(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``members`` of anchors with at most ``most`` differing contexts (column of), which are brought together, and the others."""
    return members.where(F.col("of") <= most), members.where(F.col("of") > most)


def in_chunks(members: DataFrame, chunk: int) -> DataFrame:
    """``members`` of anchors with ``of`` contexts, with chunks i <= j: any two contexts of one anchor meet in some (i, j) of bounded size."""
    m = F.ceil(F.col("of") / chunk).cast("int")
    own = F.pmod(F.xxhash64("digest"), m).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other")


def window_digests(asked: DataFrame, items: Callable, window: int) -> DataFrame:
    """(key, doc, row, a, known): a 128-bit digest for each window of the wanted contexts, kept.

    For anchors with more contexts than a group may hold: their windows are counted one by one, spread by their digests.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out: dict = {"key": [], "doc": [], "row": [], "a": [], "known": []}
            for doc, row, text, want in zip(b["doc"], b["row"], b["text"], b["want"], strict=True):
                _, part = items(text)
                for x in want:
                    for a in range(x["first"], x["first"] + x["windows"]):
                        for name, v in (("key", digest(part(a, a + window))), ("doc", doc), ("row", row), ("a", a), ("known", x["known"])):
                            out[name].append(v)
            yield out

    kinds = [("key", pa.binary()), ("doc", pa.int64()), ("row", pa.int64()), ("a", pa.int32()), ("known", pa.bool_())]
    return keep(map_rows(asked, run, "key binary, doc long, row long, a int, known boolean", pa.schema(kinds)), "windows")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with one more column behind the others, the array of (a, b) structs found for the row's content, null if none."""
    by_row = spans.groupBy("doc", "row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    doc_id, text = place_of(docs, "doc_id").cast("long"), place_of(docs, "text").cast("string")
    rows = by_place(docs)
    marked = rows.withColumn("doc", F.coalesce(doc_id, F.lit(-(1 << 63)))).withColumn("row", F.xxhash64(doc_id, text))
    return marked.join(by_row, ["doc", "row"], "left").select(*rows.columns, "spans").toDF(*docs.columns, "__spans")
