"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are cut into pieces of at most ``CAPACITY`` tokens. Only the number of pieces of each length matters for the
plan, and there are at most ``CAPACITY`` lengths: that histogram, and nothing larger, goes to the driver. There,
dominance reduction permanently fixes the sets that dominate every other set holding the same item (it fits with
nothing; one item fills the rest exactly; only one item fits beside it and the largest is taken; at most two fit but no
pair beats the largest single), which shrinks the instance; best fit in decreasing order packs the remainder. All of it
works on counts, so a plan has a few thousand entries for any number of pieces. Each piece then finds its place by its
rank among the pieces of its length; ranks are summed over ``SALTS`` groups a length, so a length that a third of all
pieces share is spread.

Null text is empty: one piece that holds only the end token. Rows of one doc_id are packed each on its own, and rows
equal in all columns are interchangeable. Texts may have any length. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import keep, map_rows, table

CAPACITY = 1024
END = 2
SALTS = 1024


def default_vocabulary() -> str:
    """The file of byte-level BPE ranks that equals byte_bpe_50k.json id by id."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, once per Python worker; its end-of-text string is the special token 50256."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256}
        )
    return _ENCODERS[path]


def token_ids(text: str | None, path: str) -> np.ndarray:
    """A text's ids. Runs of white space too long for the rank tokenizer's pattern go to the tokenizers library, which gives the same ids."""
    try:
        return encoder(path).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)


def _library(path: str):
    """The same vocabulary in the tokenizers library: the .json file beside the rank file."""
    path = path.removesuffix(".tiktoken") + ".json"
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[path] = Tokenizer.from_file(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of n tokens; the first may be shorter."""
    short = [n % capacity] if n % capacity else []
    return short + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]); without ids, 300 times less goes on to the packing."""
    vocabulary = vocabulary or default_vocabulary()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {k: [] for k, _ in fields}
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(token_ids(text, vocabulary), END).astype("<u4")
                start = 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n]
                    for name, x in (("doc_id", doc), ("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(part.tobytes()))):
                        out[name].append(x)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
                    start += n
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(texts, run, schema, pa.schema(fields))


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix dominating sets; returns (bins, [(length, times)]) and takes what is fixed out of ``counts``."""
    fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def take(a: int, b: int | None) -> None:
        n = counts[a] if b is None else counts[a] // 2 if a == b else min(counts[a], counts[b])
        fixed.append((n, [(a, 1)] if b is None else [(a, 2)] if a == b else [(a, 1), (b, 1)]))
        for x in (a,) if b is None else (a, b):
            counts[x] -= n
            if not counts[x]:
                del counts[x]

    def smallest(a: int, k: int, ascending: list[int]) -> list[int]:
        """The k smallest items besides one of length a."""
        out: list[int] = []
        for x in ascending:
            out += [x] * min(k - len(out), counts[x] - (x == a))
            if len(out) == k:
                break
        return out

    def largest_pair(a: int, room: int, ascending: list[int]) -> int:
        """The largest sum of two items within the room, besides one of length a."""
        there = [x for x in ascending if counts[x] > (x == a)]
        best = max((2 * x for x in there if 2 * x <= room and counts[x] - (x == a) >= 2), default=0)
        i, j = 0, len(there) - 1
        while i < j:
            both = there[i] + there[j]
            if both > room:
                j -= 1
            else:
                best = max(best, both)
                i += 1
        return best

    changed = True
    while changed:
        changed = False
        for a in sorted(counts, reverse=True):
            while counts.get(a):
                room = capacity - a
                ascending = sorted(counts)
                few = smallest(a, 3, ascending)
                if not few or few[0] > room:
                    take(a, None)
                elif counts.get(room, 0) > (room == a):
                    take(a, room)
                else:
                    single = max(x for x in ascending if x <= room and counts[x] > (x == a))
                    alone = len(few) < 2 or few[0] + few[1] > room
                    if alone or (len(few) < 3 or sum(few) > room) and single >= largest_pair(a, room, ascending):
                        take(a, single)
                    else:
                        break
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit in decreasing order, on counts: bins of one pattern are one entry."""
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = min((r for r, g in open_bins.items() if r >= s and g), default=None)
            n, items = open_bins[room].pop() if room is not None else (left, [])
            room = capacity if room is None else room
            each = room // s
            used, rest = min(n, left // each), 0
            if used:
                open_bins[room - each * s].append((used, [*items, (s, each)]))
                left -= used * each
            if used < n and 0 < left < each:
                rest = 1
                open_bins[room - left * s].append((1, [*items, (s, left)]))
                left = 0
            if items and n - used - rest:
                open_bins[room].append((n - used - rest, items))
    return [g for groups in open_bins.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, in order of rank: (first rank, first sequence, pieces a sequence, offset of the first)."""
    counts = {k: n for k, n in counts.items() if n}
    groups = reduce_by_dominance(counts, capacity)
    groups += best_fit(counts, capacity)
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for n, items in groups:
        offset = 0
        for length, times in items:
            out[length].append((ranks[length], sequence, times, offset))
            ranks[length] += n * times
            offset += length * times
        sequence += n
    return dict(out)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32 and more) with sequence_id and offset."""
    pieces = keep(pieces, "pieces")
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sums = keep(salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")), "lengths")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # one row a length
    placing = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in plan(counts, capacity).items()}
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = keep(sums.select("length", "__salt", (F.sum("__n").over(before) - F.col("__n")).alias("__before")), "offsets")
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.join(offsets, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = ranked.select(*columns, "__rank")
    schema = pieces.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, times, start = placing[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inner = rank[at] - first[k]
                sequence[at] = base[k] + inner // times[k]
                offset[at] = start[k] + inner % times[k] * n
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack; the ids themselves stay out of the shuffles and can be had from ``token_pieces``."""
    return pack(token_pieces(docs, vocabulary, capacity, with_ids=False), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
SQL: dict[str, str] = {}
