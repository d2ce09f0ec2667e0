"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Two 64-bit fingerprints within ``RADIUS`` = 4 bits agree on at least two of six blocks. So each distinct fingerprint
goes to fifteen shards, one for each pair of blocks and their value, and every link lies inside a shard. A shard builds
BK-trees whose children are keyed by the integer Hamming distance to their parent and follows only edges within the
radius. The trees hold all fingerprints of the corpus together, which has no size bound; so a tree is not broadcast but
built where its shard's fingerprints are shuffled to. A shard of more than ``CHUNK`` fingerprints is cut into chunks and
each pair of chunks is one group, so no group grows with the data.

Null and word-less texts have fingerprint zero and link like any other. Repeated rows share everything. Only distinct
fingerprints are linked; groups of exact copies cost one entry. Texts may have any length; an empty table gives an empty
result. ``one_of_each`` carries all columns, whatever their names; of rows with one doc_id the one with the smaller hash of
its text stays, of equal rows any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import by_place, drop, keep, map_rows, place_of, table
from folio.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
CHUNK = 8192
#: A component with so many members gets trees of its own, which are left at the first link found.
LARGE = 16
_WIDTHS = (11, 11, 11, 11, 10, 10)
_AT_ONCE = 1 << 15


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = np.array([hashed(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
        hashes = np.fromiter(
            (hashed(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)),
            np.uint64,
            len(starts),
        )
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        bits = np.unpackbits(hashes[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, fp) for every document; row is a hash of the text, which tells rows of one doc_id apart."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "row": b["row"], "fp": [fingerprint(t) for t in b["text"]]}

    text = F.col("text").cast("string")
    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")), run,
        "doc_id long, row long, fp long", pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())]),
    )


class BKTree:
    """Fingerprints by distance: children[i] maps the distance to node i to the child at that distance."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        self.codes.append(code)
        self.children.append({})
        new, at = len(self.codes) - 1, 0
        while new:
            d = (self.codes[at] ^ code).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                return
            at = child

    def within(self, code: int, radius: int) -> Iterator[int]:
        """The codes within the radius; only edges whose key can hold one are followed."""
        codes, children = self.codes, self.children
        todo = [0] if codes else []
        while todo:
            at = todo.pop()
            d = (codes[at] ^ code).bit_count()
            if d <= radius:
                yield codes[at]
            below = children[at]
            if len(below) > 2 * radius + 1:
                for k in range(d - radius, d + radius + 1):
                    if k in below:
                        todo.append(below[k])
            else:
                for k, child in below.items():
                    if -radius <= k - d <= radius:
                        todo.append(child)


def link_group(codes: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """For distinct unsigned codes: (code, first code of its component) for the others of each component."""
    parent = {c: c for c in codes}
    size = dict.fromkeys(codes, 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    common, own = BKTree(), {}
    for c in codes:
        met = {find(x) for x in common.within(c, radius)}
        for root in [r for r in own if r not in met]:
            if any(next(t.within(c, radius), None) is not None for t in own[root]):
                met.add(root)
        root = min(met, default=c)
        trees = [t for r in met for t in own.pop(r, [])]
        for r in met:
            parent[r] = root
        parent[c] = root
        size[root] = 1 + sum(size[r] for r in met)
        if trees or size[root] > LARGE:
            trees.sort(key=lambda t: -len(t.codes))
            if not trees:
                trees = [BKTree()]
            trees[0].add(c)
            own[root] = trees
        else:
            common.add(c)
    for c in codes:
        if (root := find(c)) != c:
            yield c, root


def _shards(radius: int) -> list[int]:
    """One mask for each pair of blocks; two codes within the radius agree under at least one."""
    if radius > 4:
        raise ValueError("six blocks, of which two must agree, serve radii up to 4")
    at, blocks = 0, []
    for w in _WIDTHS:
        blocks.append(((1 << w) - 1) << at)
        at += w
    masks = [a | b for i, a in enumerate(blocks) for b in blocks[:i]]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that connect all pairs within the radius."""
    spread = F.explode(
        F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_shards(radius))])
    )
    keyed = codes.select("fp", spread.alias("s")).select("fp", "s.*")
    shared = keep(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    members = keep(
        keyed.join(shared, ["t", "k"])
        .withColumn("m", chunks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"),
        "members",
    )
    key = ["t", "k", "i", "j"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held, now = [], None
        for b in batches:
            a, z = [], []
            for *at, fp in zip(*(b[c] for c in [*key, "fp"]), strict=True):
                if at != now:
                    if len(held) > 1:
                        for x, y in link_group(held, radius):
                            a.append(x), z.append(y)
                    held, now = [], at
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            yield {"a": _signed(a), "b": _signed(z)}
        found = list(link_group(held, radius)) if len(held) > 1 else []
        yield {"a": _signed([x for x, _ in found]), "b": _signed([y for _, y in found])}

    links = map_rows(
        members.repartition(*key).sortWithinPartitions(*key, "fp"), run, "a long, b long",
        pa.schema([("a", pa.int64()), ("b", pa.int64())]),
    )
    links = keep(links.distinct(), "links")
    drop(shared, members)
    return links


def _signed(codes: list[int]) -> list[int]:
    return [c - (1 << 64) if c >> 63 else c for c in codes]


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, row, fp, component_id, the smallest doc_id linked to it directly or through others,
    and root, a fingerprint that names the component."""
    marked = keep(fingerprints(docs), "fingerprints")
    codes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "codes")
    roots = components(link_fingerprints(codes.select("fp"), radius))
    rooted = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = keep(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    classes = keep(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "row", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with all columns of ``docs``: the smallest doc_id, rows without one last."""
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    found = keep(near_duplicates(docs.select(last.alias("doc_id"), "text"), radius).select("doc_id", "row", "root"), "found")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    stay = keep(first.select(F.col("first.doc_id").alias("doc"), F.col("first.row").alias("row")), "stay")
    twins = found.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    rows = by_place(docs)
    own = F.coalesce(place_of(docs, "doc_id").cast("long"), F.lit((1 << 63) - 1))
    out = rows.withColumn("doc", own).withColumn("row", F.xxhash64(place_of(docs, "text").cast("string"))).join(stay, ["doc", "row"])
    if not twins.isEmpty():
        out = out.dropDuplicates(["doc", "row"])
    return out.select(*rows.columns).toDF(*docs.columns)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
SQL: dict[str, str] = {}
