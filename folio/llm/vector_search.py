"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Vectors get one more component that brings all to the largest norm (queries get zero there), so that the largest inner
product is the smallest angle. ``ROTATIONS`` rotations, learned by iterative quantization on a sample of at most
``SAMPLE`` vectors (the smallest by hash), turn each into a code of signs. Every vector is indexed: codes are cut into
substrings of ``SUBSTRING`` 64-bit words, and a block of the index has, for each substring, the rows in order of its value.
A query looks for all codes within a radius: by the pigeonhole principle one of the m substrings of such a code lies
within radius // m of the query's, so those buckets are probed, the full distance is checked on what they hold, and the
floats of all codes within the radius are ranked by exact inner products. Substrings are long because neighbours may be
far: where they differ in two bits of five, the buckets within radius // m hold a quarter of all rows for 16 bits, so
that sixteen such tables select nothing, but a few in a hundred for 128. The radius is the ``COVER``
quantile of the distances of true neighbours in the sample, of so many as the sample holds of a query's k. No bucket or candidate
list is capped. Queries that find fewer than k rows within the radius are answered from all rows.

Blocks of at most about ``BLOCK`` rows meet blocks of about ``QUERY_BLOCK`` queries, each meeting in a task of its own, and
give k rows a query at most, which are ranked again; equal scores go to the smaller vec_id. Vectors that are null, zero, of
another length than most, or hold null or non-finite components take no part, nor do rows without a vec_id. Rows of one
vec_id count once, with the smallest of their vectors. Empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import keep, map_rows, table

K = 20
SAMPLE = 8192
SAMPLE_QUERIES = 256
ROTATIONS = 8
ITERATIONS = 15
COVER = 0.98
BLOCK = 8_192
QUERY_BLOCK = 8_192
#: 64-bit words of a substring.
SUBSTRING = 2
MOST_TASKS = 20_000


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Unit vectors whose angle to a lifted query falls as the inner product rises."""
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]]) / norm


def learn_rotations(vectors: np.ndarray, rotations: int = ROTATIONS) -> np.ndarray:
    """Rotations side by side, each learned by iterative quantization from a start of its own."""
    out = []
    for i in range(rotations):
        turn, _ = np.linalg.qr(np.random.default_rng(i).normal(size=(vectors.shape[1],) * 2))
        for _ in range(ITERATIONS):
            left, _, right = np.linalg.svd(np.where(vectors @ turn >= 0, 1.0, -1.0).T @ vectors)
            turn = (left @ right).T
        out.append(turn)
    return np.hstack(out)


def encode(lifted: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, whole substrings: bits beyond the last are left out, a code of under one is filled up with zeros."""
    bits, size = lifted @ rotations >= 0, 64 * SUBSTRING
    bits = bits[:, : max(bits.shape[1] // size * size, min(bits.shape[1], size))]
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % size)))
    return np.packbits(bits, axis=1).view(np.uint64)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words to one."""
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int32)


class MultiIndex:
    """The rows of a block by each substring of ``width`` words of their codes."""

    def __init__(self, codes: np.ndarray, width: int = 1) -> None:
        self.codes, self.width = codes, width
        self.order, self.values, self.starts = [], [], []
        for t in range(0, codes.shape[1], width):
            part = np.ascontiguousarray(codes[:, t : t + width])
            order = np.lexsort(part.T)
            held = part[order]
            first = np.flatnonzero(np.concatenate(([True], (held[1:] != held[:-1]).any(axis=1))))[: len(held)]
            self.order.append(order)
            self.values.append(held[first])
            self.starts.append(np.append(first, len(held)))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows of all buckets that may hold a code within the radius."""
        small, more = divmod(radius, len(self.values))
        seen = np.zeros(len(self.codes), bool)
        for t, values in enumerate(self.values):
            # If no substring up to `more` is within small, all of them are beyond it, and a later one is within small - 1.
            reach = small if t <= more else small - 1
            if reach < 0:
                continue
            near = np.flatnonzero(distances(values, code[t * self.width : (t + 1) * self.width]) <= reach)
            starts = self.starts[t]
            lengths = starts[near + 1] - starts[near]
            flat = np.repeat(starts[near] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            seen[self.order[t][flat]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within the radius."""
        rows = self.probed(code, radius)
        return rows[distances(self.codes[rows], code) <= radius]


def nearest(ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k largest inner products among ``rows``, ties to the smaller id."""
    rows = rows[ids[rows] != own]
    scores = (vectors[rows] * query).sum(axis=1)
    if len(rows) > k:
        least = np.partition(scores, len(rows) - k)[len(rows) - k]
        some = scores >= least
        rows, scores = rows[some], scores[some]
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows][best], scores[best]


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _searched(data: DataFrame, queries: DataFrame, radius: int | None, k: int, n: int, asked: int) -> DataFrame:
    """(query_id, vec_id, score): up to k found by each query in each block; all rows are looked at without a radius."""
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    dealt = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = data.withColumn("b", dealt(blocks)).withColumn("q", every(query_blocks))
    right = queries.withColumn("q", dealt(query_blocks)).withColumn("b", every(blocks))
    tasks = min(4 * blocks * query_blocks, MOST_TASKS)
    left, right = left.repartition(tasks, "b", "q"), right.repartition(tasks, "b", "q")

    def meet(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(block) and len(asking):
            ids = block["vec_id"].to_numpy(np.int64)
            vectors = np.stack(block["vector"].to_numpy()).astype(np.float64)
            index = MultiIndex(np.frombuffer(b"".join(block["code"]), np.uint64).reshape(len(ids), -1), SUBSTRING) if radius is not None else None
            everything = np.arange(len(ids))
            for own, vector, code in zip(asking["vec_id"], asking["vector"], asking["code"], strict=True):
                rows = index.within(np.frombuffer(code, np.uint64), radius) if index else everything
                found, scores = nearest(ids, vectors, rows, own, np.asarray(vector, np.float64), k)
                out.append((np.full(len(found), own), found, scores))
        query, vec, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pd.DataFrame({"query_id": np.asarray(query, np.int64), "vec_id": np.asarray(vec, np.int64), "score": np.asarray(score, np.float64)})

    return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(meet, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where ``queries`` (on vec_id) holds."""
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    named = named.where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    sizes = named.groupBy(F.size("vector").alias("d")).count()
    most = sizes.agg(F.max(F.struct("count", "d")).alias("x")).first()["x"]
    named = named.where(F.size("vector") == (most["d"] if most else 0))
    named = keep(named.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = named.agg(F.count("*").alias("n"), F.max(square).alias("s"), F.sum(queries.cast("int")).alias("q")).first()
    n, norm, asked = facts["n"], float(np.sqrt(facts["s"] or 1.0)), facts["q"] or 0
    taken = named.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()
    sample = np.stack(taken["vector"].to_numpy()).astype(float) if len(taken) else np.ones((1, 1))
    rotations = learn_rotations(lift(sample, norm))
    radius = _radius(sample, norm, rotations, -(-k * len(sample) // max(n, 1)))

    def index(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = np.array(b["vector"], float).reshape(len(b["vec_id"]), -1)
            codes = encode(lift(x, norm), rotations) if len(x) else []
            plain = np.hstack([x, np.zeros((len(x), 1))]) if len(x) else x
            asking = encode(plain, rotations) if len(x) else []
            yield {"vec_id": b["vec_id"], "vector": b["vector"], "code": [c.tobytes() for c in codes], "asks": [c.tobytes() for c in asking]}

    kinds = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("code", pa.binary()), ("asks", pa.binary())])
    indexed = keep(map_rows(named, index, "vec_id long, vector array<double>, code binary, asks binary", kinds), "index")
    data = indexed.select("vec_id", "vector", "code")
    wanted = indexed.where(queries).select("vec_id", "vector", F.col("asks").alias("code"))
    found = keep(_searched(data, wanted, radius, k, n, asked), "found")
    counted = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1))
    short = keep(wanted.join(counted.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "short")
    missing = short.count()
    if missing:
        again = _searched(data, short, None, k, n, missing)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(again)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _radius(sample: np.ndarray, norm: float, rotations: np.ndarray, k: int) -> int:
    """The distance within which the ``COVER`` share of the sample's true neighbours lies."""
    codes = encode(lift(sample, norm), rotations)
    asking = encode(np.hstack([sample, np.zeros((len(sample), 1))])[:SAMPLE_QUERIES], rotations)
    found: list[int] = []
    for i, code in enumerate(asking):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        found += distances(codes[best], code).tolist()
    return int(np.quantile(found, COVER, method="higher")) if found else codes.shape[1] * 64


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every embedding whose vec_id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op7_vector_search": op7_vector_search}
SQL: dict[str, str] = {}
