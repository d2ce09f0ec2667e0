"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

A document's size is its number of words. Sources in code point order, null last, weigh ``WEIGHTS`` in turn. The budget
is ``BUDGET`` times all sizes; a source's target is its share by weight, but at most ``MAX_EPOCHS`` times its own size,
and what is over goes to the others by weight. Within a source the documents stand in a hashed order; a copy's virtual
finish time is the words of its source up to and including it, a second round standing behind the whole first, divided
by the target. All copies are ordered by that time and taken until the next would exceed the budget.

Running sums are taken in two steps, by hash bucket and then inside a bucket, so that a source with a third of all rows
is spread over 4,096 groups; the cut is found in sums by ranges of virtual time, narrowed twice. Null text has size 0.
Rows of one doc_id, size and source stand in the order of a hash of their text; equal rows are interchangeable. Texts may
have any length. Empty tables and all-empty sources get target 0 and give
nothing. Other columns are carried by their places, so that their names clash with none of ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD_PATTERN, by_place, keep, named, place_of, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SHUFFLE_SEED = "mix-1:"
#: Ranges of virtual time on each of the two levels of the cut.
RANGES = 4096


def _sized(docs: DataFrame) -> DataFrame:
    order = F.md5(F.concat(F.lit(SHUFFLE_SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (
        docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))
        .withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")))
        .withColumn("__order", order)
        .withColumn("__text", F.xxhash64(F.col("text").cast("string")))
        .withColumn("__bucket", F.substring("__order", 1, 3))
    )


def _targets(fill: DataFrame) -> DataFrame:
    """__key, __source_size, __target: one row per source from the sums by source and bucket."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    sized = fill.groupBy("__key").agg(F.sum("__words").alias("__source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy("__key")) - 1, F.lit(len(WEIGHTS)))
    sized = sized.withColumn("w", F.get(weights, turn)).withColumn("cap", MAX_EPOCHS * F.col("__source_size"))
    full_at = F.col("cap") / F.col("w")
    upto = Window.orderBy(full_at, "__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # If this source is the first that stays below its cap, then each unit of weight gets this level.
    level = (
        F.sum("__source_size").over(everything) * BUDGET - (F.sum("cap").over(upto) - F.col("cap"))
    ) / (F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w"))
    sized = sized.withColumn("level", level).withColumn("full_at", full_at)
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "__key", "level"))).over(everything)
    return sized.select(
        "__key", "__source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(found["level"] * F.col("w"), F.col("cap"))).alias("__target"),
    )


def _placed(docs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Documents with __first and __second: the virtual finish times of their copies."""
    inside = Window.partitionBy("__key", "__bucket").orderBy("__order", "doc_id", "__size", "__text")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = _sized(docs).join(offsets, ["__key", "__bucket"])
    sized = sized.withColumn("__words_upto", F.col("__before") + F.sum("__size").over(inside))
    rounds = [F.col("__words_upto"), F.col("__source_size") + F.col("__words_upto")]
    first, second = (F.when(F.col("__target") > 0, r / F.col("__target")) for r in rounds)
    return sized.withColumn("__first", first).withColumn("__second", second)


def _last_taken(placed: DataFrame, budget: float) -> tuple | None:
    """(time, source key, round) of the last copy within the budget."""
    rounds = F.array(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("round")) for i, c in enumerate(("__first", "__second"))])
    rows = placed.where("__size > 0").select("__key", "__size", F.explode(rounds).alias("c")).select("__key", "__size", "c.*")
    rows, spent, last = rows.where("v IS NOT NULL"), 0, None
    place = F.struct("v", "__key", "round")
    part = F.col("v") * RANGES
    for level in range(2):
        ranged = rows.withColumn("at", F.least(F.floor(part), F.lit(4 * RANGES)).cast("long"))
        upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = ranged.groupBy("at").agg(F.sum("__size").alias("n"), F.max(place).alias("last"))
        sums = sums.withColumn("upto", F.sum("n").over(upto) + spent).withColumn("fits", F.col("upto") <= budget)
        full = sums.where("fits").agg(F.max(F.struct("at", "upto", "last")).alias("x")).first()["x"]
        edge = sums.where("NOT fits").agg(F.min("at").alias("x")).first()["x"]
        if full is not None:
            spent, last = full["upto"], full["last"]
        if edge is None:
            return last
        rows = ranged.where(F.col("at") == edge).drop("at")
        part = (part - edge) * RANGES
    upto = Window.orderBy("v", "__key", "round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = rows.withColumn("upto", F.sum("__size").over(upto) + spent).where(F.col("upto") <= budget)
    return fit.agg(F.max(place).alias("x")).first()["x"] or last


def mix(docs: DataFrame) -> DataFrame:
    """All of ``docs`` with size, source_size, target, copies (how often the mix takes the row) and finish_time.

    The five columns replace those of the same names. Deterministic: reruns take the same copies.
    """
    rows = by_place(docs).withColumns({c: place_of(docs, c) for c in ("doc_id", "text", "source")})
    fill = keep(_sized(rows).groupBy("__key", "__bucket").agg(F.sum("__size").alias("__words")), "fill")
    sources = keep(_targets(fill), "sources")
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = fill.withColumn("__before", F.sum("__words").over(before) - F.col("__words")).drop("__words")
    offsets = keep(offsets.join(sources, "__key"), "offsets")
    budget = BUDGET * (sources.agg(F.sum("__source_size")).first()[0] or 0)
    small = keep(_placed(rows.select("doc_id", "text", "source"), offsets).select("__key", "__size", "__first", "__second"), "times")
    last = _last_taken(small, budget)
    placed = _placed(rows, offsets)
    if last is None:
        copies = F.lit(0)
    else:
        end = F.struct(F.lit(last["v"]).alias("v"), F.lit(last["__key"]).alias("k"), F.lit(last["round"]).alias("r"))
        copies = sum(
            F.when(F.struct(F.col(c).alias("v"), F.col("__key").alias("k"), F.lit(i).alias("r")) <= end, 1).otherwise(0)
            for i, c in enumerate(("__first", "__second"))
        )
    taken = F.when(F.col("__first").isNull() | (F.col("__size") == 0), 0).otherwise(copies)
    extra = {"size": "__size", "source_size": "__source_size", "target": "__target", "finish_time": "__first"}
    carried = [F.col(f"u{i}").alias(c) for i, c in enumerate(docs.columns) if c not in {*extra, "copies"}]
    return placed.select(*carried, *[F.col(v).alias(k) for k, v in extra.items()], taken.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every taken copy as a row with the columns of ``docs``, range-sorted by virtual finish time.

    A document without words takes no room and stays once.
    """
    found = mix(docs.select("doc_id", "text", "source", F.struct(*map(named, docs.columns)).alias("row")))
    times = F.greatest("copies", F.when(F.col("size") == 0, 1).otherwise(0))
    out = found.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    first = F.col("finish_time")
    later = F.when(F.col("target") > 0, F.col("source_size") / F.col("target")) * (F.col("copy") - 1)
    return out.orderBy(first + later).select("row.*")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS size,
                  coalesce('s' || source, 't') AS k, md5('{SHUFFLE_SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
           FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY k) - 1) % {len(WEIGHTS)} + 1] AS w,
             {MAX_EPOCHS} * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS full_at,
             (sum(source_size) OVER () * CAST({BUDGET} AS DOUBLE) - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k, source_size, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, (full_at, k)) FROM l WHERE level <= full_at)) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, k,
             sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t USING (k)),
c AS (SELECT doc_id, size, k, r, CAST(upto + r * source_size AS DOUBLE) / target AS v
      FROM p, (SELECT unnest([0, 1]) AS r) WHERE size > 0 AND target > 0),
x AS (SELECT *, sum(size) OVER (ORDER BY v, k, r ROWS UNBOUNDED PRECEDING) AS spent FROM c),
y AS (SELECT doc_id, count(*) AS n FROM x WHERE spent <= {BUDGET} * (SELECT sum(source_size) FROM t) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM p LEFT JOIN y USING (doc_id)
"""

QUERIES = {"op10_source_mixing": op10_source_mixing}
SQL = {"op10_source_mixing": ORACLE}
