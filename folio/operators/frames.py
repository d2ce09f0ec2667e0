"""Frames of a scanning camera: how much moved, the page-turn trigger, whether tiles changed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.images import changed_share, gutter_fraction, motion_level, square
from folio.functions.text import snapshot_words
from folio.operators.similarity import new_pages
from folio.schema import Motion
from folio.sources.tables import table


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pixel arrays; 0 for empty ones or other sizes."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(total / F.size(a))


def level_of_small_frames(a: Column, b: Column, quantile: float = Motion.quantile) -> Column:
    """The motion level of frames so small that a tile is one pixel."""
    apart = F.array_sort(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.get(apart, F.least(F.size(apart) - 1, F.floor(F.size(apart) * (1 - quantile)).cast("int")))


def luma_means(bgra: Column, width: int, target_width: int) -> Column:
    """The gray frame of a BGRA one, an array of four values a pixel in rows of ``width``: luma of block means, all in integers.

    A block is as wide and high as brings the width near the target; what is over at the right and below is left out.
    """
    step = max(1, width // target_width)
    across = width // step
    down = F.floor(F.size(bgra) / (4 * width * step)).cast("int")
    weighted = lambda run: F.aggregate(F.transform(run, lambda v, i: v * F.get(F.array(*map(F.lit, LUMA)), i % 4)), F.lit(0).cast("long"), lambda s, v: s + v)

    def block(i: Column) -> Column:
        corner = (F.floor(i / across).cast("int") * step * width + i % across * step) * 4
        total = F.aggregate(F.sequence(F.lit(0), F.lit(step - 1)), F.lit(0).cast("long"), lambda s, r: s + weighted(F.slice(bgra, corner + r * width * 4 + 1, 4 * step)))
        return F.least(F.lit(255), F.floor(total / (step * step * 256)).cast("int"))

    none = F.array().cast("array<int>")
    return F.when(down > 0, F.transform(F.sequence(F.lit(0), down * across - 1), block)).otherwise(none)


def _episodes(levels: DataFrame, rule: Motion, chunk_seconds: int) -> DataFrame:
    """(stream, episode, run, moves, stirs, frame): every movement opens an episode, every frame that is not still a run.

    Both are counted within chunks of time and then over the chunks, so a stream may hold any share of the rows.
    """
    chunk = F.floor(F.col("seconds") / chunk_seconds).cast("long")
    marked = levels.select("stream", "event_id", "seconds", (F.col("level") > rule.moving).cast("long").alias("moves"), (F.col("level") > rule.still).cast("long").alias("stirs"), chunk.alias("chunk"))
    inside = Window.partitionBy("stream", "chunk").orderBy("seconds", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("stream").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("stream", "chunk").agg(F.sum("moves").alias("m"), F.sum("stirs").alias("s"))
    sums = sums.select("stream", "chunk", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    counted = marked.withColumn("episode", F.sum("moves").over(inside)).withColumn("run", F.sum("stirs").over(inside)).join(sums, ["stream", "chunk"])
    frame = F.struct("seconds", "event_id").alias("frame")
    return counted.select("stream", (F.col("episode") + F.col("m")).alias("episode"), (F.col("run") + F.col("s")).alias("run"), "moves", "stirs", frame)


def _settled(episodes: DataFrame, rule: Motion) -> DataFrame:
    """(stream, episode, frame): where an episode's page settles, the first frame still ``settle_seconds`` after its run's first."""
    still = episodes.where("stirs = 0 AND episode > 0")
    began = still.groupBy("stream", "run").agg(F.min("frame").alias("start"))
    over = (F.col("frame") > F.col("start")) & (F.col("frame.seconds") - F.col("start.seconds") >= rule.settle_seconds)
    return still.join(began, ["stream", "run"]).where(over).groupBy("stream", "episode").agg(F.min("frame").alias("frame"))


def fired(levels: DataFrame, rule: Motion, chunk_seconds: int = 86_400) -> DataFrame:
    """(stream, event_id, seconds) where a stream settled, from (stream, event_id, seconds, level), in order of time."""
    return _settled(_episodes(levels, rule, chunk_seconds), rule).select("stream", "frame.event_id", "frame.seconds")


def timely_judgements(levels: DataFrame, judged: DataFrame, rule: Motion, chunk_seconds: int = 86_400) -> DataFrame:
    """``judged`` (stream, event_id, done_at ..) but for those that a new movement overtook: their episode was over when they came."""
    episodes = _episodes(levels, rule, chunk_seconds)
    settled = _settled(episodes, rule).select("stream", "episode", "frame.event_id")
    following = episodes.where("moves = 1").select("stream", (F.col("episode") - 1).alias("episode"), F.col("frame.seconds").alias("moved_at"))
    overtaken = settled.join(following, ["stream", "episode"], "left").select("stream", "event_id", "moved_at")
    kept = judged.join(overtaken, ["stream", "event_id"]).where("moved_at IS NULL OR done_at < moved_at")
    return kept.select(*judged.columns)


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 gray frames."""
    pixel = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.5) * 255).cast("int"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", pixel.alias("pixels"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small frames with the frame before."""
    frames = _gray(spark, sf_dir)
    before = frames.select((F.col("vec_id") + 1).alias("vec_id"), F.col("pixels").alias("before"))
    return frames.join(before, "vec_id")


def a15_frame_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _pixels(spark, sf_dir)
    level = level_of_small_frames(F.col("before"), F.col("pixels")).cast("long")
    return frames.select("vec_id", mean_difference(F.col("before"), F.col("pixels")).alias("difference"), level.alias("motion_level"))


#: The events' scale is ten times as large as that of frames, and they settle within an hour.
EVENT_RULE = Motion(moving=60.0, still=25.0, settle_seconds=3600)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the motion levels of users' streams."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "event_id", F.floor(seconds / 1_000_000).cast("long").alias("seconds"), F.col("value").alias("level"))


def c9_motion_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(_levels(spark, sf_dir), EVENT_RULE)


def t5_timely_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of judgements that take up to six days for a settled page, those that no movement overtook."""
    levels = _levels(spark, sf_dir)
    judged = fired(levels, EVENT_RULE).withColumn("done_at", F.col("seconds") + F.col("event_id") % 7 * 86_400)
    return timely_judgements(levels, judged, EVENT_RULE).select("stream", "event_id", "done_at")


#: Weights of blue, green and red, and of what is left, in 256ths.
LUMA = (29, 150, 77, 0)


def _large_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen embeddings each as a frame of 32 by 32 pixels; the last one may be filled up with black."""
    frames = _gray(spark, sf_dir).withColumn("frame", F.expr("vec_id div 16"))
    packed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "pixels"))), lambda x: x["pixels"]))
    return frames.groupBy("frame").agg(packed.alias("p")).select("frame", F.concat("p", F.array_repeat(F.lit(0), F.greatest(1024 - F.size("p"), F.lit(0)))).alias("pixels"))


@F.pandas_udf(T.DoubleType())
def _changed(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([changed_share(square(x), square(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def _gutter(a: pd.Series) -> pd.Series:
    return a.map(lambda x: gutter_fraction(square(x), 0.35, 0.65, 10.0))


@F.pandas_udf(T.DoubleType())
def _level(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([motion_level(square(x), square(y)) for x, y in zip(a, b, strict=True)])


def a14_motion_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motion level of each large frame against the one before, over tiles of two by two pixels."""
    frames = _large_frames(spark, sf_dir)
    before = frames.select((F.col("frame") + 1).alias("frame"), F.col("pixels").alias("before"))
    return frames.join(before, "frame").select("frame", _level("before", "pixels").alias("motion_level"))


def a16_changed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed tiles of each frame against the one before, and its gutter."""
    frames = _large_frames(spark, sf_dir)
    before = frames.select((F.col("frame") + 1).alias("frame"), F.col("pixels").alias("before"))
    return frames.join(before, "frame").select("frame", _changed("before", "pixels").alias("changed_share"), F.coalesce(_gutter("pixels"), F.lit(-1.0)).alias("gutter"))


def t2_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large frames as BGRA ones of 16 by 16 pixels, brought down to 8 by 8."""
    return _large_frames(spark, sf_dir).select("frame", F.posexplode(luma_means(F.col("pixels"), 16, 8)).alias("place", "gray"))


def t6_page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames show a new page: eight in a row are a stream, the words are those of the document of the frame's number."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame"), snapshot_words(F.coalesce("text", F.lit(""))).alias("words"))
    frames = _large_frames(spark, sf_dir).join(words, "frame", "left")
    return new_pages(frames.select(F.expr("frame div 8").alias("book"), F.expr("cast(frame % 8 as int)").alias("page_no"), "words", "pixels"))


def t1_sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth event of each stream, as frames are sampled, with its number from 1."""
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("frame_no", F.row_number().over(place).cast("long"))
    return rows.where("frame_no % 8 = 0").select("user_id", "event_id", "frame_no")


_FIRED_SQL = """e AS (SELECT user_id AS stream, event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, value AS v,
row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT), event_id) AS i FROM events),
r AS (SELECT stream, event_id, s, i, CASE WHEN v > 60 THEN 'moving' ELSE 'idle' END AS st, CAST(NULL AS BIGINT) AS since, false AS fires FROM e WHERE i = 1
UNION ALL SELECT e.stream, e.event_id, e.s, e.i,
CASE WHEN e.v > 60 THEN 'moving' WHEN e.v > 25 OR r.st = 'idle' THEN r.st WHEN r.st = 'settling' AND r.since IS NOT NULL AND e.s - r.since >= 3600 THEN 'idle' ELSE 'settling' END,
CASE WHEN e.v > 25 OR r.st = 'idle' THEN NULL WHEN r.st = 'moving' THEN e.s WHEN r.since IS NULL THEN e.s WHEN e.s - r.since >= 3600 THEN NULL ELSE r.since END,
e.v <= 25 AND r.st = 'settling' AND r.since IS NOT NULL AND e.s - r.since >= 3600
FROM r JOIN e ON e.stream = r.stream AND e.i = r.i + 1)"""
#: Pixels of the large frames as fp (frame, pos, v), and standardized ones as z (frame, x, y, v).
_LARGE_SQL = """p0 AS (SELECT vec_id // 16 AS frame, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id, i) - 1 AS pos,
CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)),
fp AS (SELECT g.frame, g.pos, coalesce(p0.v, 0) AS v FROM (SELECT f.frame, x.pos FROM (SELECT DISTINCT frame FROM p0) f, (SELECT unnest(range(1024)) AS pos) x) g LEFT JOIN p0 ON p0.frame = g.frame AND p0.pos = g.pos),
ms AS (SELECT frame, CAST(sum(v) AS DOUBLE) / 1024 AS mean, CAST(sum(v * v) AS DOUBLE) / 1024 AS sq FROM fp GROUP BY frame),
z AS (SELECT frame, pos % 32 AS x, pos // 32 AS y, CAST(floor(1024 * (v - mean) / greatest(sqrt(greatest(sq - mean * mean, 0.0)), 8.0)) AS BIGINT) AS v FROM fp JOIN ms USING (frame))"""


def changed_sql(pairs: str) -> str:
    """CTEs to ``ch`` (a, b, share), the changed tiles of the frames in ``pairs`` (a, b)."""
    cost = "sum(abs(p.v - q.v))"
    return f"""sh AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-4, 5)) AS i) a, (SELECT unnest(range(-4, 5)) AS i) b),
c2 AS (SELECT pr.a, pr.b, dy, dx, {cost} AS cost FROM {pairs} pr JOIN z p ON p.frame = pr.a AND p.x BETWEEN 4 AND 27 AND p.y BETWEEN 4 AND 27 AND p.x % 2 = 0 AND p.y % 2 = 0, sh, z q
       WHERE q.frame = pr.b AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL),
b2 AS (SELECT a, b, arg_min(dy, (cost, dy, dx)) AS ty, arg_min(dx, (cost, dy, dx)) AS tx FROM c2 GROUP BY a, b),
c1 AS (SELECT b2.a, b2.b, dy, dx, {cost} AS cost FROM b2 JOIN sh ON abs(dy - ty) <= 1 AND abs(dx - tx) <= 1 JOIN z p ON p.frame = b2.a AND p.x BETWEEN 4 AND 27 AND p.y BETWEEN 4 AND 27, z q
       WHERE q.frame = b2.b AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL),
b1 AS (SELECT a, b, arg_min(dy, (cost, dy, dx)) AS ty, arg_min(dx, (cost, dy, dx)) AS tx FROM c1 GROUP BY a, b),
ti AS (SELECT b1.a, b1.b, 256 * sum(p.v * p.v) - sum(p.v) * sum(p.v) AS sp, 256 * sum(q.v * q.v) - sum(q.v) * sum(q.v) AS sq, {cost} AS d
       FROM b1 JOIN z p ON p.frame = b1.a AND p.x BETWEEN 4 AND 19 AND p.y BETWEEN 4 AND 19, z q WHERE q.frame = b1.b AND q.x = p.x + tx AND q.y = p.y + ty GROUP BY ALL),
ch AS (SELECT a, b, CASE WHEN greatest(sp, sq) >= 4294967296 AND 10 * d >= 786432 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS share FROM ti)"""


QUERIES = {"a14_motion_levels": a14_motion_levels, "a15_frame_difference": a15_frame_difference, "a16_changed_tiles": a16_changed_tiles, "c9_motion_trigger": c9_motion_trigger, "t5_timely_judgements": t5_timely_judgements, "t2_downsampled": t2_downsampled, "t6_page_turns": t6_page_turns, "t1_sampled_events": t1_sampled_events}
SQL = {
    "a15_frame_difference": """WITH f AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT)) AS p FROM embeddings),
d AS (SELECT a.vec_id, list_transform(range(1, len(a.p) + 1), lambda i: abs(a.p[i] - b.p[i])) AS d FROM f a JOIN f b ON a.vec_id = b.vec_id + 1)
SELECT vec_id, list_sum(d) / len(d) AS difference, CAST(list_sort(d)[least(len(d) - 1, CAST(floor(len(d) * 0.75) AS INT)) + 1] AS BIGINT) AS motion_level FROM d""",
    "a14_motion_levels": """WITH p AS (SELECT vec_id // 16 AS frame, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id, i) - 1 AS at,
CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT) AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)),
g AS (SELECT DISTINCT p.frame, x.at FROM p, (SELECT unnest(range(1024)) AS at) x),
f AS (SELECT g.frame, g.at, p.v FROM g LEFT JOIN p ON p.frame = g.frame AND p.at = g.at),
d AS (SELECT b.frame, b.at // 64 * 16 + b.at % 32 // 2 AS tile, sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) / 4 AS d FROM f a JOIN f b ON b.frame = a.frame + 1 AND a.at = b.at GROUP BY ALL)
SELECT frame, list_sort(list(d))[193] AS motion_level FROM d GROUP BY frame""",
    "a16_changed_tiles": f"""WITH {_LARGE_SQL}, pairs AS (SELECT frame - 1 AS a, frame AS b FROM ms WHERE frame - 1 IN (SELECT frame FROM ms)), {changed_sql("pairs")},
co AS (SELECT frame, pos % 32 AS x, sum(v) AS v FROM fp WHERE pos // 32 BETWEEN 6 AND 24 GROUP BY ALL),
sm AS (SELECT frame, x, CAST(sum(v) OVER w AS DOUBLE) / (count(*) OVER w * 19) AS s FROM co WINDOW w AS (PARTITION BY frame ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
gu AS (SELECT frame, list_sort(list(s))[17] AS median, min(s) FILTER (WHERE x BETWEEN 11 AND 20) AS low, arg_min(x, (s, x)) FILTER (WHERE x BETWEEN 11 AND 20) AS x FROM sm GROUP BY frame)
SELECT b AS frame, share AS changed_share, CASE WHEN median - low >= 10 THEN x / 32 ELSE -1.0 END AS gutter FROM ch JOIN gu ON gu.frame = ch.b""",
    "t2_downsampled": f"""WITH {_LARGE_SQL} SELECT frame, CAST(pos // 4 // 16 // 2 * 8 + pos // 4 % 16 // 2 AS INT) AS place,
CAST(least(255, sum(v * [{", ".join(map(str, LUMA))}][pos % 4 + 1]) // 1024) AS INT) AS gray FROM fp GROUP BY ALL""",
    "t6_page_turns": rf"""WITH RECURSIVE {_LARGE_SQL}, bk AS (SELECT frame, frame // 8 AS book FROM ms), pairs AS (SELECT x.frame AS a, y.frame AS b FROM bk x JOIN bk y ON x.book = y.book AND x.frame < y.frame), {changed_sql("pairs")},
wo AS (SELECT frame, translate(word, 'ßäçèéêíñóöü', 'ABCDEFGHIJK') AS word FROM (SELECT doc_id AS frame, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+')) AS word FROM documents) WHERE length(word) >= 4),
ww AS (SELECT DISTINCT * FROM wo WHERE frame IN (SELECT frame FROM bk)), n AS (SELECT frame, count(DISTINCT word) AS n, count(word) AS c FROM bk LEFT JOIN wo USING (frame) GROUP BY ALL),
sd AS (SELECT ch.a, ch.b, share, least(x.n, y.n) AS total, least(x.c, y.c) AS fewer, CASE WHEN x.n < y.n THEN x.frame ELSE y.frame END AS s, CASE WHEN x.n < y.n THEN y.frame ELSE x.frame END AS l
       FROM ch JOIN n x ON x.frame = ch.a JOIN n y ON y.frame = ch.b),
hd AS (SELECT sd.a, sd.b, count(DISTINCT x.word) AS shared FROM sd JOIN ww x ON x.frame = sd.s JOIN ww y ON y.frame = sd.l AND left(x.word, 1) = left(y.word, 1)
       AND (x.word = y.word OR (length(x.word) >= 5 AND abs(length(x.word) - length(y.word)) <= CASE WHEN length(x.word) >= 7 THEN 2 ELSE 1 END
            AND levenshtein(x.word, y.word) <= CASE WHEN length(x.word) >= 7 THEN 2 ELSE 1 END)) GROUP BY ALL),
sa AS (SELECT a, b FROM sd LEFT JOIN hd USING (a, b) WHERE (fewer < 3 OR coalesce(shared, 0) / total >= 0.6::DOUBLE) AND (fewer >= 12 OR share < 0.4::DOUBLE)),
tw AS (SELECT b AS frame, list(a) AS twins FROM sa GROUP BY b), pk AS (SELECT book, frame, coalesce(twins, []) AS twins, row_number() OVER (PARTITION BY book ORDER BY frame) AS k FROM bk LEFT JOIN tw USING (frame)),
wk AS (SELECT book, k, frame, true AS is_new, [frame] AS known FROM pk WHERE k = 1
 UNION ALL
 SELECT pk.book, pk.k, pk.frame, NOT list_has_any(known, twins), CASE WHEN list_contains(twins, known[-1]) THEN list_append(known[1:-2], pk.frame) WHEN list_has_any(known, twins) THEN known ELSE (list_append(known, pk.frame))[-3:] END
 FROM wk JOIN pk ON pk.book = wk.book AND pk.k = wk.k + 1)
SELECT book, CAST(frame % 8 AS INT) AS page_no, is_new FROM wk""",
    "c9_motion_trigger": f"WITH RECURSIVE {_FIRED_SQL} SELECT stream, event_id, s AS seconds FROM r WHERE fires",
    "t5_timely_judgements": f"""WITH RECURSIVE {_FIRED_SQL}, j AS (SELECT stream, event_id, i, s + event_id % 7 * 86400 AS done_at FROM r WHERE fires)
SELECT stream, event_id, done_at FROM j WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.stream = j.stream AND e.i > j.i AND e.v > 60 AND e.s <= j.done_at)""",
    "t1_sampled_events": "SELECT user_id, event_id, i AS frame_no FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i % 8 = 0",
}
