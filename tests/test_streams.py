"""Streaming operators on shuffled micro-batches against their batch forms; late rows, forgotten state, keyed audit."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators.frames import EVENT_RULE, fired, timely_judgements
from folio.operators.similarity import new_pages
from folio.schema import Motion
from folio.streaming import replayed
from folio.streaming.motion import episodes, settled_pages
from folio.streaming.ordered import use_state_store
from folio.streaming.pages import judged_pages, timely

LEVELS = "stream long, event_id long, seconds double, level double"
EPOCH = dt.datetime(1970, 1, 1)


@pytest.fixture
def streams(spark, tmp_path):
    """Writes batches as the files of a stream, and runs a stream to its end."""
    use_state_store(spark)
    made = []

    def source(batches, schema):
        folder = str(tmp_path / f"in{len(made)}")
        made.append(folder)
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def rows(stream):
        made.append(None)
        out = str(tmp_path / f"out{len(made)}")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start().awaitTermination(180)
        return spark.read.schema(stream.schema).parquet(out).collect()

    return source, rows


def shuffled(rows, at, n, late, rng, end):
    """``rows`` in n batches, each row up to ``late`` seconds behind its place, and an end that lets all others pass."""
    rows = sorted(rows, key=lambda r: at(r) + rng.random() * late)
    size = -(-len(rows) // n)
    return [*(rows[i : i + size] for i in range(0, len(rows), size)), [end]]


def levels_of(rng, n, streams=4):
    rows, event = [], 0
    for s in range(streams):
        at = 10.0
        for _ in range(n):
            at += rng.choice([0.25, 0.25, 0.5, 0.0])
            event += 1
            rows.append((s, event, at, rng.choice([*[0.5] * 14, 3.0, 9.0])))
    return rows


def test_unordered_frames_fire_like_the_batch(spark, streams):
    source, rows = streams
    rng = random.Random(4)
    levels = levels_of(rng, 150)
    stream = source(shuffled(levels, lambda r: r[2], 4, 4.0, rng, (99, -1, 10_000.0, 0.5)), LEVELS)
    got = sorted((r.stream, r.event_id, r.seconds) for r in rows(settled_pages(stream, delay="5 seconds")))
    want = sorted((r.stream, r.event_id, r.seconds) for r in fired(spark.createDataFrame(levels, LEVELS), Motion()).collect())
    assert got == want and len(want) > 20


def test_late_frames_are_lost_and_forgotten_streams_begin_anew(streams):
    source, rows = streams
    still = lambda s, e, at: (s, e, at, 0.5)
    batches = [
        [(1, 1, 10.0, 9.0), still(1, 2, 11.0), still(1, 3, 12.0), (2, 11, 10.0, 9.0), still(2, 12, 11.0)],
        [still(1, 4, 100.0), still(3, 30, 100.0)],
        [still(3, 31, 100.5)],
        [(1, 5, 13.0, 9.0)],  # too late: moves nothing
        [still(2, 13, 101.0), still(2, 14, 110.0), still(2, 15, 120.0)],  # with forget=50, stream 2 is new here
        [still(99, 99, 1_000.0)],
    ]
    got = rows(settled_pages(source(batches, LEVELS), delay="5 seconds", forget=50.0))
    assert [(r.stream, r.event_id) for r in got] == []  # all streams were forgotten before they settled
    kept = rows(settled_pages(source(batches, LEVELS), delay="5 seconds", forget=500.0))
    assert sorted((r.stream, r.event_id) for r in kept) == [(1, 4), (2, 13)]


def test_streamed_judgements_match_the_batch(spark, streams):
    source, rows = streams
    rng = random.Random(8)
    levels = levels_of(rng, 120)
    frame = spark.createDataFrame(levels, LEVELS)
    settled = fired(frame, Motion())
    judged = [(r.stream, r.event_id, r.seconds + rng.choice([0.0, 0.25, 0.5, 2.0, 6.0])) for r in settled.collect()]
    want = timely_judgements(frame, spark.createDataFrame(judged, "stream long, event_id long, done_at double"), Motion()).collect()
    timed = [(s, e, EPOCH + dt.timedelta(seconds=at)) for s, e, at in judged]
    done = source(shuffled(timed, lambda r: r[2].timestamp(), 2, 4.0, rng, (99, -1, EPOCH + dt.timedelta(seconds=10_000))), "stream long, event_id long, done_at timestamp")
    stream = source(shuffled(levels, lambda r: r[2], 3, 4.0, rng, (99, -1, 10_000.0, 0.5)), LEVELS)
    got = rows(timely(done, episodes(stream, delay="5 seconds"), "7 seconds", "5 seconds"))
    assert sorted((r.stream, r.event_id) for r in got if r.stream != 99) == sorted((r.stream, r.event_id) for r in want)
    assert 0 < len(want) < len(judged)


def test_streamed_pages_match_the_batch(spark, streams):
    source, rows = streams
    rng = random.Random(6)
    texts = [[f"wort{rng.randrange(400)}x" for _ in range(rng.choice([0, 2, 8, 30]))] for _ in range(9)]
    frames = [[rng.randrange(256) for _ in range(1024)] for _ in range(3)]
    shots = []
    for i in range(90):
        words = [w if rng.random() < 0.9 else w[:-1] for w in rng.choice(texts)]
        shots.append((i % 3, i, EPOCH + dt.timedelta(seconds=10 + i // 2), rng.choice([None, words, words]), rng.choice([None, *frames])))
    schema = "stream long, event_id long, at timestamp, words array<string>, pixels array<int>"
    place = F.row_number().over(Window.partitionBy("stream").orderBy("at", "event_id"))
    plain = spark.createDataFrame(shots, schema).select(F.col("stream").alias("book"), place.alias("page_no"), "event_id", "words", "pixels")
    want = {(r.book, r.page_no): r.is_new for r in new_pages(plain.drop("event_id")).collect()}
    want = {r.event_id: want[r.book, r.page_no] for r in plain.select("book", "page_no", "event_id").collect()}
    stream = source(shuffled(shots, lambda r: (r[2] - EPOCH).total_seconds(), 3, 4.0, rng, (99, -1, EPOCH + dt.timedelta(seconds=10_000), [], None)), schema)
    got = {r.event_id: r.is_new for r in rows(judged_pages(stream, delay="5 seconds")) if r.stream != 99}
    assert got == want and set(want.values()) == {True, False}


def test_parts_of_uneven_numbers_of_files_stay_whole(spark, tmp_path):
    use_state_store(spark)
    rng = random.Random(9)
    hours = sorted({(s, int(24 * 60 * rng.random() ** 3)) for s in range(20) for _ in range(60)})
    rows = [(s, i, 3600 * (hour + 1), rng.choice([0.0, 0.0, 30.0, 90.0])) for i, (s, hour) in enumerate(hours)]
    levels = spark.createDataFrame(rows, "stream long, event_id long, seconds long, level double").repartitionByRange(9, "seconds")
    stream = replayed.as_stream(levels, "seconds", f"file://{tmp_path}/levels", level=F.lit(0.0))
    found = replayed.all_of(settled_pages(stream, EVENT_RULE, "48 hours", 1e9), f"file://{tmp_path}", f"file://{tmp_path}/levels").collect()
    want = fired(levels, EVENT_RULE).collect()
    assert sorted((r.stream, r.event_id) for r in found) == sorted((r.stream, r.event_id) for r in want) and len(want) > 50
