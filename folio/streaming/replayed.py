"""The given tables as streams: unordered files read one a micro-batch, for the queries that run the streaming operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators.frames import _FIRED_SQL, EVENT_RULE, _levels, fired
from folio.operators.similarity import SQL as _PAGES_SQL
from folio.operators.similarity import _page_words
from folio.sources.tables import pages, shared_folder, shuffles_go
from folio.streaming.motion import episodes, settled_pages
from folio.streaming.ordered import SETTINGS, use_state_store
from folio.streaming.pages import judged_pages, timely

_FOREVER = 100 * 365 * 86_400
#: Files a table is dealt to, and how many hours late a row may come.
PARTS = 3
LATE_HOURS = 24


def as_stream(rows: DataFrame, seconds: str, folder: str, **end: Column) -> DataFrame:
    """``rows`` as a stream of unordered files in which a row is up to ``LATE_HOURS`` late, and a last one 400 days on.

    The rows are made once and written down, then dealt to parts; ``all_of`` lets one part after the other into the stream's folder.
    """
    spark, made = rows.sparkSession, f"{folder}/made"
    with shuffles_go(spark):
        rows.write.option("compression", "zstd").parquet(made)
    rows = spark.read.schema(rows.schema).parquet(made)
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    width = ((last or 0) - (first or 0)) / PARTS + 1
    late = F.pmod(F.xxhash64("event_id"), F.lit(LATE_HOURS * 3600))
    part = F.least(F.floor((F.col(seconds) - (first or 0) + late) / width), F.lit(PARTS - 1)).cast("int")
    rows.withColumn("dealt_to", part).write.partitionBy("dealt_to").option("compression", "zstd").parquet(f"{folder}/dealt")
    final = {"stream": F.lit(-1), "event_id": F.lit(-1), seconds: F.lit((last or 0) + 400 * 86_400), **end}
    spark.range(1).select(*[final[f.name].cast(f.dataType).alias(f.name) for f in rows.schema]).write.parquet(f"{folder}/dealt/dealt_to={PARTS}")
    files, path = _files(spark, folder)
    files.delete(path("made"), True)
    files.mkdirs(path("in"))
    return spark.readStream.schema(StructType(rows.schema.fields)).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def _files(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and what makes paths below it."""
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path("in").getFileSystem(spark._jsc.hadoopConfiguration()), path


def all_of(stream: DataFrame, folder: str, *inputs: str) -> DataFrame:
    """What a stream gives once all parts of its inputs, folders of ``as_stream``, were read, a part a micro-batch.

    The query is started anew for each part and goes on from its progress, so that parts of any number of files stay whole: with
    a number of files a micro-batch, rows of a part that was cut would come after its latest ones, and count as late.
    """
    for part in range(PARTS + 1):
        for files, path in (_files(stream.sparkSession, name) for name in inputs):
            if files.exists(path(f"dealt/dealt_to={part}")):
                files.rename(path(f"dealt/dealt_to={part}"), path(f"in/{part}"))
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _with_store(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with the state store that it needs, which the session keeps only while the query runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = {name: spark.conf.get(name, None) for name in SETTINGS}
        use_state_store(spark)
        try:
            return fn(spark, sf_dir)
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)

    run.__doc__ = fn.__doc__
    return run


def _level_stream(spark: SparkSession, sf_dir: str, folder: str) -> tuple[DataFrame, DataFrame]:
    levels = _levels(spark, sf_dir)
    return levels, as_stream(levels, "seconds", folder, level=F.lit(0.0))


def t9_unordered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where streams settle, from a stream of events that come up to a day late."""
    folder = shared_folder(spark)
    _, stream = _level_stream(spark, sf_dir, f"{folder}/levels")
    found = all_of(settled_pages(stream, EVENT_RULE, f"{2 * LATE_HOURS} hours", _FOREVER), folder, f"{folder}/levels")
    return found.select("stream", "event_id", F.col("seconds").cast("long").alias("seconds"))


def t5_streamed_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of judgements that take up to six days, those that no movement overtook, from two unordered streams."""
    folder = shared_folder(spark)
    levels, stream = _level_stream(spark, sf_dir, f"{folder}/levels")
    judged = fired(levels, EVENT_RULE).withColumn("done_at", F.col("seconds") + F.col("event_id") % 7 * 86_400).select("stream", "event_id", "done_at")
    done = as_stream(judged, "done_at", f"{folder}/judged").withColumn("done_at", F.timestamp_seconds("done_at"))
    delay = f"{2 * LATE_HOURS} hours"
    kept = timely(done, episodes(stream, EVENT_RULE, delay, _FOREVER), "7 days", delay)
    return all_of(kept, folder, f"{folder}/levels", f"{folder}/judged").where("stream >= 0").select("stream", "event_id", F.unix_seconds("done_at").alias("done_at"))


def c10_streamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pages by words, from an unordered stream of all books' pages, one every three hours."""
    folder = shared_folder(spark)
    words = _page_words(pages(spark, sf_dir)).select(F.col("book").alias("stream"), F.col("page_no").cast("long").alias("event_id"), ((F.col("page_no") + 1) * 10_800).cast("long").alias("seconds"), "words")
    stream = as_stream(words, "seconds", f"{folder}/pages", words=F.array()).withColumn("at", F.timestamp_seconds("seconds"))
    found = all_of(judged_pages(stream, delay=f"{2 * LATE_HOURS} hours", forget=_FOREVER), folder, f"{folder}/pages").where("stream >= 0")
    return found.select(F.col("stream").alias("book"), F.col("event_id").cast("int").alias("page_no"), "is_new")


QUERIES = {name: _with_store(fn) for name, fn in (("t9_unordered_frames", t9_unordered_frames), ("t5_streamed_judgements", t5_streamed_judgements), ("c10_streamed_pages", c10_streamed_pages))}
SQL = {
    "t9_unordered_frames": f"WITH RECURSIVE {_FIRED_SQL} SELECT stream, event_id, s AS seconds FROM r WHERE fires",
    "t5_streamed_judgements": f"""WITH RECURSIVE {_FIRED_SQL}, j AS (SELECT stream, event_id, i, s + event_id % 7 * 86400 AS done_at FROM r WHERE fires)
SELECT stream, event_id, done_at FROM j WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.stream = j.stream AND e.i > j.i AND e.v > 60 AND e.s <= j.done_at)""",
    "c10_streamed_pages": _PAGES_SQL["c10_new_pages"],
}
