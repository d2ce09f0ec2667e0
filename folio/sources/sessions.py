"""Scan sessions on a file system: catalog, session documents, page texts, file listings, and their writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.arrays import each_row, gathered
from folio.functions.text import composed, parse_iso_timestamp
from folio.operators.geometry import reading_order
from folio.schema import PAGE_JSON, SESSION_JSON

CURRENT_VERSION = 2


def _part(path: Column, i: int) -> Column:
    """A component of a file's URL, from the end, with its escapes decoded."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), i), F.lit("+"), F.lit("%2B")))


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """All session documents under a root, newest first: one row each, with directory, defaults filled in.

    A document without version, id or a readable date is an error, as is broken JSON.
    """
    raw = spark.read.schema(SESSION_JSON).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/session.json")
    created = parse_iso_timestamp(F.col("createdAt"))
    told = F.concat(F.lit("session document without version, id or date: "), F.input_file_name())
    whole = F.col("version").isNotNull() & F.col("id").isNotNull() & created.isNotNull()
    settings = F.struct(
        F.coalesce("settings.splitMode", F.lit("automatic")).alias("splitMode"), F.coalesce("settings.cropEnabled", F.lit(False)).alias("cropEnabled"),
        F.coalesce("settings.autoRotate", F.lit(True)).alias("autoRotate"),
    )
    none = lambda c: F.coalesce(c, F.array().cast(SESSION_JSON[c].dataType))
    return raw.select(
        _part(F.input_file_name(), -2).alias("directory"), "version", F.when(whole, F.col("id")).otherwise(F.raise_error(told)).alias("id"), created.alias("created_at"),
        "title", settings.alias("settings"), F.coalesce("captureCounter", F.lit(0)).alias("capture_counter"), none("pageOrder").alias("page_order"), none("pages").alias("pages"),
        none("trashed").alias("trashed"), F.coalesce("archived", F.lit(False)).alias("archived"),
    ).orderBy(F.desc("created_at"))


def session_pages(sessions: DataFrame) -> DataFrame:
    """One row per page in the session's order; ids without a page are skipped."""
    places = sessions.select(F.col("id").alias("session"), F.posexplode("page_order").alias("at", "page"))
    pages = sessions.select(F.col("id").alias("session"), F.explode("pages").alias("p")).select("session", F.col("p.id").alias("page"), "p.*").drop("id")
    order = Window.partitionBy("session").orderBy("at")
    return places.join(pages, ["session", "page"]).withColumn("number", F.row_number().over(order)).drop("at")


def _box(box: Column, i: int, j: int) -> Column:
    return F.try_element_at(F.try_element_at(box, F.lit(i)), F.lit(j))


def read_page_lines(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all page texts under a root, in reading order; texts are composed, those of an older version put in order here."""
    raw = spark.read.schema(PAGE_JSON).option("multiLine", True).json(f"{root}/*/OCR/*.json")
    rows = raw.select(
        _part(F.input_file_name(), -3).alias("directory"), F.col("pageID").alias("page"), F.coalesce("version", F.lit(1)).alias("version"),
        F.posexplode("lines").alias("line_no", "l"),
    ).select(
        "directory", "page", "version", "line_no", composed(F.col("l.text")).alias("text"), "l.confidence", _box(F.col("l.box"), 1, 1).alias("x"), _box(F.col("l.box"), 1, 2).alias("y"),
        _box(F.col("l.box"), 2, 1).alias("w"), _box(F.col("l.box"), 2, 2).alias("h"), F.coalesce("l.angle", F.lit(0.0)).alias("angle"),
    )

    names = [c for c in rows.columns if c not in ("directory", "page")]

    def reorder(row: dict) -> Iterator[tuple]:
        page = row["members"]
        order = reading_order([(x["x"], x["y"], x["w"], x["h"]) for x in page])
        for place, i in enumerate(order):
            values = page[i] | {"line_no": place, "version": CURRENT_VERSION}
            yield row["directory"], row["page"], *(values[c] for c in names)

    kinds = {"version": pa.int32(), "line_no": pa.int32(), "text": pa.string(), "confidence": pa.float32()}
    arrow = pa.schema([("directory", pa.string()), ("page", pa.string()), *((c, kinds.get(c, pa.float64())) for c in names)])
    old = gathered(rows.where(F.col("version") < CURRENT_VERSION), ["directory", "page"], "line_no", *[c for c in names if c != "line_no"])
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in arrow.names)
    return rows.where(F.col("version") >= CURRENT_VERSION).unionByName(each_row(old, reorder, schema, arrow))


def upgraded_page_texts(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Page texts of an older version written to ``path`` as JSON documents in the current one; returns what was written."""
    box = F.array(F.array("x", "y"), F.array("w", "h"))
    line = F.struct("line_no", "text", "confidence", box.alias("box"), "angle")
    old = spark.read.schema(PAGE_JSON).option("multiLine", True).json(f"{root}/*/OCR/*.json").where(F.coalesce("version", F.lit(1)) < CURRENT_VERSION)
    heads = old.select(_part(F.input_file_name(), -3).alias("directory"), F.col("pageID").alias("page"), "pixelWidth", "pixelHeight", "languages", "recognizedAt")
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["box"].alias("box"), x["angle"].alias("angle")))
    texts = read_page_lines(spark, root).groupBy("directory", "page").agg(ordered.alias("lines"))
    whole = heads.join(texts, ["directory", "page"], "left").withColumn("version", F.lit(CURRENT_VERSION)).withColumnRenamed("page", "pageID")
    whole.repartition("directory").write.partitionBy("directory").json(path)
    return spark.read.schema(T.StructType([*PAGE_JSON.fields, T.StructField("directory", T.StringType())])).json(path)


def save_page_texts(sessions: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """Append page lines (directory, page ..) by session, and the sessions with those pages' status set to done."""
    rows.repartition("directory").write.mode("append").partitionBy("directory").parquet(path)
    read = rows.groupBy("directory").agg(F.collect_set("page").alias("__read"))
    fields = sessions.schema["pages"].dataType.elementType.names
    status = lambda p: F.when(F.array_contains("__read", p["id"]), F.lit("done")).otherwise(p["ocrStatus"])
    done = F.transform("pages", lambda p: F.struct(*[(status(p) if c == "ocrStatus" else p[c]).alias(c) for c in fields]))
    joined = sessions.join(read, "directory", "left")
    return joined.withColumn("pages", F.when(F.col("__read").isNull(), F.col("pages")).otherwise(done)).select(*sessions.columns)


def write_page_lines(rows: DataFrame, path: str) -> None:
    """Page lines as Parquet by session; a later version is written to another path."""
    rows.repartition("directory").write.partitionBy("directory").parquet(path)


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(session, path inside it, bytes) of every file under a root; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    start = F.length(F.lit(root.rstrip("/"))) + F.locate(root.rstrip("/"), F.col("path")) + 1
    inner = F.expr("substring(path, at)")
    return files.withColumn("at", start.cast("int")).select(F.substring_index(inner, "/", 1).alias("session"), F.expr("substring(substring(path, at), locate('/', substring(path, at)) + 1)").alias("path"), F.col("length").alias("bytes"))


def media_type(content: Column) -> Column:
    """Type of received bytes by their first ones: pdf, png, jpeg, heic, or bin."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("25504446")), "pdf").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(F.substring(head, 9, 8) == "66747970", "heic").otherwise("bin")
    )


def supported(path: Column) -> Column:
    """Whether a file can be imported, by its extension."""
    return F.lower(F.substring_index(path, ".", -1)).isin("pdf", "heic", "heif", "jpg", "jpeg", "png", "tif", "tiff")


def png_size(content: Column) -> Column:
    """Width and height from the header of a PNG file; null for others."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(media_type(content) == "png", F.struct(number(17).alias("width"), number(21).alias("height")))


def free_directory_name(stamp: str, taken: set[str]) -> str:
    """A name for a new session: the time stamp, with (2), (3) .. behind it where that exists."""
    name, n = stamp, 1
    while name in taken:
        n += 1
        name = f"{stamp} ({n})"
    return name


RECOGNISED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.FloatType()), T.StructField("box", T.ArrayType(T.DoubleType()))]))


def recognise(images: DataFrame, recogniser, column: str = "content") -> DataFrame:
    """``images`` with lines, by a function from bytes to (text, confidence, [x, y, w, h]) rows, loaded once per worker.

    No recogniser comes with this package.
    """

    @F.pandas_udf(RECOGNISED)
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda content: [{"text": t, "confidence": c, "box": list(b)} for t, c, b in recogniser(content)])

    return images.withColumn("lines", run(F.col(column)))
