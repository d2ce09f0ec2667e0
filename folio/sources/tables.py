"""The given tables, and book pages with integer geometry derived from ``documents``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS_PER_LINE = 10
LINES_PER_PAGE = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="folio-")
    return f"{path.rstrip('/')}/folio-{uuid.uuid4().hex}"


#: Shuffled files of a write go with it, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffled files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def kept(rows: DataFrame, *by: str, dealt: bool = False) -> DataFrame:
    """``rows`` written as Parquet to a shared folder, for what is read more than once; it goes when the driver's JVM ends, or by ``dropped``.

    With ``by`` the rows are dealt to buckets by these columns, so that windows, groups and joins by them need not deal them out again;
    ``dealt`` rows lie so already, as they were made from such a table by these columns.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    tasks, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"folio_{uuid.uuid4().hex}"
    with shuffles_go(spark):
        if by:
            found = rows if dealt else rows.repartition(tasks, *by)
            found.write.bucketBy(tasks, *by).option("compression", "zstd").option("path", folder).saveAsTable(name)
            found = spark.table(name)
            found.schema  # what was read of the table stays known without its name
            spark.sql(f"DROP TABLE {name}")
        else:
            rows.write.option("compression", "zstd").parquet(folder)
            found = spark.read.schema(rows.schema).parquet(folder)
    found._kept_at = folder
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete ``kept`` tables which nothing reads any more."""
    for rows in tables:
        path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(rows._kept_at)
        path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of every document, as a book: ten words a line, thirty lines a page.

    Geometry is in thousandths of the page: cw_mil the width of a character, mid_mil the height of a line's middle, x_mil
    its left edge and w_mil its width; conf_pct is the confidence in percent. A page's first line is larger than others.
    """
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.split("text", r"\s+").alias("ws"))
    cut = F.transform(
        F.sequence(F.lit(0), F.expr("cast((size(ws) - 1) div 10 as int)")), lambda i: F.array_join(F.slice("ws", i * WORDS_PER_LINE + 1, WORDS_PER_LINE), " ")
    )
    rows = words.select("book", F.posexplode(cut).alias("line_no", "text")).where("text <> ''")
    return rows.select(
        "book",
        F.expr("line_no div 30").cast("int").alias("page_no"),
        "line_no",
        "text",
        F.length("text").alias("n"),
        F.expr("cast(25 + (book * 31 + line_no * 17) % 76 as int)").alias("conf_pct"),
        F.expr("CASE WHEN line_no % 30 = 0 THEN 24 ELSE 12 END").alias("cw_mil"),
        F.expr("950 - (line_no % 30) * 30").alias("mid_mil"),
        F.expr("cast(100 + (book + line_no * 7) % 5 * 10 as int)").alias("x_mil"),
    ).withColumn("w_mil", F.expr("n * cw_mil"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page_no, text) of the pages that have ``lines``, their texts with a space between; for what needs no single lines."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.split("text", r"\s+").alias("ws"))
    a_page = WORDS_PER_LINE * LINES_PER_PAGE
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / a_page).cast("int")), lambda i: F.array_join(F.slice("ws", i * a_page + 1, a_page), " "))
    return words.select("book", F.posexplode(cut).alias("page_no", "text")).where("text <> ''")


#: The rows of ``lines`` in DuckDB, as the first part of a WITH.
LINES_SQL = r"""
w AS (SELECT doc_id AS book, regexp_split_to_array(text, '\s+') AS ws FROM documents),
l AS (SELECT book, CAST(i AS INT) AS line_no, array_to_string(ws[i * 10 + 1:i * 10 + 10], ' ') AS text
      FROM (SELECT book, ws, unnest(range(0, (len(ws) - 1) // 10 + 1)) AS i FROM w)),
lines AS (SELECT book, CAST(line_no // 30 AS INT) AS page_no, line_no, text, length(text) AS n,
                 CAST(25 + (book * 31 + line_no * 17) % 76 AS INT) AS conf_pct,
                 CASE WHEN line_no % 30 = 0 THEN 24 ELSE 12 END AS cw_mil,
                 950 - (line_no % 30) * 30 AS mid_mil, CAST(100 + (book + line_no * 7) % 5 * 10 AS INT) AS x_mil,
                 length(text) * (CASE WHEN line_no % 30 = 0 THEN 24 ELSE 12 END) AS w_mil
          FROM l WHERE text <> '')
"""
