"""Book typography and page statistics: medians, gaps, edges, character counts, recognition quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from folio.functions.text import characters, composed
from folio.sources.tables import LINES_SQL, lines

MIN_LINES = 20


def by_page() -> WindowSpec:
    return Window.partitionBy("book", "page_no").orderBy("line_no")


def with_gaps(rows: DataFrame) -> DataFrame:
    """Lines with the distance from the line before and to the one after on their page; 0 at its ends."""
    before = F.lag("mid_mil").over(by_page()) - F.col("mid_mil")
    after = F.col("mid_mil") - F.lead("mid_mil").over(by_page())
    return rows.withColumn("gap_before", F.coalesce(before, F.lit(0))).withColumn("gap_after", F.coalesce(after, F.lit(0)))


def typography(rows: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per book: upper medians (of two middle values the larger) of line height, character width (of lines with 8 characters or more) and positive gap."""
    kept = rows.where("text <> '' AND conf_pct >= 30")
    gap = F.col("mid_mil") - F.lead("mid_mil").over(by_page())
    kept = kept.withColumn("gap", gap).withColumn("height", F.col("cw_mil") * 2)
    median = lambda c, cond: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC) FILTER (WHERE {cond})")
    found = kept.groupBy("book").agg(
        F.count("*").alias("n_lines"),
        median("height", "true").alias("median_height"),
        median("cw_mil", "n >= 8").alias("median_char_width"),
        median("gap", "gap > 0").alias("pitch"),
    )
    enough = F.col("n_lines") >= min_lines
    return found.select(
        "book", "n_lines", *[F.when(enough, F.col(c)).cast("double").alias(c) for c in ("median_height", "median_char_width", "pitch")]
    )


def edges(rows: DataFrame) -> DataFrame:
    """Per page: left edge, the tenth smallest of ten, right edge, the ninth, and the text width between."""
    page = rows.where("text <> ''").groupBy("book", "page_no").agg(
        F.count("*").alias("n_lines"), F.array_sort(F.collect_list("x_mil")).alias("ls"), F.array_sort(F.collect_list(F.col("x_mil") + F.col("w_mil"))).alias("rs")
    )
    left, right = F.expr("ls[cast(n_lines div 10 as int)]"), F.expr("rs[cast(least(n_lines - 1, n_lines * 9 div 10) as int)]")
    return page.select("book", "page_no", *[c.cast("long").alias(n) for c, n in ((left, "left_edge"), (right, "right_edge"), (F.greatest(right - left, F.lit(10)), "text_width"))])


def page_text(rows: DataFrame) -> DataFrame:
    """Per page: the text, its characters and the characters weighted by confidence, in hundredths."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return rows.groupBy("book", "page_no").agg(
        F.array_join(ordered, "\n").alias("plain_text"), F.sum("n").alias("characters"), F.sum(F.col("n") * F.col("conf_pct")).alias("confident")
    )


LISTED = 40


def listed_lines(rows: DataFrame, most: int = LISTED) -> DataFrame:
    """The first lines of every page by line_no, at most ``most``."""
    place = F.row_number().over(by_page())
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def quality(rows: DataFrame, least: int = 50) -> DataFrame:
    """Per page: lines, smallest, median and largest height, median confidence, uncertain lines, how many are listed."""
    return rows.groupBy("book", "page_no").agg(
        F.count("*").alias("n_lines"), F.min("cw_mil").alias("min_height"), F.median("cw_mil").alias("median_height"), F.max("cw_mil").alias("max_height"),
        F.median("conf_pct").alias("median_confidence"), F.count_if(F.col("conf_pct") < least).alias("uncertain"),
        F.least(F.count("*"), F.lit(LISTED)).alias("listed"),
    )


def rescan_verdict(old: Column, new: Column) -> Column:
    """Which of two scans holds more confident text, by more than three percent; undecided while one has no text."""
    better = F.when(100 * new > 103 * old, "new").when(100 * old > 103 * new, "old")
    return F.when(old.isNull() | new.isNull(), "undecided").otherwise(F.coalesce(better, F.lit("undecided")))


def a1_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typography(lines(spark, sf_dir))


def w1_line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_gaps(lines(spark, sf_dir)).select("book", "page_no", "line_no", "gap_before", "gap_after")


def a2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(lines(spark, sf_dir))


def a4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(lines(spark, sf_dir))


def a8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(lines(spark, sf_dir))


def a5_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the next page of its book, as if that were its second scan."""
    pages = page_text(lines(spark, sf_dir)).select("book", "page_no", "confident")
    new = F.lead("confident").over(Window.partitionBy("book").orderBy("page_no"))
    return pages.select("book", "page_no", rescan_verdict(F.col("confident"), new).alias("verdict"))


#: Texts as another system writes them: umlauts as letters with marks, a family, a flag and a mark on no letter between.
_DECOMPOSED = """replace(replace(replace(text, 'ä', 'a' || m), 'ö', 'o' || m), 'ü', 'u' || m) || CASE (book + line_no) % 4 WHEN 0 THEN family WHEN 1 THEN flag WHEN 2 THEN 'x' || m || m ELSE '' END"""
_MARKS = {"m": "\u0308", "family": "\U0001f468\u200d\U0001f469\u200d\U0001f467", "flag": "\U0001f1e9\U0001f1ea\U0001f1eb"}


def a4_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, the code points of its lines as they come in, those once composed, and the characters of a reader."""
    rows = lines(spark, sf_dir).withColumns({c: F.lit(v) for c, v in _MARKS.items()}).withColumn("raw", F.expr(_DECOMPOSED))
    rows = rows.select("book", "page_no", "raw", composed(F.col("raw")).alias("text"))
    return rows.groupBy("book", "page_no").agg(
        F.sum(F.length("raw")).alias("code_points"), F.sum(F.length("text")).alias("composed"), F.sum(characters(F.col("text"))).alias("characters")
    )


def a8_long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of pages of ninety lines, more than are listed."""
    rows = lines(spark, sf_dir).withColumn("page_no", F.expr("cast(line_no div 90 as int)"))
    return quality(rows)


_PAGE = "OVER (PARTITION BY book, page_no ORDER BY line_no)"
QUERIES = {
    "a1_typography": a1_typography, "w1_line_gaps": w1_line_gaps, "a2_edges": a2_edges, "a4_page_text": a4_page_text,
    "a5_rescan": a5_rescan, "a8_quality": a8_quality, "a4_characters": a4_characters, "a8_long_pages": a8_long_pages,
}
SQL = {
    "a1_typography": f"""WITH {LINES_SQL},
k AS (SELECT *, mid_mil - lead(mid_mil) {_PAGE} AS gap, cw_mil * 2 AS height FROM lines WHERE conf_pct >= 30),
m AS (SELECT book, count(*) AS n_lines, percentile_disc(0.5) WITHIN GROUP (ORDER BY height DESC) AS h,
             percentile_disc(0.5) WITHIN GROUP (ORDER BY cw_mil DESC) FILTER (WHERE n >= 8) AS c,
             percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC) FILTER (WHERE gap > 0) AS p FROM k GROUP BY book)
SELECT book, n_lines, CAST(CASE WHEN n_lines >= {MIN_LINES} THEN h END AS DOUBLE) AS median_height,
       CAST(CASE WHEN n_lines >= {MIN_LINES} THEN c END AS DOUBLE) AS median_char_width,
       CAST(CASE WHEN n_lines >= {MIN_LINES} THEN p END AS DOUBLE) AS pitch FROM m""",
    "w1_line_gaps": f"""WITH {LINES_SQL} SELECT book, page_no, line_no, coalesce(lag(mid_mil) {_PAGE} - mid_mil, 0) AS gap_before,
       coalesce(mid_mil - lead(mid_mil) {_PAGE}, 0) AS gap_after FROM lines""",
    "a2_edges": f"""WITH {LINES_SQL}, p AS (SELECT book, page_no, count(*) AS n, list_sort(list(x_mil)) AS ls, list_sort(list(x_mil + w_mil)) AS rs FROM lines GROUP BY ALL)
SELECT book, page_no, CAST(ls[n // 10 + 1] AS BIGINT) AS left_edge, rs[least(n - 1, n * 9 // 10) + 1] AS right_edge,
       greatest(rs[least(n - 1, n * 9 // 10) + 1] - ls[n // 10 + 1], 10) AS text_width FROM p""",
    "a4_page_text": f"""WITH {LINES_SQL} SELECT book, page_no, string_agg(text, chr(10) ORDER BY line_no) AS plain_text,
       CAST(sum(n) AS BIGINT) AS characters, CAST(sum(n * conf_pct) AS BIGINT) AS confident FROM lines GROUP BY ALL""",
    "a5_rescan": f"""WITH {LINES_SQL}, p AS (SELECT book, page_no, sum(n * conf_pct) AS c FROM lines GROUP BY ALL),
q AS (SELECT book, page_no, c, lead(c) OVER (PARTITION BY book ORDER BY page_no) AS d FROM p)
SELECT book, page_no, CASE WHEN d IS NULL THEN 'undecided' WHEN 100 * d > 103 * c THEN 'new' WHEN 100 * c > 103 * d THEN 'old' ELSE 'undecided' END AS verdict FROM q""",
    "a8_quality": f"""WITH {LINES_SQL} SELECT book, page_no, count(*) AS n_lines, min(cw_mil) AS min_height, median(cw_mil) AS median_height,
       max(cw_mil) AS max_height, median(conf_pct) AS median_confidence, count(*) FILTER (WHERE conf_pct < 50) AS uncertain,
       least(count(*), {LISTED}) AS listed FROM lines GROUP BY ALL""",
    "a8_long_pages": f"""WITH {LINES_SQL} SELECT book, CAST(line_no // 90 AS INT) AS page_no, count(*) AS n_lines, min(cw_mil) AS min_height, median(cw_mil) AS median_height,
       max(cw_mil) AS max_height, median(conf_pct) AS median_confidence, count(*) FILTER (WHERE conf_pct < 50) AS uncertain,
       least(count(*), {LISTED}) AS listed FROM lines GROUP BY ALL""",
    "a4_characters": f"""WITH {LINES_SQL}, r AS (SELECT book, page_no, {_DECOMPOSED} AS raw FROM (SELECT *, {", ".join(f"'{v}' AS {c}" for c, v in _MARKS.items())} FROM lines))
SELECT book, page_no, CAST(sum(length(raw)) AS BIGINT) AS code_points, CAST(sum(length(nfc_normalize(raw))) AS BIGINT) AS composed,
       CAST(sum(length_grapheme(nfc_normalize(raw))) AS BIGINT) AS characters FROM r GROUP BY ALL""",
}
