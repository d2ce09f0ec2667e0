"""Books of typed blocks as Markdown or HTML, one text per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.sources.tables import LINES_SQL, lines


def _kind(*cases: tuple[str, Column]) -> Column:
    out = None
    for kind, value in cases:
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    return out


def _assembled(pieces: DataFrame) -> DataFrame:
    """A book's pieces in order as one text; a book is one row's worth of text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "piece"))), lambda x: x["piece"])
    return pieces.groupBy("book").agg(F.first("title").alias("title"), F.array_join(ordered, "").alias("body"))


def markdown(blocks: DataFrame) -> DataFrame:
    """(book, text) from (book, title, block_no, kind, level, text, scan, printed)."""
    order = Window.partitionBy("book").orderBy("block_no")
    own = _kind(
        ("pageBreak", X.page_comment(F.col("scan"), F.col("printed"))), ("heading", F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6))), F.lit(" "), F.col("text"))),
        ("paragraph", F.col("text")), ("listItem", F.concat(F.lit("- "), F.col("text"))), ("footnote", F.concat(F.lit("> "), F.col("text"))),
        ("note", F.concat(F.lit("<!-- "), F.col("text"), F.lit(" -->"))),
    )
    before = F.lag("kind").over(order)
    seam = F.when(before.isNull(), "").when((before == "listItem") & (F.col("kind") == "listItem"), "\n").otherwise("\n\n")
    found = _assembled(blocks.withColumn("piece", F.concat(seam, own)))
    head = F.when(F.col("title").isNull(), "").otherwise(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n")))
    return found.select("book", F.concat(head, "body", F.lit("\n")).alias("text"))


def html(blocks: DataFrame, language: str = "de", comments: bool = False) -> DataFrame:
    """(book, text) as a whole page; markers are placeholders that a converter keeps, or comments."""
    order = Window.partitionBy("book").orderBy("block_no")
    text, printed = X.html_escape(F.col("text")), F.col("printed")
    wrapped = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    tag = F.concat(F.lit("h"), F.least(F.col("level") + 1, F.lit(6)).cast("string"))
    marker = F.concat(F.lit("<p>"), X.page_marker(F.col("scan"), printed), F.lit("</p>\n"))
    note = F.concat(F.lit("<p>"), X.note_marker(text), F.lit("</p>\n"))
    if comments:
        marker = F.concat(X.page_comment(F.col("scan"), printed), F.lit("\n"))
        note = F.concat(F.lit("<!-- "), X.comment_safe(F.col("text")), F.lit(" -->\n"))
    listed = lambda c: F.coalesce(c == "listItem", F.lit(False))
    opened = F.when(listed(F.lag("kind").over(order)), "").otherwise("<ul>\n")
    closed = F.when(listed(F.lead("kind").over(order)), "").otherwise("</ul>\n")
    own = _kind(
        ("pageBreak", marker), ("heading", F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">\n"))), ("paragraph", wrapped("<p>", "</p>\n")),
        ("listItem", F.concat(opened, wrapped("<li>", "</li>\n"), closed)), ("footnote", wrapped("<blockquote><p>", "</p></blockquote>\n")), ("note", note),
    )
    found = _assembled(blocks.withColumn("piece", own))
    title = X.html_escape(F.col("title"))
    head = F.when(title.isNull(), "").otherwise(F.concat(F.lit("<title>"), title, F.lit("</title>\n")))
    h1 = F.when(title.isNull(), "").otherwise(F.concat(F.lit("<h1>"), title, F.lit("</h1>\n")))
    start = F.lit(f'<!DOCTYPE html>\n<html lang="{language}">\n<head>\n<meta charset="utf-8">\n')
    return found.select("book", F.concat(start, head, F.lit("</head>\n<body>\n"), h1, "body", F.lit("</body>\n</html>\n")).alias("text"))


def write_texts(rendered: DataFrame, path: str, buckets: int | None = None) -> None:
    """The texts: a folder with a plain text for each book, or for many books so many ``buckets`` of JSON lines (book, text)."""
    if buckets is None:
        rendered.repartition("book").write.partitionBy("book").text(path)
        return
    dealt = rendered.withColumn("bucket", F.pmod(F.xxhash64("book"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "book").write.partitionBy("bucket").json(path)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as blocks of all kinds in turn, with titles for every other book."""
    kinds = "element_at(array('pageBreak','heading','paragraph','listItem','listItem','footnote','note'), cast(line_no % 7 + 1 as int))"
    return lines(spark, sf_dir).select(
        "book", F.when(F.col("book") % 2 == 0, F.concat(F.lit("Book <"), F.col("book").cast("string"), F.lit(">"))).alias("title"), F.col("line_no").alias("block_no"), F.expr(kinds).alias("kind"),
        F.expr("cast(line_no % 3 + 1 as int)").alias("level"), "text", F.col("page_no").alias("scan"), F.when(F.col("page_no") % 2 == 1, F.col("page_no").cast("string")).alias("printed"),
    )


def x28_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(_blocks(spark, sf_dir))


def x29_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html(_blocks(spark, sf_dir))


QUERIES = {"x28_markdown": x28_markdown, "x29_html": x29_html}
_E = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_B = f"""{LINES_SQL}, b AS (SELECT book, CASE WHEN book % 2 = 0 THEN 'Book <' || book || '>' END AS title, line_no, line_no % 7 AS k, line_no % 3 + 1 AS level, text, page_no AS scan,
CASE WHEN page_no % 2 = 1 THEN CAST(page_no AS VARCHAR) END AS printed, row_number() OVER (PARTITION BY book ORDER BY line_no) AS i,
lag(line_no % 7) OVER (PARTITION BY book ORDER BY line_no) AS before, lead(line_no % 7) OVER (PARTITION BY book ORDER BY line_no) AS after FROM lines)"""
_COMMENT = "coalesce('<!-- Seite ' || printed || ', Scan ' || scan || ' -->', '<!-- Seite ' || scan || ' -->')"
SQL = {
    "x28_markdown": f"""WITH {_B}, p AS (SELECT book, title, line_no, CASE WHEN i = 1 THEN '' WHEN before IN (3, 4) AND k IN (3, 4) THEN chr(10) ELSE chr(10) || chr(10) END ||
CASE k WHEN 0 THEN {_COMMENT} WHEN 1 THEN repeat('#', least(level + 1, 6)) || ' ' || text WHEN 2 THEN text WHEN 5 THEN '> ' || text WHEN 6 THEN '<!-- ' || text || ' -->' ELSE '- ' || text END AS s FROM b)
SELECT book, coalesce('# ' || any_value(title) || chr(10) || chr(10), '') || string_agg(s, '' ORDER BY line_no) || chr(10) AS text FROM p GROUP BY book""",
    "x29_html": f"""WITH {_B}, p AS (SELECT book, title, line_no, CASE k WHEN 0 THEN '<p>@@SEITE ' || scan || coalesce(' S' || printed, '') || '@@</p>' || chr(10)
WHEN 1 THEN '<h' || least(level + 1, 6) || '>' || {_E.format("text")} || '</h' || least(level + 1, 6) || '>' || chr(10) WHEN 2 THEN '<p>' || {_E.format("text")} || '</p>' || chr(10)
WHEN 5 THEN '<blockquote><p>' || {_E.format("text")} || '</p></blockquote>' || chr(10) WHEN 6 THEN '<p>@@NOTIZ ' || {_E.format("text")} || '@@</p>' || chr(10)
ELSE CASE WHEN before IN (3, 4) THEN '' ELSE '<ul>' || chr(10) END || '<li>' || {_E.format("text")} || '</li>' || chr(10) || CASE WHEN after IN (3, 4) THEN '' ELSE '</ul>' || chr(10) END END AS s FROM b)
SELECT book, '<!DOCTYPE html>' || chr(10) || '<html lang="de">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || coalesce('<title>' || {_E.format("any_value(title)")} || '</title>' || chr(10), '') ||
'</head>' || chr(10) || '<body>' || chr(10) || coalesce('<h1>' || {_E.format("any_value(title)")} || '</h1>' || chr(10), '') || string_agg(s, '' ORDER BY line_no) || '</body>' || chr(10) || '</html>' || chr(10) AS text FROM p GROUP BY book""",
}
