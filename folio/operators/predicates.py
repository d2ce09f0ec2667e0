"""Text functions and line predicates over all lines, as queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.typography import by_page
from folio.sources.tables import LINES_SQL, lines, table


def list_pages(rows: DataFrame) -> DataFrame:
    """Per page: whether at least four lines and 40 percent of them begin or end with a number."""
    numbered = X.starts_with_number(F.col("text")) | X.ends_with_number(F.col("text"))
    found = rows.where("text <> ''").groupBy("book", "page_no").agg(F.count("*").alias("n_lines"), F.count_if(numbered).alias("numbered"))
    return found.withColumn("is_list", (F.col("n_lines") >= 4) & (5 * F.col("numbered") >= 2 * F.col("n_lines")))


def _key(rows: DataFrame, **columns) -> DataFrame:
    return rows.select("book", "page_no", "line_no", *[c.alias(k) for k, c in columns.items()])


def x1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(lines(spark, sf_dir), normalized=X.normalized(F.col("text")))


def x2_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot words of each page, repeats counted."""
    words = lines(spark, sf_dir).select("book", "page_no", F.explode(X.snapshot_words(F.col("text"))).alias("word"))
    return words.groupBy("book", "page_no", "word").agg(F.count("*").alias("n"))


def x9_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lines made of a line's figures, and of a running head with a number at either end."""
    rows = lines(spark, sf_dir)
    bare = F.concat(F.lit("– "), (F.col("line_no") * 7 % 11000).cast("string"), F.lit(" –"))
    head = F.concat(F.col("page_no").cast("string"), F.lit(" "), F.substring_index("text", " ", 3))
    tail = F.concat(F.substring_index("text", " ", 7), F.lit(" "), F.col("page_no").cast("string"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return _key(
        rows, own=none(X.page_number(F.col("text"))), bare=none(X.page_number(bare)), head=none(X.header_number(head)), tail=none(X.header_number(tail))
    )


def x12_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, titles and escaped texts of all lines."""
    raw = F.concat(F.lit(" . "), F.col("text"), F.lit("/:x"))
    return _key(
        lines(spark, sf_dir), safe=X.file_system_safe(raw), title=F.coalesce(X.title_or_null(F.concat(F.lit("  "), F.col("text"))), F.lit("")),
        escaped=X.html_escape(F.col("text")), comment=X.comment_safe(F.concat(F.lit("--"), F.col("text"))),
        shown=X.display_name(F.when(F.col("line_no") % 2 == 0, F.lit("")).otherwise(F.col("text")), F.lit("directory")),
        entry=X.without_toc_numbers(F.concat_ws(" ", F.lit("12. "), F.col("text"), F.col("page_no").cast("string"))),
    )


def x16_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page markers, comments, notes, and markers turned back into comments."""
    number, printed = F.col("line_no"), F.when(F.col("page_no") % 2 == 0, F.concat(F.lit("S"), F.col("page_no").cast("string")))
    marker = X.page_marker(number, printed)
    back = X.restore_markers(F.concat(F.lit("\\"), marker, F.lit(" "), X.note_marker(F.col("text"))))
    return _key(lines(spark, sf_dir), marker=marker, comment=X.page_comment(number, printed), restored=back)


def f7_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_pages(lines(spark, sf_dir))


def f9_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends with numbers, capitals, footnote marks, excluded titles; capitals also of the upper-cased line."""
    text = F.col("text")
    return _key(
        lines(spark, sf_dir), starts=X.starts_with_number(text), ends=X.ends_with_number(text), caps=X.is_all_caps(text), upper_caps=X.is_all_caps(X.capitals(text)),
        mark=X.starts_with_footnote_marker(text), excluded=X.is_excluded_title(text),
    )


def f13_continues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines run on from the one before."""
    rows = lines(spark, sf_dir).withColumn("previous", F.lag("text").over(by_page())).where("previous IS NOT NULL")
    return _key(rows, continued=X.continues(F.col("previous"), F.col("text")))


def s12_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each folder (one a brand) by name, numbers by value: their keys and places."""
    name = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit(".png"))
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), name.alias("name"), X.natural_key(name).alias("sort_key"))
    return files.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("sort_key", "name")))


_STARTS = r"length(regexp_extract({0}, '^\p{{N}}+')) BETWEEN 1 AND 4"
_ENDS = r"(length(regexp_extract(trim({0}, '.) '), '\p{{N}}+$')) BETWEEN 1 AND 4 AND length(trim({0}, '.) ')) > length(regexp_extract(trim({0}, '.) '), '\p{{N}}+$')))"
_NUM = r"coalesce(CASE WHEN regexp_matches(trim({0}, '-–— '), '^[0-9]{{1,4}}$') THEN TRY_CAST(trim({0}, '-–— ') AS BIGINT) END, 0)"
_TOKENS = "list_filter(string_split({0}, ' '), lambda t: t <> '')"
_COUNT = r"len(regexp_extract_all({0}, '{1}'))"


def _sql_header(c: str) -> str:
    t = _TOKENS.format(c)
    first, last = _NUM.format(f"({t})[1]"), _NUM.format(f"({t})[-1]")
    lettered = r"len(list_filter({0}, lambda t: regexp_matches(t, '\p{{L}}'))) > 0"
    rest, before = lettered.format(f"({t})[2:]"), lettered.format(f"({t})[:len({t}) - 1]")
    return f"CASE WHEN len({t}) NOT BETWEEN 2 AND 7 THEN 0 WHEN {first} > 0 AND {rest} THEN {first} WHEN {last} > 0 AND {before} THEN {last} ELSE 0 END"


def _sql_caps(c: str) -> str:
    letters, digits, spaces, capitals = (_COUNT.format(c, p) for p in (r"\p{L}", r"\p{N}", r"\s", r"\p{Lu}"))
    return f"({letters} >= 4 AND 5 * (length({c}) - {letters} - {spaces}) <= 2 * length({c}) AND {digits} <= 2 AND 5 * {capitals} >= 4 * {letters})"


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TOC = "'12.  ' || text || ' ' || page_no"
_HEAD = r"regexp_replace({0}, '^[\p{{N}}. ]*', '')".format(_TOC)
_PRINTED = "CASE WHEN page_no % 2 = 0 THEN 'S' || page_no END"
_FIRST = lambda n: f"array_to_string(string_split(text, ' ')[1:{n}], ' ')"

QUERIES = {
    "x1_normalized": x1_normalized, "x2_words": x2_words, "x9_page_numbers": x9_page_numbers, "x12_names": x12_names, "x16_markers": x16_markers,
    "f7_list_pages": f7_list_pages, "f9_line_kinds": f9_line_kinds, "f13_continues": f13_continues, "s12_natural_order": s12_natural_order,
}
SQL = {
    "x1_normalized": rf"WITH {LINES_SQL} SELECT book, page_no, line_no, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')) AS normalized FROM lines",
    "x2_words": rf"""WITH {LINES_SQL} SELECT book, page_no, word, count(*) AS n FROM (SELECT book, page_no,
unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+')) AS word FROM lines) WHERE length(word) >= 4 GROUP BY ALL""",
    "x9_page_numbers": f"""WITH {LINES_SQL}, h AS (SELECT *, '– ' || (line_no * 7 % 11000) || ' –' AS b, page_no || ' ' || {_FIRST(3)} AS hd, {_FIRST(7)} || ' ' || page_no AS tl FROM lines)
SELECT book, page_no, line_no, {_NUM.format("text")} AS own, {_NUM.format("b")} AS bare, {_sql_header("hd")} AS head, {_sql_header("tl")} AS tail FROM h""",
    "x12_names": rf"""WITH {LINES_SQL} SELECT book, page_no, line_no,
trim(left(trim(regexp_replace(regexp_replace(' . ' || text || '/:x', '[/:\\?*|"<>\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), 80), '. ') AS safe,
trim('  ' || text) AS title, {_ESCAPED.format("text")} AS escaped, replace({_ESCAPED.format("('--' || text)")}, '--', '- -') AS comment,
CASE WHEN line_no % 2 = 0 OR text = '' THEN 'directory' ELSE text END AS shown,
CASE WHEN {_ENDS.format(_HEAD)} THEN regexp_replace({_HEAD}, '[\p{{N}}. ]*$', '') ELSE {_HEAD} END AS entry FROM lines""",
    "x16_markers": f"""WITH {LINES_SQL}, p AS (SELECT *, {_PRINTED} AS printed FROM lines)
SELECT book, page_no, line_no, '@@SEITE ' || line_no || coalesce(' S' || printed, '') || '@@' AS marker,
coalesce('<!-- Seite ' || printed || ', Scan ' || line_no || ' -->', '<!-- Seite ' || line_no || ' -->') AS comment,
coalesce('<!-- Seite ' || printed || ', Scan ' || line_no || ' -->', '<!-- Seite ' || line_no || ' -->') || ' <!-- ' || text || ' -->' AS restored FROM p""",
    "f7_list_pages": f"""WITH {LINES_SQL}, p AS (SELECT book, page_no, count(*) AS n_lines, count(*) FILTER (WHERE {_STARTS.format("text")} OR {_ENDS.format("text")}) AS numbered FROM lines GROUP BY ALL)
SELECT *, n_lines >= 4 AND 5 * numbered >= 2 * n_lines AS is_list FROM p""",
    "f9_line_kinds": rf"""WITH {LINES_SQL} SELECT book, page_no, line_no, {_STARTS.format("text")} AS starts, {_ENDS.format("text")} AS ends, {_sql_caps("text")} AS caps,
{_sql_caps("upper(text)")} AS upper_caps, regexp_matches(text, '{X.FOOTNOTE_MARKER}') AS mark,
regexp_matches(lower(text), '{"|".join(X.PUBLISHER_WORDS)}') OR regexp_matches(lower(text), '\b(1[5-9]|20)[0-9][0-9]\b') OR {_COUNT.format("text", r"\p{L}")} < 2 AS excluded FROM lines""",
    "f13_continues": rf"""WITH {LINES_SQL}, p AS (SELECT *, lag(text) OVER (PARTITION BY book, page_no ORDER BY line_no) AS previous FROM lines)
SELECT book, page_no, line_no, regexp_matches(previous, '[{X.HYPHENS}]$') OR (NOT regexp_matches(previous, '{X.ENDS_SENTENCE.replace("'", "''")}') AND regexp_matches(text, '^\p{{Ll}}')) AS continued FROM p WHERE previous IS NOT NULL""",
    "s12_natural_order": """SELECT p_brand AS folder, 'Part ' || p_partkey || '.png' AS name, 'part ' || lpad(CAST(p_partkey AS VARCHAR), 19, '0') || '.png' AS sort_key,
CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS place FROM part""",
}
