"""Queries go through the given tables no more often than they need to, with results as before."""

import pytest
from pyspark.sql import functions as F

from folio.operators import hyphenation, similarity, structure, titles

COVER = "book long, page_no int, line_no int, text string, conf_pct int, cw_mil int, mid_mil int"


@pytest.fixture
def given(spark, tmp_path):
    rows = [(i, " ".join(f"Wort{(i * k) % 37} des Textes" for k in range(1, 200 + i)), "de", "web") for i in range(8)]
    spark.createDataFrame([*rows, (8, "", "de", "web"), (9, None, "de", "web")], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("query", [titles.d8_titles, titles.d10_effective_titles, titles.j5_recurring_lines, similarity.j6_duplicate_pages, similarity.a10_page_keys, structure.d5_page_blocks])
def test_one_pass(spark, given, query):
    df = query(spark, given)
    assert scans(df) == 1
    df.collect()


def test_cover_of_few_lines_and_books_without_one(spark):
    rows = [
        (1, 0, 0, "Das große Buch", 90, 24, 900), (1, 0, 1, "Reihe am Fluss", 90, 12, 800), (1, 3, 90, "REIHE am Fluss!", 40, 12, 900), (1, 7, 200, "Das große Buch", 90, 12, 900),
        (2, 1, 30, "nur eine spätere Seite", 90, 12, 900), (3, 0, 0, "unsichere Zeile", 10, 24, 900),
    ]
    df = spark.createDataFrame(rows, COVER)
    found = {(r.book, r.line_no): (r.recurs, r.quarter) for r in titles.cover_lines(df).collect()}
    assert found == {(1, 0): (False, 12), (1, 1): (True, 12)}
    assert {r.book: r.title for r in titles.all_titles(df).collect()} == {1: "Das große Buch – Reihe am Fluss", 2: None, 3: None}
    assert [r.book for r in titles.suggested_titles(df).collect()] == [1]


def test_keys_of_pages_without_any(spark):
    rows = [(1, 0, "Eine lange Zeile", 90), (1, 0, "eine LANGE Zeile!", 50), (1, 0, "Eine andere Zeile", 49), (1, 1, "kurz", 90), (1, 2, None, None)]
    keys = similarity.page_keys(spark.createDataFrame(rows, "book long, page_no int, text string, conf_pct int"))
    assert {r.page_no: r["keys"] for r in keys.collect()} == {0: ["eine lange zeile"], 1: [], 2: []}
    assert keys.where(F.col("keys").isNull()).count() == 0


def test_edges_of_pages_of_any_length(spark):
    """Left and right edge are the lines at a tenth and at nine tenths of a page, in order."""
    rows = [(1, n, i, f"Zeile {i} der Seite", 0.9, float((i * 7) % n * 10), 100.0, 20.0, 900.0 - i) for n in (1, 2, 9, 10, 11, 19, 20, 30, 31, 100) for i in range(n)]
    df = spark.createDataFrame(rows, "book long, page_no int, line_no int, text string, confidence double, x_mil double, w_mil double, h_mil double, mid_mil double")
    found = structure.page_lines(df, by_book=False)
    assert not [f for f in found.schema if f.dataType.typeName() == "array"]
    for r in found.select("page_no", "lines", "left", "right").distinct().collect():
        xs = sorted(x[5] for x in rows if x[1] == r.page_no)
        assert (r.lines, r.left, r.right) == (len(xs), xs[len(xs) // 10], xs[min(len(xs) - 1, len(xs) * 9 // 10)] + 100)


def test_titles_are_looked_up_without_texts(spark):
    """What is dealt out to find contents titles holds digests; the rows that wait for it have no texts of their neighbours yet."""
    rows = [(1, 0, i, t, 0.9, 100.0, 400.0, 20.0, 900.0 - 30 * i) for i, t in enumerate(["Das Haus", "am See", "ein Satz ohne Titel", "Das Haus am See"])]
    df = spark.createDataFrame(rows, "book long, page_no int, line_no int, text string, confidence double, x_mil double, w_mil double, h_mil double, mid_mil double")
    listed = spark.createDataFrame([(1, "das haus am see"), (2, "ein satz ohne titel")], "book long, title string")
    lines = structure.keyed(structure.page_lines(df))
    assert not {"prev_text", "next_text"} & set(lines.columns)
    found = {r.line_no: (r.in_toc, r.pair_in_toc) for r in structure.with_contents(lines, listed).collect()}
    assert found == {0: (False, True), 1: (False, False), 2: (False, False), 3: (True, True)}


def test_shared_words_compare_only_what_is_not_equal(spark):
    a, b = ["haus", "garten", "gartem", "wanderer", "", None, "ufer"], ["haus", "garten", "wandrerer", "ufern", "", None, "boot", "segel", "fluss"]
    df = similarity.shared_words(spark.createDataFrame([(1, 0, a, b), (1, 1, [], b)], "book long, page_no int, a array<string>, b array<string>"))
    assert [tuple(r) for r in df.orderBy("page_no").collect()] == [(1, 0, 7, 4), (1, 1, 0, 0)]
    assert scans(df) == 3


def test_written_once(spark, given):
    """Lines and pages that are read several times are not made anew of the documents."""
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lang#")
    for query in (similarity.j3_toc_matches, similarity.j7_shared_words):
        assert read(query(spark, given)) == 0
    pages = spark.read.parquet(f"{given}/documents.parquet").where("text <> ''").select(F.col("doc_id").alias("book"), F.lit(0).alias("page_no"), F.array("text", "text").alias("texts"), "lang")
    found = hyphenation.joined_by_dictionary(pages, spark.createDataFrame([("Wort",)], "word string"))
    assert read(found) == 0 and found.count() == 8
