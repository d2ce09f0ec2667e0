"""Composed texts and characters as a reader counts them, against Python's own tables."""

import random
import unicodedata

import regex
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import typography as T

POOL = "aAä ẹ\u0301\u0323\u0308\u200d\U0001f468\U0001f469\U0001f467\U0001f3fd\U0001f1e9\U0001f1ea\u1100\u1161\u11a8각\r\n:\ufe0f\u2764"


def test_characters_and_composition_equal_plain_counts(spark):
    rnd = random.Random(3)
    texts = ["", "plain", "u\u0308ber", "\r\n", None, *("".join(rnd.choice(POOL) for _ in range(rnd.randrange(12))) for _ in range(2000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", X.characters(F.col("t")).alias("n"), X.composed(F.col("t")).alias("c")).collect()
    for r in rows:
        assert (r.n, r.c) == ((None, None) if r.t is None else (len(regex.findall(r"\X", r.t)), unicodedata.normalize("NFC", r.t)))


def test_words_and_capitals_count_characters(spark):
    df = spark.createDataFrame([("e\u0301\u0323a\u0323b c\u0323d\u0323e\u0323f\u0323 abcd",), ("ẠB\u0323C\u0323D\u0323",)], "t string")
    words, caps = df.select(X.snapshot_words(F.col("t")).alias("w"), X.is_all_caps(F.col("t")).alias("c")).collect()
    assert words.w == ["c\u0323d\u0323e\u0323f\u0323", "abcd"] and caps.c


def test_listed_lines_go_by_place_not_by_number(spark):
    rows = spark.createDataFrame([(1, 0, 2 * i + 7, f"z{i}", 12, 80) for i in range(57)] + [(1, 1, 1, "x", 12, 40)], "book long, page_no int, line_no int, text string, cw_mil int, conf_pct int")
    assert [r.text for r in T.listed_lines(rows).where("page_no = 0").orderBy("line_no").collect()] == [f"z{i}" for i in range(40)]
    assert [(r.n_lines, r.listed, r.uncertain) for r in T.quality(rows).orderBy("page_no").collect()] == [(57, 40, 0), (1, 1, 1)]


def test_capitals_are_one_character_each(spark):
    df = spark.createDataFrame([("straße ŉ ᾳ äé", "geschßä%%% au.&&&")], "t string, s string")
    row = df.select(X.capitals(F.col("t")).alias("t"), X.capitals(F.col("s")).alias("s"), X.is_all_caps(X.capitals(F.lit("ößß.$$$ b###"))).alias("c")).first()
    assert (row.t, row.s) == ("STRAẞE ŉ ᾼ ÄÉ", "GESCHẞÄ%%% AU.&&&")
    assert not row.c
