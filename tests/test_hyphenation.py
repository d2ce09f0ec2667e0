"""Joining lines by a dictionary table against the word list that travels with the function."""

import random
import time

from folio.operators import hyphenation as H

PIECES = ["Wör", "ter", "ter-", "Haus", "UN-", "TER", "und", "und mehr", "(1)", "a", "ab", "re-", "fe-rent", "ex-tra", "ein-und", "Desk-View", "Ende.", "x1", "mit-machen", "mitmachen", "wörter", "Territo", "riums", "2 b", "-", "‐"]
WORDS = ["Wörter", "wörter", "mit", "machen", "mitmachen", "extra", "Territoriums", "haus", "ab", "referent", "terter", "Unter"]


def random_lines(rng):
    return [" ".join(rng.choice(PIECES) for _ in range(rng.choice([1, 1, 2, 3]))) + rng.choice(["", "", "-", "‐"]) for _ in range(rng.randrange(0, 9))]


def test_every_word_that_is_looked_up_was_asked_for():
    rng = random.Random(5)
    for _ in range(4000):
        texts = random_lines(rng)
        listed = H.word_test(rng.sample(WORDS, 6))
        seen = set()
        H.join_lines(texts, lambda w: seen.add(w) or listed(w))  # noqa: B023
        assert {w for w in seen if listed(w)} <= H.asked_words(texts), texts


def test_dictionary_table_gives_what_a_word_list_gives(spark):
    rng = random.Random(9)
    pages = [(i // 5, i % 5, random_lines(rng)) for i in range(300)]
    df = spark.createDataFrame(pages, "book long, page_no int, texts array<string>")
    table = spark.createDataFrame([(w,) for w in [*WORDS, *WORDS, None, ""]], "word string")
    got = {(r.book, r.page_no): r.text for r in H.joined_by_dictionary(df, table).collect()}
    knows = H.word_test(WORDS)
    assert got == {(b, p): H.join_lines(texts, knows) for b, p, texts in pages}
    none = {(r.book, r.page_no): r.text for r in H.joined_by_dictionary(df, table.where("false")).collect()}
    assert none == {(b, p): H.join_lines(texts, lambda w: False) for b, p, texts in pages}


def test_a_long_paragraph_is_joined_in_linear_time():
    lines = ["ein Absatz ohne Ende, dessen Zeilen alle klein beginnen und"] * 8000
    for knows in (None, H.word_test(["ende"])):
        began = time.process_time()
        assert H.join_lines(lines, knows) == " ".join(lines)
        assert time.process_time() - began < 5
