"""Quality rules, line first: every line is judged on its own, failing lines go, then documents that lost too much go.

Line rules, on a line's text without surrounding word separators; lines without a word are neither kept nor counted:

- punctuation: the line must hold ``TERMINAL`` punctuation as its last character, closing quotes or brackets aside, and
  at most ``MAX_SYMBOL_PERCENT`` ``SYMBOLS`` per 100 words;
- navigation: at least ``MIN_SEPARATORS`` menu separators make it a menu;
- boilerplate: it holds one of the ``BOILERPLATE`` phrases (A-Z compared without case).

A document is kept if the base rules pass and the lines that stay hold at least ``MIN_KEPT_PERCENT`` percent of its
words. Null or empty text: no words, all counts zero, ``base_failed`` true. Repeated rows are judged alike, one result
each; other input columns are ignored by ``judge_lines`` and carried by ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import WORD_PATTERN, WORD_SPACE, map_columns, map_rows, named, table, with_length

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?…:;"
CLOSING = "\"'”’»)]"
SEPARATORS = "|»›•"
MIN_SEPARATORS = 2
MAX_SYMBOL_PERCENT = 30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
BOILERPLATE = (
    "lorem ipsum",
    "javascript",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "click here",
    "read more",
    "sign up for",
    "subscribe to our",
    "share on facebook",
    "alle rechte vorbehalten",
    "cookie-richtlinie",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "hier klicken",
    "newsletter abonnieren",
    "tous droits réservés",
    "politique de confidentialité",
    "politique de cookies",
    "mentions légales",
    "cliquez ici",
    "todos los derechos reservados",
    "política de privacidad",
    "política de cookies",
    "términos de uso",
    "haga clic aquí",
)

_TO_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line of ``n_words`` words, at least one, breaks a rule."""
    core = line.strip(WORD_SPACE).rstrip(CLOSING)
    if not core or core[-1] not in TERMINAL:
        return True
    if 100 * sum(map(line.count, SYMBOLS)) > MAX_SYMBOL_PERCENT * n_words:
        return True
    if sum(map(line.count, SEPARATORS)) >= MIN_SEPARATORS:
        return True
    low = line.lower() if line.isascii() else line.translate(_TO_LOWER)
    return any(p in low for p in BOILERPLATE)


def repeated_words(words: list) -> int:
    """Words covered by a three-word window that the text holds at least twice."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen: set = set()
    twice = {g for g in grams if g in seen or seen.add(g)}
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def judge_text(text: str | None) -> dict:
    """All figures of one text, and the text of the lines that stay."""
    text = text or ""
    words, stay, kept_words, dups, seen = [], [], 0, 0, set()
    for line in text.split("\n"):
        inside = line.encode().split()  # bytes split at exactly the word separators
        if not inside:
            continue
        words += inside
        dups += line in seen
        seen.add(line)
        if not line_fails(line, len(inside)):
            stay.append(line)
            kept_words += len(inside)
    n, repeats = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, WORD_SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dups,
        "n_repeat_words": repeats,
        "kept_words": kept_words,
        "base_failed": failed,
        "kept": not failed and 100 * kept_words >= MIN_KEPT_PERCENT * n,
        "clean_text": "\n".join(stay),
    }


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words")
_VERDICTS = ("base_failed", "kept")


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the figures, ``base_failed``, ``kept`` and ``clean_text``. A narrow step, no shuffle."""
    kinds = [("doc_id", pa.int64()), *((c, pa.int64()) for c in _FIGURES), *((c, pa.bool_()) for c in _VERDICTS), ("clean_text", pa.string())]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [judge_text(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], **{c: [x[c] for x in found] for c, _ in kinds[1:]}}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _FIGURES) + ", base_failed boolean, kept boolean, clean_text string"
    return map_rows(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")), run, schema, pa.schema(kinds))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, their failing lines removed; the columns are those of ``docs``, ``n_chars`` following the text."""
    texts = docs.withColumn("text", F.col("text").cast("string"))
    index = docs.columns.index("text")

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        found = [judge_text(t) for t in arrays[index].to_pylist()]
        stay = pa.array([i for i, x in enumerate(found) if x["kept"]], pa.int64())
        columns = [c.take(stay) for c in arrays]
        columns[index] = pa.array([x["clean_text"] for x in found if x["kept"]], pa.string())
        return columns

    return with_length(map_columns(texts, run, texts.schema), docs)


def op8_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all of ``documents``."""
    return judge_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINE = f"trim(line, {_SPACE})"
_CORE = f"rtrim({_LINE}, {_sql_text(CLOSING)})"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD_PATTERN}') AS ws FROM d),
g AS (SELECT r, i, (ws[i], ws[i + 1], ws[i + 2]) AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, line, len(regexp_extract_all(line, '{WORD_PATTERN}')) AS n
          FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
             sum(CASE WHEN {_CORE} = '' OR NOT contains({_sql_text(TERMINAL)}, right({_CORE}, 1))
                        OR 100 * (len(line) - len(translate(line, {_sql_text(SYMBOLS)}, ''))) > {MAX_SYMBOL_PERCENT} * n
                        OR len(line) - len(translate(line, {_sql_text(SEPARATORS)}, '')) >= {MIN_SEPARATORS}
                        OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          {_sql_text("|".join(BOILERPLATE))})
                      THEN 0 ELSE n END) AS kept_words
      FROM lines WHERE n > 0 GROUP BY r),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(text) - len(translate(text, {_sql_text(SYMBOLS)}, '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
      FROM w LEFT JOIN l USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * kept_words >= {MIN_KEPT_PERCENT} * n_words AS kept
FROM f
"""

QUERIES = {"op8_line_cleaning": op8_line_cleaning}
SQL = {"op8_line_cleaning": ORACLE}
