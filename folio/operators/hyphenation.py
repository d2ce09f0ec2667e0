"""Lines of one paragraph joined to running text, with hyphens resolved by an optional word list."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import CONJUNCTIONS, HYPHENS
from folio.sources.tables import LINES_SQL, kept, lines, table

_HEAD = re.compile(r"[^\W\d_]*$")
_TAIL = re.compile(r"^[^\W\d_]*")
_INLINE = re.compile(r"([^\W\d_]{2,})-([^\W\d_]{2,})")


def word_test(words: Iterable[str] | None) -> Callable[[str], bool] | None:
    """Whether a word, its lower-case or its capitalised form is listed; None stands for no word list."""
    if words is None:
        return None
    listed = frozenset(words)
    return lambda w: w in listed or w.lower() in listed or w[:1].upper() + w[1:].lower() in listed


def _head(text: str) -> str:
    """The letters at a text's end, looked for from there, as the text may be long."""
    reach = 64
    while True:
        start = max(0, len(text) - reach)
        found = _HEAD.search(text, start)
        if found.start() > start or not start:
            return found[0]
        reach *= 4


def _capitals(text: str) -> bool:
    letters = [c for c in (text.rsplit(maxsplit=1) or [text])[-1] if c.isalpha()]
    return len(letters) >= 2 and all(c.isupper() for c in letters)


def join_lines(texts: Iterable[str], knows: Callable[[str], bool] | None = None) -> str:
    """One text from lines; each seam is judged by what stands before and after it."""
    out = ""
    for line in (t.strip(" \t") for t in texts):
        if out and line:
            out = out + line if not _spaced(out, line, knows) else _seam(out, line, knows)
        else:
            out = out or line
    return _without_inline_hyphens(out, knows) if knows and "-" in out else out


def _spaced(out: str, line: str, knows: Callable | None) -> bool:
    """False where the texts are set together as they stand."""
    tail = _TAIL.match(line)[0]
    if out[-1] in HYPHENS:
        return not tail or knows is not None
    if knows is None or len(tail) < 2 or not line[0].islower():
        return True
    head = _head(out)
    return not (len(head) >= 2 and not knows(head) and not knows(tail) and knows(head + tail))


def _seam(out: str, line: str, knows: Callable | None) -> str:
    tail = _TAIL.match(line)[0]
    if out[-1] not in HYPHENS or not tail:
        return f"{out} {line}"
    if line[0].isupper():
        return out[:-1] + line if _capitals(out[:-1]) and _capitals(tail) else out + line
    return f"{out} {line}" if tail.lower() in CONJUNCTIONS else out[:-1] + line


def _without_inline_hyphens(text: str, knows: Callable[[str], bool]) -> str:
    """Hyphens inside a line go if the whole is a word, or the parts are no two words of four letters or more."""

    def mend(m: re.Match) -> str:
        stem, tail = m[1], m[2]
        if not tail[0].islower() or tail.lower() in CONJUNCTIONS:
            return m[0]
        parts = len(stem) >= 4 and len(tail) >= 4 and knows(stem) and knows(tail)
        return m[0] if parts and not knows(stem + tail) else stem + tail

    return _INLINE.sub(mend, text)


def joined(texts: Column, words: Iterable[str] | None = None) -> Column:
    """``join_lines`` over a column of line arrays; the word list travels with the function."""
    listed = None if words is None else frozenset(words)

    @F.pandas_udf(T.StringType())
    def run(batch: pd.Series) -> pd.Series:
        knows = word_test(listed)
        return batch.map(lambda x: join_lines(x, knows))

    return run(texts)


def _ends(lines: list[str]) -> tuple[list[list[str]], list[list[str]]]:
    """By line, the words that may stand at the end of the text that ends with it, and at the head of the text that begins with it.

    A line that is one word may go on the word before it and be gone on by the next line.
    """
    heads: list[list[str]] = []
    for line in lines:
        bare = line[:-1] if line[-1] in HYPHENS else line
        word = _HEAD.search(bare)[0]
        heads.append([word, *(h + word for h in (heads[-1] if heads and word == bare else ()))])
    tails: list[list[str]] = []
    for line in reversed(lines):
        bare = line[:-1] if line[-1] in HYPHENS else line
        word = _TAIL.match(line)[0]
        tails.append([word, *(word + t for t in (tails[-1] if tails and word == bare else ()))])
    return heads, tails[::-1]


def asked_words(texts: Iterable[str]) -> set[str]:
    """All words that ``join_lines`` may look up, whatever it gets to know."""
    lines = [t for t in (t.strip(" \t") for t in texts) if t]
    heads, tails = _ends(lines)
    found: set[str] = set()
    for i, line in enumerate(lines):
        if i and line[0].islower() and lines[i - 1][-1] not in HYPHENS:
            tail = _TAIL.match(line)[0]
            for head in heads[i - 1]:
                found |= {head, tail, head + tail}
        if "-" in line:
            for before in ["", *(heads[i - 1] if i else ())]:
                for after in ["", *(tails[i + 1] if i + 1 < len(lines) else ())]:
                    whole = before + (line[:-1] if after and line[-1] in HYPHENS else line) + after
                    for stem, tail in _INLINE.findall(whole):
                        found |= {stem, tail, stem + tail}
    return {w for w in found if len(w) > 1}


def joined_by_dictionary(pages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(book, page_no, text) of pages (book, page_no, texts) by a table of words (word) of any size.

    The words that a page's seams and inner hyphens ask for are looked up by a join, in three spellings: as they stand, in
    small letters, and with a capital, each word once for all pages. What the dictionary knows of them goes back to the page,
    whose lines are then joined. Pages and their words are written down, as they are read three times.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def asked(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: sorted(asked_words(x)))

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([join_lines(x, frozenset(k).__contains__) for x, k in zip(texts, known, strict=True)], dtype=object)

    pages = kept(pages.select("book", "page_no", "texts", asked("texts").alias("asked")))
    words = pages.select("book", "page_no", F.explode("asked").alias("asked"))
    low = F.lower("asked")
    spellings = F.array_distinct(F.array("asked", low, F.concat(F.upper(F.substring(low, F.lit(1), F.lit(1))), F.substring(low, F.lit(2), F.length(low)))))
    listed = words.select("asked").distinct().withColumn("word", F.explode(spellings)).join(dictionary.select("word"), "word", "left_semi").select("asked").distinct()
    known = words.join(listed, "asked", "left_semi").groupBy("book", "page_no").agg(F.collect_set("asked").alias("known"))
    none = F.array().cast("array<string>")
    return pages.join(known, ["book", "page_no"], "left").select("book", "page_no", run("texts", F.coalesce("known", none)).alias("text"))


def c8_joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's lines as one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    pages = lines(spark, sf_dir).groupBy("book", "page_no").agg(ordered.alias("texts"))
    return pages.select("book", "page_no", joined(F.col("texts")).alias("text"))


#: Words of the query below; the hyphens it resolves stand at line ends, where listed words alone keep a compound apart.
LISTED = frozenset(CONJUNCTIONS)


def hyphenated_lines(rows: DataFrame) -> DataFrame:
    """The lines with a long last word of small letters broken after three of them, its rest at the head of the next line."""
    page = Window.partitionBy("book", "page_no").orderBy("line_no")
    end = F.regexp_extract("text", r"(?:^|\s)(\p{Ll}{6,})$", 1)
    rest = F.substring(end, F.lit(4), F.length(end))
    broken = (end != "") & F.lead("line_no").over(page).isNotNull() & ~rest.isin(*CONJUNCTIONS)
    rows = rows.withColumn("rest", F.when(broken, rest))
    cut = F.when(F.col("rest").isNotNull(), F.concat(F.substring("text", F.lit(1), F.length("text") - F.length("rest")), F.lit("-"))).otherwise(F.col("text"))
    before = F.lag("rest").over(page)
    return rows.select("book", "page_no", "line_no", F.concat_ws(" ", before, cut).alias("text"))


def x5_dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose lines were broken inside words, as running text by a word list: each word is whole again."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    pages = hyphenated_lines(lines(spark, sf_dir)).groupBy("book", "page_no").agg(ordered.alias("texts"))
    broken = F.size(F.filter("texts", lambda t: F.endswith(t, F.lit("-")))).cast("long")
    return pages.select("book", "page_no", joined(F.col("texts"), LISTED).alias("text"), broken.alias("broken"))


#: How a line ends, by (book * 3 + line_no) % 9: the last word broken with a hyphen, without one, with U+2010, in capitals; a
#: compound; a conjunction; a bracket; a hyphen inside the last word; as it is.
_BREAKS = {0: "-", 1: "", 2: "\u2010", 3: "-"}
_NEXT = {4: "Haus ", 5: "und ", 6: "(1) "}


def broken_lines(rows: DataFrame) -> DataFrame:
    """The lines with ends of all kinds."""
    page = Window.partitionBy("book", "page_no").orderBy("line_no")
    kind = F.when(F.lead("line_no").over(page).isNotNull(), F.pmod(F.col("book") * 3 + F.col("line_no"), F.lit(9))).otherwise(8)
    word = F.regexp_extract("text", r"(?:^|\s)(\p{L}{6,})$", 1)
    rows = rows.withColumn("kind", F.when((word == "") & ((kind < 4) | (kind == 7)) | (kind == 3) & F.contains(word, F.lit("ß")), 8).otherwise(kind)).withColumn("word", word)
    head, rest = F.substring("word", F.lit(1), F.lit(3)), F.substring("word", F.lit(4), F.length("word"))
    stem = F.substring("text", F.lit(1), F.length("text") - F.length("word"))
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in _BREAKS.items() for x in kv]), F.col("kind").cast("int"))
    ends = (
        F.when(F.col("kind") == 3, F.concat(stem, F.upper(head), mark)).when(F.col("kind") < 3, F.concat(stem, head, mark)).when(F.col("kind") == 4, F.concat("text", F.lit(" Vor-")))
        .when(F.col("kind") == 5, F.concat("text", F.lit(" Ein-"))).when(F.col("kind") == 6, F.concat("text", F.lit(" Teil-"))).when(F.col("kind") == 7, F.concat(stem, head, F.lit("-"), rest)).otherwise(F.col("text"))
    )
    following = F.when(F.col("kind") == 3, F.concat(F.upper(rest), F.lit(" "))).when(F.col("kind") < 3, F.concat(rest, F.lit(" "))).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in _NEXT.items() for x in kv]), F.col("kind").cast("int")))
    rows = rows.withColumn("ends", ends).withColumn("following", following)
    return rows.select("book", "page_no", "line_no", F.concat(F.coalesce(F.lag("following").over(page), F.lit("")), "ends").alias("text"))


def x6_dictionary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with line ends of all kinds as running text, by a dictionary made of two thirds of the documents' words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("length(word) > 1 AND (length(word) + ascii(word)) % 3 <> 0").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    pages = broken_lines(lines(spark, sf_dir)).groupBy("book", "page_no").agg(ordered.alias("texts"))
    return joined_by_dictionary(pages, words)


_KNOWN = "({0} <> '' AND EXISTS (SELECT 1 FROM dict WHERE dict.word = lower({0})))"
_INNER = r"(\p{L}{2,})-(\p{Ll}\p{L}+)"
_BROKEN_SQL = rf"""k0 AS (SELECT *, CASE WHEN lead(line_no) OVER (PARTITION BY book, page_no ORDER BY line_no) IS NULL THEN 8 ELSE (book * 3 + line_no) % 9 END AS k, regexp_extract(text, '(?:^|\s)(\p{{L}}{{6,}})$', 1) AS word FROM lines),
k1 AS (SELECT book, page_no, line_no, text, word, CASE WHEN word = '' AND (k < 4 OR k = 7) OR k = 3 AND contains(word, 'ß') THEN 8 ELSE k END AS kind, word[1:3] AS head, word[4:] AS rest, left(text, length(text) - length(word)) AS stem FROM k0),
k2 AS (SELECT *, CASE kind WHEN 0 THEN stem || head || '-' WHEN 1 THEN stem || head WHEN 2 THEN stem || head || chr(8208) WHEN 3 THEN stem || upper(head) || '-' WHEN 4 THEN text || ' Vor-' WHEN 5 THEN text || ' Ein-'
             WHEN 6 THEN text || ' Teil-' WHEN 7 THEN stem || head || '-' || rest ELSE text END AS ends,
             CASE WHEN kind < 3 THEN rest || ' ' WHEN kind = 3 THEN upper(rest) || ' ' WHEN kind = 4 THEN 'Haus ' WHEN kind = 5 THEN 'und ' WHEN kind = 6 THEN '(1) ' END AS following FROM k1),
br AS (SELECT book, page_no, row_number() OVER w AS i, trim(coalesce(lag(following) OVER w, '') || ends, ' ' || chr(9)) AS line FROM k2 WINDOW w AS (PARTITION BY book, page_no ORDER BY line_no))"""

QUERIES = {"c8_joined_pages": c8_joined_pages, "x5_dehyphenated": x5_dehyphenated, "x6_dictionary_pages": x6_dictionary_pages}
SQL = {
    "x6_dictionary_pages": rf"""WITH RECURSIVE {LINES_SQL}, {_BROKEN_SQL},
dict AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS word FROM documents) WHERE length(word) > 1 AND (length(word) + ascii(word)) % 3 <> 0),
sm AS (SELECT *, regexp_extract(line, '^\p{{L}}*') AS tail, regexp_matches(line, '^\p{{Ll}}') AS low, regexp_matches(line, '^\p{{Lu}}') AS cap FROM br),
jo AS (SELECT book, page_no, i, line AS t FROM sm WHERE i = 1
 UNION ALL
 SELECT book, page_no, i, CASE WHEN hy AND tail = '' THEN t || ' ' || line WHEN hy AND cap AND caps THEN t[1:-2] || line WHEN hy AND cap THEN t || line
        WHEN hy AND lower(tail) IN ({", ".join(f"'{c}'" for c in CONJUNCTIONS)}) THEN t || ' ' || line WHEN hy THEN t[1:-2] || line
        WHEN low AND length(head) >= 2 AND length(tail) >= 2 AND NOT {_KNOWN.format("head")} AND NOT {_KNOWN.format("tail")} AND {_KNOWN.format("whole")} THEN t || line ELSE t || ' ' || line END
 FROM (SELECT sm.*, jo.t, right(jo.t, 1) IN ('-', chr(8208)) AS hy, regexp_extract(jo.t, '\p{{L}}*$') AS head, regexp_extract(jo.t, '\p{{L}}*$') || sm.tail AS whole,
              regexp_matches(jo.t, '(^|\s)[^\s\p{{Ll}}]*\p{{Lu}}[^\s\p{{Ll}}]*\p{{Lu}}[^\s\p{{Ll}}]*.$') AND regexp_matches(sm.tail, '^\p{{Lu}}{{2,}}$') AS caps
       FROM jo JOIN sm ON sm.book = jo.book AND sm.page_no = jo.page_no AND sm.i = jo.i + 1)),
wh AS (SELECT book, page_no, t FROM jo QUALIFY row_number() OVER (PARTITION BY book, page_no ORDER BY i DESC) = 1),
pc AS (SELECT book, page_no, unnest(range(1, len(gaps) + 1)) AS k, gaps, found FROM (SELECT *, regexp_split_to_array(t, '{_INNER}') AS gaps, regexp_extract_all(t, '{_INNER}') AS found FROM wh)),
pm AS (SELECT book, page_no, k, gaps[k] AS gap, coalesce(found[k], '') AS m, regexp_extract(coalesce(found[k], ''), '{_INNER}', 1) AS stem, regexp_extract(coalesce(found[k], ''), '{_INNER}', 2) AS tail FROM pc),
pr AS (SELECT *, stem || tail AS whole FROM pm)
SELECT book, page_no, string_agg(gap || CASE WHEN m = '' OR lower(tail) IN ({", ".join(f"'{c}'" for c in CONJUNCTIONS)}) THEN m WHEN {_KNOWN.format("whole")} THEN whole
 WHEN length(stem) < 4 OR length(tail) < 4 OR NOT {_KNOWN.format("stem")} OR NOT {_KNOWN.format("tail")} THEN whole ELSE m END, '' ORDER BY k) AS text FROM pr GROUP BY ALL""",
    "c8_joined_pages": f"WITH {LINES_SQL} SELECT book, page_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY ALL",
    "x5_dehyphenated": rf"""WITH {LINES_SQL}, e AS (SELECT *, regexp_extract(text, '(?:^|\s)(\p{{Ll}}{{6,}})$', 1) AS word, lead(line_no) OVER (PARTITION BY book, page_no ORDER BY line_no) AS after FROM lines)
SELECT book, page_no, string_agg(text, ' ' ORDER BY line_no) AS text,
count(*) FILTER (WHERE right(text, 1) = '-' OR word <> '' AND after IS NOT NULL AND word[4:] NOT IN ({", ".join(f"'{c}'" for c in CONJUNCTIONS)})) AS broken FROM e GROUP BY ALL""",
}
