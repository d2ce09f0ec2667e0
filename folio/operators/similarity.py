"""Pages compared by their lines and words: duplicate scans, shared words, contents titles, the same-page judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from itertools import pairwise
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.arrays import gathered, let, parts
from folio.functions.images import changed_share, square
from folio.functions.text import TOC_HEADINGS, ends_with_number, normalized, snapshot_words, starts_with_number, without_toc_numbers
from folio.operators.predicates import _ENDS, _STARTS
from folio.schema import Duplicate, SamePage
from folio.sources.tables import LINES_SQL, kept, lines, pages


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def page_keys(rows: DataFrame, rule: Duplicate = Duplicate()) -> DataFrame:
    """Per page the distinct normalised lines of enough confidence and length."""
    rows = rows.select("book", "page_no", F.when(F.col("conf_pct") >= 50, normalized(F.col("text"))).alias("key"))
    return rows.groupBy("book", "page_no").agg(F.collect_set(F.when(F.length("key") >= rule.key_length, F.col("key"))).alias("keys"))


def near_pages(keys: DataFrame, rule: Duplicate = Duplicate()) -> DataFrame:
    """(book, page_no, earlier, similarity) for pages with enough keys and each of the pages shortly before."""
    pages = keys.where(F.size("keys") >= rule.least_keys)
    other = pages.select("book", F.col("page_no").alias("earlier"), F.col("keys").alias("before"))
    reach = [F.lit(i) for i in range(1, rule.window + 1)]
    spread = pages.withColumn("step", F.explode(F.array(*reach))).withColumn("earlier", F.col("page_no") - F.col("step"))
    return spread.join(other, ["book", "earlier"]).select("book", "page_no", "earlier", jaccard(F.col("keys"), F.col("before")).alias("similarity"))


_KEPT = "array<struct<page_no: int, keys: array<string>>>"
_TWINS = "array<struct<page_no: int, of: int>>"


def duplicate_pages(keys: DataFrame, rule: Duplicate = Duplicate()) -> DataFrame:
    """(book, page_no, of): pages like one of the last three kept ones; a duplicate is not kept, so this is a fold.

    The fold runs in the JVM over a book's pages as one array.
    """

    def after(state: Column, page: Column) -> Column:
        like = lambda o: F.size(F.array_intersect(o["keys"], page["keys"])) >= rule.share * F.size(F.array_union(o["keys"], page["keys"]))
        twin = F.when(F.size(page["keys"]) >= rule.least_keys, F.get(F.filter(state["kept"], like), F.lit(0))["page_no"])

        def outcome(twin: Column) -> Column:
            more = F.concat(state["kept"], F.array(page)).cast(_KEPT)
            kept = F.when(twin.isNotNull(), state["kept"]).otherwise(F.slice(more, -F.least(F.size(more), F.lit(rule.window)), rule.window))
            twins = F.concat(state["twins"], F.array(F.struct(page["page_no"].alias("page_no"), twin.alias("of"))))
            return F.struct(kept.alias("kept"), F.when(twin.isNotNull(), twins).otherwise(state["twins"]).cast(_TWINS).alias("twins"))

        return let(twin, outcome)

    start = F.struct(F.array().cast(_KEPT).alias("kept"), F.array().cast(_TWINS).alias("twins"))
    books = gathered(keys, ["book"], "page_no", "keys")
    found = F.aggregate(F.col("members").cast(_KEPT), start, after, lambda s: s["twins"])
    return books.select("book", F.explode(found).alias("x")).select("book", "x.page_no", "x.of")


def tolerance(word: Column) -> Column:
    """Edits that a misread word may have, by its length."""
    return F.when(F.length(word) >= 7, 2).when(F.length(word) >= 5, 1).otherwise(0)


def shared_words(pairs: DataFrame) -> DataFrame:
    """For (pair columns.., a, b: word arrays): total words of the shorter distinct list and how many the other holds.

    Equal words are counted in their row. The other words of five letters or more are joined on their first letter, so that only
    such words are compared, within the tolerance; shorter ones have none.
    """
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    x, y = F.array_distinct("a"), F.array_distinct("b")
    pairs = pairs.select(*keys, F.when(F.size(x) <= F.size(y), F.struct(x.alias("s"), y.alias("l"))).otherwise(F.struct(y.alias("s"), x.alias("l"))).alias("p"))
    same = F.size(F.filter(F.array_intersect("p.s", "p.l"), lambda w: w != "")).cast("long")
    rest, others = F.filter(F.array_except("p.s", "p.l"), lambda w: F.length(w) >= 5), F.filter("p.l", lambda w: F.length(w) >= 4)
    pairs = kept(pairs.select(*keys, F.size("p.s").cast("long").alias("total"), same.alias("same"), rest.alias("rest"), others.alias("others")))
    initial = F.substring("word", 1, 1)
    short = pairs.select(*keys, F.explode("rest").alias("word")).withColumn("initial", initial)
    long = pairs.where(F.size("rest") > 0).select(*keys, F.explode("others").alias("word")).withColumn("initial", initial).withColumnRenamed("word", "other")
    like = (F.abs(F.length("word") - F.length("other")) <= tolerance(F.col("word"))) & F.levenshtein("word", "other", 2).between(F.lit(0), tolerance(F.col("word")))
    found = short.join(long, [*keys, "initial"]).where(like).select(*keys, "word").distinct()
    matched = found.groupBy(*keys).agg(F.count("*").alias("near"))
    return pairs.select(*keys, "total", "same").join(matched, keys, "left").select(*keys, "total", (F.col("same") + F.coalesce("near", F.lit(0))).alias("shared"))


def toc_titles(rows: DataFrame) -> DataFrame:
    """(book, title): distinct normalised entries of pages headed as contents, or list pages of at least six lines.

    A page's lines are brought together once, for the places of its first lines and for its counts.
    """
    page = Window.partitionBy("book", "page_no")
    numbered = starts_with_number(F.col("text")) | ends_with_number(F.col("text"))
    rows = rows.where("text <> ''").select("book", "page_no", "line_no", "text", numbered.alias("numbered"))
    rows = rows.withColumn("place", F.row_number().over(page.orderBy("line_no")))
    heading = F.when(F.col("place") <= 3, normalized(F.col("text")).isin(*TOC_HEADINGS))
    rows = rows.withColumn("headed", F.max(heading).over(page)).withColumn("n", F.count("*").over(page)).withColumn("many", F.count_if("numbered").over(page))
    entries = rows.where(F.col("headed") | ((F.col("n") >= 6) & (5 * F.col("many") >= 2 * F.col("n"))))
    # Taken as an element, as a filter would make every title anew.
    title = F.array(normalized(without_toc_numbers(F.col("text"))))
    return entries.select("book", F.explode(F.filter(title, lambda t: F.length(t) >= 6)).alias("title")).distinct()


def within(a: str, b: str, edits: int) -> bool:
    """Whether so many edits make one word of the other."""
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    if not a or not b:
        return len(a) + len(b) <= edits
    return edits > 0 and (within(a[1:], b[1:], edits - 1) or within(a[1:], b, edits - 1) or within(a, b[1:], edits - 1))


def allowed_edits(word: str) -> int:
    """``tolerance`` of one word."""
    return (len(word) >= 5) + (len(word) >= 7)


#: Letters of a word that are taken as one row of an array; the few longer words are looked through one by one.
LETTERS = 32
PAIR = 37


def signs_of(words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's letters, and its pairs of neighbours, as bits; an edit takes away one letter and two pairs at most, and adds no more."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    codes = np.array(words, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS)[:, : lengths.max()].astype(np.uint64)
    place = np.arange(codes.shape[1])

    def bits(codes: np.ndarray, less: int) -> np.ndarray:
        held = place[: codes.shape[1]] < lengths[:, None] - less
        return np.bitwise_or.reduce(np.where(held, np.uint64(1) << (codes & np.uint64(63)), np.uint64(0)), axis=1)

    letters, pairs = bits(codes, 0), bits(codes[:, :-1] * np.uint64(PAIR) + codes[:, 1:], 1)
    for i in np.flatnonzero(lengths > LETTERS):
        long = list(map(ord, words[i]))
        letters[i] = reduce(or_, {1 << x % 64 for x in long})
        pairs[i] = reduce(or_, {1 << (x * PAIR + y) % 64 for x, y in pairwise(long)})
    return letters, pairs


#: Pairs of words that are compared in one step, and words at most.
PAIRS = 1 << 20
STEP = 96


class ReadWords:
    """The words read on a page; those of four letters or more also as arrays, so that few pairs are compared letter by letter."""

    def __init__(self, words: list[str]) -> None:
        self.listed = words
        self.distinct = frozenset(words)

    @cached_property
    def long(self) -> list[str]:
        """The words of four letters or more, by first letter and length."""
        return sorted((w for w in self.distinct if len(w) >= 4), key=lambda w: (w[0], len(w)))

    @cached_property
    def signs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First letters and lengths of the long words, in one number; lengths, letters and pairs of letters."""
        n = len(self.long)
        first, lengths = (np.fromiter(map(f, self.long), np.int64, n) for f in (lambda w: ord(w[0]), len))
        return (first << 32) + lengths, lengths, *signs_of(self.long, lengths)

    def likely(self, page: ReadWords, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of another page's long words, given by place, may be a misreading of which of these: pairs, by the other's."""
        kind, length, letters, pairs = (x[places] for x in page.signs)
        edits = (length >= 5).astype(np.int64) + (length >= 7)
        low, high = np.searchsorted(self.signs[0], kind - edits), np.searchsorted(self.signs[0], kind + edits, "right")
        row = np.repeat(np.arange(len(places)), high - low)
        i = np.arange(len(row)) + np.repeat(high - np.cumsum(high - low), high - low)
        apart = lambda x, y, most: (np.bitwise_count(x & ~y) <= most) & (np.bitwise_count(y & ~x) <= most)
        edits = edits[row]
        near = apart(letters[row], self.signs[2][i], edits) & apart(pairs[row], self.signs[3][i], 2 * edits)
        return row[near], i[near]


def _misses(small: ReadWords, large: ReadWords, over: Callable[[int], bool]) -> int:
    """How many of the one page's words the other neither holds nor may be a misreading of, counted until they are ``over``.

    Words that none there comes near are counted first, some at a time; the rest is compared only as far as the answer is open.
    """
    missing = small.distinct - large.distinct
    places = np.array([i for i, w in enumerate(small.long) if len(w) >= 5 and w in missing], np.int64)
    misses, step = len(missing) - len(places), min(STEP, max(1, PAIRS // max(1, len(large.long))))
    near: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(places), step):
        if over(misses):
            return misses
        part = places[at : at + step]
        row, i = large.likely(small, part)
        near.append((part[row], i))
        misses += len(part) - np.count_nonzero(np.bincount(row, minlength=len(part)))
    if over(misses):
        return misses
    others: dict[int, list[int]] = {}
    for place, i in (pair for found in near for pair in zip(*(x.tolist() for x in found), strict=True)):
        others.setdefault(place, []).append(i)
    for place, alike in others.items():
        if over(misses):
            return misses
        word = small.long[place]
        misses += not any(within(word, large.long[i], allowed_edits(word)) for i in alike)
    return misses


def _by_size(a: ReadWords, b: ReadWords) -> list[ReadWords]:
    return sorted((a, b), key=lambda page: len(page.distinct))


def word_share(a: ReadWords, b: ReadWords) -> float:
    """The part of the smaller set of words (the first if equal) that the other one holds or may be a misreading of; 0 without words."""
    small, large = _by_size(a, b)
    return 1 - _misses(small, large, lambda _: False) / len(small.distinct) if small.distinct else 0.0


def words_alike(a: ReadWords, b: ReadWords, share: float) -> bool:
    """Whether ``word_share`` is that much."""
    small, large = _by_size(a, b)
    n = len(small.distinct)
    enough = lambda misses: 1 - misses / n >= share
    if not n or enough(len(small.distinct - large.distinct)):
        return bool(n) or share <= 0
    return enough(_misses(small, large, lambda misses: not enough(misses)))


def same_page(a: ReadWords, b: ReadWords, changed: Callable[[], float], rule: SamePage = SamePage()) -> bool:
    """Many words decide alone, a few need the tiles' consent, hardly any leave it to the tiles; ``changed`` is their changed share."""
    n = min(len(a.listed), len(b.listed))
    by_words = n < rule.least_words or words_alike(a, b, rule.share)
    return by_words and (n >= rule.few_words or changed() < rule.changed_tiles)


def judge_page(known: list[tuple], words: list[str] | None, pixels: list[int] | None, rule: SamePage = SamePage()) -> tuple[bool, list[tuple]]:
    """Whether a page is new to the last ones, structs (words, frame or None), and those to remember after it."""
    here = (ReadWords(list(words or [])), square(pixels) if pixels is not None and len(pixels) else None)
    tiles = lambda frame: lambda: 1.0 if frame is None or here[1] is None else changed_share(frame, here[1])
    same = [same_page(here[0], page, tiles(frame), rule) for page, frame in known]
    if not any(same):
        return True, [*known, here][-rule.remembered :]
    return False, [*known[:-1], here] if same[-1] else known


def new_pages(snapshots: DataFrame, rule: SamePage = SamePage()) -> DataFrame:
    """(book, page_no, is_new) of snapshots (book, page_no, words[, pixels]): a page is new if it differs from the last three.

    Pixels are those of square gray frames; without them no tile is taken as unchanged. Books are dealt out and sorted, and a
    task goes through its pages with the last three in hand, so that it never holds a book.
    """
    frames = "pixels" in snapshots.columns
    kinds = pa.schema([("book", pa.int64()), ("page_no", pa.int32()), ("is_new", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, known = None, []
        for part in (p for b in batches for p in parts(b)):
            found = []
            columns = [part[c].to_pylist() for c in ("book", "page_no", "words")]
            for b, page, words, pixels in zip(*columns, part["pixels"].to_pylist() if frames else [None] * part.num_rows, strict=True):
                if b != book:
                    book, known = b, []
                is_new, known = judge_page(known, words, pixels, rule)
                found.append((b, page, is_new))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

    rows = snapshots.select(F.col("book").cast("long").alias("book"), F.col("page_no").cast("int").alias("page_no"), "words", *["pixels"] * frames)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "book").sortWithinPartitions("book", "page_no").mapInArrow(run, "book long, page_no int, is_new boolean")


def a10_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_keys(lines(spark, sf_dir)).select("book", "page_no", F.size("keys").cast("long").alias("n_keys"))


def a11_near_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pages(page_keys(lines(spark, sf_dir)))


def j6_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book with its third page from the end (the first of shorter ones) scanned again at the end.

    A scanned page's keys are those of the page, so that lines need not be read twice.
    """
    keys = page_keys(lines(spark, sf_dir))
    end = F.max("page_no").over(Window.partitionBy("book")) + 1
    again = F.col("page_no") == F.greatest(F.col("end") - 3, F.lit(0))
    places = F.when(again, F.array("page_no", "end")).otherwise(F.array("page_no"))
    return duplicate_pages(keys.withColumn("end", end).select("book", F.explode(places).alias("page_no"), "keys"))


def _page_words(rows: DataFrame) -> DataFrame:
    words = rows.select("book", "page_no", snapshot_words(F.col("text")).alias("ws"))
    return words.groupBy("book", "page_no").agg(F.sort_array(F.flatten(F.collect_list("ws"))).alias("words"))


def j7_shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words of each page and the next."""
    words = _page_words(pages(spark, sf_dir))
    order = Window.partitionBy("book").orderBy("page_no")
    pairs = words.select("book", "page_no", F.col("words").alias("a"), F.lead("words").over(order).alias("b"), F.lead("page_no").over(order).alias("next"))
    return shared_words(pairs.where(F.col("next") == F.col("page_no") + 1).drop("next"))


def c10_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pages by words of any letters; documents have no tiles, so pages of under twelve words count as new."""
    return new_pages(_page_words(pages(spark, sf_dir)))


def _contents_lines(rows: DataFrame) -> DataFrame:
    """The lines, those of each first page as contents entries with a page number."""
    entry = F.when(F.col("page_no") == 0, F.concat("text", F.lit(" "), (F.col("line_no") + 1).cast("string"))).otherwise(F.col("text"))
    return rows.withColumn("text", entry)


def d9_toc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc_titles(_contents_lines(lines(spark, sf_dir)))


def j3_toc_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose normalised text is a contents title of their book."""
    rows = kept(lines(spark, sf_dir).select("book", "page_no", "line_no", "text"))
    titles = toc_titles(_contents_lines(rows))
    return rows.withColumn("title", normalized(F.col("text"))).join(titles, ["book", "title"], "left_semi").select("book", "page_no", "line_no")


_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
_KEYS = rf"""{LINES_SQL}, kk AS (SELECT book, page_no, list(DISTINCT {_NORM.format("text")}) FILTER (WHERE conf_pct >= 50 AND length({_NORM.format("text")}) >= 12) AS ks FROM lines GROUP BY ALL),
keys AS (SELECT book, page_no, coalesce(ks, []) AS keys FROM kk)"""
_HEADINGS = ", ".join(f"'{h}'" for h in TOC_HEADINGS)
_STRIPPED = r"CASE WHEN {s} THEN regexp_replace(text, '^[\p{{N}}. ]*', '') ELSE text END".replace("{s}", _STARTS.format("text").replace("{", "{{").replace("}", "}}")).format()


def toc_sql(text: str, source: str = "lines") -> str:
    """CTEs to ``toc``, the contents titles of the lines in ``source`` that hold ``text``."""
    return rf"""cl AS (SELECT book, page_no, line_no, {text} AS text FROM {source}),
pl AS (SELECT *, row_number() OVER (PARTITION BY book, page_no ORDER BY line_no) AS place FROM cl),
pg AS (SELECT book, page_no, bool_or(place <= 3 AND {_NORM.format("text")} IN ({_HEADINGS})) AS headed, count(*) AS n,
              count(*) FILTER (WHERE {_STARTS.format("text")} OR {_ENDS.format("text")}) AS numbered FROM pl GROUP BY ALL),
en AS (SELECT book, {_STRIPPED} AS text FROM pl JOIN pg USING (book, page_no) WHERE headed OR (n >= 6 AND 5 * numbered >= 2 * n)),
tt AS (SELECT DISTINCT book, {_NORM.format("CASE WHEN " + _ENDS.format("text") + r" THEN regexp_replace(text, '[\p{N}. ]*$', '') ELSE text END")} AS title FROM en),
toc AS (SELECT * FROM tt WHERE length(title) >= 6)"""


TOC_SQL = f"""{LINES_SQL}, {toc_sql("CASE WHEN page_no = 0 THEN text || ' ' || (line_no + 1) ELSE text END")}"""
#: Words of the pages; levenshtein counts bytes there, so that other letters of the texts become capitals, which no word holds.
_WORDS = rf"""{LINES_SQL}, wo AS (SELECT book, page_no, translate(word, 'ßäçèéêíñóöü', 'ABCDEFGHIJK') AS word FROM (SELECT book, page_no,
unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+')) AS word FROM lines) WHERE length(word) >= 4),
ww AS (SELECT DISTINCT * FROM wo), ps AS (SELECT DISTINCT book, page_no FROM lines),
n AS (SELECT book, page_no, count(DISTINCT word) AS n, count(word) AS c FROM ps LEFT JOIN wo USING (book, page_no) GROUP BY ALL)"""
_SHARED = """SELECT pr.book, pr.page_no, pr.s, pr.l, count(DISTINCT x.word) AS shared FROM pr JOIN ww x ON x.book = pr.book AND x.page_no = pr.s
      JOIN ww y ON y.book = pr.book AND y.page_no = pr.l AND left(x.word, 1) = left(y.word, 1)
      AND (x.word = y.word OR (length(x.word) >= 5 AND abs(length(x.word) - length(y.word)) <= CASE WHEN length(x.word) >= 7 THEN 2 ELSE 1 END
           AND levenshtein(x.word, y.word) <= CASE WHEN length(x.word) >= 7 THEN 2 ELSE 1 END)) GROUP BY ALL"""

QUERIES = {
    "a10_page_keys": a10_page_keys, "a11_near_pages": a11_near_pages, "j6_duplicate_pages": j6_duplicate_pages, "j7_shared_words": j7_shared_words,
    "c10_new_pages": c10_new_pages, "d9_toc_titles": d9_toc_titles, "j3_toc_matches": j3_toc_matches,
}
SQL = {
    "a10_page_keys": f"WITH {_KEYS} SELECT book, page_no, CAST(len(keys) AS BIGINT) AS n_keys FROM keys",
    "a11_near_pages": f"""WITH {_KEYS} SELECT a.book, a.page_no, b.page_no AS earlier,
len(list_intersect(a.keys, b.keys)) / len(list_distinct(list_concat(a.keys, b.keys))) AS similarity
FROM keys a JOIN keys b ON a.book = b.book AND b.page_no BETWEEN a.page_no - 3 AND a.page_no - 1 WHERE len(a.keys) >= 6 AND len(b.keys) >= 6""",
    "j6_duplicate_pages": f"""WITH RECURSIVE {LINES_SQL},
al AS (SELECT book, page_no, text, conf_pct FROM lines UNION ALL
       SELECT l.book, past, text, conf_pct FROM lines l JOIN (SELECT book, max(page_no) + 1 AS past FROM lines GROUP BY book) e ON e.book = l.book AND l.page_no = greatest(past - 3, 0)),
kk AS (SELECT book, page_no, list(DISTINCT {_NORM.format("text")}) FILTER (WHERE conf_pct >= 50 AND length({_NORM.format("text")}) >= 12) AS ks FROM al GROUP BY ALL),
pk AS (SELECT book, page_no, coalesce(ks, []) AS keys, row_number() OVER (PARTITION BY book ORDER BY page_no) AS k FROM kk),
wk AS (SELECT book, k, page_no, CAST(NULL AS INT) AS twin, [{{'p': page_no, 'ks': keys}}] AS kept FROM pk WHERE k = 1
 UNION ALL
 SELECT book, k, page_no, twin, CASE WHEN twin IS NULL THEN (list_append(kept, {{'p': page_no, 'ks': keys}}))[-{Duplicate.window}:] ELSE kept END
 FROM (SELECT pk.*, kept, CASE WHEN len(keys) >= {Duplicate.least_keys} THEN list_filter(kept, lambda o:
         len(list_intersect(o.ks, keys)) >= CAST({Duplicate.share} AS DOUBLE) * len(list_distinct(list_concat(o.ks, keys))))[1].p END AS twin
       FROM wk JOIN pk ON pk.book = wk.book AND pk.k = wk.k + 1))
SELECT book, page_no, twin AS "of" FROM wk WHERE twin IS NOT NULL""",
    "j7_shared_words": f"""WITH {_WORDS},
pr AS (SELECT a.book, a.page_no, least(a.n, b.n) AS total, CASE WHEN a.n <= b.n THEN a.page_no ELSE b.page_no END AS s, CASE WHEN a.n <= b.n THEN b.page_no ELSE a.page_no END AS l
       FROM n a JOIN n b ON a.book = b.book AND b.page_no = a.page_no + 1), m AS ({_SHARED})
SELECT book, page_no, total, coalesce(shared, 0) AS shared FROM pr LEFT JOIN m USING (book, page_no)""",
    "c10_new_pages": f"""WITH RECURSIVE {_WORDS},
pr AS (SELECT b.book, b.page_no, a.page_no AS earlier, least(a.n, b.n) AS total, CASE WHEN a.n < b.n THEN a.page_no ELSE b.page_no END AS s, CASE WHEN a.n < b.n THEN b.page_no ELSE a.page_no END AS l
       FROM n a JOIN n b ON a.book = b.book AND a.page_no < b.page_no WHERE least(a.c, b.c) >= {SamePage.few_words}), m AS ({_SHARED}),
tw AS (SELECT pr.book, pr.page_no, list(earlier) AS twins FROM pr JOIN m USING (book, page_no, s, l) WHERE shared / total >= CAST({SamePage.share} AS DOUBLE) GROUP BY ALL),
pk AS (SELECT n.book, n.page_no, coalesce(twins, []) AS twins, row_number() OVER (PARTITION BY n.book ORDER BY n.page_no) AS k FROM n LEFT JOIN tw USING (book, page_no)),
wk AS (SELECT book, k, page_no, true AS is_new, [page_no] AS known FROM pk WHERE k = 1
 UNION ALL
 SELECT pk.book, pk.k, pk.page_no, NOT list_has_any(known, twins), CASE WHEN list_contains(twins, known[-1]) THEN list_append(known[1:-2], pk.page_no)
        WHEN list_has_any(known, twins) THEN known ELSE (list_append(known, pk.page_no))[-{SamePage.remembered}:] END
 FROM wk JOIN pk ON pk.book = wk.book AND pk.k = wk.k + 1)
SELECT book, page_no, is_new FROM wk""",
    "d9_toc_titles": f"WITH {TOC_SQL} SELECT * FROM toc",
    "j3_toc_matches": f"WITH {TOC_SQL} SELECT book, page_no, line_no FROM lines WHERE EXISTS (SELECT 1 FROM toc WHERE toc.book = lines.book AND toc.title = {_NORM.format('text')})",
}
