"""Blocks of pages to books of any size.

A page's first paragraph may go on an open paragraph or footnote of the pages before, and whether it does decides what
the next page meets. So a page is a function from nine states (how the open paragraph and the open footnote end) to nine
states; such functions compose in any grouping. They are composed by runs of pages, runs of runs, and so on; the states then
come down the same way. No task holds more of a book than one run of pages, its rows of nine numbers or one merged block.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import text as X
from folio.functions.arrays import gathered, last, let
from folio.operators.hyphenation import join_lines, word_test
from folio.sources.tables import dropped, kept

PAGE = ["book", "page_no"]
#: Pages of a run, runs of a run of runs ..; with LEVELS the last row of a book has its pages by RUN ** LEVELS.
RUN = 256
LEVELS = 2

# How a text ends: nothing goes on it, a hyphen, or without a closing mark.
CLOSED, HYPHEN, OPEN = 0, 1, 2
_PLACE = "struct<page_no: int, block_no: int>"
_STATE = f"struct<s: int, paragraph: {_PLACE}, footnote: {_PLACE}>"


def ending(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(f"[{X.HYPHENS}]$")), HYPHEN).when((text == "") | F.regexp_like(text, F.lit(X.ENDS_SENTENCE)), CLOSED).otherwise(OPEN)


def page_functions(blocks: DataFrame) -> DataFrame:
    """(book, page_no, opening, f): the place, ending and start of a page's opening paragraph if it has one, and its function."""
    place = F.struct(F.col("page_no").cast("int").alias("page_no"), F.col("block_no").cast("int").alias("block_no"))
    # A block's member names its order first; a text is known by its ends only.
    member = F.struct("block_no", "kind", place.alias("place"), ending(F.col("text")).alias("ending"), F.regexp_like("text", F.lit(r"^\p{Ll}")).alias("low"), (F.col("text") != "").alias("some"))
    pages = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(member)).alias("all"))
    first = F.get("all", F.lit(0))
    pages = pages.withColumn("opening", F.when(first["kind"] == "paragraph", first))
    rest = F.when(F.col("opening").isNull(), F.col("all")).otherwise(F.slice("all", 2, F.size("all")))
    pages = pages.select(*PAGE, "opening", last(F.filter(rest, lambda b: b["kind"] != "footnote")).alias("text_block"), last(rest).alias("end_block"))
    end_if = lambda c, kind: F.when(F.col(c)["kind"] == kind, F.col(c)["ending"]).otherwise(F.when(F.col(c).isNotNull(), CLOSED))
    pages = pages.withColumn("p", end_if("text_block", "paragraph")).withColumn("n", end_if("end_block", "footnote"))
    opening = F.col("opening")

    def after(state: Column) -> Column:
        def outcome(goes: Column) -> Column:
            own = F.when(opening.isNotNull() & (goes == ""), opening["place"])
            p = F.coalesce("p", F.when(opening.isNotNull() & (goes != "footnote"), opening["ending"]).otherwise(F.floor(state / 3)))
            n = F.coalesce("n", F.when(opening.isNull() | (goes == "paragraph"), state % 3).when(goes == "footnote", opening["ending"]).otherwise(CLOSED))
            return F.struct((3 * p + n).cast("int").alias("s"), F.coalesce(F.col("text_block.place"), own).alias("paragraph"), F.coalesce(F.col("end_block.place"), own).alias("footnote")).cast(_STATE)

        return let(goes_on(opening, state), outcome)

    return pages.select(*PAGE, "opening", F.transform(F.sequence(F.lit(0), F.lit(8)), after).alias("f"))


def goes_on(opening: Column, state: Column) -> Column:
    """What an opening paragraph goes on in a state: paragraph, footnote or nothing."""
    runs = lambda end: opening["some"] & ((end == HYPHEN) | ((end == OPEN) & opening["low"]))
    return F.coalesce(F.when(runs(F.floor(state / 3)), "paragraph").when(runs(state % 3), "footnote"), F.lit(""))


def _then(state: Column, f: Column) -> Column:
    """The state after a function, with the places that it left alone."""
    place = lambda y, c: F.coalesce(y[c], state[c]).alias(c)
    return let(F.get(f, state["s"]), lambda y: F.struct(y["s"].alias("s"), place(y, "paragraph"), place(y, "footnote")).cast(_STATE))


def states_before(functions: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """(book, at, state) before each function of (book, at, f), by runs of ``run`` places and runs of these."""
    nowhere = F.lit(None).cast(_PLACE)
    state = lambda s: F.struct(s.cast("int").alias("s"), nowhere.alias("paragraph"), nowhere.alias("footnote")).cast(_STATE)
    if levels:
        groups = gathered(functions.withColumn("run", F.floor(F.col("at") / run)), ["book", "run"], "at", "f")
        nothing = F.transform(F.sequence(F.lit(0), F.lit(8)), state)
        whole = F.aggregate("members", nothing, lambda done, m: F.transform(done, lambda x: _then(x, m["f"])))
        came = states_before(groups.select("book", F.col("run").alias("at"), whole.alias("f")), run, levels - 1)
        groups = groups.join(came.withColumnRenamed("at", "run"), ["book", "run"])
    else:
        groups = gathered(functions, ["book"], "at", "f").withColumn("state", state(F.lit(0)))
    walk = f"struct<state: {_STATE}, met: array<struct<at: bigint, state: {_STATE}>>>"
    start = F.struct(F.col("state").alias("state"), F.array().alias("met")).cast(walk)
    step = lambda w, m: F.struct(_then(w["state"], m["f"]).alias("state"), F.concat(w["met"], F.array(F.struct(m["at"].alias("at"), w["state"].alias("state")))).alias("met")).cast(walk)
    return groups.select("book", F.explode(F.aggregate("members", start, step, lambda w: w["met"])).alias("m")).select("book", "m.at", "m.state")


def joined_in_turn(lists: Column, words: Iterable[str] | None = None) -> Column:
    """Of an array of lists of texts, each list's texts joined to what the ones before them gave; null for null."""
    listed = None if words is None else frozenset(words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batch: pd.Series) -> pd.Series:
        knows = word_test(listed)
        whole = lambda texts: None if texts is None else reduce(lambda a, b: join_lines([a, b], knows), texts)
        return batch.map(lambda page: None if page is None else [whole(texts) for texts in page])

    return run(lists)


def with_tails(blocks: DataFrame, functions: DataFrame, run: int = RUN) -> DataFrame:
    """``blocks`` (book, page_no, block_no, kind, text, ..) with ``tail``, the texts of openings that go on it; functions are those of their pages.

    Such an opening keeps its row with a null kind, as its note stays. Blocks are joined by page, as they lie; a condition that
    names a block as equal would deal them out anew.
    """
    came = states_before(functions.select("book", F.col("page_no").cast("long").alias("at"), "f"), run)
    goes = goes_on(F.col("opening"), F.col("state.s"))
    found = functions.where("opening IS NOT NULL").withColumn("at", F.col("page_no").cast("long")).join(came, ["book", "at"]).withColumn("goes", goes).where("goes <> ''")
    moved = found.select(*PAGE, F.col("opening.block_no").alias("gone"), F.when(F.col("goes") == "paragraph", F.col("state.paragraph")).otherwise(F.col("state.footnote")).alias("target"))
    pieces = blocks.select(*PAGE, "block_no", "text").join(moved, PAGE).where(F.col("block_no").between(F.col("gone"), F.col("gone")))
    ends = pieces.groupBy("book", F.col("target.page_no").alias("page_no"), F.col("target.block_no").alias("block_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]).alias("tail")
    )
    tails = ends.groupBy(*PAGE).agg(F.collect_list(F.struct("block_no", "tail")).alias("tails"))
    rows = blocks.join(moved.drop("target"), PAGE, "left").join(tails, PAGE, "left")
    rows = rows.withColumn("tail", F.get(F.filter("tails", lambda t: t["block_no"] == F.col("block_no")), F.lit(0))["tail"])
    return rows.withColumn("kind", F.when(F.coalesce(F.col("gone") != F.col("block_no"), F.lit(True)), F.col("kind"))).drop("gone", "tails")


def covers_plain(blocks: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Headings of a book's first page that repeat its title or are a publisher's line become paragraphs."""
    first = pages.groupBy("book").agg(F.min("page_no").alias("cover")).join(titles.select("book", "title").where("title <> ''"), "book")
    key, whole = X.normalized(F.col("text")), X.normalized(F.col("title"))
    on_cover = F.contains(whole, key) | F.contains(key, whole) | X.is_excluded_title(F.col("text"))
    falls = F.coalesce((F.col("kind") == "heading") & (F.col("page_no") == F.col("cover")) & on_cover, F.lit(False))
    rows = blocks.join(first, "book", "left").withColumn("falls", falls)
    return rows.withColumn("kind", F.when(F.col("falls"), "paragraph").otherwise(F.col("kind"))).withColumn("level", F.when(F.col("falls"), 0).otherwise(F.col("level"))).select(*blocks.columns)


def numbered(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Each of the ``elements`` of ``pages`` (book, page_no, elements) with block_no from 0 in its book, by running sums over pages and runs of pages."""
    counts = pages.select(*PAGE, F.size("elements").alias("n")).withColumn("run", F.floor(F.col("page_no") / run))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("book", "run").agg(F.sum("n").alias("n")).select("book", "run", before(Window.partitionBy("book").orderBy("run")).alias("base"))
    starts = counts.withColumn("start", before(Window.partitionBy("book", "run").orderBy("page_no"))).join(runs, ["book", "run"]).select(*PAGE, (F.col("base") + F.col("start")).alias("start"))
    found = pages.join(starts, PAGE).select(*PAGE, "start", F.posexplode("elements").alias("rank", "e"))
    return found.select(*PAGE, (F.col("start") + F.col("rank")).cast("int").alias("block_no"), "e.*")


def assembled(pages: DataFrame, blocks: DataFrame, words: Iterable[str] | None = None, titles: DataFrame | None = None, run: int = RUN) -> DataFrame:
    """(book, block_no, kind, level, text, scan, printed) of pages (book, page_no, twin, printed) and their blocks.

    Every page begins with a break; a duplicate has only a note behind it, its blocks are left out. Pages without blocks,
    books of one page and texts that are empty are all allowed; blocks of pages that are not listed are left out. The pages'
    elements are written down, so that nothing else is read for the result, and texts are not dealt out again.
    """
    blocks = blocks.join(pages.where("twin IS NULL").select(*PAGE), PAGE)
    blocks = blocks if titles is None else covers_plain(blocks, pages, titles)
    functions = kept(page_functions(blocks))
    member = F.struct("block_no", "kind", "level", "text", "uncertain", "tail")
    found = pages.join(with_tails(blocks, functions, run).groupBy(*PAGE).agg(F.sort_array(F.collect_list(member)).alias("blocks")), PAGE, "left")
    whole = F.transform("blocks", lambda b: F.when(b["tail"].isNotNull(), F.concat(F.array(b["text"]), b["tail"])))
    found = found.withColumn("whole", joined_in_turn(whole, words))
    element = lambda kind, level, text, printed: F.struct(kind.alias("kind"), level.cast("int").alias("level"), text.alias("text"), printed.cast("string").alias("printed"))
    none, zero, twin = F.lit(None), F.lit(0), F.col("twin")
    told = F.concat(F.lit("Scan "), F.col("page_no") + 1, F.lit(" ist ein Duplikat von Scan "), twin + 1, F.lit(" und wurde übersprungen"))
    opens = F.array(element(F.lit("pageBreak"), zero, F.lit(""), F.when(twin.isNull(), F.col("printed"))), F.when(twin.isNotNull(), element(F.lit("note"), zero, told, none)))
    note = lambda b: F.when(b["uncertain"] != "", element(F.lit("note"), zero, b["uncertain"], none))
    own = lambda b, i: F.when(b["kind"].isNotNull(), element(b["kind"], b["level"], F.coalesce(F.get("whole", i), b["text"]), none))
    rest = F.flatten(F.transform("blocks", lambda b, i: F.array(note(b), own(b, i))))
    elements = F.array_compact(F.when(F.col("blocks").isNull(), opens).otherwise(F.concat(opens, rest)))
    made = kept(found.select(*PAGE, elements.alias("elements")), *PAGE, dealt=True)
    dropped(functions)
    return numbered(made, run).select("book", "block_no", "kind", "level", "text", (F.col("page_no") + 1).cast("int").alias("scan"), "printed")
