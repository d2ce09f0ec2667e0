"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only. Words are lower-cased (A-Z) and freed of trailing ``.,;:)"``; a shingle is five words. Only shingles
that some template has are looked at further, each with its place. Templates of about one length (within a factor of
``CLASS``) share their windows, which are longer than the longest of them by a quarter and begin a quarter apart, so that every
run of as many words as a template has lies in one window. A window's known shingles get ``BANDS`` MinHash values, each a
band of its own, and a template that shares a band with a window is a candidate for the text.

A template matches if as many consecutive words as it has hold at least ``CONTAINMENT`` of its distinct shingles. Where that
is so, window and template have a Jaccard similarity of at least 0.8 / 1.77, so all 32 bands miss with a probability
below 1e-8. The share is told for the best run, found by a sweep: each place of a shingle opens and closes a range of
beginnings that it counts for, and sums over these ranges give all shares at once. The cost grows with the words, not with
the product of words and template length.

The template library is a list of at most ``MAX_TEMPLATES`` texts and ``MAX_BYTES`` bytes, checked here, and so may be
broadcast; the documents are never grouped by template. A template of fewer words than a shingle cannot be scanned for and
is an error; an empty library finds nothing. Null, empty and short texts match nothing; texts may have any length. Rows of
one doc_id are scanned one by one and reported together; of equally good runs the first is told. An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import keep, table
from folio.llm.license_texts import FULL

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
#: Lengths that differ by less than this factor are one class.
CLASS = 1.25
MAX_TEMPLATES = 10_000
#: Bytes of all templates together; their shingles take about three times as much, their bands 512 bytes a template.
MAX_BYTES = 1 << 20

# Public license notices.
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-grant", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0-basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
    ("mit-notice", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "Licensed under CC BY 4.0."),
    ("cc-by-4.0-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-grant", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    *FULL,
)

_TRAILING = r'[.,;:)"]*[\x20\x09-\x0D]+'
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: Column) -> Column:
    lower = F.translate(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lower, _TRAILING), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _shingles(words: Column) -> Column:
    """The hashed shingles of a word array, in order."""
    hashed = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    )
    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def _bands(shingle: Column) -> list[Column]:
    """The least hash of a group's shingles for each band, as aggregates."""
    return [F.min(F.xxhash64(shingle, F.lit(k))).alias(f"b{k}") for k in range(BANDS)]


def _banded(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys.., band, value): a row for each band of each group."""
    values = F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"b{k}").alias("value")) for k in range(BANDS)])
    return groups.select(*keys, F.explode(values).alias("b")).select(*keys, "b.band", "b.value")


def _library(spark: SparkSession, templates: tuple) -> DataFrame:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"a library holds at most {MAX_TEMPLATES} templates")
    if sum(len(text.encode()) for _, text in templates) > MAX_BYTES:
        raise ValueError(f"a library holds at most {MAX_BYTES} bytes of text")
    if not templates:
        return spark.createDataFrame([], "template int, license string, n int, class int, wanted array<bigint>")
    rows = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("\\", "\\\\").replace("'", "\\'") for x in t)) for i, t in enumerate(templates))
    texts = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, text)")
    words = texts.withColumn("w", _words(F.col("text")))
    short = F.raise_error(F.concat(F.lit(f"a template holds at least {SHINGLE} words: "), F.col("license"))).cast("int")
    sized = words.withColumn("n", F.when(F.size("w") < SHINGLE, short).otherwise(F.size("w")))
    number = F.floor(F.ln(F.col("n").cast("double")) / F.ln(F.lit(CLASS))).cast("int")
    return sized.select("template", "license", "n", number.alias("class"), F.array_distinct(_shingles(F.col("w"))).alias("wanted"))


def _hits(docs: DataFrame, known: list[int]) -> DataFrame:
    """(doc_id, row, total, pos, shingle): places of known shingles, kept; row tells apart the texts of one doc_id, total is its words.

    Known ones are literals of an IN, which Spark looks up by hash, whatever the size of the library.
    """
    text = F.col("text").cast("string")
    placed = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(i.alias("pos"), x.alias("shingle"))), lambda x: x["shingle"].isin(known))
    found = _let(_shingles(_words(text)), lambda s: F.struct((F.size(s) + SHINGLE - 1).alias("total"), placed(s).alias("places")))
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), found.alias("x")).where(F.size("x.places") > 0)
    spread = rows.select("doc_id", "row", "x.total", F.explode("x.places").alias("p")).select("doc_id", "row", "total", "p.pos", "p.shingle")
    return keep(spread, "hits")


def _candidates(hits: DataFrame, library: DataFrame) -> DataFrame:
    """(doc_id, row, template): templates that share a band with a window of the text."""
    wanted = library.select("template", "n", "class", F.explode("wanted").alias("shingle"))
    longest = Window.partitionBy("class")
    of_class = wanted.withColumn("longest", F.max("n").over(longest)).groupBy("class", "shingle").agg(F.max("longest").alias("longest"))
    step = F.greatest(F.floor(F.col("longest") / 4), F.lit(1)).cast("int")
    first = F.greatest(F.floor((F.col("pos") - F.col("longest") - F.col("step")) / F.col("step")) + 1, F.lit(0))
    windows = F.sequence(first.cast("long"), F.floor(F.col("pos") / F.col("step")).cast("long"))
    placed = hits.join(F.broadcast(of_class.withColumn("step", step)), "shingle").select("doc_id", "row", "class", "shingle", F.explode(windows).alias("window"))
    grouped = placed.groupBy("doc_id", "row", "class", "window").agg(*_bands(F.col("shingle")))
    index = _banded(wanted.groupBy("class", "template").agg(*_bands(F.col("shingle"))), "class", "template")
    shared = _banded(grouped, "doc_id", "row", "class").join(F.broadcast(index), ["class", "band", "value"])
    return shared.select("doc_id", "row", "template").distinct()


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Rows (doc_id, license, containment, first_word): each template found, its best run of words and where that begins."""
    library = _library(docs.sparkSession, templates)
    known = sorted({x for r in library.select("wanted").collect() for x in r.wanted})
    hits = _hits(docs, known)
    shingles = library.select("template", "license", "n", F.size("wanted").alias("size"), F.explode("wanted").alias("shingle"))
    key = ["doc_id", "row", "template"]
    left, right = hits.alias("h"), _candidates(hits, library).alias("c")
    asked = left.join(right, (F.col("h.row") == F.col("c.row")) & F.col("h.doc_id").eqNullSafe(F.col("c.doc_id"))).select("h.*", "c.template")
    mine = asked.join(F.broadcast(shingles), ["template", "shingle"]).distinct()
    # A place counts for the runs that hold it and no earlier place of the same shingle.
    before = F.lag("pos").over(Window.partitionBy(*key, "shingle").orderBy("pos"))
    opens = F.greatest(F.lit(0), F.col("pos") - F.col("n") + SHINGLE, F.coalesce(before + 1, F.lit(0)))
    closes = F.least(F.col("pos"), F.col("total") - F.col("n")) + 1
    ranged = mine.withColumn("opens", opens).withColumn("closes", closes).where("opens < closes")
    edges = F.explode(F.array(F.struct(F.col("opens").alias("at"), F.lit(1).alias("d")), F.struct(F.col("closes").alias("at"), F.lit(-1).alias("d"))))
    steps = ranged.select(*key, "license", "size", edges.alias("e")).groupBy(*key, "license", "size", "e.at").agg(F.sum("e.d").alias("d"))
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("d").over(upto) / F.col("size")
    verified = steps.select("doc_id", "license", "at", share.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    best = verified.groupBy("doc_id", "license").agg(F.min(F.struct(-F.col("containment"), "at")).alias("best"), F.max("containment").alias("containment"))
    return best.select("doc_id", "license", "containment", F.col("best.at").cast("long").alias("first_word"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates found in each document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql(texts: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({texts}, '') || ' ', '{_UPPER}', '{_UPPER.lower()}'), '{_TRAILING}'), lambda w: w <> '')"


_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in TEMPLATES)
ORACLE = f"""
WITH tw AS (SELECT license, {_sql("text")} AS w FROM (VALUES {_ROWS}) AS v(license, text)),
ts AS (SELECT license, len(w) AS n, list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS wanted FROM tw),
tu AS (SELECT license, n, len(wanted) AS size, unnest(wanted) AS g FROM ts),
dw AS (SELECT doc_id, {_sql("text")} AS w FROM documents),
dg AS (SELECT doc_id, len(w) AS total, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE} + 2)) AS i FROM dw)),
hit AS (SELECT doc_id, license, n, size, g, total, unnest(range(greatest(pos - n + {SHINGLE}, 0), pos + 1)) AS start FROM dg JOIN tu USING (g)),
c AS (SELECT doc_id, license, start, count(DISTINCT g) / size AS containment FROM hit WHERE start + n <= total GROUP BY doc_id, license, start, size)
SELECT doc_id, license, max(containment) AS containment, arg_min(start, (-containment, start)) AS first_word
FROM c WHERE containment >= {CONTAINMENT} GROUP BY doc_id, license
"""

QUERIES = {"op9_license_scan": op9_license_scan}
SQL = {"op9_license_scan": ORACLE}
