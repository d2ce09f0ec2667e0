"""Scan sessions: ordered pages, edits of the page order, trash and restore, texts, file rollups, devices.

A session is a row with page_order, pages and trashed; edits are Columns over such arrays, so a change of many sessions
is one DataFrame transformation whose result is written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.sources.tables import LINES_SQL, lines, table

EXPORTS = ("pdf", "md", "docx", "epub")


def set_order(old: Column, requested: Column) -> Column:
    """The known pages in the requested order, each once, then the others as they stood."""
    return F.array_distinct(F.concat(F.filter(requested, lambda p: F.array_contains(old, p)), old))


def insert_after(order: Column, page: Column, new: Column) -> Column:
    """New pages right behind a page; unchanged (and so to be refused by the caller) if that is unknown."""
    at = F.array_position(order, page).cast("int")
    return F.when(at == 0, order).otherwise(F.concat(F.slice(order, 1, at), new, F.slice(order, at + 1, F.size(order))))


def move_before(order: Column, page: Column, target: Column) -> Column:
    """A page moved before another; to the end without or with an unknown target; unchanged before itself."""
    rest = F.array_remove(order, page)
    at = F.coalesce(F.array_position(rest, target), F.lit(0)).cast("int")
    moved = F.when(at == 0, F.concat(rest, F.array(page))).otherwise(
        F.concat(F.slice(rest, 1, F.greatest(at - 1, F.lit(0))), F.array(page), F.slice(rest, F.greatest(at, F.lit(1)), F.size(rest)))
    )
    return F.when((page == target) | ~F.array_contains(order, page), order).otherwise(moved)


def trash_pages(order: Column, trashed: Column, pages: Column) -> tuple[Column, Column]:
    """Order and trash after known pages were thrown away, in the given order."""
    known = F.array_distinct(F.filter(pages, lambda p: F.array_contains(order, p)))
    return F.array_except(order, known), F.concat(trashed, known)


def restore_last(order: Column, trashed: Column, target: Column) -> tuple[Column, Column]:
    """Order and trash after the page thrown away last came back before a target, or at the end."""
    last = F.try_element_at(trashed, F.lit(-1))
    back = F.when(last.isNull(), order).otherwise(move_before(F.concat(order, F.array(last)), last, target))
    return back, F.slice(trashed, 1, F.greatest(F.size(trashed) - 1, F.lit(0)))


def replace_page(order: Column, trashed: Column, page: Column, new: Column) -> tuple[Column, Column]:
    """New pages in the place of one, which goes to the trash; also how a page is split or turned in place."""
    return trash_pages(insert_after(order, page, new), trashed, F.array(page))


def resolve_rescan(order: Column, trashed: Column, old: Column, new: Column, keep_new: Column) -> tuple[Column, Column]:
    """After a second scan behind a page: the one that lost goes to the trash."""
    return trash_pages(order, trashed, F.when(keep_new, F.array(old)).otherwise(new))


def archived(sessions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with pages marked as archived, and of a listing (session, path, bytes) what then stays: no images, no trash."""
    due = (~F.col("archived")) & (F.size("page_order") > 0)
    sessions = sessions.withColumn("archived", F.col("archived") | due)
    marked = sessions.where("archived").select("session")
    gone = F.startswith("path", F.lit("Papierkorb/")) | (F.lower(F.substring_index("path", ".", -1)) == "heic")
    return sessions, files.join(marked.withColumn("__a", F.lit(True)), "session", "left").where(~(gone & F.coalesce("__a", F.lit(False)))).drop("__a")


def without_trash(files: DataFrame) -> DataFrame:
    return files.where(~F.startswith("path", F.lit("Papierkorb/")))


def directory_for(stamp: Column, title: Column) -> Column:
    """A session's directory: the time stamp first, then the safe title."""
    safe = X.file_system_safe(F.coalesce(title, F.lit("")))
    return F.when(F.length(safe) > 0, F.concat(stamp, F.lit(" "), safe)).otherwise(stamp)


def _numbered_names(names: DataFrame) -> DataFrame:
    """(parent, base, number) that each taken (parent, name) uses up: the plain name is number 1 of itself, ``x (3)`` also number 3 of x."""
    numbered = r"^(.*) \(([2-9]|[1-9][0-9]{1,8})\)$"
    own = F.struct(F.col("name").alias("base"), F.lit(1).cast("long").alias("number"))
    of = F.struct(F.regexp_extract("name", numbered, 1).alias("base"), F.nullif(F.regexp_extract("name", numbered, 2), F.lit("")).cast("long").alias("number"))
    both = names.select("parent", F.explode(F.array(own, of)).alias("x")).select("parent", "x.base", "x.number")
    return both.where(F.col("number").isNotNull()).distinct()


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``wanted`` (parent, name, place ..) with ``free``: the name itself or the first of ``name (2)``, ``name (3)`` .. that is free.

    All are named at once, as if one after another by place, from the names ``taken`` (parent, name): the r-th to want a name gets
    the r-th of its numbers that is not taken, which is r plus the taken ones whose number less their rank is below r. Names may
    hold a number themselves; where two wishes meet so, the first by place keeps it and the other is named in another round.
    """
    done, left, used = None, wanted, taken.select("parent", "name")
    while True:
        numbers = _numbered_names(used)
        by = Window.partitionBy("parent", "base")
        free = F.col("number") - F.row_number().over(by.orderBy("number"))
        gone = numbers.withColumn("key", free).select("parent", "base", "key", F.lit(0).alias("wish"), F.lit(1).alias("is_taken"), F.lit(None).cast(wanted.schema["place"].dataType).alias("place"))
        rank = F.row_number().over(Window.partitionBy("parent", "name").orderBy("place"))
        wishes = left.select("parent", F.col("name").alias("base"), rank.alias("key"), F.lit(1).alias("wish"), F.lit(0).alias("is_taken"), "place")
        # Taken numbers with key 0 .. r - 1 stand before the wish r.
        upto = by.orderBy("key", F.desc("wish")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        number = F.col("key") + F.sum("is_taken").over(upto)
        placed = gone.unionByName(wishes).withColumn("number", number).where("wish = 1")
        named = placed.select("parent", F.col("base").alias("name"), "place", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("number").cast("string"), F.lit(")"))).alias("free"))
        keeps = F.row_number().over(Window.partitionBy("parent", "free").orderBy("place")) == 1
        judged = left.join(named.withColumn("keeps", keeps), ["parent", "name", "place"])
        ours = judged.where("keeps").drop("keeps")
        done = ours if done is None else done.unionByName(ours)
        left = judged.where("NOT keeps").select(*wanted.columns)
        if left.isEmpty():
            return done
        used = used.unionByName(ours.select("parent", F.col("free").alias("name")))


def ordered_pages(sessions: DataFrame, pages: DataFrame) -> DataFrame:
    """(session, position from 1, page ..): pages in the session's order; unknown ids are skipped."""
    places = sessions.select("session", F.posexplode("page_order").alias("at", "page"))
    joined = places.join(pages, ["session", "page"])
    return joined.withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy("at"))).drop("at")


def session_rollup(files: DataFrame) -> DataFrame:
    """Bytes per session from a file listing (session, path, bytes): images, trash, exports, all, and the export kinds."""
    kind = F.lower(F.substring_index("path", ".", -1))
    parts = F.size(F.split("path", "/"))
    in_trash, direct = F.startswith("path", F.lit("Papierkorb/")), parts == 1
    export = direct & kind.isin(*EXPORTS)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("bytes"))), F.lit(0)).alias
    kinds = F.array_join(F.filter(F.array(*map(F.lit, EXPORTS)), lambda e: F.array_contains(F.col("found"), e)), ",")
    return (
        files.groupBy("session")
        .agg(
            total(~in_trash & (kind == "heic"))("image_bytes"), total(in_trash)("trash_bytes"), total(export)("export_bytes"),
            F.sum("bytes").alias("total_bytes"), F.collect_set(F.when(export, kind)).alias("found"),
        )
        .select("session", "image_bytes", "trash_bytes", "export_bytes", "total_bytes", kinds.alias("exports"))
    )


def best_formats(formats: DataFrame) -> DataFrame:
    """(device, width, height) of each device's largest format of at least ten frames a second, most pixels first."""
    pixels = F.col("width") * F.col("height")
    best = formats.where("fps >= 10").groupBy("device").agg(F.max(F.struct(pixels.alias("pixels"), "width", "height")).alias("f"))
    return best.select("device", "f.width", "f.height", "f.pixels").orderBy(F.desc("pixels"), "device")


def stored_or_recognised(pages: DataFrame, stored: DataFrame, recognise) -> DataFrame:
    """Stored page texts, and for pages without one what ``recognise`` (DataFrame to DataFrame) makes of them."""
    have = stored.select("session", "page", "text")
    return have.unionByName(recognise(pages.join(have, ["session", "page"], "left_anti")).select("session", "page", "text"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book as a session: its pages in order, a request that turns them round with unknown and doubled ids."""
    pages = lines(spark, sf_dir).groupBy("book").agg((F.max("page_no") + 1).cast("int").alias("n"))
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("p"), i.cast("string")))
    return pages.select(F.col("book").alias("session"), "n", ids.alias("page_order"))


def u3_set_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("page_order")
    request = F.concat(F.array(F.lit("zz")), F.slice(F.reverse(order), 1, 3), F.slice(order, 1, 1))
    return _sessions(spark, sf_dir).select("session", F.array_join(set_order(order, request), ",").alias("page_order"))


def m_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert behind the first page, move the last before the second, throw away two and get one back."""
    s = _sessions(spark, sf_dir).withColumn("none", F.array().cast("array<string>"))
    order, last = F.col("page_order"), F.element_at("page_order", -1)
    trashed = trash_pages(order, F.col("none"), F.array(last, F.lit("p0"), F.lit("zz")))
    s = s.withColumn("left", trashed[0]).withColumn("bin", trashed[1])
    back = restore_last(F.col("left"), F.col("bin"), F.lit("p1"))
    join = lambda c: F.array_join(c, ",")
    return s.select(
        "session", join(insert_after(order, F.lit("p0"), F.array(F.lit("n1"), F.lit("n2")))).alias("inserted"),
        join(move_before(order, last, F.lit("p1"))).alias("moved"), join("left").alias("left"), join("bin").alias("bin"),
        join(back[0]).alias("restored"), join(back[1]).alias("bin_after"),
    )


def m3_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page replaced by two, and a rescan of the last one resolved, in favour of the new page every other time."""
    s = _sessions(spark, sf_dir).withColumn("none", F.array().cast("array<string>"))
    order, last, new = F.col("page_order"), F.element_at("page_order", -1), F.array(F.lit("n1"), F.lit("n2"))
    replaced = replace_page(order, F.col("none"), F.lit("p0"), new)
    resolved = resolve_rescan(insert_after(order, last, new), F.col("none"), last, new, F.col("session") % 2 == 0)
    join = lambda c: F.array_join(c, ",")
    return s.select("session", join(replaced[0]).alias("replaced"), join(replaced[1]).alias("out"), join(resolved[0]).alias("resolved"), join(resolved[1]).alias("lost"))


def m9_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories by order date and title; every third title has nothing that a file system takes."""
    title = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" /:")).otherwise(F.concat(F.col("o_orderpriority"), F.lit(": No. ")))
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH-mm-ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", directory_for(stamp, title).alias("directory"))


_TITLED = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' Atlas' WHEN 2 THEN ' Atlas II' ELSE ' Briefe' END"
_NUMBER = "CASE WHEN o_orderkey % 5 < 2 THEN '' ELSE ' (' || (o_orderkey % 5) || ')' END"


def m9_free_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories for two thirds of the orders, by month and title, among those that the other third has, with gaps in their numbers."""
    orders = table(spark, sf_dir, "orders").withColumn("parent", F.col("o_custkey") % 4).withColumn("name", F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM"), F.expr(_TITLED)))
    taken = orders.where("o_orderkey % 3 = 0").select("parent", F.concat("name", F.expr(_NUMBER)).alias("name"))
    wanted = orders.where("o_orderkey % 3 <> 0").select("parent", "name", F.col("o_orderkey").alias("place"))
    return free_names(wanted, taken).select(F.col("place").alias("o_orderkey"), "free")


def m10_archived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each session's files once all sessions with pages (every other) are archived."""
    files = _files(spark, sf_dir)
    sessions = files.select("session").distinct().withColumn("archived", F.col("session") % 4 == 1)
    sessions = sessions.withColumn("page_order", F.when(F.col("session") % 2 == 0, F.array(F.lit("p0"))).otherwise(F.array().cast("array<string>")))
    marked, left = archived(sessions, files)
    return left.groupBy("session").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).join(marked.select("session", "archived"), "session")


def j1_ordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each session in reversed order with a dangling id, with their characters."""
    pages = lines(spark, sf_dir).groupBy("book", "page_no").agg(F.sum("n").alias("characters"))
    pages = pages.select(F.col("book").alias("session"), F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("page"), "characters")
    order = F.concat(F.array(F.lit("zz")), F.reverse("page_order"))
    found = ordered_pages(_sessions(spark, sf_dir).select("session", order.alias("page_order")), pages)
    return found.select("session", F.col("position").cast("long").alias("position"), "page", "characters")


def j2_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its text's lines, and pages without text (here those of low confidence only) with none."""
    rows = lines(spark, sf_dir)
    pages = rows.select("book", "page_no").distinct()
    texts = rows.where("conf_pct >= 90").groupBy("book", "page_no").agg(F.count("*").alias("n_lines"))
    return pages.join(texts, ["book", "page_no"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


_PATH = "CASE page_id % 6 WHEN 0 THEN 'Aufnahme-' || page_id || '.heic' WHEN 1 THEN 'Papierkorb/Aufnahme-' || page_id || '.heic' WHEN 2 THEN 'book.PDF' WHEN 3 THEN 'OCR/Aufnahme-' || page_id || '.json' WHEN 4 THEN 'book.md' ELSE 'old/book.pdf' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as the files of forty sessions."""
    return table(spark, sf_dir, "pages").select(F.expr("page_id % 40").alias("session"), F.expr(_PATH).alias("path"), F.octet_length("html").cast("long").alias("bytes"))


def a6_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_rollup(_files(spark, sf_dir))


def a7_library_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a6_session_rollup(spark, sf_dir).agg(F.sum("total_bytes").alias("total_bytes"), F.sum("trash_bytes").alias("trash_bytes"), F.count("*").alias("sessions"))


def s14_best_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the formats of devices named by brand."""
    formats = table(spark, sf_dir, "part").selectExpr("p_brand AS device", "p_size * 16 + p_partkey % 7 AS width", "p_size * 9 AS height", "p_partkey % 30 AS fps")
    return best_formats(formats).select("device", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "pixels")])


def x23_camera_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cameras, named in four ways."""
    name = F.expr("""concat(element_at(array('Camera of "', 'Kamera von „', 'Camera at ', ''), cast(p_partkey % 4 + 1 as int)), p_brand, IF(p_partkey % 4 < 2, '"', ''))""")
    wrapped = F.expr("IF(p_partkey % 3 = 0, 'Desk (%s)', NULL)")
    return table(spark, sf_dir, "part").select("p_partkey", X.short_camera_name(name, F.col("p_size") / 10, wrapped=wrapped).alias("camera"))


def s21_export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export file names: a safe title, or the time stamp where the title is empty; directory and ISO stamps beside."""
    at = F.col("o_orderdate").cast("timestamp")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" /:")).otherwise(F.concat(F.col("o_orderpriority"), F.lit(": No. ")))
    safe = X.file_system_safe(title)
    name = F.when(F.length(safe) > 0, safe).otherwise(F.concat(F.lit("Buchscan "), F.date_format(at, "yyyy-MM-dd HH-mm")))
    iso = X.iso_timestamp(at)
    back = X.iso_timestamp(X.parse_iso_timestamp(iso)) == iso
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(name, F.lit(".pdf")).alias("file"), F.date_format(at, "yyyy-MM-dd HH-mm-ss").alias("directory"), iso.alias("iso"), back.alias("round_trip")
    )


QUERIES = {
    "u3_set_order": u3_set_order, "m_edits": m_edits, "m3_replacements": m3_replacements, "m9_directories": m9_directories, "m9_free_directories": m9_free_directories, "m10_archived_files": m10_archived_files, "j1_ordered_pages": j1_ordered_pages, "j2_page_texts": j2_page_texts,
    "a6_session_rollup": a6_session_rollup, "a7_library_total": a7_library_total, "s14_best_formats": s14_best_formats, "x23_camera_names": x23_camera_names, "s21_export_names": s21_export_names,
}
_SESSIONS = f"{LINES_SQL}, ss AS (SELECT book AS session, list_transform(range(0, max(page_no) + 1), lambda i: 'p' || i) AS o FROM lines GROUP BY book)"
_ROLLUP = f"""f AS (SELECT page_id % 40 AS session, {_PATH} AS path, strlen(html) AS bytes FROM pages),
k AS (SELECT *, starts_with(path, 'Papierkorb/') AS t, NOT contains(path, '/') AND lower(string_split(path, '.')[-1]) IN ('pdf', 'md', 'docx', 'epub') AS e, lower(string_split(path, '.')[-1]) AS x FROM f),
r AS (SELECT session, CAST(coalesce(sum(bytes) FILTER (WHERE NOT t AND x = 'heic'), 0) AS BIGINT) AS image_bytes, CAST(coalesce(sum(bytes) FILTER (WHERE t), 0) AS BIGINT) AS trash_bytes,
             CAST(coalesce(sum(bytes) FILTER (WHERE e), 0) AS BIGINT) AS export_bytes, CAST(sum(bytes) AS BIGINT) AS total_bytes,
             array_to_string(list_filter(['pdf', 'md', 'docx', 'epub'], lambda z: list_contains(coalesce(list(x) FILTER (WHERE e), []), z)), ',') AS exports FROM k GROUP BY session)"""
SQL = {
    "u3_set_order": f"WITH {_SESSIONS} SELECT session, array_to_string(list_concat(list_reverse(o)[1:3], CASE WHEN len(o) > 3 THEN ['p0'] ELSE [] END, list_filter(o[2:], lambda p: NOT list_contains(list_reverse(o)[1:3], p))), ',') AS page_order FROM ss",
    "m_edits": f"""WITH {_SESSIONS}, t AS (SELECT session, o, CASE WHEN len(o) = 1 THEN ['p0'] ELSE [o[-1], 'p0'] END AS bin, CASE WHEN len(o) = 1 THEN [] ELSE o[2:len(o) - 1] END AS lf FROM ss)
SELECT session, array_to_string(list_concat(o[1:1], ['n1', 'n2'], o[2:]), ',') AS inserted,
array_to_string(CASE WHEN len(o) <= 2 THEN o ELSE list_concat(o[1:1], [o[-1]], o[2:len(o) - 1]) END, ',') AS moved, array_to_string(lf, ',') AS left, array_to_string(bin, ',') AS bin,
array_to_string(CASE WHEN list_contains(lf, 'p1') THEN list_concat(['p0'], lf) ELSE list_concat(lf, ['p0']) END, ',') AS restored, array_to_string(bin[1:len(bin) - 1], ',') AS bin_after FROM t""",
    "m3_replacements": f"""WITH {_SESSIONS} SELECT session, array_to_string(list_concat(['n1', 'n2'], o[2:]), ',') AS replaced, 'p0' AS "out",
array_to_string(CASE WHEN session % 2 = 0 THEN list_concat(o[1:len(o) - 1], ['n1', 'n2']) ELSE o END, ',') AS resolved, CASE WHEN session % 2 = 0 THEN o[-1] ELSE 'n1,n2' END AS lost FROM ss""",
    "m9_directories": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H-%M-%S') || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE
' ' || trim(left(trim(regexp_replace(replace(o_orderpriority || ': No. ', ':', ' '), '\\s+', ' ', 'g')), 80), '. ') END AS directory FROM orders""",
    "m9_free_directories": f"""WITH o AS (SELECT o_orderkey, o_custkey % 4 AS parent, strftime(o_orderdate, '%Y-%m') || {_TITLED} AS name FROM orders),
t AS (SELECT DISTINCT parent, name, {_NUMBER} AS tail FROM o WHERE o_orderkey % 3 = 0),
u AS (SELECT DISTINCT parent, name, CASE WHEN tail = '' THEN 1 ELSE CAST(tail[3:-2] AS BIGINT) END AS number FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY parent, name ORDER BY o_orderkey) AS r FROM o WHERE o_orderkey % 3 <> 0),
g AS (SELECT parent, name, unnest(range(1, m + 10)) AS number FROM (SELECT parent, name, max(r) AS m FROM w GROUP BY ALL)),
f AS (SELECT parent, name, number, row_number() OVER (PARTITION BY parent, name ORDER BY number) AS r FROM g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.parent = g.parent AND u.name = g.name AND u.number = g.number))
SELECT o_orderkey, name || CASE WHEN number = 1 THEN '' ELSE ' (' || number || ')' END AS free FROM w JOIN f USING (parent, name, r)""",
    "m10_archived_files": f"""WITH f AS (SELECT page_id % 40 AS session, {_PATH} AS path, strlen(html) AS bytes FROM pages)
SELECT session, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, session % 4 <> 3 AS archived FROM f
WHERE session % 4 = 3 OR NOT (starts_with(path, 'Papierkorb/') OR lower(string_split(path, '.')[-1]) = 'heic') GROUP BY session""",
    "j1_ordered_pages": f"""WITH {LINES_SQL}, p AS (SELECT book AS session, page_no, CAST(sum(n) AS BIGINT) AS characters FROM lines GROUP BY ALL)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY page_no DESC) AS position, 'p' || page_no AS page, characters FROM p""",
    "j2_page_texts": f"WITH {LINES_SQL} SELECT book, page_no, count(*) FILTER (WHERE conf_pct >= 90) AS n_lines FROM lines GROUP BY ALL",
    "a6_session_rollup": f"WITH {_ROLLUP} SELECT * FROM r",
    "a7_library_total": f"WITH {_ROLLUP} SELECT CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(trash_bytes) AS BIGINT) AS trash_bytes, count(*) AS sessions FROM r",
    "s14_best_formats": """WITH f AS (SELECT p_brand AS device, p_size * 16 + p_partkey % 7 AS width, p_size * 9 AS height FROM part WHERE p_partkey % 30 >= 10),
b AS (SELECT device, arg_max(width, (width * height, width, height)) AS width, arg_max(height, (width * height, width, height)) AS height FROM f GROUP BY device)
SELECT device, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(width * height AS BIGINT) AS pixels FROM b""",
    "x23_camera_names": """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Desk (' || p_brand || ')' ELSE p_brand END
WHEN p_partkey % 4 = 2 THEN 'Camera at ' || p_brand ELSE p_brand END || ' · ' || printf('%.1f MP', p_size / 10) AS camera FROM part""",
    "s21_export_names": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Buchscan ' || strftime(o_orderdate, '%Y-%m-%d %H-%M') ELSE
trim(left(trim(regexp_replace(replace(o_orderpriority || ': No. ', ':', ' '), '\\s+', ' ', 'g')), 80), '. ') END || '.pdf' AS file,
strftime(o_orderdate, '%Y-%m-%d %H-%M-%S') AS directory, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, true AS round_trip FROM orders""",
}
