"""Sessions as the result of an ordered log of edits, replayed in the JVM.

An edit is a row (session, seq, kind, page, new_pages, target, text, settings):

- ``add``: new pages at the end; ``insert``: new pages right behind a page; ``replace``: the same, and the page is thrown away;
- ``move``: a page before a target, to the end without or with an unknown one; ``order``: ``new_pages`` is the order wished for;
- ``trash``: ``new_pages`` are thrown away, unknown ones are passed over; ``restore``: the page thrown away last comes back
  before a target or at the end, the trash being a stack;
- ``status``: text becomes a page's status; ``title``: the trimmed text, nothing if empty; ``settings``: taken as they are.

Pages are numbered by a counter that never goes back, and files are named by it. An edit of an unknown page (``insert``,
``replace``, ``move``, ``status``), or with no new page (``insert``, ``replace``), changes nothing but the list of errors.

Replaying a log in slices gives the same state as at once, so a long log is a number of replays with the states written in
between, and a stream of edits is a replay a micro-batch. Edits of one session run one after another; sessions are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.arrays import last, let
from folio.operators.sessions import insert_after, move_before, set_order
from folio.sources.tables import table

_PAGES = "array<struct<id: string, file: string, status: string>>"
_SETTINGS = "struct<split_mode: string, crop: boolean, rotate: boolean>"
#: What a session is; a session without a state starts empty.
STATE = f"struct<page_order: array<string>, pages: {_PAGES}, trashed: {_PAGES}, counter: int, title: string, settings: {_SETTINGS}, errors: array<struct<seq: bigint, page: string>>>"
EDIT = f"struct<seq: bigint, kind: string, page: string, new_pages: array<string>, target: string, text: string, settings: {_SETTINGS}>"
KINDS = ("add", "insert", "replace", "move", "order", "trash", "restore", "status", "title", "settings")
#: White space and line ends around a title.
AROUND = r"^[\p{Z}\t\n-\r]+|[\p{Z}\t\n-\r]+$"


def no_state() -> Column:
    """The state of a session before its first edit."""
    nothing = F.lit(None)
    settings = F.struct(F.lit("automatic").alias("split_mode"), F.lit(True).alias("crop"), F.lit(True).alias("rotate"))
    return F.struct(
        F.array().cast("array<string>").alias("page_order"), F.array().cast(_PAGES).alias("pages"), F.array().cast(_PAGES).alias("trashed"), F.lit(0).alias("counter"),
        nothing.cast("string").alias("title"), settings.alias("settings"), F.array().cast("array<struct<seq: bigint, page: string>>").alias("errors"),
    ).cast(STATE)


def _with(state: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        state = state.withField(name, value)
    return state.cast(STATE)


def _grown(state: Column, new: Column) -> Column:
    """The state with records of new pages; where they stand is still open."""
    number = lambda i: state["counter"] + i + 1
    records = F.transform(new, lambda p, i: F.struct(p.alias("id"), F.format_string("Aufnahme-%04d.heic", number(i)).alias("file"), F.lit("pending").alias("status")))
    return _with(state, pages=F.concat(state["pages"], records.cast(_PAGES)), counter=state["counter"] + F.size(new))


def _without(state: Column, ids: Column) -> Column:
    """The state after known ones of these pages went to the trash, in their order."""

    def thrown(ids: Column) -> Column:
        found = F.transform(ids, lambda x: F.get(F.filter(state["pages"], lambda p: p["id"] == x), F.lit(0)))
        gone = F.filter(found, lambda p: p.isNotNull())
        left = F.filter(state["pages"], lambda p: ~F.array_contains(ids, p["id"]))
        known = F.transform(gone, lambda p: p["id"])
        return _with(state, pages=left, page_order=F.filter(state["page_order"], lambda x: ~F.array_contains(known, x)), trashed=F.concat(state["trashed"], gone))

    return let(F.array_distinct(ids), thrown)


def _restored(state: Column, target: Column) -> Column:
    """The state after the page thrown away last came back."""
    page = last(state["trashed"])
    order = move_before(F.array_append(state["page_order"], page["id"]), page["id"], target)
    back = _with(state, pages=F.array_append(state["pages"], page), page_order=order, trashed=F.slice(state["trashed"], 1, F.size(state["trashed"]) - 1))
    return F.when(F.size(state["trashed"]) == 0, state).otherwise(back)


def edited(state: Column, edit: Column) -> Column:
    """A session's state after one edit."""
    kind, page, order = edit["kind"], edit["page"], state["page_order"]
    new = F.coalesce(edit["new_pages"], F.array().cast("array<string>"))
    refused = _with(state, errors=F.array_append(state["errors"], F.struct(edit["seq"].alias("seq"), page.alias("page"))))
    stands = F.coalesce(F.array_contains(order, page), F.lit(False))
    has_record = F.exists(state["pages"], lambda p: p["id"] == page)
    inserted = _with(_grown(state, new), page_order=insert_after(order, page, new))
    status = _with(state, pages=F.transform(state["pages"], lambda p: F.when(p["id"] == page, p.withField("status", edit["text"])).otherwise(p)))
    title = F.regexp_replace(edit["text"], AROUND, "")
    return (
        F.when(kind == "add", _with(_grown(state, new), page_order=F.concat(order, new)))
        .when(kind.isin("insert", "replace") & (~stands | (F.size(new) == 0)), refused)
        .when(kind == "insert", inserted)
        .when(kind == "replace", let(inserted, lambda s: _without(s, F.array(page))))
        .when(kind == "move", F.when(stands, _with(state, page_order=move_before(order, page, edit["target"]))).otherwise(refused))
        .when(kind == "order", _with(state, page_order=set_order(order, new)))
        .when(kind == "trash", _without(state, new))
        .when(kind == "restore", _restored(state, edit["target"]))
        .when(kind == "status", F.when(has_record, status).otherwise(refused))
        .when(kind == "title", _with(state, title=F.nullif(title, F.lit(""))))
        .when(kind == "settings", _with(state, settings=F.coalesce(edit["settings"], state["settings"])))
        .otherwise(state)
    )


def replay(sessions: DataFrame, edits: DataFrame) -> DataFrame:
    """(session, state) of all sessions (session, state) after their edits; sessions that only edits name begin empty."""
    fields = ("seq", "kind", "page", "new_pages", "target", "text", "settings")
    logs = edits.groupBy("session").agg(F.sort_array(F.collect_list(F.struct(*fields).cast(EDIT))).alias("log"))
    both = sessions.select("session", "state").join(logs, "session", "full")
    start = F.coalesce(F.col("state").cast(STATE), no_state())
    return both.select("session", F.when(F.col("log").isNull(), start).otherwise(F.aggregate("log", start, edited)).alias("state"))


def replay_in_slices(sessions: DataFrame, edits: DataFrame, folder: str, length: int = 10_000) -> DataFrame:
    """``replay`` for logs of any length: at most ``length`` edits of a session at a time, states written to ``folder`` in between.

    Edits must have distinct seq within a session. A place in the log is counted by ranges of seq, so that no task sorts a whole log.
    """
    spark = sessions.sparkSession
    spans = edits.withColumn("span", F.floor(F.col("seq") / length).cast("long"))
    spans.write.mode("overwrite").partitionBy("span").parquet(f"{folder}/log")
    kinds = spans.schema
    order = [r.span for r in spans.select("span").distinct().orderBy("span").collect()]
    states = sessions.select("session", F.col("state").cast(STATE).alias("state"))
    for number, span in enumerate(order):
        part = spark.read.schema(kinds).parquet(f"{folder}/log").where(F.col("span") == span).drop("span")
        path = f"{folder}/states-{number}"
        replay(states, part).write.mode("overwrite").parquet(path)
        states = spark.read.parquet(path)
    return states


def page_by_id(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session, page, file, status, place) of the asked (session, page), place from 1 in the order; pages not there are left out."""
    records = sessions.select("session", F.col("state.page_order").alias("o"), F.explode("state.pages").alias("p"))
    records = records.select("session", F.col("p.id").alias("page"), "p.file", "p.status", F.array_position("o", F.col("p.id")).alias("place"))
    return records.join(wanted.select("session", "page").distinct(), ["session", "page"], "left_semi")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order of time as the log of one session: kinds by event_id, pages by their number in the session."""
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.row_number().over(place).cast("long").alias("seq"))
    kind = F.element_at(F.array(*map(F.lit, ("add", *KINDS))), (F.pmod(F.col("event_id") * 7 + F.col("seq"), F.lit(len(KINDS) + 1)) + 1).cast("int"))
    some = lambda k: F.concat(F.lit("p"), F.pmod(F.col("event_id") * k, F.col("seq") + 2).cast("string"))
    fresh = F.transform(F.sequence(F.lit(0), F.pmod("event_id", F.lit(3))), lambda i: F.concat(F.lit("p"), (F.col("seq") * 3 + i).cast("string")))
    kept = F.array(some(11), some(13), F.lit("zz"), some(11))
    settings = F.struct(F.element_at(F.array(F.lit("none"), F.lit("middle")), F.pmod("event_id", F.lit(2)).cast("int") + 1).alias("split_mode"), (F.col("event_id") % 3 == 0).alias("crop"), F.lit(False).alias("rotate"))
    rows = rows.withColumn("kind", kind).withColumn("page", some(5))
    return rows.select(
        "session", "seq", "kind", "page",
        F.when(F.col("kind").isin("add", "replace"), fresh).when(F.col("kind") == "insert", F.slice(fresh, 1, F.pmod("event_id", F.lit(4)).cast("int"))).when(F.col("kind").isin("order", "trash"), kept).alias("new_pages"),
        F.when(F.col("event_id") % 4 != 0, some(17)).alias("target"),
        F.when(F.col("kind") == "status", F.lit("done")).when(F.col("kind") == "title", F.concat(F.lit(" \n"), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("No. "), F.col("seq").cast("string"))), F.lit("\t"))).alias("text"),
        settings.alias("settings"),
    )


def m_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session after its whole log."""
    empty = spark.createDataFrame([], f"session long, state {STATE}")
    state = replay(empty, _log(spark, sf_dir)).select("session", "state.*")
    listed = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["id"], p["file"], p["status"])), ",")
    errors = F.array_join(F.transform("errors", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["page"])), ",")
    return state.select(
        "session", F.array_join("page_order", ",").alias("page_order"), listed("pages").alias("pages"), listed("trashed").alias("trashed"), F.col("counter").cast("long").alias("counter"),
        F.coalesce("title", F.lit("-")).alias("title"), F.concat_ws(",", "settings.split_mode", F.col("settings.crop").cast("string")).alias("settings"), errors.alias("errors"),
    )


def d15_pages_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session the page numbered like its user, and one that no session has."""
    empty = spark.createDataFrame([], f"session long, state {STATE}")
    states = replay(empty, _log(spark, sf_dir))
    wanted = states.select("session", F.explode(F.array(F.concat(F.lit("p"), F.pmod("session", F.lit(40)).cast("string")), F.lit("zz"))).alias("page"))
    return page_by_id(states, wanted).withColumn("place", F.col("place").cast("long"))


QUERIES = {"m_edit_log": m_edit_log, "d15_pages_by_id": d15_pages_by_id}
_IDS = "list_transform(pages, lambda p: p.id)"
#: The log, and the states after each edit as a recursive query.
LOG_SQL = f"""ev AS (SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
ek AS (SELECT *, [{", ".join(f"'{k}'" for k in ("add", *KINDS))}][(event_id * 7 + seq) % {len(KINDS) + 1} + 1] AS kind, 'p' || (event_id * 5) % (seq + 2) AS page FROM ev),
lg AS (SELECT session, seq, event_id, kind, page, CASE WHEN kind IN ('add', 'replace') THEN list_transform(range(0, event_id % 3 + 1), lambda i: 'p' || (seq * 3 + i))
              WHEN kind = 'insert' THEN list_transform(range(0, event_id % 3 + 1), lambda i: 'p' || (seq * 3 + i))[1:event_id % 4]
              WHEN kind IN ('order', 'trash') THEN ['p' || (event_id * 11) % (seq + 2), 'p' || (event_id * 13) % (seq + 2), 'zz', 'p' || (event_id * 11) % (seq + 2)] ELSE [] END AS fresh,
              CASE WHEN event_id % 4 <> 0 THEN 'p' || (event_id * 17) % (seq + 2) END AS target FROM ek),
st AS (SELECT session, CAST(0 AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS ord, CAST([] AS STRUCT(id VARCHAR, no BIGINT, status VARCHAR)[]) AS pages, CAST([] AS STRUCT(id VARCHAR, no BIGINT, status VARCHAR)[]) AS bin,
              CAST(0 AS BIGINT) AS counter, CAST(NULL AS VARCHAR) AS title, 'automatic,true' AS settings, CAST([] AS VARCHAR[]) AS errors FROM (SELECT DISTINCT session FROM lg)
 UNION ALL
 SELECT session, seq,
   CASE WHEN bad THEN ord WHEN kind = 'add' THEN list_concat(ord, fresh) WHEN kind = 'insert' THEN list_concat(ord[1:pos], fresh, ord[pos + 1:])
        WHEN kind = 'replace' THEN list_concat(ord[1:pos - 1], fresh, ord[pos + 1:]) WHEN kind = 'move' AND target IS NOT DISTINCT FROM page THEN ord
        WHEN kind = 'move' THEN CASE WHEN list_contains(rest, target) THEN list_concat(rest[1:list_position(rest, target) - 1], [page], rest[list_position(rest, target):]) ELSE list_append(rest, page) END
        WHEN kind = 'order' THEN list_concat(wish, list_filter(ord, lambda x: NOT list_contains(wish, x))) WHEN kind = 'trash' THEN list_filter(ord, lambda x: NOT list_contains(fresh, x))
        WHEN kind = 'restore' AND len(bin) > 0 THEN CASE WHEN list_contains(ord, target) THEN list_concat(ord[1:list_position(ord, target) - 1], [bin[-1].id], ord[list_position(ord, target):]) ELSE list_append(ord, bin[-1].id) END ELSE ord END,
   CASE WHEN bad THEN pages WHEN kind IN ('add', 'insert') THEN list_concat(pages, recs) WHEN kind = 'replace' THEN list_filter(list_concat(pages, recs), lambda p: p.id <> page)
        WHEN kind = 'trash' THEN list_filter(pages, lambda p: NOT list_contains(fresh, p.id)) WHEN kind = 'restore' AND len(bin) > 0 THEN list_append(pages, bin[-1])
        WHEN kind = 'status' THEN list_transform(pages, lambda p: CASE WHEN p.id = page THEN {{'id': p.id, 'no': p.no, 'status': 'done'}} ELSE p END) ELSE pages END,
   CASE WHEN bad THEN bin WHEN kind = 'replace' THEN list_concat(bin, list_filter(pages, lambda p: p.id = page))
        WHEN kind = 'trash' THEN list_concat(bin, list_filter(pages, lambda p: p.id = fresh[1]), CASE WHEN fresh[2] <> fresh[1] THEN list_filter(pages, lambda p: p.id = fresh[2]) ELSE [] END)
        WHEN kind = 'restore' AND len(bin) > 0 THEN bin[1:len(bin) - 1] ELSE bin END,
   counter + CASE WHEN NOT bad AND kind IN ('add', 'insert', 'replace') THEN len(fresh) ELSE 0 END,
   CASE WHEN kind = 'title' THEN CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'No. ' || seq END ELSE title END,
   CASE WHEN kind = 'settings' THEN CASE WHEN event_id % 2 = 0 THEN 'none' ELSE 'middle' END || ',' || (event_id % 3 = 0) ELSE settings END,
   CASE WHEN bad THEN list_append(errors, seq || ':' || page) ELSE errors END
 FROM (SELECT *, kind IN ('insert', 'replace') AND (pos = 0 OR len(fresh) = 0) OR kind = 'move' AND pos = 0 OR kind = 'status' AND NOT list_contains({_IDS}, page) AS bad FROM
   (SELECT lg.*, ord, pages, bin, counter, title, settings, errors, coalesce(list_position(ord, page), 0) AS pos, list_filter(ord, lambda x: x <> page) AS rest,
           list_transform(range(1, len(fresh) + 1), lambda i: {{'id': fresh[i], 'no': counter + i, 'status': 'pending'}}) AS recs,
           list_filter(CASE WHEN fresh[1] = fresh[2] THEN fresh[1:1] ELSE fresh[1:2] END, lambda x: list_contains(ord, x)) AS wish
    FROM st JOIN lg ON lg.session = st.session AND lg.seq = st.seq + 1))),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) = 1)"""
_FILE = "printf('Aufnahme-%04d.heic', p.no)"
SQL = {
    "m_edit_log": f"""WITH RECURSIVE {LOG_SQL}
SELECT session, array_to_string(ord, ',') AS page_order, array_to_string(list_transform(pages, lambda p: p.id || ':' || {_FILE} || ':' || p.status), ',') AS pages,
array_to_string(list_transform(bin, lambda p: p.id || ':' || {_FILE} || ':' || p.status), ',') AS trashed, counter, coalesce(title, '-') AS title, settings, array_to_string(errors, ',') AS errors FROM fin""",
    "d15_pages_by_id": f"""WITH RECURSIVE {LOG_SQL}
SELECT session, p.id AS page, {_FILE} AS file, p.status AS status, list_position(ord, p.id)::BIGINT AS place FROM (SELECT session, ord, unnest(pages) AS p FROM fin) WHERE p.id = 'p' || session % 40""",
}
