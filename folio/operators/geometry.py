"""Page geometry: reading order, orientation, rotated boxes, text-free gaps and cuts, render resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.arrays import each_row, gathered
from folio.sources.tables import LINES_SQL, lines, table


def reading_order(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Indices of (x, y, w, h) boxes, origin at the bottom left, by rows from top to bottom, in a row from left to right.

    A line joins the last row only if it stands beside every member: much vertical overlap, hardly any horizontal.
    """
    middle = lambda b: b[1] + b[3] / 2

    def beside(a: tuple, b: tuple) -> bool:
        down = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        across = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        return down > 0.5 * min(a[3], b[3]) and across < 0.2 * min(a[2], b[2])

    rows: list[list[int]] = []
    for i in sorted(range(len(boxes)), key=lambda i: -middle(boxes[i])):
        if rows and all(beside(boxes[i], boxes[j]) for j in rows[-1]):
            rows[-1].append(i)
        else:
            rows.append([i])
    return [i for row in rows for i in sorted(row, key=lambda i: boxes[i][0])]


def in_reading_order(rows: DataFrame) -> DataFrame:
    """(book, page_no, line_no, place): a fold over each page's lines with x, y, w, h, from their line_no on ties."""

    def order(row: dict) -> Iterator[tuple]:
        page = row["members"]
        for place, i in enumerate(reading_order([(b["x"], b["y"], b["w"], b["h"]) for b in page])):
            yield row["book"], row["page_no"], page[i]["line_no"], place

    kinds = [("book", pa.int64()), ("page_no", pa.int32()), ("line_no", pa.int32()), ("place", pa.int32())]
    pages = gathered(rows, ["book", "page_no"], "line_no", "x", "y", "w", "h")
    return each_row(pages, order, "book long, page_no int, line_no int, place int", pa.schema(kinds))


def quadrant(angle: Column) -> Column:
    """Quarter turns that put a line of this baseline angle upright, 0 to 3; halves round away from zero."""
    return F.pmod(-F.round(angle / (F.pi() / 2)), F.lit(4)).cast("int")


def baseline_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.atan2(y1 - y0, x1 - x0)


def orientation(rows: DataFrame) -> DataFrame:
    """(book, page_no, turn): the quarter turns with most confident characters; the smallest on ties; 0 without a vote."""
    votes = rows.where("conf_pct >= 30").groupBy("book", "page_no", quadrant(F.col("angle")).alias("turn")).agg(F.sum(F.col("conf_pct") * F.greatest("n", F.lit(1))).alias("votes"))
    best = votes.groupBy("book", "page_no").agg(F.max_by("turn", F.struct("votes", -F.col("turn"))).alias("turn"))
    pages = rows.select("book", "page_no").distinct()
    return pages.join(best, ["book", "page_no"], "left").withColumn("turn", F.coalesce("turn", F.lit(0)).cast("long"))


def rotated_box(turns: Column, x: Column, y: Column, w: Column, h: Column, unit: int = 1) -> dict[str, Column]:
    """The bounding box after quarter turns, in a page of size ``unit``."""
    pick = lambda zero, one, two, three: F.when(turns == 1, one).when(turns == 2, two).when(turns == 3, three).otherwise(zero)
    return {
        "x": pick(x, unit - y - h, unit - x - w, y),
        "y": pick(y, x, unit - y - h, unit - x - w),
        "w": pick(w, h, w, h),
        "h": pick(h, w, h, w),
    }


def is_double_page(width: Column, height: Column) -> Column:
    return width / F.greatest(height, F.lit(1)) >= 1.15


def cut_tests(rows: DataFrame, cut: int = 500) -> DataFrame:
    """Per page: whether text crosses the cut, and whether text stands on both sides of it (thousandths)."""
    usable = (F.col("conf_pct") >= 50) & (F.col("w_mil") >= 50)
    left, right = F.col("x_mil"), F.col("x_mil") + F.col("w_mil")
    crossing = (F.col("conf_pct") >= 30) & (F.col("w_mil") > 0) & (100 * (cut - left) >= 15 * F.col("w_mil")) & (100 * (right - cut) >= 15 * F.col("w_mil"))
    both = F.bool_or(usable & (right < cut - 20)) & F.bool_or(usable & (left > cut + 20))
    return rows.groupBy("book", "page_no").agg(F.bool_or(crossing).alias("crosses"), F.coalesce(both, F.lit(False)).alias("both_sides"))


def text_free_gap(rows: DataFrame) -> DataFrame:
    """(book, page_no, lo, hi): the widest run of columns without text between text, its centre in the page's middle."""
    usable = rows.where("conf_pct >= 50 AND w_mil >= 50").withColumn("last", F.least(F.lit(999), F.col("x_mil") + F.col("w_mil")))
    page = Window.partitionBy("book", "page_no")
    before = page.orderBy("x_mil", "last").rowsBetween(Window.unboundedPreceding, -1)
    runs = usable.withColumn("n", F.count("*").over(page)).withColumn("lo", F.max("last").over(before) + 1).withColumn("hi", F.col("x_mil") - 1)
    runs = runs.where("n >= 4 AND hi - lo >= 9 AND lo + hi BETWEEN 700 AND 1300")
    widest = runs.groupBy("book", "page_no").agg(F.max_by(F.struct("lo", "hi"), F.struct(F.col("hi") - F.col("lo"), -F.col("lo"))).alias("g"))
    return widest.select("book", "page_no", F.col("g.lo").cast("long").alias("lo"), F.col("g.hi").cast("long").alias("hi"))


def cut_places(pages: DataFrame, profile: DataFrame, rows: DataFrame) -> DataFrame:
    """(book, page_no, cut): where each double page is cut, as a share of its width; null where it stays whole.

    Pages are (book, page_no, mode, width, height), profiles (book, page_no, place, value) the gray value of each column. Mode
    ``middle`` cuts there. ``automatic`` looks for the darkest smoothed column, within the gap between two columns of text if
    there is one (at least 10 below the median of all columns, else the gap's centre), else in the middle third (20, else the
    middle). A cut through text, or one with all text on one side, is none; nor are other modes and pages that are no double pages.
    """
    key = ["book", "page_no"]
    double = pages.where(is_double_page(F.col("width"), F.col("height")) & F.col("mode").isin("middle", "automatic"))
    gaps = double.join(text_free_gap(rows), key, "left")
    bounds = gaps.select(
        *key, "mode", "width", "lo", "hi",
        F.greatest(F.lit(0), F.floor(F.when(F.col("lo").isNull(), F.col("width") * 350).otherwise(F.col("width") * F.col("lo")) / 1000)).alias("left"),
        F.least(F.col("width") - 1, F.floor(F.when(F.col("lo").isNull(), F.col("width") * 650).otherwise(F.col("width") * (F.col("hi") + 1)) / 1000)).alias("right"),
    )
    around = Window.partitionBy(*key).orderBy("place").rowsBetween(-2, 2)
    smooth = profile.withColumn("v", F.sum("value").over(around) / F.count("value").over(around)).join(bounds, key)
    inside = F.col("place").between(F.col("left"), F.col("right")) & (F.col("left") < F.col("right"))
    dark = smooth.groupBy(*key).agg(
        F.min_by("place", F.when(inside, F.struct("v", "place"))).alias("place"), F.min(F.when(inside, F.col("v"))).alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)").alias("median")
    )
    depth = F.when(F.col("lo").isNull(), 20).otherwise(10)
    found = bounds.join(dark, key, "left")
    automatic = F.when(F.col("median") - F.col("low") >= depth, F.col("place") / F.col("width")).otherwise(F.coalesce((F.col("lo") + F.col("hi") + 1) / 2000, F.lit(0.5)))
    cuts = found.select(*key, F.when(F.col("mode") == "middle", F.lit(0.5)).otherwise(automatic).alias("cut"))
    at, left, right = F.col("cut") * 1000, F.col("x_mil"), F.col("x_mil") + F.col("w_mil")
    crossing = (F.col("conf_pct") >= 30) & (F.col("w_mil") > 0) & (100 * (at - left) >= 15 * F.col("w_mil")) & (100 * (right - at) >= 15 * F.col("w_mil"))
    usable = F.coalesce(F.col("conf_pct") >= 30, F.lit(False))
    judged = cuts.join(rows.select(*key, "x_mil", "w_mil", "conf_pct"), key, "left").groupBy(*key, "cut").agg(
        F.bool_or(F.coalesce(crossing, F.lit(False))).alias("crosses"), F.bool_or(usable).alias("text"),
        F.bool_or(usable & F.coalesce(right < at - 20, F.lit(False))).alias("before"), F.bool_or(usable & F.coalesce(left > at + 20, F.lit(False))).alias("behind"),
    )
    stays = F.col("crosses") | (F.col("text") & ~(F.col("before") & F.col("behind")))
    kept = judged.select(*key, F.when(~stays, F.col("cut")).alias("cut"))
    return pages.select(*key).join(kept, key, "left")


def darkest_place(profile: DataFrame, depth: float) -> DataFrame:
    """(book, page_no, place): the first smallest smoothed value of a profile, if that far below its upper median.

    The profile's rows are (book, page_no, place, value); smoothing is the mean of two on either side, cut at the ends.
    """
    around = Window.partitionBy("book", "page_no").orderBy("place").rowsBetween(-2, 2)
    smooth = profile.withColumn("v", F.sum("value").over(around) / F.count("value").over(around))
    low = smooth.groupBy("book", "page_no").agg(
        F.min_by("place", F.struct("v", "place")).alias("place"), F.min("v").alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)").alias("middle")
    )
    return low.where(F.col("middle") - F.col("low") >= depth).select("book", "page_no", F.col("place").cast("long").alias("place"))


def render_dpi(pixels: Column, points: Column) -> Column:
    """Dots per inch of a page's widest embedded image, between 72 and 600; 300 without one."""
    dpi = pixels * 72 / points
    return F.when(pixels.isNull(), 300.0).otherwise(F.least(F.lit(600.0), F.greatest(F.lit(72.0), dpi)))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as two columns, every other line on the right."""
    side = F.col("line_no") % 2
    return lines(spark, sf_dir).withColumn("x_mil", (40 + side * 500 + F.col("book") % 30).cast("int")).withColumn("w_mil", F.least(F.col("n") * 6, F.lit(420)))


def d1_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns whose lines overlap in height: rows of a left and a right line, found again from the boxes."""
    pairs = F.expr("950 - ((line_no % 30) div 2) * 60")
    rows = _columns(spark, sf_dir).select("book", "page_no", "line_no", (F.col("x_mil") / 1000).alias("x"), (pairs / 1000).alias("y"), (F.col("w_mil") / 1000).alias("w"), F.lit(0.04).alias("h"))
    return in_reading_order(rows)


def a3_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("angle", F.expr("((book * 7 + line_no * 13) % 9 - 4) * pi() / 4"))
    return orientation(rows)


def x26_rotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("turns", F.col("line_no") % 4)
    box = rotated_box(F.col("turns"), F.col("x_mil"), F.col("mid_mil"), F.col("w_mil"), F.col("cw_mil"), 1000)
    return rows.select("book", "line_no", *[v.cast("long").alias(k) for k, v in box.items()])


def f5_cut_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_tests(_columns(spark, sf_dir))


def w4_text_free_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_free_gap(_columns(spark, sf_dir))


def w5_darkest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line lengths as a page's profile."""
    return darkest_place(lines(spark, sf_dir).select("book", "page_no", F.col("line_no").alias("place"), F.col("n").alias("value")), 3.0)


def s10_render_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages whose image is p_size * 100 pixels wide, or absent."""
    wide = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 100)
    return table(spark, sf_dir, "part").select("p_partkey", render_dpi(wide, F.lit(500.0)).alias("dpi"), is_double_page(F.col("p_size") * 100, F.lit(2500)).alias("double"))


_MODE = "CASE book % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'middle' ELSE 'automatic' END"
_HEIGHT = "CASE WHEN book % 7 = 3 THEN 64 ELSE 40 END"
#: Every third page has a valley of its own depth and place, and every ninth a line across its middle.
_GRAY = "CAST(150 + (book * 7 + place * 13) % 11 - CASE WHEN (book + page_no) % 3 = 0 AND abs(place - (27 + (book + page_no) % 11)) <= 2 THEN (book * 5 + page_no) % 60 ELSE 0 END AS BIGINT)"


def g5_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of the books' pages as double pages of 64 columns, in all modes; -1 for none."""
    rows = _columns(spark, sf_dir).withColumn("w_mil", F.when(((F.col("book") + F.col("page_no")) % 9 == 0) & (F.col("line_no") % 30 == 4), F.lit(600)).otherwise(F.col("w_mil")))
    rows = rows.where("(book + page_no) % 8 <> 1 OR line_no % 2 = 0")
    pages = lines(spark, sf_dir).select("book", "page_no").distinct()
    profile = pages.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("value", F.expr(_GRAY))
    pages = pages.select("book", "page_no", F.expr(_MODE).alias("mode"), F.lit(64).alias("width"), F.expr(_HEIGHT).alias("height"))
    return cut_places(pages, profile, rows).withColumn("cut", F.coalesce("cut", F.lit(-1.0)))


QUERIES = {
    "g5_cuts": g5_cuts, "d1_reading_order": d1_reading_order, "a3_orientation": a3_orientation, "x26_rotated_boxes": x26_rotated_boxes, "f5_cut_tests": f5_cut_tests,
    "w4_text_free_gap": w4_text_free_gap, "w5_darkest_place": w5_darkest_place, "s10_render_dpi": s10_render_dpi,
}
_COLUMNS = f"{LINES_SQL}, cols AS (SELECT book, page_no, line_no, conf_pct, CAST(40 + line_no % 2 * 500 + book % 30 AS INT) AS x, least(n * 6, 420) AS w FROM lines)"
SQL = {
    "g5_cuts": f"""WITH {_COLUMNS}, ro AS (SELECT book, page_no, conf_pct AS c, x, CASE WHEN (book + page_no) % 9 = 0 AND line_no % 30 = 4 THEN 600 ELSE w END AS w FROM cols WHERE (book + page_no) % 8 <> 1 OR line_no % 2 = 0),
pg AS (SELECT DISTINCT book, page_no, {_MODE} AS mode, {_HEIGHT} AS height FROM lines),
us AS (SELECT *, count(*) OVER (PARTITION BY book, page_no) AS n FROM ro WHERE c >= 50 AND w >= 50),
bi AS (SELECT DISTINCT book, page_no, unnest(range(x, least(999, x + w) + 1)) AS i FROM us WHERE n >= 4),
ru AS (SELECT book, page_no, lag(i) OVER (PARTITION BY book, page_no ORDER BY i) + 1 AS lo, i - 1 AS hi FROM bi),
ga AS (SELECT book, page_no, arg_max(lo, (hi - lo, -lo)) AS lo, arg_max(hi, (hi - lo, -lo)) AS hi FROM ru WHERE hi - lo >= 9 AND lo + hi BETWEEN 700 AND 1300 GROUP BY ALL),
bo AS (SELECT pg.*, lo, hi, CASE WHEN lo IS NULL THEN 22 ELSE 64 * lo // 1000 END AS a, CASE WHEN lo IS NULL THEN 41 ELSE least(63, 64 * (hi + 1) // 1000) END AS z FROM pg LEFT JOIN ga USING (book, page_no)),
pr AS (SELECT book, page_no, place, {_GRAY} AS v FROM (SELECT book, page_no, unnest(range(64)) AS place FROM pg)),
sm AS (SELECT book, page_no, place, sum(v) OVER k / count(*) OVER k AS v FROM pr WINDOW k AS (PARTITION BY book, page_no ORDER BY place ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
da AS (SELECT book, page_no, list_sort(list(v))[33] AS median, min(v) FILTER (WHERE place BETWEEN a AND z AND a < z) AS low, arg_min(place, (v, place)) FILTER (WHERE place BETWEEN a AND z AND a < z) AS place FROM sm JOIN bo USING (book, page_no) GROUP BY ALL),
cu AS (SELECT book, page_no, CASE WHEN mode = 'middle' THEN 0.5::DOUBLE WHEN median - low >= CASE WHEN lo IS NULL THEN 20 ELSE 10 END THEN place / 64 ELSE coalesce((lo + hi + 1) / 2000, 0.5::DOUBLE) END AS cut
       FROM bo JOIN da USING (book, page_no) WHERE mode <> 'none' AND height = 40),
ju AS (SELECT book, page_no, cut, coalesce(bool_or(c >= 30 AND w > 0 AND 100 * (cut * 1000 - x) >= 15 * w AND 100 * (x + w - cut * 1000) >= 15 * w), false) AS crosses, coalesce(bool_or(c >= 30), false) AS has,
              coalesce(bool_or(c >= 30 AND x + w < cut * 1000 - 20), false) AS l, coalesce(bool_or(c >= 30 AND x > cut * 1000 + 20), false) AS r FROM cu LEFT JOIN ro USING (book, page_no) GROUP BY ALL)
SELECT book, page_no, CASE WHEN crosses OR has AND NOT (l AND r) THEN -1.0::DOUBLE ELSE coalesce(cut, -1.0::DOUBLE) END AS cut FROM pg LEFT JOIN ju USING (book, page_no)""",
    "d1_reading_order": f"WITH {LINES_SQL} SELECT book, page_no, line_no, CAST(row_number() OVER (PARTITION BY book, page_no ORDER BY line_no // 2, line_no % 2) - 1 AS INT) AS place FROM lines",
    "a3_orientation": f"""WITH {LINES_SQL}, q AS (SELECT book, page_no, CAST((((-round((((book * 7 + line_no * 13) % 9 - 4) * pi() / 4) / (pi() / 2))) % 4) + 4) % 4 AS BIGINT) AS turn, conf_pct * greatest(n, 1) AS v FROM lines WHERE conf_pct >= 30),
s AS (SELECT book, page_no, turn, sum(v) AS v FROM q GROUP BY ALL), b AS (SELECT book, page_no, arg_max(turn, (v, -turn)) AS turn FROM s GROUP BY ALL)
SELECT DISTINCT book, page_no, coalesce(turn, 0) AS turn FROM lines LEFT JOIN b USING (book, page_no)""",
    "x26_rotated_boxes": f"""WITH {LINES_SQL}, t AS (SELECT book, line_no, line_no % 4 AS t, x_mil AS x, mid_mil AS y, w_mil AS w, cw_mil AS h FROM lines)
SELECT book, line_no, CAST(CASE t WHEN 1 THEN 1000 - y - h WHEN 2 THEN 1000 - x - w WHEN 3 THEN y ELSE x END AS BIGINT) AS x,
CAST(CASE t WHEN 1 THEN x WHEN 2 THEN 1000 - y - h WHEN 3 THEN 1000 - x - w ELSE y END AS BIGINT) AS y,
CAST(CASE WHEN t IN (1, 3) THEN h ELSE w END AS BIGINT) AS w, CAST(CASE WHEN t IN (1, 3) THEN w ELSE h END AS BIGINT) AS h FROM t""",
    "f5_cut_tests": f"""WITH {_COLUMNS} SELECT book, page_no, bool_or(conf_pct >= 30 AND w > 0 AND 100 * (500 - x) >= 15 * w AND 100 * (x + w - 500) >= 15 * w) AS crosses,
bool_or(conf_pct >= 50 AND w >= 50 AND x + w < 480) AND bool_or(conf_pct >= 50 AND w >= 50 AND x > 520) AS both_sides FROM cols GROUP BY ALL""",
    "w4_text_free_gap": f"""WITH {_COLUMNS}, u AS (SELECT book, page_no, x, least(999, x + w) AS z, count(*) OVER (PARTITION BY book, page_no) AS n FROM cols WHERE conf_pct >= 50 AND w >= 50),
c AS (SELECT book, page_no, unnest(range(x, z + 1)) AS i FROM u WHERE n >= 4), d AS (SELECT DISTINCT book, page_no, i FROM c),
g AS (SELECT book, page_no, lag(i) OVER (PARTITION BY book, page_no ORDER BY i) + 1 AS lo, i - 1 AS hi FROM d)
SELECT book, page_no, arg_max(lo, (hi - lo, -lo)) AS lo, arg_max(hi, (hi - lo, -lo)) AS hi FROM g WHERE hi - lo >= 9 AND lo + hi BETWEEN 700 AND 1300 GROUP BY ALL""",
    "w5_darkest_place": f"""WITH {LINES_SQL}, s AS (SELECT book, page_no, line_no, sum(n) OVER k / count(n) OVER k AS v FROM lines WINDOW k AS (PARTITION BY book, page_no ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT book, page_no, arg_min(line_no, (v, line_no)) AS place, min(v) AS low, percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS mid FROM s GROUP BY ALL)
SELECT book, page_no, CAST(place AS BIGINT) AS place FROM m WHERE mid - low >= 3.0""",
    "s10_render_dpi": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN least(600.0::DOUBLE, greatest(72.0::DOUBLE, p_size * 100 * 72 / 500.0::DOUBLE)) ELSE 300.0::DOUBLE END AS dpi, p_size * 100 / 2500::DOUBLE >= 1.15 AS double FROM part",
}
