"""Pixel size and orientation from the headers of JPEG and PNG files, without decoding; whatever is broken is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.arrays import let
from folio.sources.sessions import media_type, png_size
from folio.sources.tables import table

# Markers of JPEG segments and the orientation tag of EXIF.
START_OF_FRAME = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
ALONE = (0x01, *range(0xD0, 0xD9))
END_OF_HEADER = (0xD9, 0xDA)
APP1 = 0xE1
EXIF = "457869660000"
ORIENTATION = 0x0112
SHORT = 3

_STATE = "struct<at: int, open: boolean, width: int, height: int, exif: int>"


def number(content: Column, at: Column, size: int, little: Column | None = None) -> Column:
    """The unsigned number in ``size`` bytes from place ``at`` (from 1), high byte first unless ``little``; null if they are not all there."""
    def value(part: Column) -> Column:
        digits = F.hex(part)
        if little is not None:
            digits = F.when(little, F.concat(*[F.hex(F.substring(part, i, 1)) for i in range(size, 0, -1)])).otherwise(digits)
        return F.when(F.length(part) == size, F.conv(digits, 16, 10).cast("long"))

    return F.when(at >= 1, let(F.substring(content, at, F.lit(size)), value))


def _walk(content: Column) -> Column:
    """The state at the end of the header: where the walk stands, whether it goes on, the frame's size and the place of the EXIF block.

    A step passes a segment or a fill byte, so there are no more steps than bytes. They are taken in rounds, as many as the
    root of the bytes and of as many steps; once the walk has ended, what is left are rounds that do nothing.
    """

    def step(state: Column, _: Column) -> Column:
        at = state["at"]

        def segment(s: Column) -> Column:
            marker, length = s["marker"], s["length"]
            fill = (s["lead"] == 0xFF) & (marker == 0xFF)
            whole = (s["lead"] == 0xFF) & (marker.isin(*ALONE) | ((length >= 2) & (at + 1 + length <= F.length(content))))
            goes_on = F.coalesce(fill | (whole & ~marker.isin(*END_OF_HEADER)), F.lit(False))
            kind = F.when(~goes_on, "end").when(fill, "fill").when(marker.isin(*ALONE), "alone").when(marker.isin(*START_OF_FRAME) & (length >= 8), "frame").when(marker == APP1, "app")
            return let(F.coalesce(kind, F.lit("other")), lambda k: passed(s, k))

        def passed(s: Column, kind: Column) -> Column:
            size = lambda place, old: F.when((kind == "frame") & state["width"].isNull(), F.nullif(number(content, at + place, 2), F.lit(0))).otherwise(old)
            exif = (kind == "app") & state["exif"].isNull() & (F.hex(F.substring(content, at + 4, F.lit(6))) == EXIF)
            return F.struct(
                F.when(kind == "fill", at + 1).when(kind == "alone", at + 2).otherwise(at + 2 + s["length"]).cast("int").alias("at"), (kind != "end").alias("open"),
                size(7, state["width"]).cast("int").alias("width"), size(5, state["height"]).cast("int").alias("height"), F.when(exif, at + 10).otherwise(state["exif"]).cast("int").alias("exif"),
            ).cast(_STATE)

        here = F.struct(number(content, at, 1).alias("lead"), number(content, at + 1, 1).alias("marker"), number(content, at + 2, 2).alias("length"))
        return F.when(state["open"], let(here, segment)).otherwise(state)

    start = F.struct(F.lit(3), F.lit(True), F.lit(None), F.lit(None), F.lit(None)).cast(_STATE)
    root = F.sequence(F.lit(1), F.ceil(F.sqrt(F.length(content))).cast("int"))
    return F.aggregate(root, start, lambda state, _: F.when(state["open"], F.aggregate(root, state, step)).otherwise(state))


def _exif_orientation(content: Column, tiff: Column) -> Column:
    """The orientation in the first directory of the EXIF block that begins at ``tiff``; null if there is none from 1 to 8."""
    def entries(little: Column, directory: Column) -> Column:
        def oriented_as(place: Column) -> Column:
            return let(number(content, place + 8, 2, little), lambda v: F.when(v.between(1, 8), v.cast("int")))

        def first(count: Column) -> Column:
            places = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: directory + 12 * i - 10)
            named = F.filter(places, lambda p: (number(content, p, 2, little) == ORIENTATION) & (number(content, p + 2, 2, little) == SHORT) & (number(content, p + 4, 4, little) == 1))
            return F.when(count >= 1, let(F.get(named, F.lit(0)), oriented_as))

        return let(number(content, directory, 2, little), first)

    def inside(order: Column) -> Column:
        # A directory that would begin behind the file holds nothing; the sum stays inside an int.
        start = lambda little: tiff + F.least(number(content, tiff + 4, 4, little), F.length(content).cast("long")).cast("int")
        read = let(order == "49492A00", lambda little: let(start(little), lambda at: entries(little, at)))
        return F.when(order.isin("49492A00", "4D4D002A"), read)

    return let(F.hex(F.substring(content, tiff, F.lit(4))), inside)


def _jpeg(content: Column) -> Column:
    def found(state: Column) -> Column:
        orientation = F.when(state["exif"].isNotNull(), _exif_orientation(content, state["exif"]))
        named = F.struct(state["width"].alias("width"), state["height"].alias("height"), F.coalesce(orientation, F.lit(1)).alias("orientation"))
        return F.when(state["width"].isNotNull() & state["height"].isNotNull(), named)

    return F.when(F.hex(F.substring(content, 1, 2)) == "FFD8", let(_walk(content), found))


def _header(content: Column) -> Column:
    png = let(png_size(content), lambda s: F.when((s["width"] > 0) & (s["height"] > 0), F.struct(s["width"].alias("width"), s["height"].alias("height"), F.lit(1).alias("orientation"))))
    return F.when(media_type(content) == "png", png).otherwise(_jpeg(content))


def image_header(content: Column) -> Column:
    """Struct (width, height, orientation) of a JPEG or PNG file as stored, before it is turned; null for others.

    A JPEG file is walked segment by segment up to the image data. It is null too if that walk ends, or meets a broken
    segment, before a frame with a size; segments behind a broken one are not read. The orientation is 1 where no EXIF block
    names another. The bytes are bound once: a column's bytes would be copied whole at each look.
    """
    return let(content, _header)


def oriented(header: Column) -> Column:
    """Struct (width, height) as shown: orientations from 5 on lie on their side."""
    side = header["orientation"] >= 5
    return F.when(header.isNotNull(), F.struct(F.when(side, header["height"]).otherwise(header["width"]).alias("width"), F.when(side, header["width"]).otherwise(header["height"]).alias("height")))


#: What the query takes from a document: the file's size, its orientation and its kind, shared by Spark and DuckDB.
_FACTS = """doc_id, CAST(100 + doc_id * 37 % 4000 AS INT) AS width, CAST(1 + n % 5000 AS INT) AS height, CAST(doc_id % 10 AS INT) AS turn, CAST(doc_id % 7 AS INT) AS kind"""


def _header_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): for every document the head of an image file with its text as the comment segments.

    By kind: 0 little-endian EXIF, 1 big-endian EXIF, 2 none, 3 a PNG, 4 cut off before the frame, 5 EXIF behind 80 fill bytes and the
    frame, 6 no image.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = docs.selectExpr(*_FACTS.split(", CAST")[:1], *["CAST" + x for x in _FACTS.split(", CAST")[1:]], "text")
    big = lambda value, digits: F.lpad(F.hex(value.cast("long")), digits, "0")
    small = lambda value, digits: F.rpad(F.regexp_replace(F.reverse(big(value, digits)), "(.)(.)", "$2$1"), digits, "0")

    def exif(mark: str, put) -> Column:
        entry = lambda tag, value: F.concat(put(F.lit(tag), 4), put(F.lit(SHORT), 4), put(F.lit(1), 8), put(value, 4), F.lit("0000"))
        tiff = F.concat(F.lit(mark), put(F.lit(8), 8), put(F.lit(2), 4), entry(0x0100, F.col("width")), entry(ORIENTATION, F.col("turn")), F.lit("00000000"))
        return F.concat(F.lit("FFE1"), big(F.length(tiff) / 2 + 8, 4), F.lit(EXIF), tiff)

    # The text in comment segments of at most 60,000 bytes each.
    digits = F.hex(F.col("text").cast("binary"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 120000).cast("int")), lambda i: F.substring(digits, i * 120000 + 1, F.lit(120000)))
    notes = F.array_join(F.transform(cuts, lambda c: F.concat(F.lit("FFFE"), big(F.length(c) / 2 + 2, 4), c)), "")
    frame = F.concat(F.lit("FFC0001108"), big(F.col("height"), 4), big(F.col("width"), 4), F.lit("03012200021101031101"))
    scan, start = F.lit("FFDA000C03010002110311003F00"), F.lit("FFD8")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(F.col("width"), 8), big(F.col("height"), 8), F.lit("0802000000"))
    little, high = exif("49492A00", small), exif("4D4D002A", big)
    whole = (
        F.when(F.col("kind") == 0, F.concat(start, little, notes, frame, scan)).when(F.col("kind") == 1, F.concat(start, notes, high, frame, scan))
        .when(F.col("kind") == 2, F.concat(start, notes, frame, scan)).when(F.col("kind") == 3, png).when(F.col("kind") == 4, F.concat(start, little, notes))
        .when(F.col("kind") == 5, F.concat(start, F.lit("FF" * 80), notes, frame, little, scan)).otherwise(digits)
    )
    return rows.select("doc_id", F.unhex(whole).alias("content"))


def s7_image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and orientation of image files made of every document, read back from their bytes."""
    rows = _header_files(spark, sf_dir).select("doc_id", image_header(F.col("content")).alias("h"))
    shown = oriented(F.col("h"))
    return rows.select("doc_id", "h.width", "h.height", "h.orientation", shown["width"].alias("shown_width"), shown["height"].alias("shown_height"))


QUERIES = {"s7_image_headers": s7_image_headers}
SQL = {
    "s7_image_headers": f"""WITH f AS (SELECT {_FACTS} FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)),
h AS (SELECT doc_id, CASE WHEN kind NOT IN (4, 6) THEN width END AS width, CASE WHEN kind NOT IN (4, 6) THEN height END AS height,
             CASE WHEN kind IN (4, 6) THEN NULL WHEN kind IN (0, 1, 5) AND turn BETWEEN 1 AND 8 THEN turn ELSE 1 END AS orientation FROM f)
SELECT *, CASE WHEN orientation >= 5 THEN height ELSE width END AS shown_width, CASE WHEN orientation >= 5 THEN width ELSE height END AS shown_height FROM h"""
}
