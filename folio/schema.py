"""Schemas of the page data model and the tunable thresholds of its operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h")])
#: One recognised text row; boxes are fractions of the page, the origin is at the bottom left.
LINE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.FloatType()),
        T.StructField("box", BOX),
        T.StructField("angle", T.DoubleType()),
    ]
)
#: One page file as it is stored: boxes as [[x, y], [w, h]].
PAGE_JSON = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("pageID", T.StringType()),
        T.StructField("pixelWidth", T.IntegerType()),
        T.StructField("pixelHeight", T.IntegerType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("recognizedAt", T.StringType()),
        T.StructField(
            "lines",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("text", T.StringType()),
                        T.StructField("confidence", T.FloatType()),
                        T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))),
                        T.StructField("angle", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fileName", T.StringType()),
        T.StructField("capturedAt", T.StringType()),
        T.StructField("pixelWidth", T.IntegerType()),
        T.StructField("pixelHeight", T.IntegerType()),
        T.StructField("ocrStatus", T.StringType()),
    ]
)
SESSION_JSON = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("createdAt", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField(
            "settings",
            T.StructType(
                [
                    T.StructField("splitMode", T.StringType()),
                    T.StructField("cropEnabled", T.BooleanType()),
                    T.StructField("autoRotate", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("captureCounter", T.IntegerType()),
        T.StructField("pageOrder", T.ArrayType(T.StringType())),
        T.StructField("pages", T.ArrayType(_RECORD)),
        T.StructField("trashed", T.ArrayType(_RECORD)),
        T.StructField("archived", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Confidence:
    """Least confidences by use."""

    typography: float = 0.3
    duplicate_key: float = 0.5
    uncertain: float = 0.5


@dataclass(frozen=True)
class Structure:
    """Ratios of page structuring, against the book's median size, pitch and text width."""

    footnote_size: float = 0.92
    footnote_median: float = 0.85
    footnote_zone: float = 0.38
    heading_1: float = 1.9
    heading_2: float = 1.4
    short_heading: float = 0.7
    spaced: float = 1.5
    same_block: float = 1.6
    short_line: float = 0.15


@dataclass(frozen=True)
class Duplicate:
    """When two pages are one page scanned twice."""

    share: float = 0.6
    least_keys: int = 6
    key_length: int = 12
    window: int = 3


@dataclass(frozen=True)
class Motion:
    """Thresholds of the page-turn trigger on its motion level."""

    moving: float = 6.0
    still: float = 2.5
    settle_seconds: float = 1.5
    tiles_across: int = 16
    quantile: float = 0.25


@dataclass(frozen=True)
class SamePage:
    """When two snapshots show one page."""

    share: float = 0.6
    few_words: int = 12
    least_words: int = 3
    changed_tiles: float = 0.4
    remembered: int = 3
