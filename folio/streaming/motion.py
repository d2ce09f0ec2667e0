"""The page-turn trigger as a state machine, and on a stream of motion levels that come in any order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.schema import Motion
from folio.streaming.ordered import InOrder, in_order

_DAY = 86_400


def step(state: str, since: float | None, at: float, level: float, rule: Motion = Motion()) -> tuple[str, float | None, bool]:
    """State, start of the still time, and whether the page has settled, after one frame.

    Only frames move time: nothing settles unless another frame arrives.
    """
    if level > rule.moving:
        return "moving", None, False
    if level > rule.still:
        return state, None, False
    if state == "idle":
        return state, since, False
    if state == "moving" or since is None:
        return "settling", at, False
    if at - since >= rule.settle_seconds:
        return "idle", None, True
    return state, since, False


def episodes(levels: DataFrame, rule: Motion = Motion(), delay: str = "10 seconds", forget: float = _DAY) -> DataFrame:
    """(stream, event_id, at, kind, seconds) of a stream of motion levels (stream long, event_id long, seconds double, level double).

    ``settled`` rows say where a page lies still after a movement, ``left`` rows repeat such a page's event_id when the next
    movement begins. Frames may come up to ``delay`` late, in event time; later ones are lost, as a camera drops late frames. A
    stream at rest whose last page was left keeps no state; any other is forgotten ``forget`` seconds after its last frame,
    and frames after such a gap begin a new stream.
    """

    def fold(key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        name, since, page = state or ("idle", -1.0, -1)
        since = None if since < 0 else since
        out = []
        for _, event, seconds, level in rows:
            moves = level > rule.moving
            if moves and page >= 0:
                out.append((key[0], page, pd.Timestamp(seconds, unit="s"), "left", seconds))
                page = -1
            name, since, fires = step(name, since, seconds, level, rule)
            if fires:
                page = event
                out.append((key[0], event, pd.Timestamp(seconds, unit="s"), "settled", seconds))
        at_rest = name == "idle" and page < 0
        return (None if at_rest else (name, -1.0 if since is None else since, page)), out

    fields = "micros long, event_id long, seconds double, level double"
    machine = InOrder(fields, "name string, since double, page long", ["stream", "event_id", "at", "kind", "seconds"], fold, round(forget * 1e6))
    timed = levels.select("stream", "event_id", F.col("seconds").cast("double").alias("seconds"), F.col("level").cast("double").alias("level"), F.timestamp_micros(F.round(F.col("seconds") * 1_000_000).cast("long")).alias("at"))
    timed = timed.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    return in_order(timed, "stream", machine, "stream long, event_id long, at timestamp, kind string, seconds double", "at")


def settled_pages(levels: DataFrame, rule: Motion = Motion(), delay: str = "10 seconds", forget: float = _DAY) -> DataFrame:
    """(stream, event_id, seconds) where a stream of motion levels settled; see ``episodes``."""
    return episodes(levels, rule, delay, forget).where("kind = 'settled'").select("stream", "event_id", "seconds")
