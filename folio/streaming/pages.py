"""Page judgements on streams: whether a settled page is new, and whether a judgement came before the page was left."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.images import square
from folio.operators.similarity import ReadWords, judge_page
from folio.schema import SamePage
from folio.streaming.ordered import InOrder, in_order

_DAY = 86_400


def judged_pages(snapshots: DataFrame, rule: SamePage = SamePage(), delay: str = "10 seconds", forget: float = _DAY) -> DataFrame:
    """(stream, event_id, at, is_new) of a stream of snapshots (stream, event_id, at timestamp, words[, pixels]), in order of ``at``.

    A page is new if it differs from the last three remembered; see ``new_pages``, of which this is the stream. Snapshots may
    come up to ``delay`` late. What a stream remembers is its state, which goes ``forget`` seconds after its last snapshot.
    """
    pixels = F.col("pixels") if "pixels" in snapshots.columns else F.lit(None)

    def fold(key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        known = [(ReadWords(json.loads(w)), square(p) if len(p) else None) for w, p in zip(*state, strict=True)] if state else []
        out = []
        for micros, event, words, frame in rows:
            is_new, known = judge_page(known, json.loads(words), frame, rule)
            out.append((key[0], event, pd.Timestamp(micros, unit="us"), is_new))
        return ([json.dumps(page.listed, ensure_ascii=False) for page, _ in known], [[] if frame is None else frame.ravel().astype(int).tolist() for _, frame in known]), out

    # A page's words are one text in the state, as each of their strings would cost several steps there and back.
    fields = "micros long, event_id long, words string, pixels array<int>"
    machine = InOrder(fields, "words array<string>, pixels array<array<int>>", ["stream", "event_id", "at", "is_new"], fold, round(forget * 1e6))
    empty = F.array().cast("array<int>")
    rows = snapshots.select("stream", "event_id", "at", F.coalesce(F.to_json("words"), F.lit("[]")).alias("words"), F.coalesce(pixels.cast("array<int>"), empty).alias("pixels"))
    rows = rows.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    return in_order(rows, "stream", machine, "stream long, event_id long, at timestamp, is_new boolean", "at")


def timely(judged: DataFrame, episodes: DataFrame, longest: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """A stream of judgements (stream, event_id, done_at timestamp ..) but for those whose page was left before they were done.

    ``episodes`` is the stream of ``motion.episodes``; a judgement takes ``longest`` at most, which bounds the state of the
    join of the two streams. Judgements may come up to ``delay`` late.
    """
    left = episodes.where("kind = 'left'").select(F.col("stream").alias("of_stream"), F.col("event_id").alias("of_event"), F.col("at").alias("left_at"))
    mine = judged.withWatermark("done_at", delay)
    over = (F.col("stream") == F.col("of_stream")) & (F.col("event_id") == F.col("of_event")) & (F.col("left_at") <= F.col("done_at")) & (F.col("left_at") >= F.col("done_at") - F.expr(f"INTERVAL {longest}"))
    return mine.join(left, over, "left_outer").where("of_event IS NULL").select(*judged.columns)
