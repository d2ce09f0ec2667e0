"""Streams dealt to bundles, pages without their lines, and words that may be misreadings, against plain forms."""

import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.operators.similarity import ReadWords, allowed_edits, within, word_share
from folio.sources.tables import lines, pages
from folio.streaming.ordered import OWNER, InOrder


class Handle:
    """The state of one bundle in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.lists = Counter(), set(), {}

    def getListState(self, name, _):
        rows = self.lists.setdefault(name, [])

        def call(kind, change):
            def run(*a):
                self.calls[kind] += 1
                return change(*a)

            return run

        return SimpleNamespace(get=call("get", lambda: iter(list(rows))), appendList=call("append", rows.extend), clear=call("clear", rows.clear))

    def listTimers(self):
        self.calls["timers"] += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls["register"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["delete"] += 1
        self.timers.discard(at)


def running(forget):
    """A sum of each stream's values in order, forgotten if it is 0."""

    def fold(key, state, rows):
        total, out = state[0] if state else 0, []
        for micros, event, value in rows:
            total += value
            out.append((key[0], event, total))
        return ((total,) if total else None), out

    machine = InOrder("micros long, event_id long, value long", "total long", ["stream", "event_id", "total"], fold, forget)
    handle = Handle()
    machine.init(handle)
    return machine, handle


def take(machine, watermark_ms):
    values = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
    due = [t for t in machine.handle.timers if t <= watermark_ms]
    found = [tuple(r) for _ in due[:1] for frame in machine.handleExpiredTimer((0,), values, None) for r in frame.itertuples(index=False)]
    machine.handle.timers -= set(due)
    return found


def given(machine, rows):
    assert list(machine.handleInputRows((0,), iter([pd.DataFrame(rows, columns=[OWNER, "micros", "event_id", "value"])]), None)) == []


def test_a_bundle_of_streams_takes_few_calls_and_keeps_streams_apart():
    machine, handle = running(10**12)
    rng = random.Random(3)
    rows = [(rng.choice([None, "7", str(2**60 + i % 500)]), 1_000_000 + rng.randrange(10**6) * 1000, i, rng.randrange(1, 9)) for i in range(5000)]
    got = []
    for part, watermark in ((rows[:3000], 1_400), (rows[3000:], 10**9)):
        late = [r for r in part if not got or r[1] > 1_400_000]
        given(machine, late)
        got += take(machine, watermark)
    assert sum(handle.calls.values()) < 30
    want, totals = [], {}
    taken = [r for r in rows[:3000]] + [r for r in rows[3000:] if r[1] > 1_400_000]
    for owner, _, event, value in sorted(taken, key=lambda r: (r[1], r[2])):
        totals[owner] = totals.get(owner, 0) + value
        want.append((owner, event, totals[owner]))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_streams_of_a_bundle_are_forgotten_one_by_one():
    machine, handle = running(5_000_000)
    given(machine, [("a", 1_000_000, 1, 2), ("b", 4_000_000, 2, 3), ("c", 2_000_000, 3, 0)])
    assert take(machine, 4_500) == [("a", 1, 2), ("b", 2, 3), ("c", 3, 0)]
    assert sorted(r[0] for r in handle.lists["held"]) == ["a", "b"]  # the state of c is none
    assert take(machine, 6_100) == [] and [r[0] for r in handle.lists["held"]] == ["b"]
    given(machine, [("a", 7_000_000, 4, 2), ("b", 8_000_000, 5, 1)])
    assert take(machine, 8_500) == [("a", 4, 2), ("b", 5, 4)]
    assert take(machine, 60_000) == [] and not handle.lists["held"] and not handle.lists["waiting"] and not handle.timers


@pytest.mark.parametrize("docs", [["", " ", "a", " b", "c ", "w " * 300, "w " * 299 + "w", " " + "v " * 299, "x " * 301, "y\n" * 900, None]])
def test_pages_are_the_lines_of_each(spark, tmp_path, docs):
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.book, r.page_no): r.text.split() for r in pages(spark, str(tmp_path)).collect()}
    rows = lines(spark, str(tmp_path)).groupBy("book", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls")).collect()
    assert got == {(r.book, r.page_no): " ".join(x.text for x in r.ls).split() for r in rows} and len(got) > 10


def test_shares_of_words_with_all_pairs_compared():
    rng = random.Random(5)
    letters = "abcäß́x"

    def misread(word):
        at = rng.randrange(1, len(word) + 1)
        return word[:at] + rng.choice(["", rng.choice(letters)]) + word[at + rng.randrange(2) :]

    for _ in range(300):
        one = ["".join(rng.choices(letters, k=rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 31, 32, 33, 34, 40, 90]))) for _ in range(rng.randrange(25))]
        two = [misread(w) if rng.random() < 0.7 else w for w in one if rng.random() < 0.8] + ["abcab" + w for w in one[:3]]
        two = [misread(w) if rng.random() < 0.5 else w for w in two if w]
        small, large = sorted((set(one), set(two)), key=len)
        held = sum(w in large or (len(w) >= 5 and any(len(x) >= 4 and x[0] == w[0] and within(w, x, allowed_edits(w)) for x in large)) for w in small)
        assert word_share(ReadWords(one), ReadWords(two)) == pytest.approx(held / len(small) if small else 0)
