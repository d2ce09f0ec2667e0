"""Random edit logs against a plain model of a session."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import edit_log as E

EDITS = "session long, seq long, kind string, page string, new_pages array<string>, target string, text string, settings struct<split_mode: string, crop: boolean, rotate: boolean>"


class Model:
    def __init__(self):
        self.order, self.pages, self.bin, self.counter, self.title, self.settings, self.errors = [], {}, [], 0, None, ("automatic", True, True), []

    def put(self, ids):
        for p in ids:
            self.counter += 1
            self.pages[p] = [p, f"Aufnahme-{self.counter:04d}.heic", "pending"]

    def place(self, page, target):
        self.order.insert(self.order.index(target) if target in self.order else len(self.order), page)

    def trash(self, ids):
        for p in ids:
            if p in self.pages:
                self.bin.append(self.pages.pop(p))
                self.order = [x for x in self.order if x != p]

    def run(self, seq, kind, page, new, target, text, settings):
        new = new or []
        known = page in (self.pages if kind == "status" else self.order)
        if kind in ("insert", "replace", "move", "status") and not known or kind in ("insert", "replace") and not new:
            self.errors.append((seq, page))
        elif kind == "add":
            self.put(new)
            self.order += new
        elif kind in ("insert", "replace"):
            self.put(new)
            i = self.order.index(page) + 1
            self.order[i:i] = new
            if kind == "replace":
                self.trash([page])
        elif kind == "move" and page != target:
            self.order.remove(page)
            self.place(page, target)
        elif kind == "order":
            wish = [p for p in dict.fromkeys(new) if p in self.order]
            self.order = wish + [p for p in self.order if p not in wish]
        elif kind == "trash":
            self.trash(new)
        elif kind == "restore" and self.bin:
            back = self.bin.pop()
            self.pages[back[0]] = back
            self.place(back[0], target)
        elif kind == "status":
            self.pages[page][2] = text
        elif kind == "title":
            self.title = (text or "").strip() or None
        elif kind == "settings" and settings:
            self.settings = settings

    def shown(self):
        return self.order, [tuple(p) for p in self.pages.values()], [tuple(p) for p in self.bin], self.counter, self.title, self.settings, self.errors


def random_log(rng, length):
    rows, fresh = [], 0
    for seq in range(length):
        kind = rng.choice(["add", *E.KINDS, "nonsense"])
        some = lambda: rng.choice([None, "zz", *[f"n{i}" for i in range(fresh)]])  # noqa: B023, E731
        new = None
        if kind in ("add", "insert", "replace"):
            new = [f"n{fresh + i}" for i in range(rng.randrange(0, 4))]
            fresh += len(new)
        elif kind in ("order", "trash"):
            new = [rng.choice(["zz", *[f"n{i}" for i in range(fresh)]]) for _ in range(rng.randrange(0, 5))]
        rows.append((seq, kind, some(), new, some(), rng.choice([None, "", " \t", "done", "  A title\r\n"]) if kind != "status" else "failed", rng.choice([None, ("none", False, True)])))
    return rows


def shown(state):
    return (
        state.page_order, [tuple(p) for p in state.pages], [tuple(p) for p in state.trashed], state.counter, state.title, tuple(state.settings), [tuple(x) for x in state.errors]
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_match_a_plain_model(spark, tmp_path, seed):
    rng = random.Random(seed)
    logs = {s: random_log(rng, rng.randrange(1, 60)) for s in range(40)}
    rows = [(s, *r) for s, log in logs.items() for r in log]
    rng.shuffle(rows)
    edits = spark.createDataFrame(rows, EDITS)
    want = {}
    for s, log in logs.items():
        model = Model()
        for r in log:
            model.run(*r)
        want[s] = model.shown()
    empty = spark.createDataFrame([], f"session long, state {E.STATE}")
    whole = {r.session: shown(r.state) for r in E.replay(empty, edits).collect()}
    assert whole == want
    sliced = {r.session: shown(r.state) for r in E.replay_in_slices(empty, edits, str(tmp_path), 7).collect()}
    assert sliced == want
    assert sum(len(x[2]) for x in want.values()) > 20 and sum(len(x[6]) for x in want.values()) > 100


def test_states_without_edits_and_null_states_stay(spark):
    before = spark.createDataFrame([(1,), (2,)], "session long").withColumn("state", E.no_state())
    before = before.withColumn("state", F.when(F.col("session") == 1, F.col("state").withField("title", F.lit("kept"))))
    none = spark.createDataFrame([], EDITS)
    found = {r.session: r.state for r in E.replay(before, none).collect()}
    assert found[1].title == "kept" and found[2].page_order == [] and found[2].counter == 0
    one = spark.createDataFrame([(1, 0, "add", None, ["a"], None, None, None), (3, 0, "restore", None, None, None, None, None)], EDITS)
    found = {r.session: r.state for r in E.replay(before, one).collect()}
    assert found[1].page_order == ["a"] and found[1].title == "kept" and found[3].pages == []


def test_look_up_by_id(spark):
    edits = spark.createDataFrame([(1, 0, "add", None, ["a", "b"], None, None, None), (1, 1, "move", "b", None, "a", None, None)], EDITS)
    states = E.replay(spark.createDataFrame([], f"session long, state {E.STATE}"), edits)
    wanted = spark.createDataFrame([(1, "a"), (1, "a"), (1, "zz"), (2, "a"), (None, None)], "session long, page string")
    assert [tuple(r) for r in E.page_by_id(states, wanted).collect()] == [(1, "a", "Aufnahme-0001.heic", "pending", 2)]
