"""Session files, page texts, edits and rollups."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import sessions as M
from folio.sources import sessions as S


def test_documents_pages_and_listing(spark, tmp_path):
    a, b = tmp_path / "2026-01-02 03-04-05", tmp_path / "old"
    (a / "OCR").mkdir(parents=True)
    (a / "Papierkorb").mkdir()
    b.mkdir()
    page = {"id": "p1", "fileName": "Aufnahme-0001.heic", "capturedAt": "2026-01-02T03:04:05.000Z", "pixelWidth": 10, "pixelHeight": 20, "ocrStatus": "done"}
    (a / "session.json").write_text(json.dumps({"version": 1, "id": "A", "createdAt": "2026-01-02T03:04:05.123Z", "pageOrder": ["zz", "p2", "p1"], "pages": [page, page | {"id": "p2"}]}))
    (b / "session.json").write_text(json.dumps({"version": 1, "id": "B", "createdAt": "2025-01-02T03:04:05Z", "archived": True}))
    lines = [{"text": "right", "confidence": 0.9, "box": [[0.6, 0.88], [0.3, 0.02]]}, {"text": "left", "confidence": 0.9, "box": [[0.1, 0.885], [0.3, 0.02]], "angle": 0.5}, {"text": "bottom", "confidence": 0.9, "box": [[0.1, 0.48], [0.3, 0.02]]}]
    (a / "OCR" / "Aufnahme-0001.json").write_text(json.dumps({"version": 1, "pageID": "p1", "lines": lines}))
    (a / "Aufnahme-0001.heic").write_bytes(b"x" * 7)
    (a / "Papierkorb" / "Aufnahme-0002.heic").write_bytes(b"x" * 5)
    (a / "Buch.pdf").write_bytes(b"%PDF")
    found = S.read_sessions(spark, str(tmp_path)).collect()
    assert [(r.id, r.directory, r.archived, r.settings.splitMode) for r in found] == [("A", a.name, False, "automatic"), ("B", "old", True, "automatic")]
    pages = S.session_pages(S.read_sessions(spark, str(tmp_path))).orderBy("number").collect()
    assert [(r.page, r.number) for r in pages] == [("p2", 1), ("p1", 2)]
    rows = S.read_page_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.text, r.version, r.angle) for r in rows] == [("left", 2, 0.5), ("right", 2, 0.0), ("bottom", 2, 0.0)]
    upgraded = S.upgraded_page_texts(spark, str(tmp_path), str(tmp_path / "new")).collect()
    assert [(r.version, r.pageID, r.directory, [(x.text, x.box[0], x.angle) for x in r.lines]) for r in upgraded] == [
        (2, "p1", a.name, [("left", [0.1, 0.885], 0.5), ("right", [0.6, 0.88], 0.0), ("bottom", [0.1, 0.48], 0.0)])
    ]
    texts = S.read_page_lines(spark, str(tmp_path)).withColumn("page", F.lit("p2"))
    sessions = S.read_sessions(spark, str(tmp_path)).withColumn("pages", F.transform("pages", lambda p: p.withField("ocrStatus", F.lit("pending"))))
    saved = {r.id: [(p.id, p.ocrStatus) for p in r.pages] for r in S.save_page_texts(sessions, texts, str(tmp_path / "texts")).collect()}
    assert saved == {"A": [("p1", "pending"), ("p2", "done")], "B": []} and spark.read.parquet(str(tmp_path / "texts")).count() == 3
    rollup = {r.session: r for r in M.session_rollup(S.file_listing(spark, str(tmp_path))).collect()}
    assert (rollup[a.name].image_bytes, rollup[a.name].trash_bytes, rollup[a.name].export_bytes, rollup[a.name].exports) == (7, 5, 4, "pdf")
    (b / "session.json").write_text(json.dumps({"version": 1, "id": "B", "createdAt": "yesterday"}))
    with pytest.raises(Exception, match="without version"):
        S.read_sessions(spark, str(tmp_path)).collect()


def test_media_types_and_names(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x01\x00\x00\x00\x00\x20"
    df = spark.createDataFrame([(b"%PDF-1.7",), (png,), (b"\xff\xd8\xff\xe0",), (b"\x00\x00\x00\x18ftypheic",), (b"",)], "c binary")
    assert [r[0] for r in df.select(S.media_type(F.col("c"))).collect()] == ["pdf", "png", "jpeg", "heic", "bin"]
    assert [r[0] for r in df.select(S.png_size(F.col("c"))).collect()][1] == (256, 32)
    assert S.free_directory_name("x", {"x", "x (2)"}) == "x (3)"


def test_order_edits(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*map(F.lit, x))
    abc = arr("a", "b", "c")
    assert one(M.set_order(abc, arr("b", "zz", "a"))) == ["b", "a", "c"]
    assert one(M.insert_after(abc, F.lit("b"), arr("x", "y"))) == ["a", "b", "x", "y", "c"]
    assert one(M.move_before(abc, F.lit("c"), F.lit("a"))) == ["c", "a", "b"]
    assert one(M.move_before(abc, F.lit("a"), F.lit(None).cast("string"))) == ["b", "c", "a"]
    assert one(M.move_before(abc, F.lit("b"), F.lit("b"))) == ["a", "b", "c"]
    order, trash = M.trash_pages(abc, arr("t"), arr("c", "zz", "a"))
    assert one(order) == ["b"] and one(trash) == ["t", "c", "a"]
    back, left = M.restore_last(arr("b"), arr("t", "c"), F.lit("b"))
    assert one(back) == ["c", "b"] and one(left) == ["t"]


def test_replacing_rescans_and_archives(spark):
    one = lambda *c: spark.range(1).select(*c).first()[:]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(*M.replace_page(arr("a", "b"), arr(), F.lit("a"), arr("x", "y"))) == (["x", "y", "b"], ["a"])
    assert one(*M.resolve_rescan(arr("a", "n"), arr(), F.lit("a"), arr("n"), F.lit(True))) == (["n"], ["a"])
    assert one(*M.resolve_rescan(arr("a", "n"), arr(), F.lit("a"), arr("n"), F.lit(False))) == (["a"], ["n"])
    assert one(M.directory_for(F.lit("2026"), F.lit(" a/b ")), M.directory_for(F.lit("2026"), F.lit(None).cast("string"))) == ("2026 a b", "2026")
    assert one(X.issue_text(F.lit("missing"), F.lit(3), F.lit(3)), X.issue_text(F.lit("missing"), F.lit(3), F.lit(4))) == ("page 3 missing", "pages 3–4 missing")
    sessions = spark.createDataFrame([("s", False, ["a"]), ("t", False, [])], "session string, archived boolean, page_order array<string>")
    files = spark.createDataFrame([("s", "a.heic", 1), ("s", "Papierkorb/b.heic", 1), ("s", "OCR/a.json", 1), ("t", "c.heic", 1)], "session string, path string, bytes long")
    marked, left = M.archived(sessions, files)
    assert sorted((r.session, r.archived) for r in marked.collect()) == [("s", True), ("t", False)]
    assert sorted(r.path for r in left.collect()) == ["OCR/a.json", "c.heic"]
    assert M.without_trash(files).count() == 3


def test_free_names_like_one_after_another(spark):
    rng = random.Random(3)
    base = ["x", "x (2)", "y", "x (2) (2)", "z (1)", "(3)", "x (02)"]
    taken = [(rng.randrange(3), rng.choice(base) + rng.choice(["", "", " (2)", " (3)", " (7)"])) for _ in range(40)]
    wanted = [(rng.randrange(3), rng.choice(["x", "y", "z", "(3)", "x (02)", "new"]), i, "extra") for i in range(120)]
    held = [set(n for p, n in taken if p == q) for q in range(3)]
    want = {}
    for p, name, place, _ in wanted:
        want[place] = S.free_directory_name(name, held[p])
        held[p].add(want[place])
    frame = spark.createDataFrame(wanted, "parent int, name string, place int, other string")
    found = M.free_names(frame, spark.createDataFrame(taken, "parent int, name string")).collect()
    assert {r.place: r.free for r in found} == want and len(found) == len(wanted) and found[0].other == "extra"
    meeting = spark.createDataFrame([(0, "x", 1), (0, "x", 3), (0, "x (2)", 2), (0, "x", 4)], "parent int, name string, place int")
    got = {r.place: r.free for r in M.free_names(meeting, spark.createDataFrame([], "parent int, name string")).collect()}
    assert got == {1: "x", 2: "x (2)", 3: "x (4)", 4: "x (3)"}
