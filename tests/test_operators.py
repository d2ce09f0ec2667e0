"""Golden vectors of the page operators."""

import datetime as dt
import functools
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import images as I
from folio.functions import text as X
from folio.operators import render, similarity
from folio.operators.frames import fired, luma_means, timely_judgements
from folio.operators.geometry import cut_places, quadrant, reading_order, rotated_box
from folio.operators.sequence import ISSUES_SQL, PRINTED_SQL, live_issues, printed_numbers, sequence_issues
from folio.operators.similarity import ReadWords, c10_new_pages, new_pages, same_page, within, word_share, words_alike
from folio.operators.titles import composed
from folio.schema import Motion
from folio.streaming.motion import step
from folio.streaming.ordered import use_state_store


def ranges(text):
    return [(0, 0) if p == "-" else tuple(map(int, (p.split("–") * 2)[:2])) for p in text.split(",")]


#: Page sequences and the issues their rules give: (page, kind, first, last).
SEQUENCES = {
    "7,8,-,10,11": [],
    "100,101,105,106": [(2, "missing", 102, 104)],
    "30,31,32,31,33": [(3, "duplicate", 2, 2)],
    "50,51,55,56,53,57": [(2, "missing", 52, 54), (4, "outOfOrder", 56, 56), (5, "missing", 54, 54)],
    "8,9,38": [(2, "missing", 10, 37)],
    "8,9,45": [],
    "40,41,45,46,42,43": [(2, "missing", 44, 44), (4, "outOfOrder", 46, 46)],
}


def test_sequence_issues(spark):
    rows = [(b, i, *r) for b, text in enumerate(SEQUENCES) for i, r in enumerate(ranges(text))]
    printed = spark.createDataFrame(rows, "book long, page_no int, lo long, hi long")
    got = sorted(tuple(r) for r in sequence_issues(printed).collect())
    assert got == sorted((b, *x) for b, found in enumerate(SEQUENCES.values()) for x in found)
    assert sequence_issues(printed.where("false")).collect() == []


def test_random_sequences_match_the_recursive_query(spark):
    rng = np.random.default_rng(11)
    rows = []
    for book in range(400):
        at, wide = int(rng.integers(1, 40)), int(rng.random() < 0.3)
        for page in range(int(rng.integers(1, 14))):
            at += (1 + wide) * int(rng.choice([1, 1, 1, 1, 2, 4]))
            kind = rng.random()
            lo = 0 if kind < 0.15 else int(rng.integers(1, 60)) if kind < 0.3 else at
            rows.append((book, page, lo, lo + wide if lo else 0))
    columns = ["book", "page_no", "lo", "hi"]
    got = sorted(tuple(r) for r in sequence_issues(spark.createDataFrame(rows, "book long, page_no int, lo long, hi long")).collect())
    db = duckdb.connect()
    db.register("given", pd.DataFrame(rows, columns=columns))
    sql = ISSUES_SQL.replace(PRINTED_SQL, "printed AS (SELECT book, CAST(page_no AS INT) AS page_no, lo, hi FROM given)")
    want = db.execute(f'WITH RECURSIVE {sql} SELECT book, page_no, kind, "first", "last" FROM issue').fetchall()
    assert got == sorted(want) and {x[2] for x in got} == {"missing", "duplicate", "outOfOrder"}


def test_live_issues_are_told_once_and_only_while_fresh(spark, tmp_path):
    use_state_store(spark)
    schema = "book long, page_no int, lo long, hi long, at timestamp"
    now = dt.datetime(2026, 1, 1, 12)
    batches = [
        [(1, 0, 5, 5, now), (1, 1, 6, 6, now), (2, 0, 5, 5, now), (2, 1, 5, 5, now - dt.timedelta(seconds=500))],
        [(1, 2, 9, 9, now + dt.timedelta(seconds=60))],
        [(1, 3, 10, 10, now + dt.timedelta(seconds=90)), (3, 0, 4, 4, now), (3, 1, 4, 4, now + dt.timedelta(seconds=80))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        told = []
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live = live_issues(source, lambda df: told.extend(tuple(r) for r in df.collect()))
        query = live.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert told == {0: [], 1: [(1, 2, "missing", 7, 8)], 2: [(3, 1, "duplicate", 1, 1)]}[batches.index(rows)]


def values(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


def test_text_functions(spark):
    assert values(spark, X.page_number, "– 42 –", "1990", "0", "12345", "4 2", "x") == [42, 1990, None, None, None, None]
    assert values(spark, X.header_number, "24 Einleitung", "Einleitung 24", "3 Vgl. Müller 1998", "24", "a b c d e f g 8") == [24, 24, 3, None, None]
    assert values(spark, X.file_system_safe, "  c't 12/2026 ", "a" * 100, "Ende.") == ["c't 12 2026", "a" * 80, "Ende"]
    assert values(spark, X.normalized, "  Über – Maß, 3.  ") == ["über maß 3"]
    assert values(spark, X.ends_with_number, "Titel 12", "12", "Titel 12.", "Titel 12345") == [True, False, True, False]
    assert values(spark, X.starts_with_footnote_marker, "* a", "(1) b", "1) c", "1990 d", "2a") == [True, True, True, False, True]
    assert values(spark, X.is_all_caps, "DAS KAPITEL", "Das Kapitel", "ABC", "AE000 1 2H0N0") == [True, False, False, False]
    assert values(spark, X.restore_markers, "\\@@SEITE 3 S12@@ x @@SEITE 4@@ @@NOTIZ a b@@") == ["<!-- Seite 12, Scan 3 --> x <!-- Seite 4 --> <!-- a b -->"]
    assert values(spark, lambda t: X.iso_timestamp(X.parse_iso_timestamp(t)), "2026-09-26T11:01:42.883Z", "2026-09-26T11:01:42Z", "x") == ["2026-09-26T11:01:42.883Z", "2026-09-26T11:01:42.000Z", None]
    names = ["Seite 10.png", "seite 9.png", "Seite 9b.png"]
    assert sorted(names, key=dict(zip(names, values(spark, X.natural_key, *names), strict=True)).get) == ["seite 9.png", "Seite 9b.png", "Seite 10.png"]
    assert values(spark, X.is_excluded_title, "Beispiel Verlag", "Roman 1987", "Das Buch", "X") == [True, True, False, True]


def test_printed_numbers(spark):
    base = [(0, i, f"Zeile {i} des Textes mit vielen Wörtern und noch mehr davon", 800 - 50 * i, 100) for i in range(10)]
    pages = {1: [("– 42 –", 50, 400)], 2: [("24 Einleitung", 950, 400)], 3: [("24", 50, 200), ("25", 50, 800)], 4: [("3 Vgl. Müller 1998", 50, 100)], 5: [("1990", 500, 400)]}
    rows = [(1, p, i, t, m, x, 50) for p in pages for _, i, t, m, x in base] + [(1, p, 20 + i, *line, 50) for p, extra in pages.items() for i, line in enumerate(extra)]
    df = spark.createDataFrame(rows, "book long, page_no int, line_no int, text string, mid_mil int, x_mil int, w_mil int")
    got = {r.page_no: (r.lo, r.hi) for r in printed_numbers(df).collect()}
    assert got == {1: (42, 42), 2: (24, 24), 3: (24, 25), 4: (0, 0), 5: (0, 0)}


def test_reading_order():
    boxes = [(0.6, 0.88, 0.3, 0.02), (0.1, 0.885, 0.3, 0.02), (0.1, 0.48, 0.3, 0.02)]
    assert reading_order(boxes) == [1, 0, 2]
    skewed = [(0.1, 0.9 - 0.03 * i, 0.8, 0.09) for i in range(12)]
    assert [skewed.index(skewed[::-1][i]) for i in reading_order(skewed[::-1])] == list(range(12))


def test_quadrants_and_boxes(spark):
    assert spark.range(1).select(*[quadrant(F.lit(k) * F.pi() / 4) for k in (0, 1, 2, -2, 3, 4)]).first()[:] == (0, 3, 3, 1, 2, 2)
    box = rotated_box(F.lit(1), F.lit(100), F.lit(200), F.lit(300), F.lit(50), 1000)
    assert spark.range(1).select(*box.values()).first()[:] == (750, 100, 50, 300)


def test_words():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcä"), rng.integers(1, 9))) for _ in range(160)})
    distance = lambda a, b: min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0])) if a and b else len(a) + len(b)
    distance = functools.lru_cache(None)(distance)
    for k in range(3):
        assert all(within(a, b, k) == (distance(a, b) <= k) for a in words[:60] for b in words[:60])
    allowed = lambda w: (len(w) >= 5) + (len(w) >= 7)
    like = lambda a, b: a == b or len(b) >= 4 and allowed(a) and a[0] == b[0] and abs(len(a) - len(b)) <= allowed(a) and distance(a, b) <= allowed(a)
    for _ in range(60):
        one, two = (list(rng.choice(words, rng.integers(0, 40))) for _ in range(2))
        small, large = sorted((set(one), set(two)), key=len)
        want = sum(any(like(a, b) for b in large) for a in small) / len(small) if small else 0.0
        assert word_share(ReadWords(one), ReadWords(two)) == pytest.approx(want)
    read = lambda text, times=1: ReadWords(text.split() * times)
    one, two = "hinter alten mühlen wachsen wieder gelbe sträucher", "hinter alten muhlen wachsem wieder gelbe strauchen"
    assert same_page(read(one, 3), read(two, 3), lambda: 1.0) and not same_page(read("a"), read("b"), lambda: 0.5) and same_page(read(""), read(""), lambda: 0.1)


def test_alike_pages_by_parts_and_with_very_long_words(monkeypatch):
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("abcä"), rng.integers(1, 9))) for _ in range(160)})
    for _ in range(300):
        one, two = (ReadWords(list(rng.choice(words, rng.integers(0, 30)))) for _ in range(2))
        monkeypatch.setattr(similarity, "PAIRS", int(rng.choice([1, 40, 1 << 20])))
        share = float(rng.choice([0, 0.3, 0.6, 1]))
        assert words_alike(one, two, share) == (word_share(one, two) >= share)
    long = ["".join(rng.choice(list("abcdefgh"), 600)) for _ in range(40)]
    began = time.process_time()
    assert words_alike(ReadWords(long), ReadWords([w[:300] + "x" + w[301:] for w in long]), 0.6)
    assert not words_alike(ReadWords(long), ReadWords([w[:5] + "xxx" + w[8:] for w in long]), 0.6)
    assert time.process_time() - began < 2


def test_motion_trigger():
    state, since, fires = "idle", None, []
    for i, level in enumerate([0, 24, 24, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0]):
        state, since, fired = step(state, since, i * 0.25, level)
        fires.append(fired)
    assert fires.index(True) == 10 and sum(fires) == 1


def test_titles(spark):
    big, small, author = ("Vom Meer", "vom meer", 30, 800, False), ("und Wind", "und wind", 28, 700, False), ("Ida Muster", "ida muster", 10, 900, True)
    series, foot, blank = ("Bibliothek", "bibliothek", 29, 750, True), ("Ida Muster", "ida muster", 10, 100, True), ("  ", "", 30, 760, False)
    covers = [
        ([big, small], None, "Vom Meer und Wind"), ([author, big, small], 10, "Ida Muster – Vom Meer und Wind"), ([big, series, small], None, "Vom Meer – Bibliothek – und Wind"),
        ([big], 25, None), ([big, small, foot], 10, "Vom Meer und Wind – Ida Muster"), ([series, blank, small], None, "Bibliothek – und Wind"), ([blank], None, None), ([], None, None),
    ]
    rows = [(i, [(-float(m), k, t, key, float(size), recurs) for k, (t, key, size, m, recurs) in enumerate(c)], q and float(q)) for i, (c, q, _) in enumerate(covers)]
    df = spark.createDataFrame(rows, "i int, cover array<struct<down: double, line_no: int, text: string, key: string, size: double, recurs: boolean>>, quarter double")
    got = df.select("i", composed(F.array_sort("cover"), F.col("quarter")).alias("title")).orderBy("i").collect()
    assert [r.title for r in got] == [t for *_, t in covers]


def test_few_words_need_the_tiles_too(spark):
    rng = np.random.default_rng(4)
    picture = [int(v) for v in rng.integers(0, 255, 1024)]
    other = [int(v) for v in rng.integers(0, 255, 1024)]
    few, many = ["wald", "berge", "wiese", "bach"], [f"wort{chr(97 + i)}" for i in range(20)]
    rows = [(1, 0, few, picture), (1, 1, few, picture), (1, 2, few, other), (1, 3, [], other), (2, 0, many, picture), (2, 1, many, other), (3, 0, None, None), (3, 1, [], None)]
    got = new_pages(spark.createDataFrame(rows, "book long, page_no int, words array<string>, pixels array<int>")).collect()
    assert sorted((r.book, r.page_no) for r in got if r.is_new) == [(1, 0), (1, 2), (2, 0), (3, 0), (3, 1)]


def test_camera_names_and_long_numbers(spark):
    name = lambda t: X.short_camera_name(t, F.lit(12.34), ("Kamera an ",), F.lit("Tisch (%s)"))
    assert values(spark, name, "Kamera an „Ida“", "Webcam") == ["Tisch (Ida) · 12.3 MP", "Webcam · 12.3 MP"]
    names = ["s 7", "s 0010", "s 9999999999999999999", "s 10000000000000000000", "s 99999999999999999999", "s 123456789012345678901234567890"]
    keys = values(spark, X.natural_key, *names)
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_rendering(spark):
    rows = [(1, "T & U", i, *x) for i, x in enumerate([("pageBreak", 0, "", 1, "9"), ("heading", 1, "H", 1, None), ("listItem", 0, "a<b", 1, None), ("listItem", 0, "c", 1, None), ("footnote", 0, "f", 1, None), ("note", 0, "n--n", 1, None)])]
    df = spark.createDataFrame(rows, "book long, title string, block_no int, kind string, level int, text string, scan int, printed string")
    assert render.markdown(df).first().text == "# T & U\n\n<!-- Seite 9, Scan 1 -->\n\n## H\n\n- a<b\n- c\n\n> f\n\n<!-- n--n -->\n"
    body = render.html(df, comments=True).first().text
    assert "<h1>T &amp; U</h1>\n<!-- Seite 9, Scan 1 -->\n<h2>H</h2>\n<ul>\n<li>a&lt;b</li>\n<li>c</li>\n</ul>\n<blockquote><p>f</p></blockquote>\n<!-- n- -n -->\n</body>" in body


def test_texts_are_written_by_book_or_by_bucket(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text {i}\nend") for i in range(30)], "book long, text string")
    render.write_texts(texts, str(tmp_path / "buckets"), 4)
    read = spark.read.schema("book long, text string, bucket int").json(str(tmp_path / "buckets"))
    assert sorted((r.book, r.text) for r in read.collect()) == [(i, f"text {i}\nend") for i in range(30)] and read.select("bucket").distinct().count() <= 4
    render.write_texts(texts.where("book = 3"), str(tmp_path / "one"))
    assert [r.value for r in spark.read.text(str(tmp_path / "one" / "book=3")).collect()] == ["text 3", "end"]


def test_chunks_of_time_do_not_change_where_streams_settle(spark):
    rng = np.random.default_rng(9)
    rows = [(s, i, int(i * 3 + rng.integers(0, 3)), float(rng.choice([0, 1, 4, 20], p=[0.5, 0.2, 0.1, 0.2]))) for s in range(3) for i in range(150)]
    levels = spark.createDataFrame(rows, "stream long, event_id long, seconds long, level double")
    want = []
    for s in range(3):
        state, since = "idle", None
        for stream, event, at, level in sorted(rows, key=lambda r: (r[2], r[1])):
            if stream == s:
                state, since, found = step(state, since, at, level, Motion(settle_seconds=5))
                want += [(s, event, at)] * found
    for chunk in (7, 100, 86_400):
        assert sorted(tuple(r) for r in fired(levels, Motion(settle_seconds=5), chunk).collect()) == sorted(want)
    judged = fired(levels, Motion(settle_seconds=5)).withColumn("done_at", F.col("seconds") + 6)
    moves = {s: [r[2] for r in rows if r[0] == s and r[3] > 6] for s in range(3)}
    timely = [(s, e) for s, e, at in want if not any(at < m <= at + 6 for m in moves[s])]
    assert sorted((r.stream, r.event_id) for r in timely_judgements(levels, judged, Motion(settle_seconds=5)).collect()) == sorted(timely)


def test_image_kernels():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (60, 80)).astype(np.uint8)
    assert I.changed_share(a, a) == 0 and I.changed_share(a, np.roll(a, 2, axis=1)) == 0
    assert I.changed_share(a, rng.integers(0, 255, (60, 80)).astype(np.uint8)) > 0.9
    assert I.changed_share(a, a[:10]) == 1
    b = a.copy()
    b[:10] = 0
    assert I.motion_level(a, b) == 0 and I.mean_difference(a, a[:5]) == 0
    page = np.full((100, 160), 220, np.uint8)
    page[:, 78:83] = 60
    assert abs(I.gutter_fraction(page, 0.35, 0.65, 20) - 0.5) < 0.02 and I.gutter_fraction(page * 0 + 9, 0.35, 0.65, 20) is None
    bgra = np.dstack([np.full((8, 8), v, np.uint8) for v in (10, 20, 30, 255)])
    assert (I.gray(bgra, 4) == (10 * 29 + 20 * 150 + 30 * 77) // 256).all() and I.gray(bgra, 4).shape == (4, 4)
    assert I.rotate(page, 1).shape == (160, 100) and I.downscale(page, 80).shape == (50, 80) and I.crop(page, 10, 10, 5, 6).shape == (6, 5)


def test_cuts_of_double_pages():
    page = np.full((100, 160), 220, np.uint8)
    page[:, 70:74] = 60
    columns = [(0.05, 0.35, 0.9)] * 3 + [(0.55, 0.4, 0.9)] * 3
    assert I.cut_fraction(page, "none") is None and I.cut_fraction(page[:, :100], "automatic") is None
    assert I.cut_fraction(page, "middle") == 0.5
    assert abs(I.cut_fraction(page, "automatic") - 0.45) < 0.02
    assert abs(I.cut_fraction(page, "automatic", columns) - 0.45) < 0.02
    assert abs(I.cut_fraction(page * 0 + 9, "automatic", columns) - 0.475) < 0.01
    assert I.cut_fraction(page, "automatic", [*columns, (0.2, 0.6, 0.9)]) is None
    assert I.cut_fraction(page, "automatic", columns[:3]) is None
    assert [x.shape[1] for x in I.split(page, "middle")] == [80, 80]
    assert len(I.prepare(page.T, "automatic", 1, columns)) == 2 and len(I.prepare(page.T, "automatic", 1, columns, False)) == 1


def test_new_pages_take_words_of_any_letters(spark, tmp_path):
    same = [chr(0x430 + i % 30) * 2 + "слово" + chr(0x430 + i // 2) for i in range(60)]
    other = [f"größe{chr(97 + i % 26)}{'äöü'[i // 26]}{i * i}" for i in range(60)]
    rows = [(0, " ".join(same * 10)), (1, " ".join(other * 5 + same * 5)), (2, " ".join(other * 5 + [w + "ß" * 4 for w in other] * 5))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.book, r.page_no): r.is_new for r in c10_new_pages(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): True, (0, 1): False, (1, 0): True, (1, 1): True, (2, 0): True, (2, 1): True}


def test_block_means_in_the_jvm_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(1)
    for w, h, target in ((7, 5, 3), (12, 9, 4), (8, 8, 20), (10, 1, 3)):
        image = rng.integers(0, 256, (h, w, 4))
        df = spark.createDataFrame([(image.ravel().tolist(),)], "p array<int>")
        assert df.select(luma_means(F.col("p"), w, target)).first()[0] == I.gray(image.astype(np.uint8), target).ravel().tolist()


def test_cuts_over_rows_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(7)
    pages, profile, rows, want = [], [], [], {}
    for book in range(120):
        mode, w, h = ["middle", "automatic", "automatic", "none"][book % 4], 100, int(rng.choice([60, 90]))
        column = 150 - (np.abs(np.arange(w) - rng.integers(30, 70)) < 3) * rng.integers(0, 60) + rng.integers(0, 6, w)
        pages.append((book, 0, mode, w, h))
        profile += [(book, 0, i, int(v)) for i, v in enumerate(column)]
        boxes = [(int(rng.integers(0, 9)) + int(rng.choice([50, 550])), int(rng.choice([380, 400, 30, 700], p=[0.55, 0.3, 0.1, 0.05])), int(rng.integers(20, 99))) for _ in range(int(rng.integers(0, 14)))]
        rows += [(book, 0, i, x, n, c) for i, (x, n, c) in enumerate(boxes)]
        want[book] = I.cut_fraction(np.repeat(column[None], h, 0), mode, [(x / 1000, n / 1000, c / 100) for x, n, c in boxes])
    found = cut_places(
        spark.createDataFrame(pages, "book long, page_no int, mode string, width int, height int"), spark.createDataFrame(profile, "book long, page_no int, place int, value long"),
        spark.createDataFrame(rows, "book long, page_no int, line_no int, x_mil int, w_mil int, conf_pct int"),
    )
    got = {r.book: r.cut for r in found.collect()}
    differ = {b: (got[b], want[b]) for b in want if got[b] != pytest.approx(want[b])}
    assert not differ and sum(v is None for v in want.values()) < 100 and len({v for v in want.values() if v}) > 10
