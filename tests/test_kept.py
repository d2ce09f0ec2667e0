"""What tables that are kept leave on the disk, and what is not dealt out again."""

import os
import time
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import assembly, structure
from folio.sources import tables

LINES = "book long, page_no int, line_no int, text string, confidence double, x_mil double, w_mil double, h_mil double, mid_mil double"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tables_kept_by_page_are_not_dealt_out_again(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = tables.kept(spark.range(500).selectExpr("id % 7 AS book", "cast(id % 11 AS int) AS page_no", "id"), "book", "page_no")
        page = Window.partitionBy("book", "page_no")
        found = rows.withColumn("n", F.count("*").over(page)).join(rows.groupBy("book", "page_no").agg(F.max("id").alias("most")), ["book", "page_no"])
        assert shuffles(found) == 0
        again = tables.kept(found, "book", "page_no", dealt=True)
        assert shuffles(again.groupBy("book", "page_no").count()) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.id for r in again.collect()) == list(range(500)) and {r.n for r in again.collect()} == {6, 7}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("folio_")]
    folder = again._kept_at.removeprefix("file://")
    assert os.listdir(folder)
    tables.dropped(again)
    assert not os.path.exists(folder) and rows.count() == 500


def test_shuffled_files_of_a_kept_table_go_with_its_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())}
    set_before, before = spark.conf.get(tables._CLEANUP, None), names()
    kept = tables.kept(spark.range(1000).selectExpr("id % 9 AS book", "id").groupBy("book").agg(F.collect_list("id")), "book")
    for _ in range(100):
        if not (left := {n for n in names() - before if n.startswith("shuffle_")}):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 9 and spark.conf.get(tables._CLEANUP, None) == set_before


def test_a_book_leaves_only_its_elements(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    rows = [(b, p, 30 * p + i, f"Zeile {b} {p} {i} ohne ende" if i else f"{p + 3}", 0.9, 100.0, 400.0, 20.0, 900.0 - 30 * i) for b in range(3) for p in range(4) for i in range(6)]
    found = structure.books(spark.createDataFrame(rows, LINES))
    assert len(os.listdir(tmp_path)) == 1
    texts = [r.text for r in found.orderBy("book", "block_no").collect() if r.kind == "pageBreak" or "Zeile" in r.text]
    assert len(texts) >= 3 * 4 and all(sum(f"Zeile {b} {p} {i} " in t for t in texts) == 1 for b in range(3) for p in range(4) for i in range(1, 6))


def test_texts_of_blocks_are_not_dealt_out_for_the_assembly(spark, monkeypatch):
    """Blocks kept by page are joined and grouped as they lie; what is dealt out are openings and places."""
    plans = []
    write = tables.kept

    def watched(rows, *by, **how):
        plans.append(rows)
        return write(rows, *by, **how)

    monkeypatch.setattr(assembly, "kept", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = tables.kept(spark.range(40).selectExpr("id % 4 AS book", "cast(id div 4 AS int) AS page_no", "cast(null AS int) AS twin", "cast(null AS string) AS printed"), "book", "page_no")
        blocks = tables.kept(pages.selectExpr("book", "page_no", "explode(sequence(1, 3)) AS block_no", "'paragraph' AS kind", "0 AS level", "concat('seite ', page_no, ' ohne') AS text", "cast(null AS string) AS uncertain"), "book", "page_no", dealt=True)
        assembly.assembled(pages, blocks)
        # Texts leave their place only as pieces of other blocks, by the block that they go on, and as the tails of a page.
        plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(block_no" not in plan and "Exchange hashpartitioning(gone" not in plan
    lines = plan.splitlines()
    dealt = [lines[i + 1 : i + 3] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert dealt and not any("uncertain" in x for two in dealt for x in two)
