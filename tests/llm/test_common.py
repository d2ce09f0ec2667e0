"""Shared helpers: bounded slices, kept tables, the shared folder."""

import threading

import pyarrow as pa
import pytest

from folio.llm import common as C
from folio.llm import line_cleaning, mixing, simhash_dedup, substring_dedup, suffix_dedup


def test_slices_hold_all_rows_in_order_within_the_bound():
    batch = pa.RecordBatch.from_pydict({"i": list(range(500)), "t": ["x" * (i % 70) for i in range(499)] + ["y" * 10_000]})
    parts = list(C.slices(iter([batch, batch.slice(0, 0)]), 2_000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(500))
    assert all(p.nbytes <= 2_000 or p.num_rows <= 1 for p in parts)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(Session())


def test_kept_tables_are_read_back_and_dropped(spark):
    kept = C.keep(spark.range(5), "numbers")
    assert kept.count() == 5
    C.drop(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._kept_at)


def test_tables_of_one_call_go_and_those_of_others_stay(spark):
    outside = C.keep(spark.range(1), "outside")
    with C.own_tables() as wanted:
        gone = C.keep(spark.range(2), "gone")
        with C.own_tables():
            inner = C.keep(spark.range(3), "inner")
        stays = C.keep(spark.range(4), "stays")
        wanted.append(stays)

        def other():
            # Another thread's tables are its own.
            with C.own_tables() as theirs:
                theirs.append(C.keep(spark.range(5), "theirs"))

        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    assert outside.count() == 1 and stays.count() == 4
    for table in (gone, inner):
        with pytest.raises(Exception):
            spark.read.parquet(table._kept_at)
    C.drop(outside, stays)


CLASHING = ("__doc", "__row", "__spans", "__size", "__key", "__order", "__text", "__bucket", "__copy", "u0", "u1", "doc", "row", "spans", "copy", "size")


def test_columns_of_any_name_pass_unchanged(spark):
    words = " ".join(f"word{i}" for i in range(90))
    texts = [words, words, words + " more", None, "", "own text of a few words"]
    rows = [(i, t, "s" if i % 2 else None, *[i * 100 + j for j in range(len(CLASHING))]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHING))
    for stage in (line_cleaning.clean_documents, simhash_dedup.one_of_each, suffix_dedup.cleaned_documents, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(r[3 + j] == r.doc_id * 100 + j for r in out.collect() for j in range(len(CLASHING)))
    for step in (lambda d: suffix_dedup.deduplicate(d), lambda d: substring_dedup.deduplicate(d), mixing.mix):
        out = step(docs)
        kept = [c for c in CLASHING if c in ("__doc", "__row", "__spans", "__size", "__key", "__order", "__text", "__bucket", "u0", "u1", "doc", "row")]
        assert all(r[c] == r.doc_id * 100 + CLASHING.index(c) for r in out.collect() for c in kept)
