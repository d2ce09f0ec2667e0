"""The pipeline against a plain version of its stages over the small dataset's documents."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from folio.llm import common, line_cleaning, mixing, packing, simhash_dedup  # noqa: E402
from tests.llm.test_simhash_dedup import classes, plain  # noqa: E402
from tests.llm.test_suffix_dedup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    staged = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sequences":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = corpus_pipeline.keep(out, name)
            staged.append(sorted((r.doc_id, r.text) for r in docs.collect()))
        else:
            packed = out.collect()
    judged = [(r, line_cleaning.judge_text(r["text"])) for r in rows]
    rows = [r | {"text": j["clean_text"]} for r, j in judged if j["kept"]]
    assert staged[0] == sorted((r["doc_id"], r["text"]) for r in rows)
    roots = classes([r["doc_id"] for r in rows], [plain(r["text"]) for r in rows])
    rows = [r for r in rows if roots[r["doc_id"]] == r["doc_id"]]
    assert staged[1] == sorted((r["doc_id"], r["text"]) for r in rows)
    kept = brute([r["text"] for r in rows], 200)
    rows = [r | {"text": k.decode("utf-8", "ignore")} for r, (_, k) in zip(rows, kept, strict=True)]
    assert staged[2] == sorted((r["doc_id"], r["text"]) for r in rows)
    assert set(staged[3]) <= set(staged[2]) and max(Counter(staged[3]).values()) <= 2
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(r["text"].split())
    taken, by_id = defaultdict(int), {r["doc_id"]: r for r in rows}
    for d, t in staged[3]:
        taken[by_id[d]["source"]] += len(t.split())
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sum(taken.values()) >= 1.4 * sum(sizes.values())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in staged[3])
    ends = defaultdict(list)
    for r in packed:
        ends[r.sequence_id].append((r.offset, r.length))
    for parts in ends.values():
        starts = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == starts[:-1].tolist() and starts[-1] <= packing.CAPACITY
    assert mixing.MAX_EPOCHS == 2 and simhash_dedup.RADIUS == 4


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_stages_take_nulls_ties_long_texts_and_other_columns(spark):
    def prose(k, n=80):
        return "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(10)) + "." for i in range(n // 10))

    long = prose(7, 60_000)
    rows = [
        (1, prose(1), "en", "a", 5, "k1", 1.5), (2, prose(1), "en", "a", 5, "k2", None), (2, prose(1), "en", "a", 5, "k2", None), (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", 0.0), (5, prose(5), None, None, None, None, 2.5), (None, prose(6), "de", "b", 9, "k6", None), (7, long, "fr", "a", 1, "k7", 7.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, `a.b` double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "a.b"]
        got = {(r.doc_id, r.text, r.kept, r["a.b"]) for r in docs.collect()}
        want = {(1, prose(1), "k1", 1.5), (5, prose(5), None, 2.5), (None, prose(6), "k6", None), (7, long, "k7", 7.5)}
        assert got == want | {(2, prose(1), "k2", None)} if name == "quality_rules" else got <= want and (got == want or name == "source_mix")
    packed = corpus_pipeline.sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run_deletes_what_its_stages_kept(spark):
    folder = f"{common.shared_dir(spark).removeprefix('file:').replace('//', '')}/folio/{common._RUN}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = set(os.listdir(folder)) - before
    assert {name.rsplit("-", 1)[0] for name in left} <= {"source_mix", "pieces", "lengths", "offsets"}
