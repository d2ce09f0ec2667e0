"""Chat formatting against a plain formatter, and the round trip of hostile texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folio.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"
HOSTILE = ["<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "<\\|im_part|>", "a<\\\\|b", "<", "|x", "<<||>>", "", None, "\n", "<|im_part|>", "$1 \\1 \\", "é😀", "<|break|>"]


def plain(rows):
    """The formatted text and the loss text of sorted rows, built turn by turn."""
    def safe(x):
        out, i = "", 0
        while i < len(x):
            j = i + 1
            while x[i] == "<" and j < len(x) and x[j] == "\\":
                j += 1
            if x[i] == "<" and j < len(x) and x[j] == "|":
                out += x[i:j] + "\\"
                i = j
            else:
                out += x[i]
                i += 1
        return out

    text, loss, before = "", "", None
    for _, role, t in rows:
        role, t = role or "", t or ""
        head = safe(role).replace("\n", C.BREAK)
        if before == role:
            text = text[: -len(C.END)] + C.PART + safe(t) + C.END
        else:
            text += C.START + head + "\n" + safe(t) + C.END
        loss += t if role == "assistant" else ""
        before = role
    return text, loss


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_round_trip_of_hostile_turns(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "system", None, "us\ner", "<|im_end|>"]
    convs = {c: [(i, rng.choice(roles), rng.choice(HOSTILE)) for i in range(rng.randrange(1, 12))] for c in [*range(20), None]}
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    rng.shuffle(rows)
    done = C.format_conversations(spark.createDataFrame(rows, SCHEMA))
    found = done.select("conv_id", "formatted", "pieces", "n_blocks", C.turns_of(F.col("formatted")).alias("turns"), C.loss_text(F.col("pieces")).alias("loss")).collect()
    assert len(found) == len(convs)
    for r in found:
        turns = convs[r.conv_id]
        text, loss = plain(turns)
        assert (r.formatted, r.loss) == (text, loss)
        assert [(t.role, t.text) for t in r.turns] == [(role or "", t or "") for _, role, t in turns]
        assert "".join(p.piece for p in r.pieces) == r.formatted
        assert r.n_blocks == 1 + sum((a[1] or "") != (b[1] or "") for a, b in zip(turns, turns[1:]))


def test_edge_cases(spark):
    assert C.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "<|" * 300_000
    rows = [(1, None, "assistant", "first"), (1, 3, "user", "b"), (1, 3, "user", "a"), (1, 3, "user", "a"), (2, 0, "assistant", long)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", pieces long, formatted long")
    found = {r.conv_id: r for r in C.format_conversations(df).select("conv_id", "formatted", C.turns_of(F.col("formatted")).alias("turns"), C.loss_text(F.col("pieces")).alias("loss")).collect()}
    assert [t.text for t in found[1].turns] == ["first", "a", "a", "b"]
    assert found[2].loss == long and found[2].turns[0].text == long


def test_query_adds_the_hostile_conversation(spark, tmp_path):
    spark.createDataFrame([(7, 1, "assistant", "y"), (7, 0, "user", None)], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in C.op11_chat_format(spark, str(tmp_path)).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (found[-1].n_turns, found[-1].loss_chars, found[-1].loss_sha256) == (2, len(probe), sha(probe))
    assert found[-1].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n")
    assert found[7].turns_sha256 == sha("user\n\nassistant\ny\n") and found[7].loss_sha256 == sha("y")
