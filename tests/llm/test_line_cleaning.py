"""Line rules and document figures against plain Python."""

import random
import re
from collections import Counter

from folio.llm import line_cleaning as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def corpus():
    rng = random.Random(1)
    parts = ["word", "é", "a|b", "x\x1cy", " ", "\t", "\n", "\r\n", ".", "#", "of the", "same line here.\n", "\x0b"]
    return ["".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(rng.randrange(0, 200))) for _ in range(60)] + [None, "", " \n ", "one two three " * 40]


def test_figures_match_plain_python(spark):
    rows = [(i, t, "x") for i, t in enumerate(corpus())]
    got = L.judge_lines(spark.createDataFrame(rows + rows[:2], "doc_id long, text string, kept string")).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = plain(rows[r.doc_id][1])
        assert {k: r[k] for k in want} == want
        assert not (r.kept and r.base_failed)


def test_line_rules():
    good = ["A full sentence ends here.", 'She said "so it is."', "Is it so?", "  Spaces around it!  "]
    bad = ["Home | About | Contact.", "No end mark here", "We use of cookies policy: use of cookies.", "###", "!!! $$$ ***.", "Menu » Products » Shoes."]
    assert not any(L.line_fails(x, len(x.split())) for x in good)
    assert all(L.line_fails(x, len(x.split())) for x in bad)


def test_documents_lose_failing_lines_then_fail(spark):
    sentence = "This{0} is{0} plain{0} sentence{0} number {0} with{0} words{0}."
    text = "\n".join(sentence.format(i) for i in range(10))
    menu = "Home | About | Contact | Legal | Help | Blog and many more things to see"
    rows = [(1, f"{menu}\n{text}", 5), (2, "\n".join([menu + str(i) for i in range(20)] + [sentence.format(1)]), 5), (3, None, None), (4, "short.", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = L.clean_documents(df)
    assert out.columns == df.columns and [(r.doc_id, r.text, r.n_chars) for r in out.collect()] == [(1, text, len(text))]
    assert L.clean_documents(df.where("false")).collect() == []


def test_boilerplate_in_four_languages_and_very_long_texts(spark):
    for line in ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "All rights reserved."):
        assert L.line_fails(line, 3)
    line = " ".join(f"w{i}" for i in range(20)) + "."
    text = "\n".join(line.replace("w", f"{i}v") for i in range(20_000))
    df = spark.createDataFrame([(1, text, 2), (None, text[:5000], None), (3, None, 1)], "doc_id long, text string, `a.b` int")
    got = {r.doc_id: (r.n_words, r.kept) for r in L.judge_lines(df).collect()}
    assert got == {1: (400_000, True), None: (len(text[:5000].split()), True), 3: (0, False)}
    assert sorted(map(repr, (r["a.b"] for r in L.clean_documents(df).collect()))) == ["2", "None"]
