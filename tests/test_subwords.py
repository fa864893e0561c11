"""Pieces, alignment and token statistics against plain Python and numpy."""

import random

import numpy as np
import pytest

from lexarium.operators import subwords

PIECES = ["un", "##able", "##a", "##b", "aff", "##aff", "a", "b", "u", "##n", "abc", "##bc", "▁", "##▁", "##word", "日", "##本", "x" * 13]


def plain_pieces(word, table, longest=12, longest_word=100):
    if not word:
        return []
    out, at = [], 0
    while at < len(word) and len(word) <= longest_word:
        for n in range(min(longest, len(word) - at), 0, -1):
            p = ("##" if at else "") + word[at : at + n]
            if p in table:
                out.append(p)
                at += n
                break
        else:
            return ["[UNK]"]
    return out if at == len(word) else ["[UNK]"]


@pytest.fixture(scope="module")
def known(spark):
    rng = random.Random(2)
    words = ["unaffable", "affable", "abcabc", "", "zzz", "unz", "日本", "x" * 13, "a" * 101, "a" * 100, "▁word", "▁", None, "un", "un"] + ["".join(rng.choices("abun", k=rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    table = spark.createDataFrame([(p,) for p in PIECES * 2], "piece string")
    return sorted({w for w in words if w is not None}), subwords.word_pieces(df, table)


def test_word_pieces(known):
    words, found = known
    got = {r.word: r.pieces for r in found.collect()}
    assert got == {w: plain_pieces(w, set(PIECES)) for w in words}


def test_alignment_with_bare_marks_and_truncation(spark, known):
    _, found = known
    rows = [(1, ["unaffable", "▁word", "zzz"], ["B-X", "I-X", "O"]), (2, [], []), (3, ["", "a"], ["B-X", "O"]), (4, ["abcabc"] * 5, ["O", "B-X", "O", "O", "O"])]
    df = spark.createDataFrame(rows, "id long, words array<string>, labels array<string>")
    got = {r.id: (r.pieces, r.word_ids, r.label_ids) for r in subwords.aligned_labels(subwords.piece_sentences(df, ["id"], found, max_length=8), "labels", {"O": 0, "B-X": 1, "I-X": 2}).collect()}
    assert got[1] == (["un", "##aff", "##able", "▁", "##word", "[UNK]"], [0, 0, 0, 1, 1, 2], [1, -100, -100, -100, 2, 0]), "the mark's label goes to the next piece"
    assert got[2] == ([], [], []) and got[3] == (["a"], [1], [0])
    want = [p for w in rows[3][1] for p in plain_pieces(w, set(PIECES))][:6]
    assert got[4][0] == want and len(got[4][2]) == 6


def test_token_statistics_equal_numpy(spark):
    rng = random.Random(4)
    data = {"one": [rng.randint(1, 200) for _ in range(301)], "two": [7] * 5, "three": [3, 9]}
    rows = [(m, v) for m, vs in data.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "model string, v int").repartition(4)
    parts = df.randomSplit([0.5, 0.5], 1)
    counts = subwords.merged_counts(*[subwords.length_counts(p, ["model"], p["v"]) for p in parts])
    for r in subwords.length_statistics(counts, ["model"], 100).collect():
        x = np.array(data[r.model])
        assert (r.rows, r.min, r.max) == (len(x), x.min(), x.max())
        assert [r.mean, r.std, r.truncated] == pytest.approx([x.mean(), x.std(), (x > 100).mean()], abs=1e-6)
        assert [r[f"p{q}"] for q in subwords.PERCENTILES] == pytest.approx(np.percentile(x, subwords.PERCENTILES), abs=1e-9)
    bins = {(r.model, r.bin): (r.n, r.lower, r.upper) for r in subwords.length_bins(counts, ["model"]).collect()}
    for m, x in data.items():
        n, edges = np.histogram(x, 10)
        for k in range(10):
            assert bins.get((m, k), (0, edges[k], edges[k + 1])) == pytest.approx((n[k], edges[k], edges[k + 1]))


def test_held_and_joined_pieces_agree(spark, known, monkeypatch):
    words, _ = known
    table = spark.createDataFrame([(p,) for p in PIECES], "piece string")
    lines = [["unaffable", "zzz", None, "abun"], [], None, words[:40], ["", "un", "un"]]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, words array<string>")
    held = {n: subwords.cut_sentences(rows, ["id"], table, max_length=n) for n in (None, 2, 7)}
    alone = subwords.word_pieces(spark.createDataFrame([(w,) for w in words], "word string"), table)
    # No word leaves its row: nothing is exploded or shuffled.
    plan = held[None]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan
    assert "Join" not in alone._jdf.queryExecution().executedPlan().toString()
    got = {n: sorted(df.collect()) for n, df in held.items()}
    pieces = {r.word: r.pieces for r in alone.collect()}
    monkeypatch.setattr(subwords, "HELD_PIECES", 3)
    assert {n: sorted(subwords.cut_sentences(rows, ["id"], table, max_length=n).collect()) for n in held} == got
    assert {r.word: r.pieces for r in subwords.word_pieces(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()} == pieces
