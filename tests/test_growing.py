"""Indices that grow by batches equal those of all documents, whatever is played again or cut off."""

import pytest
from pyspark.sql import functions as F

from lexarium.operators import classify, index
from lexarium.sources import corpus
from lexarium.streaming import append

BATCHES = [[(1, "a b\nc"), (2, None), (3, "d")], [], [(10, "e f g\n\nh"), (11, "")], [(20, "i"), (21, "j k")]]


def frames(spark):
    return [spark.createDataFrame(b, "doc_id long, text string") for b in BATCHES]


def whole(spark):
    rows = corpus.corpus_sentences(spark.createDataFrame([r for b in BATCHES for r in b], "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.line, r.spos, r.cpos, r.words) for r in rows)


def grown(spark, out):
    return sorted((r.doc_id, r.line, r.spos, r.cpos, r.words) for r in append.grown_index(spark, out).collect())


def test_batches_played_again(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="committed"):
        append.grown_index(spark, out)
    dfs = frames(spark)
    for k in (0, 0, 1, 2, 1, 2, 3, 3):
        append.append_batch(dfs[k], k, out)
    assert grown(spark, out) == whole(spark)
    assert sorted((r.batch, r.sentences, r.tokens) for r in append.committed(spark, out).collect()) == [(0, 3, 4), (1, 3, 4), (2, 5, 8), (3, 7, 11)]


def test_a_batch_cut_off_between_rows_and_offsets(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    dfs = frames(spark)
    append.append_batch(dfs[0], 0, out)
    append.append_batch(dfs[1], 1, out)
    before = grown(spark, out)
    index = append.length_index

    def killed(rows):
        index(rows).write.mode("overwrite").parquet(f"{out}/rows/batch=2")
        raise RuntimeError("executor lost")

    monkeypatch.setattr(append, "length_index", killed)
    with pytest.raises(RuntimeError):
        append.append_batch(dfs[2], 2, out)
    assert grown(spark, out) == before, "rows that nothing commits aren't seen"
    monkeypatch.undo()
    append.append_batch(dfs[2], 2, out)
    append.append_batch(dfs[3], 3, out)
    assert grown(spark, out) == whole(spark)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for df in frames(spark):
        df.write.mode("append").parquet(folder)
        append.append_positions(append.document_stream(spark, folder, files_per_batch=1000), out, progress).awaitTermination()
    assert grown(spark, out) == whole(spark)
    append.append_positions(append.document_stream(spark, folder, files_per_batch=1000), out, progress).awaitTermination()
    assert grown(spark, out) == whole(spark), "nothing new arrived"


def test_model_error_cards(spark):
    words = "w0 w1 w2 w3 w4 w5 w6 w7".split()
    gold = ["B-A", "I-A", "O", "B-B", "O", "O", "O", "O"]
    runs = [("one", ["B-A", "O", "O", "O", "O", "B-A", "I-A", "O"], [0.5] * 8), ("two", ["B-B", "I-B", "O", "B-A", "O", "O", "O", "O"], [k / 8 for k in range(8)])]
    schema = "seq_id long, words array<string>, gold array<string>, runs array<struct<model string, pred array<string>, conf array<double>>>"
    rows = spark.createDataFrame([(1, words, gold, runs), (2, [], [], []), (3, words[:1], ["O"], [("one", ["O"], [0.1])])], schema)
    got = {(r.kind, r.start, r.end, r.gold_type, r.anchor): [(m.model, m.pred_type, m.correct, m.confidence) for m in r.models] for r in classify.model_error_cards(rows).collect()}
    assert got == {
        ("TYPE", 0, 2, "A", None): [("one", "A", True, 0.5), ("two", "B", False, 0.0625)],
        ("TYPE", 3, 4, "B", None): [("one", None, False, 0.5), ("two", "A", False, 0.375)],
        ("FP", 5, 7, None, "one"): [("one", "A", False, 0.5), ("two", None, False, 0.6875)],
    }
    alone = classify.model_error_cards(rows.withColumn("runs", F.slice("runs", 1, 1))).where("seq_id = 1 and gold_type = 'B'").first()
    assert alone.kind == "FN" and alone.context == "w0 w1 w2 w3 w4 w5 w6 w7"


def test_sample_finds_planted_flaws_and_bounds_the_rest(spark):
    s = spark.createDataFrame([(k, 2 * k, ["a", "b"]) for k in range(1000)], "spos long, cpos long, words array<string>")
    good = s.select("spos", "cpos", F.size("words").alias("count"))
    assert index.validate_sample(good, s, 100, 10).count() == 0
    clean = index.sample_bound(good, index.validate_sample(good, s, 100, 10), 100, 10).first()
    assert (clean.sampled, clean.wrong) == (100, 0) and clean.at_most == pytest.approx(1.645**2 / (100 + 1.645**2))
    bad = good.withColumn("count", F.col("count") + F.when(F.col("spos") % 10 == 3, 1).otherwise(0)).union(spark.createDataFrame([(5000, 1, 1)], "spos long, cpos long, count int"))
    every = {(r.rule, r.spos, r.detail) for r in index.validate_sample(bad, s, 100, 100).collect()}
    assert every == {("count", k, 1) for k in range(3, 1000, 10)} | {("missing", 5000, 0)}
    some = {(r.rule, r.spos, r.detail) for r in index.validate_sample(bad, s, 100, 20).collect()}
    assert some < every and some == {(r.rule, r.spos, r.detail) for r in index.validate_sample(bad.repartition(5), s, 100, 20).collect()}
    bound = index.sample_bound(bad, index.validate_sample(bad, s, 100, 20), 100, 20).first()
    assert bound.wrong / bound.sampled < bound.at_most < 0.25
