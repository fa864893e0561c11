import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexarium.functions import text as X
from lexarium.operators import annotation, assistant, classify, index, islands, lm, ner, select, wiki
from lexarium.plans import search
from lexarium.sources import corpus, files
from lexarium.sources.corpus import TOKEN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(*items):
    return F.array(*[F.lit(x) for x in items])


def test_neighbours_of_different_types_have_tags_of_their_own(spark):
    ws, run = words("a", "b", "c", "d", "e", "f"), words(False, False, True, True, False, False)
    labels = words("B-PER", "B-ORG", "O", "B-PER", "B-PER", "I-PER")
    keys = islands.switch_keys(run, labels)
    assert one(spark, islands.tag_runs(ws, keys)) == "<NE1>a</NE1> <NE2>b</NE2> <CS1>c d</CS1> <NE3>e f</NE3>"
    assert one(spark, islands.tag_map(keys, {"CS": F.transform(ws, F.upper), "NE": ws})) == {"NE1": "a", "NE2": "b", "CS1": "C D", "NE3": "e f"}
    assert one(spark, islands.tag_runs(ws, islands.switch_keys(run))) == "a b <CS1>c d</CS1> e f"
    assert one(spark, islands.tag_runs(F.array().cast("array<string>"), F.array().cast("array<string>"))) == ""
    assert one(spark, islands.entity_tag_map(ws, labels, ["PER", "ORG"], ["ORG"])) == {"NE1:B-PER": "a", "NE3:B-PER": "d", "NE4:B-PER": "e", "NE5:I-PER": "f"}


def test_spans_start_only_at_b(spark):
    labels = words("I-X", "B-X", "I-X", "I-Y", "I-Y", "B-Y", "B-Y", "I-Y", "O", None, "I-Y")
    assert [tuple(s) for s in one(spark, islands.valid_spans(labels))] == [(1, 3, "X"), (5, 6, "Y"), (6, 8, "Y")]


def test_span_table_equals_a_full_join(spark):
    rows = [("a", ["B-X", "I-X", "O", "B-Y"], ["B-X", "O", "B-Y", "B-Y"]), ("b", ["O"], ["B-X"]), ("c", [], []), ("d", None, ["B-X"])]
    df = spark.createDataFrame(rows, "seq_id string, gold array<string>, pred array<string>")
    got = sorted((r.seq_id, r.start, r.end, r.gold_type, r.pred_type) for r in classify.span_table(df.where("gold is not null")).collect())
    assert got == [("a", 0, 1, None, "X"), ("a", 0, 2, "X", None), ("a", 2, 3, None, "Y"), ("a", 3, 4, "Y", "Y"), ("b", 0, 1, None, "X")]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 400])
def test_running_sums(spark, n):
    values = [k % 7 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(X.running_sum(F.col("v")).alias("x")).first()["x"]
    assert got == [sum(values[: k + 1]) for k in range(n)]


def test_long_sentences_keep_their_labels(spark):
    text = " ".join(f"<L{k}>ab</L{k}> c" if k % 3 else "d  e" for k in range(1, 400))
    r = classify.labelled_words(spark.createDataFrame([(1, text)], "k int, t string"), "t", ["k"]).first()
    plain = X.STRIPS["upper"]
    import re

    assert r.words == re.sub(plain, "", text).split() and r.labels.count("B-LOAN") == sum(1 for k in range(1, 400) if k % 3)
    spans = one(spark, annotation.inline_spans(F.lit("x <L1>a b</L1><CS2>c</CS2> <L3></L3>")))
    assert [(s.prefix, s.num, s.content, s.start, s.end) for s in spans] == [("L", "1", "a b", 2, 5), ("CS", "2", "c", 5, 6), ("L", "3", "", 7, 7)]


def test_bare_mark_defers_the_label(spark):
    ids = {"O": 0, "B-X": 1}
    pieces, at = words("<s>", "▁", "ab", "c", "▁", "d", "▁"), words(None, 0, 0, 0, 1, 2, 3).cast("array<int>")
    labels = words("B-X", "O", "B-X", "O")
    assert one(spark, classify.align_subwords(labels, at, ids, pieces)) == [-100, -100, 1, -100, 0, 1, 0]
    assert one(spark, classify.align_subwords(labels, at, ids)) == [-100, 1, -100, -100, 0, 1, 0]


def test_views(spark):
    df = spark.createDataFrame([(1, ["a b", "c"], ["B-X", None], ["I-X", "O"], [0.5, 0.25])], "k int, words array<string>, gold array<string>, pred array<string>, conf array<double>")
    rows = [tuple(r) for r in classify.prediction_view(df, ["k"]).collect()]
    assert rows == [(1, 0, "a_b", "B-X", "I-X", 0.5, True), (1, 1, "c", "~~", "~~", None, False)]
    assert not any(r.differs for r in classify.prediction_view(df, ["k"], relaxed=True).collect())


def test_misaligned_indices_are_an_error(spark):
    s = spark.createDataFrame([(0, 0, 2), (1, 2, 3)], "spos long, cpos long, count int")
    good, bad = s.withColumn("x", F.lit(1)), s.withColumn("cpos", F.col("cpos") + F.col("spos")).withColumn("x", F.lit(1))
    rows, lemmas = search.mask_sources(s, good, vocabulary=[" Job", "", "job"])
    assert rows.columns == ["spos", "cpos", "count", "x"] and rows.count() == 2 and lemmas == ["job"]
    with pytest.raises(ValueError, match="sentence 1"):
        search.mask_sources(s, bad)
    assert [tuple(r) for r in index.validate_totals(s, 5).collect()] == [] and index.validate_totals(s, 4, 3).count() == 2


def test_sums_and_neighbours_over_blocks_of_blocks(spark):
    df = spark.range(300).select((F.col("id") * 3 % 299 + 1000 * (F.col("id") % 2)).alias("doc_id"), (F.col("id") % 5).alias("n"))
    got = corpus.running_totals(df, [F.col("doc_id")], {"s": F.col("n")}).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    at = 0
    for r in got:
        assert r.s == at
        at += r.n
    rows = [(k, 2 * k, 2) for k in range(100) if k not in (16, 40)]
    idx = spark.createDataFrame(rows, "spos long, cpos long, count int")
    assert sorted(r.spos for r in index.validate_index(idx, block_keys=4).collect()) == [17, 41]


def test_dictionary_headings(spark):
    lines = ["<title>a</title>", "text ==Latvian==", "===Etymology 1===", "lost", "===Etymology===", "kept", "===Etymology 2===", "more", "====Noun====", "lost", "== Latvian ==", "===Etymology===", "other", "<title>b</title> ==Latvian==", "===Etymology===", "in b", "==X=="]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")
    want = [(11, "Latvian", "a", "kept ===Etymology 2=== more"), (17, "Latvian", "b", "in b")]
    assert sorted(tuple(r) for r in wiki.entries(df, ["Latvian"]).collect()) == want
    wiki_block = wiki.LINE_BLOCK
    try:
        wiki.LINE_BLOCK = 2
        assert sorted(tuple(r) for r in wiki.entries(df, ["Latvian"]).collect()) == want
    finally:
        wiki.LINE_BLOCK = wiki_block
    known = spark.createDataFrame([("lv", "Latvian")], "code string, canonical_name string")
    assert wiki.language_code(known, " latvian ") == "lv"
    with pytest.raises(ValueError):
        wiki.language_code(known, "Klingon")


def test_greedy_choice_is_the_plain_rule():
    import random

    rng = random.Random(3)
    for limit in (1, 2):
        records = [(k, rng.randint(0, 4) / 4, [rng.choice("abcdef") for _ in range(rng.randint(1, 3))]) for k in range(40)]
        used, uses, want = set(), {x: 0 for x in "abcdef"}, []
        n = {x: sum(r[2].count(x) for r in records) for x in uses}
        for lemma in sorted((x for x in uses if n[x]), key=lambda x: (n[x], x)):
            if uses[lemma] >= limit:
                continue
            fits = [r for r in records if lemma in r[2] and r[0] not in used and all(uses[x] < limit for x in r[2])]
            if fits:
                pick = max(fits, key=lambda r: (r[1], -r[0]))
                used.add(pick[0])
                want.append(pick[0])
                for x in pick[2]:
                    uses[x] += 1
        assert select.greedy_choice(records, limit) == want


def test_strata_beyond_k_have_no_quota(spark):
    rows = [(k, [f"s{k % 7}"], float(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "spos long, l array<string>, score_total double")
    got = select.select_stratified(df, 3, "l").collect()
    assert sorted((r.stratum, r.spos) for r in got) == [("s0", 49), ("s1", 43), ("s2", 44)]


def test_random_draws_repeat(spark):
    m = spark.range(100).select(F.lit("q").alias("q"), F.col("id").alias("spos"))
    a = sorted(r.spos for r in select.reduced_matches(m, "q", ["spos"], {"q": 10}).collect())
    assert len(a) == 10 and a == sorted(r.spos for r in select.reduced_matches(m.repartition(5), "q", ["spos"], {"q": 10}).collect())
    assert a != sorted(r.spos for r in select.reduced_matches(m, "q", ["spos"], {"q": 10}, seed=1).collect())
    assert select.reduced_matches(m, "q", ["spos"], {"other": 3}).count() == 100


def test_replies_and_prompts(spark):
    assert one(spark, X.clean_reply(F.lit(" a b\n  Polish: c\nd "))) == "a b" and one(spark, X.clean_reply(F.lit(" a\nPolish: c "), pairs=False)) == "a\nPolish: c"
    assert one(spark, X.pair_prompt(F.lit("x  y\nz russian : q"), "A", "B")) == X.PAIR_PROMPT.format(src="A", tgt="B", text="x y z")
    roles = one(spark, X.chat_messages(F.lit("hi"), "A", "B"))
    assert [r.role for r in roles] == ["system", "user"] and "from A to B" in roles[0].content and roles[1].content == "hi"


def test_model_is_saved_and_loaded(spark, tmp_path):
    counts = lm.count_table(spark.createDataFrame([("ab", 2), ("b", 1)], "word string, freq long"))
    lm.save_counts(counts, str(tmp_path / "m"))
    again, order = lm.load_counts(spark, str(tmp_path / "m"))
    assert order == 3 and sorted(map(tuple, again.select(counts.columns).collect())) == sorted(map(tuple, counts.collect()))
    files.write_index(spark.range(1).withColumnRenamed("id", "spos"), str(tmp_path / "x"), {})
    with pytest.raises(TypeError):
        lm.load_counts(spark, str(tmp_path / "x"))


def test_workbook_and_json_array(spark, tmp_path):
    rows = spark.createDataFrame([("<L1>a & b</L1>", "n\nm", "", "+", "x\x01")], [annotation.LABEL, annotation.REPLACEMENT, "Target", "Valid", "Reason"])
    files.write_xlsx(rows, str(tmp_path / "s.xlsx"))
    from xml.dom.minidom import parseString

    with zipfile.ZipFile(tmp_path / "s.xlsx") as z:
        parsed = {n: parseString(z.read(n)) for n in z.namelist()}
    cells = [c.firstChild.data if c.firstChild else "" for c in parsed["xl/worksheets/sheet1.xml"].getElementsByTagName("t")]
    assert cells == [annotation.LABEL, annotation.REPLACEMENT, "Target", "Valid", "Reason", "<L1>a & b</L1>", "n\nm", "", "+", "x"]
    files.write_dataset_array(annotation.plain_records(spark.createDataFrame([("é",), ("b",)], "value string")), str(tmp_path / "d.json"))
    data = json.loads((tmp_path / "d.json").read_text())
    assert [r["source_plain"] for r in data] == ["é", "b"] and files.read_dataset(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "w.csv").write_text("word,ok\na,x\nb,?\nc,\nd,?\n")
    assert [tuple(r) for r in files.unexpected_validity(spark, str(tmp_path / "w.csv"), "ok").collect()] == [("?", 2)]


def test_converted_index(spark):
    df = spark.createDataFrame([(0, [[0.0, 5.0, 1.0], [0.0, 1.0, 5.0]])], "spos long, logits array<array<double>>")
    r = ner.convert_index(df, ["O", "B-X", "I-X"]).first()
    assert r.labels == ["B-X", "I-X"] and r.confidence[0] == pytest.approx(0.975, abs=1e-3)
    assert "confidence" not in ner.convert_index(df, ["O", "B-X", "I-X"], with_confidence=False).columns


def test_clusters_know_their_anchor(spark):
    p = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "a long, b long, similarity double")
    assert sorted(map(tuple, assistant.clusters(p).collect())) == [(1, 1, 1.0), (2, 1, 0.9), (3, 1, 0.0)]


def test_tagged_lemmas(spark):
    t = [("x", "n", "Job"), ("y", "n", "deal"), ("z", "n", "job")]
    df = spark.createDataFrame([(t,), ([],)], f"t array<{TOKEN.simpleString()}>")
    assert [r.x for r in df.select(islands.tagged_lemmas(F.col("t"), ["JOB", "deal"], "deal").alias("x")).collect()] == [{"L1": "deal", "L2": "JOB", "L3": "JOB"}, {"L1": "deal"}]
