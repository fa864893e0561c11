import random

import pytest

from lexarium.operators import annotation as A
from lexarium.operators import assistant, classify, models, ner, wiki
from lexarium.sources import shared
from pyspark.sql import functions as F

COLS = "row_index int, `Label sentence` string, `Replacement sentence` string, Target string, Valid string, Reason string, Notes string"


def rules(spark, label, repl="", valid="+", reason="", target="", mode="extended", **more):
    df = spark.createDataFrame([(1, label, repl, target, valid, reason, "n")], COLS)
    return sorted(r.rule_id for r in A.error_rows(A.validate_rows(df, mode, **more)).collect())


CASES = [
    ("<L1>a</L1>", "<N1>b</N1>", "x", "", ["V0.1"]),
    ("<L1>a</L1>", "<N1>b</N1>", "-", "", ["V0.2"]),
    ("<L1>a</L1>", "<N1>b</N1>", "+", "NE", ["V0.3"]),
    ("<L1>a</L1>", "<N1>b</N1>", "", "", ["V0.4"]),
    ("<L1>a</L1>", "<N1>b</N1>", "  ", "", ["S9"]),
    ("a\nb", "", "+", "", ["V1.1"]),
    ("<L>a", "", "+", "", ["V1.2"]),
    ("<Q1>a</Q1>", "", "+", "", ["V1.3"]),
    ("<N1>a</N1>", "", "+", "", ["V1.8"]),
    ("<L1>a", "<N1>b</N1>", "+", "", ["V1.4"]),
    ("<L1>a <L2>b</L2> </L1>", "<N1>a</N1> <N2>b</N2>", "+", "", ["V1.5"]),
    ("<L1>a</L2>", "<N1>b</N1>", "+", "", ["V1.4", "V1.6"]),
    ("a</L1>", "", "+", "", ["V1.7"]),
    ("<L1>a</L1> <L1>b</L1>", "<N1>b</N1>", "+", "", ["V2.1"]),
    ("<L2>a</L2>", "<N2>b</N2>", "+", "", ["V2.2", "V2.2"]),
    ("<L1>a</L1>", "", "+", "", ["V3.1"]),
    ("<CS1>a</CS1>", "", "+", "", ["V3.2"]),
    ("<CS1>a</CS1>", "<CS1>b</CS1>", "+", "", ["V3.5"]),
    ("<L1>a,</L1>", "<N1>b</N1>", "+", "", ["V4.2"]),
    ("<L1>a</L1>b", "<N1>b</N1>", "+", "", ["V4.3"]),
    ("<L1></L1>", "<N1>b</N1>", "+", "", ["V4.4"]),
    ("<L1>  </L1>", "<N1>b</N1>", "+", "", ["V4.5"]),
    (None, None, "+", "", []),
]


def test_every_rule(spark):
    rows = [(k, a, b, "", v, r, "n") for k, (a, b, v, r, _) in enumerate(CASES)]
    got = {}
    for e in A.error_rows(A.validate_rows(spark.createDataFrame(rows, COLS), "extended")).collect():
        got.setdefault(e.row_index, []).append(e.rule_id)
    for k, case in enumerate(CASES):
        assert sorted(got.get(k, [])) == case[4], case
    assert rules(spark, "a", target="<L1>x</L1>") == ["V4.1"]
    assert rules(spark, "<NE1>a</NE1>", "<NE2>b</NE2>", entity_parity=True) == ["V2.2", "V3.3"]
    assert rules(spark, "<NE1>a</NE1>", "<NE1>b</NE1>", entity_parity=True) == ["V3.4"]


def test_missing_column(spark):
    with pytest.raises(ValueError):
        A.validate_rows(spark.createDataFrame([("a",)], "Valid string"))


def test_transform_and_export(spark):
    rows = [(1, "Ein <L1>Job</L1>.", "", "", "+", "", ""), (2, "x", "", "", "-", "NE", ""), (3, "y", "z", "", "+", "", ""), (4, "<L1>y", "", "", "+", "", "")]
    out = A.generate_replacements(spark.createDataFrame(rows, COLS), "extended")
    assert {r.row_index: (r.status, r["Replacement sentence"]) for r in out.collect()} == {1: ("transformed", "Ein <N1>Job</N1>."), 2: ("skipped_unselected", ""), 3: ("skipped_nonempty", "z"), 4: ("skipped_precondition", "")}
    rec = A.dataset_records(spark.createDataFrame([(1, "Ein <L1>Job</L1>.", "Eine <N1>Arbeit</N1>.", "t", "+", "", "")], COLS)).first()
    assert rec.words_in_L_tags == {"1": "Job"} and rec.corresponding_words == {"1": ["Job", "Arbeit"]} and rec.source_plain == "Ein Job."


def test_translation_keeps_protected_spans(spark):
    rows = [(1, "a <CS1>keep Me</CS1> <L1>b</L1>", "", "", "+", "", ""), (2, "q", "", "", "-", "", ""), (3, "q", "", "done", "+", "", "")]
    out = models.translate_sheet(spark.createDataFrame(rows, COLS), models.echo_model)
    assert {r.row_index: r.Target for r in out.collect()} == {1: "A keep Me B", 2: "", 3: "done"}


def test_facts(spark):
    rows = [("f", 1, "Der <L1>Job</L1> ist <L2>gut so</L2>", "Die <N1>Arbeit</N1> ist <N2>gut so</N2>"), ("f", 2, "Job <CS1>job</CS1>", "Job <CS1>job</CS1>")]
    df = spark.createDataFrame(rows, "file string, row_index int, a string, b string")
    t = assistant.token_facts(df, "a", ["file", "row_index"])
    assert {(r.row_index, r.tok, r.surface, r.prefix) for r in t.collect()} >= {(1, 1, "Job", "L"), (1, 4, "so", "L"), (2, 0, "Job", "o"), (2, 1, "job", "CS")}
    s = assistant.span_facts(df, "a", "b", ["file", "row_index"])
    assert {(r.tag_id, r.paired_lemma_key, r.is_replaced) for r in s.collect()} == {("L1", "arbeit", True), ("L2", "gut so", False), ("CS1", "job", False)}
    assert [(r.lemma_key, r.prefixes) for r in assistant.contradictions(t).collect()] == [("job", "CS,L,o")]
    assert [r.tag_id for r in assistant.multiword_spans(s, ["file", "row_index"]).collect()] == ["L2"]
    total = [r for r in assistant.statistics(t, s).collect() if r.file is None][0]
    assert (total.words, total.spans, total.replaced, total.duplicate_lemmas) == (7, 3, 1, 1)
    changed = assistant.changed_rows(df, df.where("row_index = 1"), "a", "b")
    assert [r.change for r in changed.collect()] == ["removed"]


def test_similar_and_clusters(spark):
    sets = [(1, list("abcde")), (2, list("abcdf")), (3, list("abcdefg")), (4, list("xyz")), (5, list("xyz")), (6, [])]
    df = spark.createDataFrame(sets, "id long, s array<string>")
    got = {(r.a, r.b): round(r.similarity, 3) for r in assistant.similar_pairs(df, "id", "s", 0.6).collect()}
    assert got == {(1, 2): round(4 / 6, 3), (1, 3): round(5 / 7, 3), (2, 3): round(5 / 7, 3), (4, 5): 1.0}
    assert {r.node: r.cluster for r in assistant.clusters(assistant.similar_pairs(df, "id", "s", 0.6)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_wiki(spark):
    text = ["<title>abc</title>", "==Latvian==", "===Etymology===", "From {{bor|lv|de|x}}", "  more", "===Noun===", "not this", "==French==", "===Etymology===", "fr", "<title>Def</title>", "==Latvian==", "===Etymology 1===", "numbered", "<title>end</title>", "==Latvian==", "===Etymology===", "lost"]
    df = spark.createDataFrame(list(enumerate(text, 1)), "line_no int, line string")
    assert [tuple(r) for r in wiki.entries(df, ["Latvian"]).collect()] == [(8, "Latvian", "abc", "From {{bor|lv|de|x}} more")]
    assert {r.word for r in wiki.entries(df, ["Latvian"], mode="all").collect()} == {"abc", "Def"}
    rows = [("Latvian", "Abc", ""), (" latvian", "ab", "x"), ("Latvian", "-abc", "x"), ("Latvian", "abc", "x"), ("Latvian", "abcd", "{{bor|lv|gem-pro|x}}"), ("Latvian", "abce", "{{bor|lv|de|x}} {{bor|en|de}}"), ("Latvian", "abcf", "{{bor}}"), ("Dutch", "abc", "")]
    f = wiki.loan_funnel(spark.createDataFrame(rows, "language string, word string, etymology_text string"))
    assert {r.word: r.reason for r in f.collect()} == {"Abc": "uppercase_initial", "ab": "too_short", "-abc": "affix_form", "abc": "no_templates", "abcd": "no_valid_loan_template", "abce": None, "abcf": "format_returned_none"}
    langs = spark.createDataFrame([("de", "German")], "code string, canonical_name string")
    assert [tuple(r) for r in wiki.loan_lemmas(f, langs).collect()] == [("abce", "", "<C>borrowed from</C> <L>German</L> x")]
    counts = {r.stage: r.n for r in wiki.funnel_counts(f).collect()}
    assert counts["1_total"] == 7 and counts["9_unique_words"] == 1 and counts["excluded_too_short"] == 1


def test_bio_and_metrics(spark):
    df = spark.createDataFrame([("s", "Der <L1>big deal</L1>, <CS1>so</CS1>")], "seq_id string, t string")
    r = classify.labelled_words(df, "t", ["seq_id"]).first()
    assert r.words == ["Der", "big", "deal,", "so"] and r.labels == ["O", "B-LOAN", "I-LOAN", "B-CS"]
    rows = [("a", ["w"] * 5, ["B-X", "I-X", "O", "B-Y", "O"], ["B-X", "I-X", "O", "B-X", "B-Y"], [0.5] * 5), ("b", ["w"] * 2, ["B-X", "O"], ["O", "O"], [0.5] * 2)]
    df = spark.createDataFrame(rows, "seq_id string, words array<string>, gold array<string>, pred array<string>, conf array<double>")
    m = {x.type: x for x in classify.entity_metrics(classify.span_table(df)).collect()}
    assert (m["X"].tp, m["X"].fp, m["X"].fn) == (1, 1, 1) and (m["Y"].tp, m["Y"].fp, m["Y"].fn) == (0, 1, 1)
    assert m["micro"].f1 == pytest.approx(1 / 3) and m["macro"].f1 == pytest.approx(0.25)
    cards = sorted((c.seq_id, c.kind, c.start) for c in classify.error_cards(df).collect())
    assert cards == [("a", "FP", 4), ("a", "TYPE", 3), ("b", "FN", 0)]
    ids = spark.range(1).select(classify.align_subwords(F.array(*map(F.lit, ["O", "B-X"])), F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1), F.lit(1)), {"O": 0, "B-X": 1}).alias("x")).first()["x"]
    assert ids == [-100, 0, 1, -100]


def test_entity_labels(spark):
    names = ["O", "B-A", "I-A"]
    logits = F.array(*[F.array(*map(F.lit, x)) for x in ([0.0, 1.0, 9.0], [0.0, 1.0, 9.0], [5.0, 0.0, 6.0])])
    assert spark.range(1).select(ner.constrained_labels(logits, names).alias("x")).first()["x"] == [1, 2, 2]
    labels, conf = F.array(*map(F.lit, ["B-A", "I-A", "O", "B-A"])), F.array(*map(F.lit, [0.1, 0.9, 0.9, 0.9]))
    assert spark.range(1).select(ner.filter_confidence(labels, conf, {"B-A": 0.5}).alias("x")).first()["x"] == ["O", "O", "O", "B-A"]
    assert ner.parse_thresholds(["B-A:0.5"]) == {"B-A": 0.5}
    with pytest.raises(ValueError):
        ner.parse_thresholds(["x"])


def test_similar_pairs_move_numbers_not_words(spark):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(60)]
    rows, last = [], set()
    for k in range(150):
        last = (last | {rng.choice(pool)}) - {rng.choice(pool)} if k % 6 else set(rng.sample(pool, rng.randint(1, 30)))
        rows.append((k, sorted(last)))
    found = assistant.similar_pairs(spark.createDataFrame(rows, "id int, items array<string>"), "id", "items", 0.8)
    want, seen = {}, {}
    for k, s in rows:
        if s and tuple(s) in seen:
            want[seen[tuple(s)], k] = 1.0
        elif s:
            for t, a in seen.items():
                if (j := len(set(s) & set(t)) / len(set(s) | set(t))) >= 0.8:
                    want[a, k] = j
            seen[tuple(s)] = k
    got = [(r.a, r.b, r.similarity) for r in found.collect()]
    assert len(got) == len(want) > 100 and {(a, b): s for a, b, s in got} == pytest.approx(want)
    # A pair of candidates carries items as numbers.
    plan = found._jdf.queryExecution().optimizedPlan()
    assert "array_intersect" in plan.toString()
    assert any("array<bigint>" in x for x in _types(plan)) and not any("array<string>" in x for x in _types(plan.children().apply(0)))


def _types(plan) -> list[str]:
    """The types of the columns that a plan's nodes hand on."""
    own = [plan.schema().catalogString()]
    return own + [t for k in range(plan.children().size()) for t in _types(plan.children().apply(k))]


def test_similar_pairs_leaves_unlike_sets_where_they_are(spark):
    """Sets that share an item of their prefixes, but little else, are not moved for the exact check; rows of one key are one set."""
    rng = random.Random(5)
    rows = [(k, ["rare"] + [f"w{x}" for x in rng.sample(range(2000), 199)]) for k in range(40)]
    rows += [(100 + k, [*rows[k][1][:195], "y"]) for k in range(3)] + [(200, rows[0][1][:90]), (200, rows[0][1][90:])]
    made = len(shared._made)
    found = assistant.similar_pairs(spark.createDataFrame(rows, "id int, items array<string>"), "id", "items", 0.8)
    assert sorted((r.a, r.b, round(r.similarity, 6)) for r in found.collect()) == [(0, 100, round(195 / 201, 6)), (0, 200, 1.0), (1, 101, round(195 / 201, 6)), (2, 102, round(195 / 201, 6))]
    moved = [p for _, p in shared._made[made:] if "/candidates-" in p]
    assert spark.read.parquet(*moved).count() == 3


def test_valid_rows_make_a_sentence_once_for_all_rules(spark):
    """A filter by errors has the sentences' own expressions in it; each rule's copy of them would make its sentence anew."""
    rows = spark.createDataFrame([(["a", "b"],), (["a", "b,"],), (["", "b"],)], "w array<string>")
    text = lambda p: F.concat(F.lit(f"<{p}1>"), F.element_at("w", 2), F.lit(f"</{p}1>"), F.array_join("w", "-made-"))
    sheet = rows.select(text("L").alias(A.LABEL), F.concat(text("N"), F.lit(" ")).alias(A.REPLACEMENT), F.lit("").alias("Target"), F.lit("+").alias("Valid"), F.lit("").alias("Reason"))
    plan = A.valid_rows(sheet.withColumns({c: F.replace(F.col(f"`{c}`"), F.lit(">a"), F.lit("> a")) for c in (A.LABEL, A.REPLACEMENT)}))
    condition = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert sum(x.count("-made-") for x in condition) == 2
    assert [r[A.LABEL] for r in plan.collect()] == ["<L1>b</L1> a-made-b"]


def test_clusters_take_rows_of_one_key_as_one_set(spark):
    whole = [f"w{k}" for k in range(20)]
    rows = [(1, whole), (2, whole[:10]), (2, whole[10:]), (3, [*whole[:19], "z"]), (4, ["other"])]
    pairs = assistant.similar_pairs(spark.createDataFrame(rows, "id int, items array<string>"), "id", "items", 0.8)
    assert sorted((r.node, r.cluster, round(r.similarity, 6)) for r in assistant.clusters(pairs).collect()) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, round(19 / 21, 6))]
