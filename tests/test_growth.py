"""What keeps the queries' work in proportion to their input."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexarium.functions import spans
from lexarium.functions import text as X
from lexarium.operators import annotation, assistant, classify, islands, lm, tagger
from lexarium.plans import search
from lexarium.sources import corpus

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lemma_stubs_are_those_of_single_words(spark):
    odd = ["", "--", "«Ab-c»", "a..b.", ".\tx\r", "\r", "Ä1!?", "…ß", "ΑΣ.", "x "]
    lines = [[], [""], ["", "a.", ""], odd, odd[::-1], ["."] * 3]
    got = spark.createDataFrame([(x,) for x in lines], "w array<string>").select(X.lemma_stubs(F.col("w")).alias("all"), F.transform("w", X.lemma_stub).alias("one")).collect()
    assert [r["all"] for r in got] == [r["one"] for r in got]


def test_tokens_of_words_with_spaces_and_nulls(spark):
    rows = [(x,) for x in (["A b.", None], ["«x»", None, "Y"], [], [""], ["é! ", "", "Z."], None)]
    got = spark.createDataFrame(rows, "w array<string>").select(corpus.tokens_of(F.col("w")).alias("t"), F.transform("w", lambda w: F.struct(w, X.pos_stub(w), X.lemma_stub(w))).alias("one"))
    assert all([tuple(x) for x in r["t"] or []] == [tuple(x) for x in r["one"] or []] and (r["t"] is None) == (r["one"] is None) for r in got.collect())


def test_rules_of_metadata_leave_the_sentences_alone(spark):
    marks = [(v, r) for v in ("+", "-", "", " ", "?", None) for r in ("", "NE", "zz", None)]
    sheet = spark.createDataFrame([("a <L1>b</L1> <L3>", "c", "", v, r) for v, r in marks], "`Label sentence` string, `Replacement sentence` string, Target string, Valid string, Reason string")
    of = lambda df: [[tuple(e) for e in r["errors"] if e["rule_id"] == "S9" or e["rule_id"].startswith("V0")] for r in df.collect()]
    assert of(annotation.validate_metadata(sheet)) == of(annotation.validate_rows(sheet, "extended"))
    assert "regexp" not in plan(entry.queries()["sheet_metadata_rules"](spark, SMALL))


@pytest.mark.parametrize("name", ["select_stratified", "stratified_quota", "selection_summary", "select_greedy"])
def test_choosing_searches_the_documents_once(spark, name):
    assert "Generate posexplode" not in plan(entry.queries()[name](spark, SMALL))


def test_a_long_row_costs_no_more_than_its_length(spark):
    """60,000 words and 8,571 spans in a row: a search of all spans for every word takes minutes."""
    n, began = 60_000, time.time()
    words = [f"<L{i // 7 + 1}>w{i}</L{i // 7 + 1}>" if i % 7 == 3 else f"w{i}" for i in range(n)]
    rows = spark.createDataFrame([(1, " ".join(words), " ".join(words).replace("L", "N"))], "k int, a string, b string")
    assert {r["prefix"]: r["count"] for r in assistant.token_facts(rows, "a", ["k"]).groupBy("prefix").count().collect()} == {"L": 8571, "o": n - 8571}
    assert assistant.span_facts(rows, "a", "b", ["k"]).where("paired_surface = surface and not is_replaced").count() == 8571
    labels = classify.labelled_words(rows, "a", ["k"])
    table = classify.span_table(labels.withColumn("pred", F.reverse("labels")), "k", "labels", "pred")
    assert table.where("gold_type is not null").count() == 8571
    assert time.time() - began < 40


def test_spans_row_by_row_are_those_of_the_expressions(spark):
    texts = ["<L1>a b</L1>c d", "x<L1></L1>y <CS2>q</CS2><NE3>r  s</NE3>.", "<L1>open </L2> <N4>n</N4>", "no </ tag", "", "  a  <L12>b</L12>\tc\n", "<L1>a <CS1>b</CS1> c</L1> d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "k int, t string")
    fields = ("prefix", "num", "content", "start", "end")
    for r in df.select("t", annotation.inline_spans(F.col("t")).alias("s")).collect():
        if r["t"] is not None:
            assert spans.tagged(r["t"]) == [tuple(x[c] for c in fields) for x in r["s"]]
    words = lambda t: classify.word_spans(X.strip_tags(t))
    want = df.select("k", classify.bio_labels(words(F.col("t")), annotation.inline_spans(F.col("t"))).alias("l"))
    assert sorted(want.collect()) == sorted(classify.labelled_words(df, "t", ["k"]).select("k", "labels").collect())
    bio = [["B-X", "I-X", "I-Y", "O", None, "I-X", "B-Y", "B-Y", "I-Y"], ["I-X", "I-X"], [], ["B-", "I-", "O", "B-X"], ["I-X", "B-X", "I-X"]]
    for r in spark.createDataFrame([(x,) for x in bio], "l array<string>").select("l", islands.valid_spans(F.col("l")).alias("s")).collect():
        assert spans.bio_spans(r["l"]) == [(x["start"], x["end"], x["type"]) for x in r["s"]]


def test_an_epoch_moves_a_sentence_once_for_all_models(spark, monkeypatch):
    """Five models of the same lessons: as many rows are dealt as there are sentences."""
    seen, learned = [], tagger._learned
    monkeypatch.setattr(tagger, "_learned", lambda rows, *a: seen.append(rows.count()) or learned(rows, *a))
    rows = spark.createDataFrame([(i, [f"w{i % 7}", "x"], ["B-A" if i % 7 == 3 else "O", "O"]) for i in range(40)], "k int, words array<string>, labels array<string>")
    found = tagger.cross_validated(rows, "k", ["O", "B-A"], epochs=1, shards=2, buckets=256)
    assert found.count() == 40 and seen == [40]


def _sequential(lines, limit_lines=None, limit_bytes=None):
    """read_vertical() line by line."""
    out, toks, size, now = [], 0, 0, None
    for n, line in enumerate(lines):
        if limit_lines is not None and n >= limit_lines or limit_bytes is not None and size >= limit_bytes:
            break
        size += len(line.encode()) + 1
        if line.startswith(("<s ", "<s>")) or line == "<s":
            if now:
                out.append(now)
            now, on = [re.search('id="([^"]*)"', line), toks, []], True
        elif line.startswith("</s>"):
            if now and on:
                out.append(now)
                now = None
        elif line.strip(" ") and (not line.startswith("<") or "\t" in line):
            toks += 1
            if now:
                now[2].append(line.split("\t")[0])
    return [(k, m[1] if m and m[1] else str(k), at, ws) for k, (m, at, ws) in enumerate(out)]


def test_vertical_lines_are_read_where_they_lie(spark, tmp_path):
    """No line is shuffled; at any split and batch, sentences are those of a reader that goes line by line."""
    rng = random.Random(5)
    pick = ["<s>", '<s id="q">', "</s>", "</s>", "<s", "<g/>", "", " ", "a\tN\ta", "b", "<x\tN", "\t", "<sub>", "é\tX"]
    lines = [rng.choice(pick + ["w\tN\tv"] * 9) for _ in range(400)]
    lines[150:260] = ["t"] * 110
    (tmp_path / "v").mkdir()
    for k in range(3):
        (tmp_path / "v" / f"part-{k}.txt").write_text("".join(x + "\n" for x in lines[k * 150 : (k + 1) * 150]))
    for split, batch in (("128m", "10000"), ("97", "7"), ("300", "1")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for lines_limit, bytes_limit in ((None, None), (123, None), (None, 700)):
                rows = corpus.read_vertical(spark, f"{tmp_path}/v", lines_limit, limit_bytes=bytes_limit)
                assert "value#" not in plan(rows)
                got = sorted((r.spos, r.sentence_id, r.cpos, [t.word for t in r.tokens]) for r in rows.collect())
                assert got == _sequential(lines, lines_limit, bytes_limit)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_held_and_joined_counts_score_alike(spark, monkeypatch):
    """No join where the counts can be held, and no shuffle of words by the empty context, which all bytes share, where they can't."""
    words = ["abba", "Äb", "", None, "zzz", "ab", "ßa b"]
    f = spark.createDataFrame([("abba", 3), ("ab", 1), ("äö", 2), ("zz", 5)], "word string, freq long")
    rows = spark.createDataFrame([(k, w) for k, w in enumerate([["ab", "Xyz", "1a", "ab", "zz"], [], ["--"], None, ["abba", "zz", "Ab"]])], "spos int, words array<string>")
    seen = []
    for most in (lm.HELD_COUNTS, 0):
        monkeypatch.setattr(lm, "HELD_COUNTS", most)
        scored = lm.score_words(spark.createDataFrame([(w,) for w in words], "word string"), lm.count_table(f))
        index = search.surprisal_index(rows, counts=lm.count_table(f))
        assert most == 0 or "Join" not in plan(scored) + plan(index)
        assert most or plan(scored).count("strategy=broadcast") == 4
        traced = lm.traced_bytes(scored)
        seen.append([sorted((r.word, r.pos, r.byte, round(r.surprisal, 9)) for r in scored.collect()), sorted((r.word, r.pos, r.byte, r.bits) for r in traced.collect()), sorted((r.spos, r.mean, r.dm_mad) for r in index.collect())])
    assert seen[0] == seen[1]
    assert ("Äb", 1, 0x84, "10000100") in seen[0][1] and len(seen[0][0]) == 17


def test_tokens_of_a_concordance_without_regular_expressions(spark):
    def parts(raw):
        if re.search(r"^[^\n\r\u0085  ]*/[^/]*/[^/]*\Z", raw):
            return tuple(raw.rsplit("/", 2))
        return (*raw.rsplit("/", 1), raw.rsplit("/", 1)[0]) if "/" in raw else (raw, "UNK", raw)

    raws = ["a", "a/N", "a/N/l", "a/b/N/l", "//", "/", "a//", "x/y/z/N/l", "a\nb/N/l", "a\nb/N", "a/b\nc/N/l", "a/N\n/l\n", "a /N/l", "a\nb"]
    for lines in (raws, [r for r in raws if "\n" not in r]):
        text = "<LINE><MATCHNUM>1</MATCHNUM><CONTENT>" + " ".join(f"<TOKEN>{r}</TOKEN>" for r in lines) + "<MATCH></MATCH></CONTENT></LINE>"
        df = spark.createDataFrame([(text,)], "t string").select(corpus.parse_concordance(F.col("t")).alias("x"))
        assert [tuple(t) for t in df.first()["x"][0]["tokens"]] == [parts(r) for r in lines]
        assert plan(df).count("regexp_extract(") == 1


def test_a_row_of_many_runs_is_tagged_in_time(spark):
    """20,000 tagged runs in a row: counting the runs before each takes minutes."""
    n, began = 40_000, time.time()
    keys = [None if i % 2 else ("CS" if i % 4 else "NE:X") for i in range(n)]
    r = spark.createDataFrame([([f"w{i}" for i in range(n)], keys)], "w array<string>, k array<string>").select(islands.tag_runs(F.col("w"), F.col("k")).alias("t")).first()["t"]
    assert r.startswith("<NE1>w0</NE1> w1 <CS1>w2</CS1> w3 <NE2>w4</NE2>") and f"<CS{n // 4}>w{n - 2}</CS{n // 4}>" in r
    assert time.time() - began < 40


def test_cards_take_types_without_regular_expressions(spark):
    rows = spark.createDataFrame([(1, ["a"], ["O"], [("m", ["B-X"], [0.5])])], "seq_id int, words array<string>, gold array<string>, runs array<struct<model string, pred array<string>, conf array<double>>>")
    cards = classify.model_error_cards(rows)
    assert "regexp" not in plan(cards) and cards.first()["kind"] == "FP"


def test_epochs_read_lessons_dealt_once(spark, monkeypatch):
    """Epochs shuffle no sentence and look for no features: these lie dealt and in order, two bytes a feature, and are deleted in the end."""
    plans, learned = [], tagger._learned
    monkeypatch.setattr(tagger, "_learned", lambda rows, *a: plans.append((rows._jdf.queryExecution().executedPlan().toString(), dict(rows.dtypes), rows)) or learned(rows, *a))
    rows = spark.createDataFrame([(i, [f"w{i % 7}", "x", ""], ["B-A" if i % 7 == 3 else "O", "O", None]) for i in range(60)], "k int, words array<string>, labels array<string>")
    taught = tagger.train_tagger(rows, "k", ["O", "B-A"], epochs=2, shards=2)
    assert len(plans) == 2 and all("Exchange" not in p and "crc32" not in p and t["features"] == "array<smallint>" for p, t, _ in plans)
    file = plans[0][2]._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    assert not os.path.exists(file.removeprefix("file:"))
    assert taught.weights.any()
    wide = tagger.train_tagger(rows, "k", ["O", "B-A"], epochs=2, shards=2, buckets=1 << 17)
    assert plans[-1][1]["features"] == "array<int>" and wide.buckets == 1 << 17
