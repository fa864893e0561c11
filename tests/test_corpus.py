from pyspark.sql import functions as F

from lexarium.operators import index, islands
from lexarium.sources import corpus, files

VERT = """<doc x="1">
out\tX\tout
<s id="a">
The\tD\tthe

dog\tN\tdog
<b\tN\tb
</s>
<s id="b">
Runs\tV
<s>
fast\tA\tfast
</s>
<s id="c">
</s>
<s id="lost">
never\tA\tnever
"""


def test_vertical(spark, tmp_path):
    (tmp_path / "x.vert").write_text(VERT)
    rows = corpus.read_vertical(spark, str(tmp_path / "x.vert")).orderBy("spos").collect()
    assert [(r.spos, r.sentence_id, [t.word for t in r.tokens]) for r in rows] == [(0, "a", ["The", "dog", "<b"]), (1, "b", ["Runs"]), (2, "2", ["fast"]), (3, "c", [])]
    assert [r.cpos for r in rows[:3]] == [1, 4, 5]
    assert rows[1].tokens[0].lemma == "Runs"
    assert corpus.read_vertical(spark, str(tmp_path / "x.vert"), limit_sentences=2).count() == 2


def test_concordance(spark):
    t = "<LINE><MATCHNUM>7</MATCHNUM><CONTENT><TOKEN>a/b/DT/the</TOKEN> <MATCH><TOKEN>x</TOKEN></MATCH><TOKEN> </TOKEN><TOKEN>y/N</TOKEN></CONTENT></LINE>"
    r = spark.range(1).select(corpus.parse_concordance(F.lit(t)).alias("x")).first()["x"][0]
    assert (r.cqp_id, r.match_index) == (7, 1)
    assert [tuple(x) for x in r.tokens] == [("a/b", "DT", "the"), ("x", "UNK", "x"), ("y", "N", "y")]


def test_runs(spark):
    rows = [(0, [0, 9, 9]), (1, [9, 1, 9, 9, 1, 9, 9]), (2, []), (3, [1, 5, 9]), (4, [9, 9, 9, 1]), (5, [9, 9, 9, 9])]
    rows = [(k, [float(x) for x in v]) for k, v in rows]
    df = spark.createDataFrame(rows, "spos int, s array<double>")
    got = {r.spos: (r.run_start, r.run_length) for r in islands.best_runs(df, "s", 5.0, 2, 3, block_keys=2).collect()}
    # 0/1 share a run over their edge; in 1 the run at its end stands before 2 (empty) and 3, which starts low.
    assert got == {1: (2, 2)}
    got = {r.spos: (r.run_start, r.run_length) for r in islands.best_runs(df, "s", 5.0, 2, None).collect()}
    assert got == {1: (2, 2), 5: (0, 4)}


def test_tagging(spark):
    from lexarium.sources.corpus import TOKEN

    t = [("Der", "x", "der"), ("Job", "n", "job"), ("Deal", "n", "deal"), ("job", "n", "job")]
    df = spark.createDataFrame([(t,)], f"t array<{TOKEN.simpleString()}>")
    r = df.select(islands.tag_loanwords(F.col("t"), ["job", "deal"], "deal").alias("x")).first()["x"]
    assert r == "Der <L2>Job</L2> <L1>Deal</L1> <L3>job</L3>"
    words = F.array(*map(F.lit, "a b c d e".split()))
    labels = F.array(*map(F.lit, ["B-PER", "B-PER", "O", "I-LOC", "O"]))
    keys = islands.entity_types(labels)
    assert spark.range(1).select(islands.tag_runs(words, keys).alias("x")).first()["x"] == "<PER1>a b</PER1> c <LOC1>d</LOC1> e"
    flags = F.array(*map(F.lit, [False, False, True, True, False]))
    assert spark.range(1).select(islands.tag_switch_and_entities(words, flags, labels).alias("x")).first()["x"] == "<NE1>a b</NE1> <CS1>c d</CS1> e"


def test_index_checks(spark):
    a = spark.createDataFrame([(0, 0, 3), (1, 3, 2), (2, 4, 1), (4, 9, 1)], "spos long, cpos long, count long")
    assert {(r.rule, r.spos, r.detail) for r in index.validate_index(a, block_keys=2).collect()} == {("cpos_overlap", 2, 1), ("spos_step", 4, 2)}
    b = a.where("spos != 1")
    assert index.first_divergence(a, b).first()["spos"] == 1
    assert index.first_divergence(a, a).first()["spos"] is None
    pts = spark.createDataFrame([(0,), (2,), (3,), (7,), (9,), (10,)], "cpos long")
    s = spark.createDataFrame([(0, 0, 3), (1, 3, 2), (2, 9, 1)], "spos long, cpos long, count long")
    assert {r.cpos: r.spos for r in index.locate_positions(pts, s, span=4).collect()} == {0: 0, 2: 0, 3: 1, 7: -1, 9: 2, 10: -1}


def test_vocabulary(spark):
    lines = spark.createDataFrame([("b", 1), ("", 2), ("a", 3), ("b", 4), ("B", 5)], "value string, n int")
    v = index.vocabulary(lines, "value", "n")
    assert [(r.idx, r.lemma) for r in v.orderBy("idx").collect()] == [(1, "b"), (2, "a"), (3, "B")]
    ids, missing = index.wanted_ids(["B", "zz"], v)
    assert {r.idx for r in ids.collect()} == {1, 3} and [r.requested for r in missing.collect()] == ["zz"]


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "v double")
    assert [r.n for r in index.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 2]
    assert [r.n for r in index.histogram(df.where("v = 5"), "v", 2).orderBy("bin").collect()] == [1, 0]
    assert index.histogram(df.where("false"), "v", 2).count() == 0


def test_round_trips(spark, tmp_path):
    p = str(tmp_path)
    idx = spark.createDataFrame([(0, [1.0]), (1, [])], "spos long, scores array<double>")
    files.write_index(idx, f"{p}/i", {"order": 3})
    back, meta = files.read_index(spark, f"{p}/i")
    assert back.count() == 2 and meta == {"order": 3}
    (tmp_path / "w.csv").write_text("word,ok\n a ,x\n,x\nb,\nc,x\n")
    assert [r.word for r in files.read_words(spark, f"{p}/w.csv", "word", "ok").collect()] == ["a", "c"]
    rec = spark.createDataFrame([("a", "b", "t", "p", "q", {"1": "x"}, {"1": "y"}, {"1": ["x", "y"]})], files.RECORD)
    files.write_dataset(rec, f"{p}/d")
    assert files.read_dataset(spark, f"{p}/d").collect() == rec.collect()
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    files.write_splits(rows, f"{p}/s", [f"{p}/w.csv"])
    back, src = files.read_splits(spark, f"{p}/s")
    assert back.count() == 2 and len(src.first()["sha256"]) == 64


def test_stream_appends_once(spark, tmp_path):
    from lexarium.streaming.append import append_index, document_stream

    p = str(tmp_path)
    spark.createDataFrame([(1, "ab cd\nef"), (2, None)], "doc_id long, text string").write.parquet(f"{p}/in/a")
    for _ in range(2):
        q = append_index(document_stream(spark, f"{p}/in/a"), f"{p}/out", f"{p}/cp")
        q.awaitTermination()
    assert spark.read.parquet(f"{p}/out").count() == 2


ODD_DOCUMENTS = [(3, "a b\n\nc  d e\n"), (1, "one"), (None, "null id\nsecond line"), (None, "another"), (2, None), (-5, "minus five"), (2**62, "far\naway " * 3), (7, "\n \n"), (3, "a b\n\nc  d e\n"), (3, "other text of three"), (0, "zero"), (4, "")] + [(10**15 * k + 17, f"sparse {k}\nids") for k in range(1, 40)]


def test_positions_of_documents_with_null_sparse_and_repeated_ids(spark):
    docs = spark.createDataFrame(ODD_DOCUMENTS, "doc_id long, text string").repartition(5)
    rows = sorted(corpus.corpus_sentences(docs).collect(), key=lambda r: r.spos)
    assert [r.spos for r in rows] == list(range(len(rows)))
    at = 0
    for r in rows:
        assert r.cpos == at
        at += len(r.words)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0)), "in order of doc_id, null ones last"
    want = sorted((str(i), n, t.split(" ")) for i, x in ODD_DOCUMENTS if x for n, t in enumerate(x.split("\n")) if t)
    assert sorted((str(r.doc_id), r.line, r.words) for r in rows) == [(i, n, [w for w in t if w]) for i, n, t in want]
    three = [(r.line, r.words) for r in rows if r.doc_id == 3]
    copy = [(0, ["a", "b"]), (2, ["c", "d", "e"])]
    assert three in ([*copy, *copy, (0, ["other", "text", "of", "three"])], [(0, ["other", "text", "of", "three"]), *copy, *copy]), "documents of one id follow one another"
    assert corpus.corpus_sentences(docs.limit(0)).count() == 0


def test_positions_move_texts_once_and_words_never(spark, tmp_path):
    spark.createDataFrame([(k, f"a b {k}\nc") for k in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    s = corpus.corpus_sentences(spark.read.parquet(f"{tmp_path}/d")).select("spos", "cpos", "words")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = s._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(_id" in x]
    assert len(shuffles) == 2 and plan.count("text#") and plan.index("Generate") < plan.index("Exchange hashpartitioning"), "texts and counts move to be joined, lines are cut out above"


def test_positions_of_sentences_equal_those_of_documents(spark):
    docs = spark.createDataFrame([x for x in ODD_DOCUMENTS if x[0] != 3 and x[0] is not None], "doc_id long, text string").repartition(3)
    key = lambda df: sorted((r.doc_id, r.line, r.words, r.spos, r.cpos) for r in df.collect())
    assert key(corpus.positions(corpus.document_sentences(docs))) == key(corpus.corpus_sentences(docs))


def test_vertical_round_trip_at_any_split(spark, tmp_path):
    """Written by several tasks, read in one split and in fifty; words that look like marks stay words."""
    words = ["a", "<s>", "</s>", "<s id=1>", "<b>", "x y\tz", "é", "", "<"]
    rows = [(k, f"d{k}", [(w, "n", f"l{k}") for w in words[: k % 10]]) for k in range(120)]
    df = spark.createDataFrame(rows, "spos long, id string, tokens array<struct<word string, pos string, lemma string>>").repartition(4)
    corpus.write_vertical(df, f"{tmp_path}/v", "id")
    seen = [w.replace("\t", " ") for w in words]
    seen[1:4] = ["＜" + w[1:] for w in words[1:4]]
    want, at = [], 0
    for k, name, tokens in rows:
        got = [w for w in seen[: k % 10]]
        want.append((k, name, at, got))
        at += len(got)
    for size in ("128m", "100"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            back = corpus.read_vertical(spark, f"{tmp_path}/v")
            assert size == "128m" or spark.read.text(f"{tmp_path}/v").rdd.getNumPartitions() >= 50
            got = sorted((r.spos, r.sentence_id, r.cpos, [t.word for t in r.tokens]) for r in back.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
        assert all(g[2] == w[2] for g, w in zip(got, want, strict=True))


def test_stored_indices_join_without_a_shuffle(spark, tmp_path):
    s = spark.createDataFrame([(k, 2 * k, 2, k % 5) for k in range(500)], "spos long, cpos long, count int, x int")
    for name in ("one", "two"):
        files.store_index(s.withColumnRenamed("x", name), f"test_{name}", f"{tmp_path}/{name}", buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (files.stored_index(spark, f"test_{n}") for n in ("one", "two"))
        joined = a.join(b.drop("cpos", "count"), "spos")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 500
        lookup = files.stored_index(spark, "test_one", [7])
        assert "EqualTo(spos,7)" in lookup._jdf.queryExecution().executedPlan().toString() and lookup.first()["cpos"] == 14
        assert index.aligned(a, b).count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table test_one")
        spark.sql("drop table test_two")


def test_datasets_of_both_layouts(spark, tmp_path):
    rows = spark.createDataFrame([(f"s {k}", f"t {k}") for k in range(5)], "source_plain string, target string")
    files.write_dataset(rows.repartition(2), f"{tmp_path}/lines")
    (tmp_path / "list.json").write_text('\n[\n {"source_plain": "a"},\n {"source_plain": "b"}\n]\n')
    (tmp_path / "one.json").write_text('{\n"source_plain": "a"\n}\n')
    read = lambda p: sorted(r.source_plain for r in files.read_dataset(spark, str(tmp_path / p)).collect())
    assert read("lines") == [f"s {k}" for k in range(5)] and read("list.json") == ["a", "b"] and read("one.json") == ["a"]


def test_a_vertical_file_is_made_once(spark, tmp_path):
    """Neither the ranges' bounds nor the filter make a sentence's lines again."""
    made = spark.sparkContext.accumulator(0)

    def counted(words):
        made.add(len(words))
        return words

    df = spark.range(200).select(F.col("id").alias("spos"), F.udf(lambda n: counted([f"w{n}"]), "array<string>")("id").alias("words"))
    corpus.write_vertical(df.select("spos", corpus.tokens_of(F.col("words")).alias("tokens")), f"{tmp_path}/v")
    assert made.value == 200
    assert sorted(r.spos for r in corpus.read_vertical(spark, f"{tmp_path}/v").collect()) == list(range(200))
