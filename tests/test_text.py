import numpy as np
from pyspark.sql import functions as F

from lexarium.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_half_precision_matches_numpy(spark):
    values = [0.1, 1.0, -3.3, 2049.0, 65504.0, 65519.9, 65520.0, 7e4, -7e4, 1e-5, 6e-8, 2e-8, 2.0**-14, 2.0**-25, 3 * 2.0**-25, 0.0, 1 / 3, 5.96e-8]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.half_precision("v").alias("h"))
    for r in df.collect():
        with np.errstate(over="ignore"):
            assert r.h == float(np.float16(r.v)), r


def test_clean_words(spark):
    good, bad = ["tion", "né", "a-b", "U.S"], ["a", "", "a/b", "a_b", "[abc]", "x2", "=>", "ˈɐx", "12", "a±b"]
    df = spark.createDataFrame([(w,) for w in good + bad], "w string").select("w", X.is_clean_word("w").alias("k"), X.is_clean_word("w", False).alias("s"))
    got = {r.w: (r.k, r.s) for r in df.collect()}
    assert all(got[w][0] for w in good) and not any(got[w][0] for w in bad)
    assert got["tion"] == (True, True) and got["né"] == (True, False) and got["U.S"] == (True, False)


def test_tags(spark):
    t = "Ein <L1>Job</L1> und <L2>ein Deal</L2> <CS1>of course</CS1>"
    assert one(spark, X.extract_tags(F.lit(t), "L")) == {"1": "Job", "2": "ein Deal"}
    assert one(spark, X.native_template(F.lit(t))).startswith("Ein <N1>Job</N1>")
    assert one(spark, X.paired_tags(F.lit(t), F.lit("<N1>Arbeit</N1>"))) == {"1": ["Job", "Arbeit"]}
    assert one(spark, X.remap_tag(F.lit(t), "CS", "NE")).endswith("<NE1>of course</NE1>")
    assert one(spark, X.strip_tags(F.lit(t))) == "Ein Job und ein Deal of course"


def test_protected_terms_beyond_ten(spark):
    t = " ".join(f"<CS{k}>w{k}</CS{k}>" for k in range(1, 13))
    held = spark.range(1).select(X.protect_spans(F.lit(t)).alias("h"))
    assert "<CS" not in held.first()["h"]["text"]
    assert held.select(X.restore_spans(F.col("h.text"), F.col("h.terms")).alias("x")).first()["x"] == t


def test_small_functions(spark):
    assert one(spark, X.split_sentences(F.lit("One. Two! Three"))) == ["One.", "Two!", "Three"]
    assert one(spark, X.normalize_slashes(F.lit("a//zxb"))) == "a/b"
    assert one(spark, X.clean_reply(F.lit(" Hallo \n German: Welt\nx"))) == "Hallo"
    assert [(r["byte"], r["bits"]) for r in one(spark, X.byte_trace(F.lit("aé")))] == [(97, "01100001"), (195, "11000011"), (169, "10101001")]
    assert one(spark, X.exact_token_query(F.lit("Hi, you"))) == '[word="Hi" %c] [word="," %c] [word="you" %c]'
    assert one(spark, X.template_parts(F.lit("a {{bor|lv| de |x}} b {{w}}"))) == [["bor", "lv", "de", "x"], ["w"]]
    assert abs(sum(one(spark, X.softmax(F.array(*map(F.lit, (1.0, 2.0, 3.0)))))) - 1) < 1e-12
