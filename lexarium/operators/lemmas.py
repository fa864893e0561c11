"""A lemmatiser of suffix rules learned from (word, lemma) pairs.

A pair is told by what remains after the longest common prefix: the word's ending goes, the lemma's takes its place. It
votes for that rewrite under each ending of the word that holds what goes, up to CONTEXT more characters. The rewrite
with most votes becomes the rule of an ending. A word takes the lemma that was seen for it most often, else the rule of
its longest ending, else itself. Words and lemmas are compared in lower case; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT, LONGEST = 3, 8


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    differs = lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))
    places = F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i > n) | differs(i))
    return F.array_min(places) - 1


def _clean_pairs(pairs: DataFrame) -> DataFrame:
    rows = pairs.select(F.lower("word").alias("word"), F.lower("lemma").alias("lemma"), F.col("freq").cast("bigint").alias("freq"))
    return rows.where("word != '' and lemma != '' and freq > 0").groupBy("word", "lemma").agg(F.sum("freq").alias("freq"))


def known_lemmas(pairs: DataFrame) -> DataFrame:
    """word, lemma: the most frequent lemma of each word, the first by name among equals."""
    best = F.max_by("lemma", F.struct("freq", F.col("rank")))
    ranked = _clean_pairs(pairs).withColumn("rank", -F.row_number().over(Window.partitionBy("word").orderBy("lemma")))
    return ranked.groupBy("word").agg(best.alias("lemma"))


def suffix_rules(pairs: DataFrame, least: int = 2, context: int = CONTEXT, longest: int = LONGEST) -> DataFrame:
    """ending, cut (characters that go), add (what comes): one row an ending with at least `least` votes for its rewrite; distinct words vote once. Equal votes: the smaller cut, then add. Endings over `longest` characters have no rule."""
    rows = _clean_pairs(pairs).select("word", "lemma").distinct().withColumn("_n", _common(F.col("word"), F.col("lemma")))
    rows = rows.select("word", (F.length("word") - F.col("_n")).cast("int").alias("cut"), F.expr("substring(lemma, _n + 1, length(lemma))").alias("add"))
    upto = F.least(F.length("word"), F.col("cut") + context, F.lit(longest))
    ends = rows.where(F.col("cut") <= upto).select("cut", "add", F.explode(F.transform(F.sequence(F.col("cut"), upto), lambda k: F.when(k == 0, "").otherwise(F.expr("word").substr(F.length("word") - k + 1, k)))).alias("ending"))
    votes = ends.groupBy("ending", "cut", "add").agg(F.count("*").alias("n"))
    best = votes.where(F.col("n") >= least).groupBy("ending").agg(F.min(F.struct((-F.col("n")).alias("m"), "cut", "add")).alias("r"))
    return best.select("ending", "r.cut", "r.add")


def lemmatize(words: DataFrame, rules: DataFrame, known: DataFrame | None = None, longest: int = LONGEST) -> DataFrame:
    """word, lemma of the distinct lower-cased words. Each looks its endings up in one join; a rule that would leave nothing is passed over."""
    w = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    upto = F.least(F.length("word"), F.lit(longest))
    ends = w.select("word", F.explode(F.sequence(F.lit(0), upto)).alias("_k"))
    ends = ends.select("word", "_k", F.when(F.col("_k") == 0, "").otherwise(F.expr("substring(word, length(word) - _k + 1, _k)")).alias("ending"))
    hits = ends.join(rules, "ending").withColumn("_l", F.expr("concat(substring(word, 1, length(word) - cut), add)")).where("_l != ''")
    found = hits.groupBy("word").agg(F.max_by("_l", "_k").alias("_rule"))
    out = w.join(found, "word", "left")
    if known is None:
        return out.select("word", F.coalesce("_rule", "word").alias("lemma"))
    return out.join(known.select("word", F.col("lemma").alias("_known")), "word", "left").select("word", F.coalesce("_known", "_rule", "word").alias("lemma"))


def lemmatize_sentences(sentences: DataFrame, keys: list[str], rules: DataFrame, known: DataFrame | None = None, words: str = "words") -> DataFrame:
    """sentences plus lemmas (array<string>, as many as words); each distinct word is worked out once. keys tell sentences apart."""
    tokens = sentences.select(*keys, F.posexplode(words).alias("_i", "_w")).withColumn("word", F.lower("_w"))
    placed = tokens.join(lemmatize(tokens.select("word"), rules, known), "word", "left")
    lists = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "lemma"))).alias("_x")).select(*keys, F.col("_x.lemma").alias("lemmas"))
    return sentences.join(lists, keys, "left").withColumn("lemmas", F.coalesce("lemmas", F.array().cast("array<string>")))


def paired_forms(vocabulary: DataFrame, stem: int = 6, most: int = 4) -> DataFrame:
    """word, lemma, freq: pairs that a vocabulary (distinct word, freq) shows by itself. Words of stem to stem + most characters with the same first `stem` are forms of the most frequent of them (then the shortest, then the first)."""
    v = vocabulary.where(F.length("word").between(stem, stem + most)).withColumn("_s", F.substring("word", 1, stem))
    first = v.groupBy("_s").agg(F.min(F.struct((-F.col("freq")).alias("f"), F.length("word").alias("n"), "word")).alias("m")).select("_s", F.col("m.word").alias("lemma"))
    return v.join(first, "_s").select("word", "lemma", "freq")
