"""Language of word lists: naive Bayes over character n-grams, in count tables and joins.

Training counts the n-grams (1 to ORDER characters of each lower-cased word between two spaces) a language. A list of
words scores sum(log(n + 1)) - n-grams * log(N + V) for a language, N its n-grams in all and V the distinct n-grams of
all languages: add-one smoothing, with every n-gram nobody has seen at no cost but the common one. Languages are equally
likely beforehand. Lists are sums over their words' scores. A table of at most HELD_GRAMS n-grams is sent to every task,
and lists are scored where they stand; of a larger one, each distinct word is scored once and joined to the lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.sources.shared import kept

ORDER = 3
MAX_LANGUAGES = 200
#: Models of more n-grams, or of more values in all, are joined.
HELD_GRAMS, HELD_VALUES = 1 << 18, 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """The languages in order, log(N + V) of each, and the table gram, s0, s1, ... of log(n + 1)."""

    languages: list[str]
    base: list[float]
    grams: DataFrame
    order: int = ORDER


def word_grams(word: Column, order: int = ORDER) -> Column:
    """array<string>: the n-grams of the lower-cased word between spaces, single spaces left out."""
    of = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
    padded = F.concat(F.lit(" "), F.lower(word), F.lit(" "))
    each = [F.when(F.length(word) + 2 >= n, of(padded, n)).otherwise(F.array().cast("array<string>")) for n in range(1, order + 1)]
    return F.filter(F.concat(*each), lambda g: g != " ")


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n from (lang, word, n); words without a language don't count."""
    grams = words.where("lang is not null and word != ''").select("lang", "n", F.explode(word_grams(F.col("word"), order)).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.sum("n").cast("bigint").alias("n"))


def train_languages(words: DataFrame, order: int = ORDER) -> LanguageModel:
    """A model of (lang, word, n). Only the languages and their totals reach the driver; more than MAX_LANGUAGES of them are an error."""
    counts = kept(gram_counts(words, order), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if not 0 < len(totals) <= MAX_LANGUAGES:
        raise ValueError(f"{len(totals)} languages to learn; there may be 1 to {MAX_LANGUAGES}")
    distinct = counts.select("gram").distinct().count()
    languages = [r["lang"] for r in totals]
    wide = counts.groupBy("gram").agg(*[F.log(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) + 1).alias(f"s{k}") for k, x in enumerate(languages)])
    return LanguageModel(languages, [math.log(r["n"] + distinct) for r in totals], wide, order)


def word_scores(words: DataFrame, model: LanguageModel) -> DataFrame:
    """word, l0, l1, ...: the log-likelihood of each distinct non-empty word in each language."""
    grams = words.where("word is not null and word != ''").select("word").distinct().select("word", F.explode(word_grams(F.col("word"), model.order)).alias("gram"))
    known = grams.join(model.grams, "gram", "left").groupBy("word").agg(F.count("*").alias("_g"), *[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(model.languages))])
    return known.select("word", *[(F.col(f"s{k}") - F.col("_g") * F.lit(b)).alias(f"l{k}") for k, b in enumerate(model.base)])


def detect(lists: DataFrame, keys: list[str], model: LanguageModel, words: str = "words", min_confidence: float = 0.0) -> DataFrame:
    """keys, lang, confidence (its posterior) of each list of words; equal likelihoods: the first by name. Lists without a non-empty word have no row, and lang is null under min_confidence. A word that a list repeats is joined once."""
    tokens = lists.select(*keys, F.explode(words).alias("word")).where("word != ''").groupBy(*keys, "word").agg(F.count("*").alias("_n"))
    scores = word_scores(tokens, model)
    n = range(len(model.languages))
    sums = tokens.join(scores, "word").groupBy(*keys).agg(*[F.sum(F.col("_n") * F.col(f"l{k}")).alias(f"l{k}") for k in n])
    best = F.greatest(*[F.col(f"l{k}") for k in n]) if len(n) > 1 else F.col("l0")
    rows = sums.withColumn("_best", best)
    total = sum((F.exp(F.col(f"l{k}") - F.col("_best")) for k in n), F.lit(0.0))
    lang = F.lit(None).cast("string")
    for k in reversed(n):
        lang = F.when(F.col(f"l{k}") == F.col("_best"), model.languages[k]).otherwise(lang)
    rows = rows.select(*keys, lang.alias("lang"), (1 / total).alias("confidence"))
    return rows.withColumn("lang", F.when(F.col("confidence") >= min_confidence, F.col("lang")))


def held_scores(model: LanguageModel):
    """A function of a column of word lists: array<double> of their log-likelihoods in each language, null for lists without a non-empty word; None if the model is too large to be held."""
    most = min(HELD_GRAMS, HELD_VALUES // len(model.languages))
    rows = model.grams.select("gram", *[f"s{k}" for k in range(len(model.languages))]).limit(most + 1).collect()
    if len(rows) > most:
        return None
    sent = model.grams.sparkSession.sparkContext.broadcast({r[0]: np.array(r[1:]) for r in rows})
    base, order = np.array(model.base), model.order

    @F.arrow_udf("array<double>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = sent.value

        @lru_cache(1 << 16)
        def one(word: str) -> np.ndarray:
            w = f" {word} "
            found = [g for n in range(1, order + 1) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " "]
            return sum((grams[g] for g in found if g in grams), np.zeros(len(base))) - len(found) * base

        for batch in batches:
            flat = batch.flatten().dictionary_encode()
            of = np.array([one(x) for x in flat.dictionary.to_pylist()] or [np.zeros(len(base))])
            have = np.asarray(batch.value_lengths().fill_null(0), np.int64)
            # Lists are summed one by one, so that no list's sum depends on the others in its batch.
            at, ends = flat.indices.to_numpy(zero_copy_only=False), np.cumsum(have)
            sums = [of[at[e - n : e]].sum(axis=0).tolist() if n else None for n, e in zip(have, ends, strict=True)]
            yield pa.array(sums, pa.list_(pa.float64()))

    return lambda words: scores(F.transform(F.filter(words, lambda w: w != ""), F.lower))


def with_languages(rows: DataFrame, key: str, parts: dict[str, tuple[Column, float]], model: LanguageModel) -> DataFrame:
    """rows plus, for each part (its words, its least confidence), a column with that part's language; key is unique. All parts are scored in one pass; by a model that can be held, where they stand."""
    if (scores := held_scores(model)) is not None:
        out = rows
        for name, (words, least) in parts.items():
            out = out.withColumn(f"_l_{name}", scores(words))
        for name, (_, least) in parts.items():
            ll = [F.get(f"_l_{name}", k) for k in range(len(model.languages))]
            best = F.greatest(*ll) if len(ll) > 1 else ll[0]
            lang = F.lit(None).cast("string")
            for k in reversed(range(len(ll))):
                lang = F.when(ll[k] == best, model.languages[k]).otherwise(lang)
            total = sum((F.exp(x - best) for x in ll), F.lit(0.0))
            out = out.withColumn(name, F.when(1 / total >= least, lang))
        return out.drop(*[f"_l_{name}" for name in parts])
    lists = rows.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("part"), words.alias("words")) for name, (words, _) in parts.items()])).alias("p"))
    found = detect(lists.select(key, "p.part", "p.words"), [key, "part"], model)
    wide = found.groupBy(key).agg(*[F.max(F.when((F.col("part") == name) & (F.col("confidence") >= least), F.col("lang"))).alias(name) for name, (_, least) in parts.items()])
    return rows.join(wide, key, "left")
