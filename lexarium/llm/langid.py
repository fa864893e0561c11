"""Language identification with word-first backoff.

Training counts every word of every training document per language, and the n-grams of all words, weighted by the
words' counts. A word or n-gram is known if it was seen MIN_COUNT times in one language, whatever the corpus; all
languages' counts of a known key are kept. The known keys are two written tables that prediction joins with.

The most frequent words, as many as make HELD values, are sent to the executors as well. That cache saves most look-ups
and changes no result, whatever its size: scores are sums of log frequencies in fixed point. All other words of the documents are looked up once each by a join, and, if they are
not known, their n-grams.

A known word scores its log frequency in each language. Any other word is scored by its n-grams: those of five
characters if one of them is known, else of four, and so on down to single characters. The scores of a text's words
add up to the posterior.

Cases: a null text, or one without a letter, is `und` with score 0; training skips null texts and null languages;
without any training row everything is `und`; ties go to the first language in code-point order; rows are predicted
one by one, repeated or not; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import double_array, materialize, read_table, works_as

MIN_COUNT = 2
HELD = 1_600_000  # counts in the broadcast: words times languages
LONGEST = 5
FLUSH = 200_000
CACHE = 500_000
SMOOTH = 0.5
#: Log frequencies are whole multiples of 1 / SCALE, so that sums don't depend on their order.
SCALE = 1 << 20
_WORDS = re.compile(r"[^\W\d_]+")
#: Numerals that aren't digits, such as a half or a superscript, count among the word characters; they end a word here.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+")


def text_words(text: str | None) -> list[str]:
    """The runs of letters of the lower-case text."""
    words = _WORDS.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():  # rare, so that the slow pattern sees few words
        words = [x for w in words for x in ([w] if w.isalpha() else _LETTERS.findall(w))]
    return words


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between two boundary marks; single characters without them."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _counted(rows: DataFrame, keys, schema: str) -> DataFrame:
    """Sums of (lang, key, n) from keys(lang, text, n) -> Counter-able items, pre-aggregated in bounded counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush():
            rows = [(lang, k, n) for lang, c in held.items() for k, n in c.items()]
            held.clear()
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "key", "n"])

        for batch in batches:
            for lang, text, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys(held.setdefault(lang, Counter()), text, n)
                if sum(map(len, held.values())) > FLUSH:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _add_words(counter: Counter, text: str, n: int) -> None:
    counter.update(text_words(text))


def _add_grams(counter: Counter, word: str, n: int) -> None:
    for size in range(1, LONGEST + 1):
        for g in grams(word, size):
            counter[g if size > 1 else f"{g}\0"] += n


class Model:
    """Log frequencies of words and n-grams: key -> row of a (rows, languages) table. `tables` are the written words (key, vec) and n-grams (key, vec) of a model that isn't held whole."""

    def __init__(self, langs: list[str], words: list[tuple[str, str, int]], parts: list[tuple[str, str, int]], totals: dict[str, int], tables: tuple[DataFrame, DataFrame] | None = None):
        self.tables = tables
        self.langs = sorted(langs)
        at = {x: k for k, x in enumerate(self.langs)}
        self.words, word_logs = self._table(words, at, {(x, 0): totals.get(x, 0) for x in at}, lambda k: 0)
        sums: Counter = Counter()
        for lang, g, n in parts:
            sums[lang, len(g) if g[-1] != "\0" else 1] += n
        self.grams, gram_logs = self._table(parts, at, sums, lambda g: len(g) if g[-1] != "\0" else 1)
        self.logs = np.concatenate([word_logs, gram_logs])
        self.fixed = np.rint(word_logs.astype(np.float64).reshape(-1, len(self.langs)) * SCALE).astype(np.int64) if self.langs else word_logs

    @staticmethod
    def _table(rows, at, sums, size):
        index: dict[str, int] = {}
        for _, key, _ in rows:
            index.setdefault(key, len(index))
        out = np.zeros((len(index), len(at)), dtype=np.float32)
        for lang, key, n in rows:
            out[index[key], at[lang]] = n
        totals = np.ones((max((size(k) for k in index), default=0) + 1, len(at)))
        for (lang, n), total in sums.items():
            if n < len(totals):
                totals[n, at[lang]] += total
        which = np.array([size(k) for k in index], dtype=np.int64)
        return index, np.log((out + SMOOTH) / totals[which]).astype(np.float32) if index else out

    def parts(self, word: str) -> tuple[int, ...]:
        """Rows of `logs` whose mean is the word's score: its own, or its longest known n-grams'; () if no part is known."""
        if (k := self.words.get(word)) is not None:
            return (k,)
        first, known = len(self.words), self.grams
        for n in range(LONGEST, 0, -1):
            found = tuple(first + k for g in grams(word, n) if (k := known.get(g if n > 1 else f"{g}\0")) is not None)
            if found:
                return found
        return ()

    def predict(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> tuple[str, float]:
        counts = Counter(text_words(text))
        if not counts or not self.langs:
            return "und", 0.0
        if len(cache) > CACHE:
            cache.clear()
        rows: list[int] = []
        weights: list[float] = []
        for word, n in counts.items():
            if (found := cache.get(word)) is None:
                found = cache[word] = self.parts(word)
            rows += found
            if (k := len(found)) == 1:
                weights.append(n)
            else:
                weights += [n / k] * k if k else ()
        total = np.array(weights, dtype=np.float32) @ self.logs[rows] if rows else np.zeros(len(self.langs))
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def _by_key(counts: DataFrame, langs: list[str], tag: str) -> DataFrame:
    """key, counts (one number a language, in order) of the known keys."""
    per_lang = F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("long") for x in langs]).cast("array<bigint>")
    return materialize(counts.groupBy("key").agg(per_lang.alias("counts")).where(F.array_max("counts") >= MIN_COUNT), tag)


def _size(key: Column) -> Column:
    return F.when(key.endswith("\0"), 1).otherwise(F.length(key))


def train(labelled: DataFrame) -> Model:
    """From all rows (lang, text); nulls don't count. The driver holds frequent words only."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.lit(1).cast("long").alias("n"))
    counts = materialize(_counted(rows, _add_words, "lang string, key string, n bigint"), "words")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], [], [], {})
    words = _by_key(counts, langs, "known")
    parts = _by_key(_counted(counts.select("lang", F.col("key").alias("text"), "n"), _add_grams, "lang string, key string, n bigint"), langs, "grams")
    sums = parts.groupBy(_size(F.col("key")).alias("size")).agg(*[F.sum(F.get("counts", k)) for k in range(len(langs))])
    sums = {0: [totals[x] for x in langs]} | {r[0]: r[1:] for r in sums.collect()}
    flat = double_array(1.0 + (sums[size][k] if size in sums else 0) for size in range(LONGEST + 1) for k in range(len(langs)))
    vec = lambda size: F.transform("counts", lambda n, k: F.round(F.log((n + SMOOTH) / F.get(flat, size * len(langs) + k)) * SCALE).cast("long")).alias("vec")
    often = double_array(1.0 / max(1, totals[x]) for x in langs)
    frequent = words.orderBy(F.array_max(F.transform("counts", lambda n, k: n * F.get(often, k))).desc(), "key").limit(max(1, HELD // len(langs))).select("key", vec(F.lit(0))).toArrow().combine_chunks()
    model = Model(langs, [], [], totals, (words.select("key", vec(F.lit(0))), parts.select("key", vec(_size(F.col("key"))))))
    model.words = {key: k for k, key in enumerate(frequent.column("key").to_pylist())}
    model.fixed = pc.list_flatten(frequent.column("vec")).to_numpy().reshape(len(model.words), len(langs))
    return model


def _sum_vec(n_langs: int, weight: Column) -> list[Column]:
    return [F.sum(weight * F.get("vec", k)).alias(f"s{k}") for k in range(n_langs)]


def resolve(vocabulary: DataFrame, words: DataFrame, parts: DataFrame, n_langs: int) -> DataFrame:
    """word, vec of those distinct words that are known, or have a known n-gram: the mean of the longest known ones."""
    looked_up = vocabulary.join(words.withColumnRenamed("key", "word").hint("merge"), "word", "left").withColumn("wid", F.monotonically_increasing_id())
    looked_up = materialize(looked_up, "vocabulary")
    # n-grams go with the word's number: a word of a million characters has as many n-grams.
    rest = looked_up.where("vec is null").select("wid", "word")
    found = looked_up.where("vec is not null").select("wid", "vec")

    def split(sizes: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            works_as("languages", lambda: None)
            for batch in batches:
                wids, keys = [], []
                for wid, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for n in sizes:
                        new = grams(word, n) if n > 1 else [f"{g}\0" for g in word]
                        wids += [wid] * len(new)
                        keys += new
                    if len(keys) >= FLUSH:
                        yield pa.record_batch([pa.array(wids, pa.int64()), pa.array(keys, pa.string())], names=["wid", "key"])
                        wids, keys = [], []
                yield pa.record_batch([pa.array(wids, pa.int64()), pa.array(keys, pa.string())], names=["wid", "key"])

        return rest.select("wid", "word").mapInArrow(run, "wid bigint, key string")

    # The longest n-grams first: few words are left for the shorter ones.
    for sizes in ((LONGEST,), tuple(range(1, LONGEST))):
        hits = split(sizes).hint("merge").join(parts.where(_size(F.col("key")).isin(*sizes)).hint("merge"), "key")
        hits = hits.groupBy("wid", _size(F.col("key")).alias("size")).agg(F.count("*").alias("found"), *_sum_vec(n_langs, F.lit(1)))
        mean = F.array(*[F.round(F.col(f"s{k}") / F.col("found")).cast("long") for k in range(n_langs)])
        hits = materialize(hits.groupBy("wid").agg(F.max_by(mean, "size").alias("vec")), "resolved")
        found, rest = found.unionByName(hits), rest.join(hits.hint("merge"), "wid", "left_anti")
    return looked_up.select("wid", "word").join(found.hint("merge"), "wid").drop("wid")


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep's columns plus lang_pred and score; the prediction sees text alone."""
    n_langs = len(model.langs)
    given = docs.select(*[F.col(c).alias(c) for c in keep], F.col("text").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.fixed))
    schema = T.StructType([*given.schema.fields[:-1], *T._parse_datatype_string("_any boolean, _sum array<bigint>, _rest array<struct<word:string,n:bigint>>").fields])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works_as("languages", lambda: None)
        index, logs = sent.value
        for batch in batches:
            seen, sums, words, times, ends = [], [], [], [], [0]
            for text in batch.column(len(keep)):
                counts = Counter(text_words(text.as_py()))
                rows, weights = [], []
                for word, n in counts.items():
                    if (k := index.get(word)) is not None:
                        rows.append(k)
                        weights.append(n)
                    elif n_langs:
                        words.append(word)
                        times.append(n)
                seen.append(bool(counts))
                sums.append((np.array(weights, dtype=np.int64) @ logs[rows]).tolist() if rows else [0] * n_langs)
                ends.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["word", "n"])
            cols = [pa.array(seen, pa.bool_()), pa.array(sums, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)]
            yield pa.record_batch([*batch.columns[:-1], *cols], names=[*keep, "_any", "_sum", "_rest"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seen, *parts in zip(*(batch.column(len(keep) + k).to_pylist() for k in range(3)), strict=True):
                if not seen or not langs:
                    out.append(("und", 0.0))
                    continue
                total = sum(np.array(x, dtype=np.int64) for x in parts if x)
                best = int(np.argmax(total))
                out.append((langs[best], float(1 / np.exp(np.clip((total - total[best]) / SCALE, -700, 0)).sum())))
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*keep, "lang_pred", "score"])

    langs = model.langs
    scored = given.mapInArrow(first, schema).withColumn("_rid", F.monotonically_increasing_id())
    if langs:
        scored = materialize(scored, "scored")
        rest = scored.select("_rid", F.explode("_rest").alias("w")).select("_rid", "w.*")
        vecs = resolve(rest.select("word").distinct(), *model.tables, n_langs)
        more = rest.hint("merge").join(vecs.hint("merge"), "word").groupBy("_rid").agg(*_sum_vec(n_langs, F.col("n")))
        more = more.select("_rid", F.array(*[f"s{k}" for k in range(n_langs)]).alias("_more"))
        scored = scored.join(more, "_rid", "left")
    else:
        scored = scored.withColumn("_more", F.col("_sum"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return scored.select(*keep, "_any", "_sum", "_more").mapInArrow(last, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    model = train(docs.where("not coalesce(held_out, false)").select("lang", "text"))
    return predict(docs.withColumn("held_out", F.coalesce("held_out", F.lit(False))), model, ["doc_id", "held_out"])
