"""Byte n-gram language model with Witten-Bell back-off, kept as count tables.

A context is the hex string of its bytes. Words are padded with order - 1 spaces in front and one behind. A table of at
most HELD_COUNTS counts is sent to every task, and words are scored where they stand; a larger one is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.sources.files import read_index, write_index
from lexarium.sources.shared import dropped, kept

ORDER = 3
FLOOR = 1e-10
HELD_COUNTS = 1 << 18
#: Longer n-grams don't fit the 64 bits of a held key.
HELD_ORDER = 7


def padded_hex(word: Column, order: int) -> Column:
    return F.concat(F.lit("20" * (order - 1)), F.hex(F.encode(F.lower(word), "UTF-8")), F.lit("20"))


def count_table(words: DataFrame, order: int = ORDER) -> DataFrame:
    """order, ctx, byte, c from (word, freq): for each byte of the padded word at or after the padding, and each order n, the n - 1 bytes before it."""
    h = words.where("word is not null and word != ''").select(padded_hex(F.col("word"), order).alias("h"), F.col("freq").cast("long").alias("freq"))
    at = F.explode(F.sequence(F.lit(order), (F.length("h") / 2).cast("int")))
    h = h.select("h", "freq", at.alias("p"))
    grams = F.explode(F.array(*[F.struct(F.lit(n).alias("order"), F.expr(f"substring(h, 2 * (p - {n}) + 1, {2 * (n - 1)})").alias("ctx"), F.expr("substring(h, 2 * p - 1, 2)").alias("byte")) for n in range(1, order + 1)]))
    return h.select("freq", grams.alias("g")).groupBy("g.order", "g.ctx", "g.byte").agg(F.sum("freq").alias("c"))


def context_table(counts: DataFrame) -> DataFrame:
    """order, ctx, n (count), r (distinct bytes)."""
    return counts.groupBy("order", "ctx").agg(F.sum("c").alias("n"), F.count("*").alias("r"))


def held_counts(counts: DataFrame, order: int = ORDER) -> Broadcast | None:
    """For each order, sorted n-grams as numbers with their counts, and sorted contexts with n and r; None if they are too many to be held."""
    if order > HELD_ORDER:
        return None
    rows = counts.where(F.col("order") <= order).select(F.col("order").cast("int").alias("order"), F.conv(F.concat("ctx", "byte"), 16, 10).cast("long").alias("key"), "c").limit(HELD_COUNTS + 1).toArrow()
    if rows.num_rows > HELD_COUNTS:
        return None
    orders, keys, c = (rows.column(k).to_numpy() for k in range(3))
    tables = []
    for n in range(1, order + 1):
        at = np.flatnonzero(orders == n)
        at = at[np.argsort(keys[at])]
        known, place, r = np.unique(keys[at] >> 8, return_inverse=True, return_counts=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, c[at])
        tables.append((keys[at], c[at], known, total, r))
    return counts.sparkSession.sparkContext.broadcast(tables)


def _bits(tables: list, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the words' bytes, one word after the other, and the words' sizes."""
    order, sizes = len(tables), np.array([len(w) for w in words], np.int64)
    pad = b" " * (order - 1)
    text = np.frombuffer(pad + pad.join(words), np.uint8).astype(np.int64)
    at = np.arange(sizes.sum()) + np.repeat((order - 1) * np.arange(1, len(words) + 1), sizes)
    prob, key = np.full(len(at), 1 / 256), np.zeros(len(at), np.int64)
    for n, (keys, c, known, total, r) in enumerate(tables):
        key = key | text[at - n] << 8 * n
        if len(keys):
            i, j = (np.minimum(np.searchsorted(a, x), len(a) - 1) for a, x in ((known, key >> 8), (keys, key)))
            all_of = (total + r)[i]
            prob = np.where(known[i] != key >> 8, prob, np.where(keys[j] == key, c[j] / all_of, r[i] / all_of * prob))
    return -np.log(np.maximum(prob, FLOOR)) / np.log(2), sizes


def held_bytes(held: Broadcast) -> Callable[[Column], Column]:
    """A function of a column of words: array<double>, the bits of each of a word's bytes."""

    @F.arrow_udf("array<double>")
    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, sizes = _bits(held.value, [w.encode() for w in batch.fill_null("").to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found))

    return lambda word: bits(F.lower(word))


def held_means(held: Broadcast) -> Callable[[Column], Column]:
    """A function of a column of word lists: array<double>, each word's mean bits per byte as half_precision(), 0 for null and empty words."""

    @F.arrow_udf("array<double>")
    def means(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.flatten().dictionary_encode()
            bits, sizes = _bits(held.value, [w.encode() for w in flat.dictionary.to_pylist()])
            word = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(word, bits, len(sizes))
            of = pa.array((sums / np.maximum(sizes, 1)).astype(np.float16).astype(np.float64))
            ends = np.concatenate([[0], np.cumsum(np.asarray(batch.value_lengths().fill_null(0), np.int64))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of.take(flat.indices).fill_null(0.0), mask=batch.is_null())

    return lambda words: means(F.transform(words, F.lower))


def score_words(words: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """word, pos, byte, surprisal (bits) for each byte of the distinct words: c / (n + r) if the byte was seen in its context, else r / (n + r) times the shorter context's probability; an unseen context passes on; below order 1 it is 1 / 256."""
    w = words.select("word").where("word is not null and word != ''").distinct()
    if (held := held_counts(counts, order)) is not None:
        scored = w.select("word", held_bytes(held)(F.col("word")).alias("_s")).select("word", F.posexplode("_s").alias("pos", "surprisal"))
        byte = F.substring(F.hex(F.encode(F.lower("word"), "UTF-8")), F.col("pos") * 2 + 1, F.lit(2))
        return scored.select("word", "pos", byte.alias("byte"), "surprisal")
    w = w.withColumn("h", padded_hex(F.col("word"), order))
    at = F.explode(F.sequence(F.lit(order), (F.length("h") / 2 - 1).cast("int")))
    w = w.select("word", "h", at.alias("p"))
    byte = F.expr("substring(h, 2 * p - 1, 2)")
    grams = w.withColumn("byte", byte)
    ctx = context_table(counts)
    prob = F.lit(1 / 256)
    df = grams
    for n in range(1, order + 1):
        here = F.expr(f"substring(h, 2 * (p - {n}) + 1, {2 * (n - 1)})")
        seen = counts.where(F.col("order") == n).select(F.col("ctx").alias(f"x{n}"), F.col("byte").alias(f"y{n}"), F.col("c").alias(f"c{n}"))
        known = ctx.where(F.col("order") == n).select(F.col("ctx").alias(f"z{n}"), F.col("n").alias(f"n{n}"), F.col("r").alias(f"r{n}"))
        if n < 3:  # at most 65,536 counts, and contexts that very many bytes share
            seen, known = F.broadcast(seen), F.broadcast(known)
        df = df.withColumn(f"k{n}", here)
        df = df.join(known, F.col(f"k{n}") == F.col(f"z{n}"), "left").join(seen, (F.col(f"k{n}") == F.col(f"x{n}")) & (F.col("byte") == F.col(f"y{n}")), "left")
        c, total, r = F.col(f"c{n}"), F.col(f"n{n}"), F.col(f"r{n}")
        prob = F.when(total.isNull(), prob).when(c.isNotNull(), c / (total + r)).otherwise(r / (total + r) * prob)
        df = df.withColumn(f"q{n}", prob)
        prob = F.col(f"q{n}")
    bits = -F.log2(F.greatest(prob, F.lit(FLOOR)))
    return df.select("word", (F.col("p") - order).alias("pos"), "byte", bits.alias("surprisal"))


def word_surprisal(scores: DataFrame) -> DataFrame:
    """word, surprisal: mean bits per byte."""
    return scores.groupBy("word").agg(F.avg("surprisal").alias("surprisal"))


def next_bytes(contexts: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """ctx, byte (0 to 255), p: the full Witten-Bell distribution after each distinct context, hex of at most order - 1 bytes. A shorter context is unknown to every order but the first."""
    c = contexts.select("ctx").distinct()
    known = context_table(counts)
    rows = c.select("ctx", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte"))
    prob = F.lit(1 / 256)
    for n in range(1, order + 1):
        # At order n the context has lost order - n bytes from its front.
        here = F.expr(f"substring(ctx, {2 * (order - n) + 1}, length(ctx))")
        seen = counts.where(F.col("order") == n).select(F.col("ctx").alias("_x"), F.conv("byte", 16, 10).cast("int").alias("_y"), F.col("c").alias(f"c{n}"))
        rest = known.where(F.col("order") == n).select(F.col("ctx").alias("_x"), F.col("n").alias(f"n{n}"), F.col("r").alias(f"r{n}"))
        rows = rows.withColumn("_k", here).join(rest, F.col("_k") == F.col("_x"), "left").drop("_x")
        rows = rows.join(seen, (F.col("_k") == F.col("_x")) & (F.col("byte") == F.col("_y")), "left").drop("_x", "_y", "_k")
        total, r, k = F.col(f"n{n}"), F.col(f"r{n}"), F.col(f"c{n}")
        rows = rows.withColumn(f"q{n}", F.when(total.isNull(), prob).when(k.isNotNull(), k / (total + r)).otherwise(r / (total + r) * prob))
        prob = F.col(f"q{n}")
    return rows.select("ctx", "byte", prob.alias("p"))


def complete(prompts: DataFrame, counts: DataFrame, length: int = 20, order: int = ORDER, temperature: float = 0.0, seed: int = 0, generate: bool = False) -> DataFrame:
    """id, prompt, bytes (hex of the prompt and what follows), text of (id, prompt).

    All prompts advance by a byte a round, in joins with the distributions of the contexts that the round meets: the
    likeliest byte, the least among equals, or at a temperature a draw by seed, id and step from p ** (1 / temperature),
    so that reruns agree. A prompt ends before a space or after `length` bytes. generate: prompts are preceded by
    order - 1 spaces, as words are in training, and a space ends only what has another byte. Bytes that aren't UTF-8
    read as U+FFFD in text. A null prompt is an empty one; ids tell rows apart.
    """
    hexed = F.hex(F.encode(F.coalesce("prompt", F.lit("")), "UTF-8"))
    pad = F.lit("20" * (order - 1) if generate else "")
    state = prompts.select("id", "prompt", F.concat(pad, hexed).alias("h"), F.lit(True).alias("on"))
    counts = kept(counts, "counts")
    for step in range(length):
        now = state.withColumn("ctx", F.when(F.col("on"), F.right("h", F.lit(2 * (order - 1)))))
        after = next_bytes(now.where("on"), counts, order)
        if temperature <= 0:
            chosen = after.groupBy("ctx").agg(F.max(F.struct("p", (-F.col("byte")).alias("b"))).alias("m")).select("ctx", (-F.col("m.b")).alias("byte"))
            new = now.join(chosen, "ctx", "left")
        else:
            weight = F.pow(F.col("p") + FLOOR, F.lit(1 / temperature))
            upto = Window.partitionBy("ctx").orderBy("byte")
            table = after.select("ctx", "byte", F.sum(weight).over(upto).alias("_to"), F.sum(weight).over(Window.partitionBy("ctx")).alias("_all"))
            ladder = table.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("byte", (F.col("_to") / F.col("_all")).alias("to")))).alias("_l"))
            u = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(step)), F.lit(1 << 40)) / float(1 << 40)
            first = lambda ladder, x: F.coalesce(F.get(F.filter(ladder, lambda y: y["to"] > x), F.lit(0))["byte"], F.lit(255))
            new = now.join(ladder, "ctx", "left").withColumn("byte", F.when(F.col("on"), first(F.col("_l"), u)))
        word_yet = F.regexp_replace("h", "^(20)+", "") != "" if generate else F.lit(True)
        ends = (F.col("byte") == 32) & word_yet
        longer = F.concat("h", F.lpad(F.hex(F.col("byte").cast("bigint")), 2, "0"))
        done = kept(new.select("id", "prompt", F.when(F.col("on") & ~ends, longer).otherwise(F.col("h")).alias("h"), (F.col("on") & ~ends).alias("on")), "step")
        if step:
            dropped(state)
        state = done
        if state.where("on").isEmpty():
            break
    whole = F.regexp_replace("h", "^(20)+", "") if generate else F.col("h")
    return state.select("id", "prompt", whole.alias("bytes"), F.make_valid_utf8(F.unhex(whole).cast("string")).alias("text"))


def parse_frequency_list(lines: DataFrame) -> DataFrame:
    """word (lower case), freq from lines `word count` or `count word`; other lines are skipped, repeats stay."""
    part = F.split(F.trim("value"), r"\s+")
    a, b = F.get(part, 0), F.get(part, 1)
    second = b.rlike(r"^\d+$")
    return lines.where(F.size(part) == 2).select(F.lower(F.when(second, a).otherwise(b)).alias("word"), F.when(second, b).otherwise(a).try_cast("bigint").alias("freq")).where("freq is not null")


def mean_deviation(index: DataFrame, scores: str = "mean") -> DataFrame:
    """index plus dm_mad: per sentence (mean - median) / median absolute deviation of the non-zero scores; 0 with fewer than two of them or no deviation."""

    from lexarium.functions.text import let

    def middle(a: Column) -> Column:
        at = lambda s, i: F.get(s, F.floor(i).cast("int"))
        return let(F.sort_array(a), lambda s: (at(s, (F.size(s) - 1) / 2) + at(s, F.size(s) / 2)) / 2)

    def of(clean: Column) -> Column:
        mean = F.aggregate(clean, F.lit(0.0), lambda s, x: s + x) / F.size(clean)
        spread = lambda mid: middle(F.transform(clean, lambda x: F.abs(x - mid)))
        share = lambda mid: let(spread(mid), lambda mad: F.when(mad == 0, 0.0).otherwise((mean - mid) / mad))
        return F.when(F.size(clean) < 2, 0.0).otherwise(let(middle(clean), share))

    return index.withColumn("dm_mad", let(F.filter(F.col(scores), lambda x: x != 0), of))


def save_counts(counts: DataFrame, path: str, order: int = ORDER, mode: str = "error") -> None:
    """A model: its counts as Parquet, with the order beside them."""
    write_index(counts.withColumnRenamed("order", "n"), path, {"kind": "byte counts", "order": order}, mode, sort=["n", "ctx"])


def load_counts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(counts, order); anything but a saved model is an error."""
    rows, meta = read_index(spark, path)
    if meta.get("kind") != "byte counts":
        raise TypeError(f"{path} holds no language model")
    return rows.withColumnRenamed("n", "order"), meta["order"]


def traced_bytes(scored: DataFrame) -> DataFrame:
    """word, pos, byte, bits, surprisal of every byte of the words in score_words() rows."""
    code = F.conv(F.substring(F.hex(F.encode("word", "UTF-8")), F.col("pos") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    rows = scored.where(F.col("pos") < F.octet_length("word")).select("word", "pos", code.alias("byte"), "surprisal")
    return rows.select("word", "pos", "byte", F.lpad(F.bin("byte"), 8, "0").alias("bits"), "surprisal")
