"""Sub-words by the longest match first, label alignment over them, and token statistics of several tokenizations.

A word is cut from left to right, each time at the longest piece of a table that fits; pieces inside a word begin with
MARK. A word that can't be cut to its end is one UNKNOWN piece. A table of at most HELD_PIECES pieces is sent to every
task, and words and sentences are cut where they stand. A larger one meets every distinct word's substrings in one join;
what fits where is then folded over the word, in as many steps as it has characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.operators.classify import align_subwords

#: How such tables write pieces inside a word, and the piece for what they can't spell.
MARK, UNKNOWN = "##", "[UNK]"
LONGEST_PIECE, LONGEST_WORD = 12, 100
#: Tables of more pieces are joined.
HELD_PIECES = 1 << 18


def held_pieces(pieces: DataFrame, longest: int = LONGEST_PIECE) -> frozenset[str] | None:
    """The pieces of up to `longest` characters, if there are at most HELD_PIECES."""
    inside = F.when(F.col("piece").startswith(MARK), len(MARK)).otherwise(0)
    rows = pieces.select("piece").where(F.length("piece") - inside <= longest).distinct().limit(HELD_PIECES + 1).collect()
    return frozenset(r["piece"] for r in rows) if len(rows) <= HELD_PIECES else None


def _cutter(table: frozenset[str], longest: int, longest_word: int) -> Callable[[str | None], list[str]]:
    inside = {p.removeprefix(MARK): p for p in table if p.startswith(MARK)}
    first = {p: p for p in table}
    most = [min(longest, max(map(len, t), default=0)) for t in (first, inside)]

    def cut(word: str | None) -> list[str]:
        if not word:
            return []
        out, at, size = [], 0, len(word)
        while at < size <= longest_word:
            held = inside if at else first
            for end in range(min(at + most[at > 0], size), at, -1):
                if (piece := held.get(word[at:end])) is not None:
                    break
            else:
                break
            out.append(piece)
            at = end
        return out if at == size else [UNKNOWN]

    return lru_cache(1 << 18)(cut)


def word_pieces(words: DataFrame, pieces: DataFrame, longest: int = LONGEST_PIECE, longest_word: int = LONGEST_WORD) -> DataFrame:
    """word, pieces (array<string>) of the distinct words (word); pieces: piece. Pieces over `longest` characters are never used; longer words than longest_word are unknown; the empty word has no piece."""
    w = words.select("word").where("word is not null").distinct()
    table = held_pieces(pieces, longest)
    if table is None:
        return joined_pieces(w, pieces, longest, longest_word)
    sent = words.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = _cutter(sent.value, longest, longest_word)
        for batch in batches:
            yield pa.array([each(x) for x in batch.to_pylist()], pa.list_(pa.string()))

    return w.select("word", cut("word").alias("pieces"))


def joined_pieces(w: DataFrame, pieces: DataFrame, longest: int = LONGEST_PIECE, longest_word: int = LONGEST_WORD) -> DataFrame:
    """word_pieces() of distinct words by a join with the pieces, of which there may be any number."""
    short = w.where(F.length("word").between(1, longest_word))
    parts = short.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    parts = parts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at")))).alias("n"))
    inside = F.when(F.col("at") > 0, MARK).otherwise("")
    parts = parts.select("word", "at", "n", F.concat(inside, F.expr("substring(word, at + 1, n)")).alias("piece"))
    hits = parts.join(pieces.select("piece").distinct(), "piece").groupBy("word", "at").agg(F.max("n").alias("n"))
    found = hits.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("_fits"))

    def step(acc: Column, i: Column) -> Column:
        n = F.element_at(F.col("_fits"), i)
        cut = F.concat(F.when(i > 0, MARK).otherwise(""), F.expr("word").substr(i + 1, n))
        here = acc["next"] == i
        return F.when(~here, acc).when(n.isNull(), F.struct(F.lit(-1).alias("next"), acc["out"].alias("out"))).otherwise(F.struct((i + n).alias("next"), F.concat(acc["out"], F.array(cut)).alias("out")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(F.sequence(F.lit(0), F.length("word") - 1), start, step)
    cut = found.withColumn("_r", folded).select("word", F.when(F.col("_r.next") == F.length("word"), F.col("_r.out")).alias("_p"))
    unknown = F.when(F.col("word") == "", F.array().cast("array<string>")).otherwise(F.array(F.lit(UNKNOWN)))
    return w.join(cut, "word", "left").select("word", F.coalesce("_p", unknown).alias("pieces"))


def piece_sentences(sentences: DataFrame, keys: list[str], known: DataFrame, words: str = "words", max_length: int | None = None) -> DataFrame:
    """sentences plus pieces and word_ids (array<int>), by the table known (word, pieces); with max_length, cut to that many pieces less two for the special ones at the ends. keys tell sentences apart."""
    tokens = sentences.select(*keys, F.posexplode(words).alias("_i", "word"))
    lists = tokens.join(known, "word").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "pieces"))).alias("_x"))
    flat = F.flatten(F.transform("_x", lambda x: F.transform(x["pieces"], lambda p: F.struct(p.alias("p"), x["_i"].alias("w")))))
    flat = flat if max_length is None else F.slice(flat, F.lit(1), F.lit(max(0, max_length - 2)))
    lists = lists.withColumn("_f", flat).select(*keys, F.col("_f.p").alias("pieces"), F.col("_f.w").alias("word_ids"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return sentences.join(lists, keys, "left").select(*sentences.columns, none("pieces", "array<string>"), none("word_ids", "array<int>"))


def cut_sentences(sentences: DataFrame, keys: list[str], pieces: DataFrame, words: str = "words", max_length: int | None = None, longest: int = LONGEST_PIECE, longest_word: int = LONGEST_WORD) -> DataFrame:
    """piece_sentences() by the pieces themselves (piece). Up to HELD_PIECES of them, no word leaves its row; keys serve only beyond that."""
    table = held_pieces(pieces, longest)
    if table is None:
        listed = sentences.select(F.explode(words).alias("word"))
        return piece_sentences(sentences, keys, joined_pieces(listed.where("word is not null").distinct(), pieces, longest, longest_word), words, max_length)
    sent = sentences.sparkSession.sparkContext.broadcast(table)
    most = None if max_length is None else max(0, max_length - 2)

    @F.arrow_udf("struct<pieces:array<string>,word_ids:array<int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = _cutter(sent.value, longest, longest_word)
        for batch in batches:
            flat = batch.flatten().dictionary_encode()
            lists = pa.array([each(x) for x in flat.dictionary.to_pylist()], pa.list_(pa.string())).take(flat.indices)
            sizes = np.asarray(batch.value_lengths().fill_null(0), np.int64)
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(sizes)
            place = np.arange(len(counts)) - np.repeat(ends - sizes, sizes)
            upto = np.concatenate([[0], np.cumsum(counts)])
            first, have = upto[ends - sizes], upto[ends] - upto[ends - sizes]
            ids, found = np.repeat(place, counts).astype(np.int32), lists.flatten()
            if most is not None:
                on = np.arange(len(ids)) - np.repeat(first, have) < most
                ids, found, have = ids[on], found.filter(pa.array(on)), np.minimum(have, most)
            offsets = pa.array(np.concatenate([[0], np.cumsum(have)]).astype(np.int32))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, found), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["pieces", "word_ids"])

    return sentences.withColumn("_cut", cut(words)).select(*sentences.columns, F.col("_cut.pieces").alias("pieces"), F.col("_cut.word_ids").alias("word_ids"))


def aligned_labels(rows: DataFrame, labels: str, label_ids: dict[str, int], out: str = "label_ids") -> DataFrame:
    """rows of piece_sentences() plus out: the word's label id on its first piece (past a bare mark), -100 on all others."""
    return rows.withColumn(out, align_subwords(F.col(labels), F.col("word_ids"), label_ids, F.col("pieces")))


def length_counts(rows: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """keys, value, n: how many rows have that length. Such tables of parts of a corpus add up to that of the whole."""
    return rows.select(*keys, length.cast("bigint").alias("value")).where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))


def merged_counts(*tables: DataFrame) -> DataFrame:
    """The sum of tables of counts with the same keys."""
    keys = [c for c in tables[0].columns if c != "n"]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


PERCENTILES = (50, 75, 90, 95, 99)


def length_statistics(counts: DataFrame, keys: list[str], max_len: int) -> DataFrame:
    """keys, rows, min, mean, std (population), p50 to p99 (linear between neighbours), max, truncated (share over max_len). Exact, from running sums over the distinct lengths of a key."""
    each = Window.partitionBy(*keys)
    upto = F.sum("n").over(each.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    c = counts.withColumns({"_to": upto, "_all": F.sum("n").over(each)})

    def percentile(q: int) -> Column:
        place = (F.col("_all") - 1) * q / F.lit(100.0)
        at = lambda k: F.min(F.when(F.col("_to") > k, F.col("value")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return (low + (high - low) * part).alias(f"p{q}")

    n, total = F.sum("n"), F.sum(F.col("n") * F.col("value"))
    square = F.sum(F.col("n") * F.col("value") * F.col("value"))
    spread = F.sqrt(F.greatest(square / n - (total / n) * (total / n), F.lit(0.0)))
    over = F.sum(F.when(F.col("value") > max_len, F.col("n")).otherwise(0))
    return c.groupBy(*keys).agg(n.alias("rows"), F.min("value").alias("min"), (total / n).alias("mean"), spread.alias("std"), *map(percentile, PERCENTILES), F.max("value").alias("max"), (over / n).alias("truncated"))


def length_bins(counts: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, bin, lower, upper, n: bins of equal width between a key's least and greatest length, the last with its upper edge; a single length has half a unit on either side. Bins without rows are left out."""
    each = Window.partitionBy(*keys)
    c = counts.withColumns({"_lo": F.min("value").over(each).cast("double"), "_hi": F.max("value").over(each).cast("double")})
    c = c.withColumns({"_lo": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")), "_hi": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    binned = c.select(*keys, place.alias("bin"), (F.col("_lo") + place * width).alias("lower"), (F.col("_lo") + (place + 1) * width).alias("upper"), "n")
    return binned.groupBy(*keys, "bin").agg(F.min("lower").alias("lower"), F.min("upper").alias("upper"), F.sum("n").alias("n"))
