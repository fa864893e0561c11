"""Registered queries of sub-word tokenization: pieces, alignment, statistics of several tokenizations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.operators import subwords
from lexarium.plans.catalog import SENT, query
from lexarium.sources.corpus import document_sentences, read_table
from lexarium.sources.shared import kept

#: The piece table comes from the words themselves: single characters seen five times, longer pieces seen often.
PIECES_SQL = SENT + """, wc AS (SELECT w AS word, count(*) AS n FROM tok GROUP BY 1),
ch AS (SELECT word, n, unnest(range(0, length(word))) AS p0 FROM wc),
sb AS (SELECT n, p0, k, substring(word, p0 + 1, k) AS s FROM (SELECT *, unnest(range(1, least(length(word) - p0, 4) + 1)) AS k FROM ch)),
pc AS (SELECT CASE WHEN p0 > 0 THEN '##' ELSE '' END || s AS piece FROM sb GROUP BY 1, k HAVING sum(n) >= CASE WHEN k = 1 THEN 5 ELSE 60 END),
ft AS (SELECT word, p0, max(k) AS k FROM (SELECT word, p0, unnest(range(1, least(length(word) - p0, 12) + 1)) AS k FROM ch WHERE length(word) <= 100) JOIN pc ON piece = CASE WHEN p0 > 0 THEN '##' ELSE '' END || substring(word, p0 + 1, k) GROUP BY word, p0),
ks AS (SELECT ch.word, list(coalesce(ft.k, 0)::BIGINT ORDER BY ch.p0) AS ks FROM ch LEFT JOIN ft ON ft.word = ch.word AND ft.p0 = ch.p0 GROUP BY ch.word),
cu AS (SELECT word, ks, list_reduce(list_prepend([0::BIGINT], list_transform(range(0, length(word)), lambda i: [i])), lambda c, x: CASE WHEN c[-1] = x[1] AND ks[x[1] + 1] > 0 THEN list_append(c, x[1] + ks[x[1] + 1]) ELSE c END) AS cuts FROM ks),
wp AS (SELECT word, CASE WHEN cuts[-1] = length(word) THEN list_transform(cuts[:-2], lambda i: CASE WHEN i > 0 THEN '##' ELSE '' END || substring(word, i + 1, ks[i + 1])) ELSE ['[UNK]'] END AS pieces FROM cu)
"""


def _lines(spark, d) -> DataFrame:
    return document_sentences(read_table(spark, d, "documents")).where("size(words) > 0")


def piece_table(words: DataFrame) -> DataFrame:
    """piece, from (word, n)."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    cut = at.select("word", "n", "at", F.explode(F.sequence(F.lit(1), F.least(F.length("word") - F.col("at"), F.lit(4)))).alias("k"))
    piece = F.concat(F.when(F.col("at") > 0, subwords.MARK).otherwise(""), F.expr("substring(word, at + 1, k)"))
    return cut.groupBy(piece.alias("piece"), "k").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("k") == 1, 5).otherwise(60)).select("piece")


def _words(spark, d) -> DataFrame:
    return kept(_lines(spark, d).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")


def _pieces(spark, d) -> DataFrame:
    return kept(piece_table(_words(spark, d)), "pieces")


@query("word_pieces", PIECES_SQL + "SELECT word, array_to_string(pieces, ' ') AS pieces, len(pieces)::BIGINT AS n FROM wp")
def word_pieces(spark, d):
    """Every distinct word of all documents in pieces."""
    words = _words(spark, d)
    return subwords.word_pieces(words, kept(piece_table(words), "pieces")).select("word", F.array_join("pieces", " ").alias("pieces"), F.size("pieces").cast("bigint").alias("n"))


ALIGN_SQL = PIECES_SQL + """, fl AS (SELECT doc_id, line, i, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS k FROM tok JOIN wp ON wp.word = tok.w),
nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i, k) AS p0 FROM fl)
"""


@query("piece_alignment", ALIGN_SQL + "SELECT doc_id, line::BIGINT AS line, string_agg(p, ' ' ORDER BY p0) AS pieces, string_agg(CASE WHEN k > 1 THEN -100 WHEN i % 7 = 3 THEN 1 WHEN i % 7 = 4 THEN 2 ELSE 0 END::VARCHAR, ' ' ORDER BY p0) AS label_ids FROM nu WHERE p0 <= 126 GROUP BY doc_id, line")
def piece_alignment(spark, d):
    """Every line in at most 128 pieces with its two special ones; spans of two words, B and I, on their first pieces."""
    label = F.transform("words", lambda w, i: F.when(i % 7 == 3, "B-LOAN").when(i % 7 == 4, "I-LOAN").otherwise("O"))
    rows = subwords.cut_sentences(_lines(spark, d), ["doc_id", "line"], _pieces(spark, d), max_length=128).withColumn("labels", label)
    out = subwords.aligned_labels(rows, "labels", {"O": 0, "B-LOAN": 1, "I-LOAN": 2})
    return out.select("doc_id", F.col("line").cast("bigint").alias("line"), F.array_join("pieces", " ").alias("pieces"), F.array_join(F.col("label_ids").cast("array<string>"), " ").alias("label_ids"))


COUNTS_SQL = ALIGN_SQL + """, ln AS (SELECT 'pieces' AS model, doc_id, line, count(*) AS v FROM nu GROUP BY ALL UNION ALL SELECT 'words', doc_id, line, count(*) FROM tok GROUP BY ALL)
"""


def _two_tokenizations(spark, d) -> DataFrame:
    """model, value, n: lines by their pieces and by their words."""
    rows = subwords.cut_sentences(_lines(spark, d), ["doc_id", "line"], _pieces(spark, d))
    pieces, words = (subwords.length_counts(rows.withColumn("model", F.lit(m)), ["model"], F.size(m)) for m in ("pieces", "words"))
    return kept(subwords.merged_counts(pieces, words), "lengths")


@query("token_statistics", COUNTS_SQL + "SELECT model, count(*) AS rows, min(v)::BIGINT AS min, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, " + ", ".join(f"round(quantile_cont(v, {q / 100}), 6) AS p{q}" for q in (50, 75, 90, 95, 99)) + ", max(v)::BIGINT AS max, round(avg((v > 128)::INT), 6) AS truncated FROM ln GROUP BY model")
def token_statistics(spark, d):
    s = subwords.length_statistics(_two_tokenizations(spark, d), ["model"], 128)
    return s.select("model", "rows", "min", *[F.round(c, 6).alias(c) for c in ("mean", "std", *(f"p{q}" for q in subwords.PERCENTILES))], "max", F.round("truncated", 6).alias("truncated"))


@query("token_histogram", COUNTS_SQL + ", e AS (SELECT model, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM ln GROUP BY model), b AS (SELECT ln.model, lo, (hi - lo) / 10 AS width, least(floor((v - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin FROM ln JOIN e USING (model)) SELECT model, bin, round(any_value(lo + bin * width), 6) AS lower, round(any_value(lo + (bin + 1) * width), 6) AS upper, count(*) AS n FROM b GROUP BY model, bin")
def token_histogram(spark, d):
    b = subwords.length_bins(_two_tokenizations(spark, d), ["model"])
    return b.select("model", F.col("bin").cast("bigint").alias("bin"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")
