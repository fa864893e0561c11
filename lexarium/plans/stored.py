"""Registered queries over what the library writes: each writes its format from whole tables and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexarium.operators import annotation, index
from lexarium.plans.catalog import CLEAN_SQL, LEMMA_SQL, SENT, SHEET_SQL, query, sentences, sheet
from lexarium.plans.inspection import LENGTHS
from lexarium.sources import corpus, files
from lexarium.sources.corpus import read_table, tokens_of
from lexarium.sources.shared import kept, scratch
from lexarium.streaming import append

# ---- corpora ----


@query("vertical_round_trip", SENT + "SELECT spos::BIGINT AS spos, any_value(doc_id || ':' || line) AS sentence_id, any_value(cpos)::BIGINT AS cpos, coalesce(string_agg(w || ' ' || CASE WHEN regexp_matches(w, '^\\p{Lu}') THEN 'n' ELSE 'x' END || ' ' || " + LEMMA_SQL + ", '|' ORDER BY i), '') AS tokens FROM (SELECT s.doc_id, s.line, s.spos, s.cpos, t.w, t.i FROM sent s LEFT JOIN tok t USING (spos)) GROUP BY spos")
def vertical_round_trip(spark, d):
    """All documents as a vertical corpus, read back with its positions."""
    s = sentences(spark, d).select("spos", F.concat_ws(":", "doc_id", "line").alias("id"), tokens_of(F.col("words")).alias("tokens"))
    path = scratch(spark, "vertical")
    corpus.write_vertical(s, path, "id")
    back = corpus.read_vertical(spark, path)
    text = F.array_join(F.transform("tokens", lambda t: F.concat_ws(" ", t["word"], t["pos"], t["lemma"])), "|")
    return back.select(F.col("spos").cast("bigint"), "sentence_id", F.col("cpos").cast("bigint"), text.alias("tokens"))


@query("concordance_round_trip", SENT + "SELECT spos::BIGINT AS cqp_id, len(any_value(words))::BIGINT AS n, (any_value(spos) % len(any_value(words)))::BIGINT AS match_index, string_agg(w || ' ' || " + LEMMA_SQL + ", '|' ORDER BY i) AS tokens FROM tok JOIN (SELECT spos, words FROM sent) USING (spos) WHERE NOT contains(array_to_string(words, ' '), '/') AND NOT contains(array_to_string(words, ' '), '<') GROUP BY spos")
def concordance_round_trip(spark, d):
    """Every line without slashes and brackets as a concordance with a match of two tokens, parsed again."""
    s = sentences(spark, d).where("size(words) > 0").where(~F.array_join("words", " ").rlike("[/<]"))
    s = s.select("spos", tokens_of(F.col("words")).alias("tokens"), (F.col("spos") % F.size("words")).cast("int").alias("at"))
    markup = corpus.concordance_markup(F.col("spos"), F.col("tokens"), F.col("at"), F.lit(2))
    rows = s.select(F.explode(corpus.parse_concordance(markup)).alias("x")).select("x.*")
    text = F.array_join(F.transform("tokens", lambda t: F.concat_ws(" ", t["word"], t["lemma"])), "|")
    return rows.select("cqp_id", F.size("tokens").cast("bigint").alias("n"), F.col("match_index").cast("bigint"), text.alias("tokens"))


# ---- indices ----


@query("stored_indices", LENGTHS + f", v AS (SELECT spos, sum(c)::BIGINT AS chars FROM ln GROUP BY spos), l AS (SELECT spos, count(*) FILTER ({CLEAN_SQL}) AS clean FROM tok GROUP BY spos) SELECT s.spos::BIGINT AS spos, s.cpos::BIGINT AS cpos, len(words)::BIGINT AS count, coalesce(chars, 0) AS chars, coalesce(clean, 0) AS clean FROM sent s LEFT JOIN v USING (spos) LEFT JOIN l USING (spos)")
def stored_indices(spark, d):
    """Length and word-class indices of all sentences as bucketed tables, joined where they lie."""
    s = kept(sentences(spark, d).select("spos", "cpos", F.size("words").alias("count"), "words"), "sentences")
    tag = uuid.uuid4().hex
    lengths = index.length_index(s).select("spos", "cpos", "count", "char_len")
    clean = s.select("spos", "cpos", "count", F.transform("words", lambda w: index.char_len(w).isNotNull()).alias("clean"))
    for name, rows in (("lengths", lengths), ("clean", clean)):
        files.store_index(rows, f"{name}_{tag}", scratch(spark, name), buckets=16)
    both = index.aligned(files.stored_index(spark, f"lengths_{tag}"), files.stored_index(spark, f"clean_{tag}"))
    total = F.aggregate(F.filter("char_len", lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return both.select("spos", "cpos", F.col("count").cast("bigint").alias("count"), total.alias("chars"), F.size(F.filter("clean", lambda x: x)).cast("bigint").alias("clean"))


# ---- sheets, datasets, candidates ----


@query("sheet_round_trip", SHEET_SQL + """SELECT lab AS label, rep AS replacement, CASE line % 5 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE '+' END AS valid, CASE WHEN line % 5 = 1 AND line % 2 = 0 THEN 'NE' ELSE '' END AS reason FROM sh""")
def sheet_round_trip(spark, d):
    """Every annotation row through a sheet file."""
    path = scratch(spark, "sheet")
    files.write_sheet(sheet(spark, d).drop("doc_id", "line", "file"), path)
    rows = files.read_sheet(spark, path)
    return rows.select(F.col(f"`{annotation.LABEL}`").alias("label"), F.col(f"`{annotation.REPLACEMENT}`").alias("replacement"), *[F.coalesce(c, F.lit("")).alias(c.lower()) for c in ("Valid", "Reason")])


@query("dataset_round_trip", SHEET_SQL + "SELECT regexp_replace(lab, '</?[A-Z]+[0-9]+>', '', 'g') AS source_plain, lab AS source_annotated, n_loans FROM sh JOIN (SELECT doc_id, line, count(*) FILTER (prefix = 'L') AS n_loans, bool_or(prefix <> 'o' AND (w = '' OR (prefix = 'L' AND regexp_matches(w, '[.?!,;]')))) OR count(*) FILTER (prefix = 'CS') <> coalesce(max(k) FILTER (prefix = 'CS'), 0) AS flaw FROM tg GROUP BY ALL) USING (doc_id, line) WHERE line % 5 NOT IN (0, 1) AND NOT flaw")
def dataset_round_trip(spark, d):
    """Every valid row of the sheet as a dataset record, written as JSON lines and read again."""
    path = scratch(spark, "dataset")
    files.write_dataset(annotation.dataset_records(sheet(spark, d), "extended"), path)
    back = files.read_dataset(spark, path)
    loans = F.size(F.filter(F.map_values("words_in_L_tags"), lambda x: x.isNotNull()))
    return back.select("source_plain", F.col("source_annotated_loanwords").alias("source_annotated"), loans.cast("bigint").alias("n_loans"))


# ---- growing indices ----


@query("growing_index", LENGTHS + ", v AS (SELECT spos, sum(c)::BIGINT AS chars FROM ln GROUP BY spos) SELECT doc_id, line::BIGINT AS line, s.spos::BIGINT AS spos, s.cpos::BIGINT AS cpos, len(words)::BIGINT AS count, coalesce(chars, 0) AS chars FROM sent s LEFT JOIN v USING (spos)")
def growing_index(spark, d):
    """All documents as they arrive in three parts, each indexed by a stream that goes on where it stopped."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    folder, out, progress = scratch(spark, "arrivals"), scratch(spark, "grown"), scratch(spark, "progress")
    low, high = docs.approxQuantile("doc_id", [1 / 3, 2 / 3], 0.01) or (0, 0)
    part = F.when(F.col("doc_id") <= low, 0).when(F.col("doc_id") <= high, 1).otherwise(2)
    for k in range(3):
        docs.where(part == k).write.mode("append").parquet(folder)
        append.append_positions(append.document_stream(spark, folder, files_per_batch=1 << 30), out, progress).awaitTermination()
    total = F.aggregate(F.filter("char_len", lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return append.grown_index(spark, out).select("doc_id", F.col("line").cast("bigint").alias("line"), "spos", "cpos", F.col("count").cast("bigint").alias("count"), total.alias("chars"))


# ---- cross-check of a sample ----

#: An index with planted flaws: every 97th count is one too large, every 89th position three ahead, and sentences that aren't there at its end.
SAMPLE_SQL = SENT + """, ix AS (SELECT spos, cpos + CASE WHEN spos % 89 = 0 THEN 3 ELSE 0 END AS cpos, len(words) + CASE WHEN spos % 97 = 0 THEN 1 ELSE 0 END AS n FROM sent UNION ALL SELECT spos + (SELECT count(*) FROM sent), 0, 1 FROM sent WHERE spos < 100),
sm AS (SELECT * FROM ix QUALIFY row_number() OVER (PARTITION BY spos // 64 ORDER BY md5('42:' || spos), spos) <= 16),
jn AS (SELECT sm.spos, sm.cpos, sm.n, s.cpos AS c, len(s.words) AS m FROM sm LEFT JOIN sent s USING (spos)),
vi AS (SELECT 'missing' AS rule, spos, 0 AS detail FROM jn WHERE m IS NULL UNION ALL SELECT 'cpos', spos, cpos - c FROM jn WHERE cpos <> c UNION ALL SELECT 'count', spos, n - m FROM jn WHERE n <> m)
"""


def _flawed(spark, d):
    s = kept(sentences(spark, d).select("spos", "cpos", "words"), "sentences")
    own = s.select("spos", (F.col("cpos") + F.when(F.col("spos") % 89 == 0, 3).otherwise(0)).alias("cpos"), (F.size("words") + F.when(F.col("spos") % 97 == 0, 1).otherwise(0)).alias("count"))
    beyond = s.where("spos < 100").select((F.col("spos") + s.count()).alias("spos"), F.lit(0).alias("cpos"), F.lit(1).alias("count"))
    return own.union(beyond), s


@query("index_sample_check", SAMPLE_SQL + "SELECT rule, spos::BIGINT AS spos, detail::BIGINT AS detail FROM vi")
def index_sample_check(spark, d):
    """What a sample of a quarter of the sentences shows of a flawed index."""
    flawed, s = _flawed(spark, d)
    return index.validate_sample(flawed, s, 64, 16).select("rule", F.col("spos").cast("bigint"), "detail")


@query("index_sample_bound", SAMPLE_SQL + "SELECT sampled, wrong, round((p + 1.645 * 1.645 / (2 * sampled) + 1.645 * sqrt(p * (1 - p) / sampled + 1.645 * 1.645 / (4 * sampled * sampled))) / (1 + 1.645 * 1.645 / sampled), 6) AS at_most FROM (SELECT *, wrong / sampled AS p FROM (SELECT (SELECT count(*) FROM sm) AS sampled, (SELECT count(DISTINCT spos) FROM vi) AS wrong))")
def index_sample_bound(spark, d):
    """How much of the index can be wrong, by that sample."""
    flawed, s = _flawed(spark, d)
    return index.sample_bound(flawed, index.validate_sample(flawed, s, 64, 16), 64, 16).select("sampled", "wrong", F.round("at_most", 6).alias("at_most"))
