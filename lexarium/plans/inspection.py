"""More registered queries: inspections, tag maps, prompts, checks, samples and the searches' records, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions import text as X
from lexarium.operators import annotation, assistant, classify, index, islands, lm, ner, select, wiki
from lexarium.operators.scoring import scoring_config
from lexarium.plans import search
from lexarium.plans.catalog import (
    CLEAN_SQL, DENSITY_SQL, KEYS, LEMMA_LIST, LEMMA_SQL, LEMMAS, LM_SQL, LOGIT_SQL, LONG, NEAR_SQL, NER_LABELS, RUNS_SQL, SENT, SEQ_SQL, SHEET_SQL,
    _freq, _label_sentences, _lemma_rows, _lemma_sets, _logits, _sequences, _tokens, lemma_pool, long_word_index, query, sentences, sheet, token_rows,
)
from lexarium.sources.corpus import document_sentences, read_table, tokens_of
from lexarium.sources.shared import kept

LENGTHS = SENT + f", ln AS (SELECT spos, i, CASE WHEN {CLEAN_SQL} THEN least(length(w), 254) END AS c, CASE WHEN {CLEAN_SQL} THEN least(strlen(w), 254) END AS b FROM tok)"


def _big(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def _length_rows(spark, d) -> DataFrame:
    return index.length_index(sentences(spark, d)).select("spos", "cpos", F.size("words").alias("count"), "char_len", "byte_len")


# ---- lengths and indices ----

_STAT = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, median(v) AS median, min(v)::BIGINT AS min, max(v)::BIGINT AS max, " + ", ".join(f"round(avg(v) {s} {k} * stddev_samp(v), 6) AS {n}" for n, s, k in (("lo1", "-", 1), ("hi1", "+", 1), ("lo2", "-", 2), ("hi2", "+", 2)))


@query("lengths_info", LENGTHS + f" SELECT 'sent_len' AS variable, {_STAT} FROM (SELECT len(words) AS v FROM sent) UNION ALL SELECT 'char_len', {_STAT} FROM (SELECT c AS v FROM ln) UNION ALL SELECT 'byte_len', {_STAT} FROM (SELECT b AS v FROM ln)")
def lengths_info(spark, d):
    s, t = document_sentences(read_table(spark, d, "documents")), token_rows(spark, d)
    out = None
    for name, values in (("sent_len", s.select(F.size("words").alias("v"))), ("char_len", t.select(X.char_len("w").alias("v"))), ("byte_len", t.select(X.byte_len("w").alias("v")))):
        r = index.ranged_stats(values, "v").select(F.lit(name).alias("variable"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], F.col("median").cast("double"), *_big("min", "max"), *[F.round(c, 6).alias(c) for c in ("lo1", "hi1", "lo2", "hi2")])
        out = r if out is None else out.union(r)
    return out


@query("lengths_ranks", LENGTHS + " SELECT count(c) AS n, count(*) FILTER (c IS NULL) AS excluded, count(*) FILTER (c BETWEEN 2.5 AND 7.5) AS in_range, round(100.0 * count(*) FILTER (c BETWEEN 2.5 AND 7.5) / count(c), 6) AS percent_in, round(100.0 * count(*) FILTER (c <= 6) / count(c), 6) AS percentile FROM ln")
def lengths_ranks(spark, d):
    r = index.value_ranks(token_rows(spark, d).select(X.char_len("w").alias("v")), "v", 5.0, 2.5, 6.0)
    return r.select("n", "excluded", "in_range", F.round("percent_in", 6).alias("percent_in"), F.round("percentile", 6).alias("percentile"))


@query("lengths_sentence", LENGTHS + " SELECT s.spos::BIGINT AS spos, i::BIGINT AS idx, c::BIGINT AS char_len, b::BIGINT AS byte_len FROM sent s JOIN ln ON s.spos = ln.spos WHERE s.cpos <= 1000 AND 1000 < s.cpos + len(words) AND i < 16")
def lengths_sentence(spark, d):
    return index.sentence_tokens(_length_rows(spark, d), ["char_len", "byte_len"], cpos=1000).select(*_big("spos", "idx", "char_len", "byte_len"))


@query("index_describe", "SELECT * FROM (VALUES ('spos', 'bigint'), ('cpos', 'bigint'), ('count', 'int'), ('char_len', 'array<int>'), ('byte_len', 'array<int>')) t(name, type), (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t <> '')")
def index_describe(spark, d):
    return index.describe(_length_rows(spark, d))


@query("index_totals", SENT + "SELECT 'token_total' AS rule, sum(len(words))::BIGINT + 3 AS expected, sum(len(words))::BIGINT AS found FROM sent UNION ALL SELECT 'sentence_total', count(*) - 1, count(*) FROM sent")
def index_totals(spark, d):
    rows = _length_rows(spark, d)
    t, n = rows.agg(F.sum("count"), F.count("*")).first()
    return index.validate_totals(rows, t + 3, n - 1)


@query("aligned_indices", LENGTHS + ", v AS (SELECT spos, sum(c)::BIGINT AS chars FROM ln GROUP BY spos) SELECT spos, len(words)::BIGINT AS n, chars FROM sent LEFT JOIN v USING (spos)")
def aligned_indices(spark, d):
    s = sentences(spark, d).select("spos", "cpos", F.size("words").alias("count"))
    rows, _ = search.mask_sources(s, surprisal=_length_rows(spark, d).drop("byte_len"))
    clean = F.filter("char_len", lambda x: x.isNotNull())
    total = F.when(F.size(clean) > 0, F.aggregate(clean, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return rows.select(*_big("spos"), F.col("count").cast("bigint").alias("n"), total.alias("chars"))


@query("sentence_fetch", SENT + ", want AS (SELECT o_orderkey AS id, (o_custkey * 31) % (SELECT max(spos) + 100 FROM sent) AS spos FROM orders) SELECT id, spos, len(words)::BIGINT AS n FROM want JOIN sent USING (spos)")
def sentence_fetch(spark, d):
    s = sentences(spark, d)
    top = s.agg(F.max("spos")).first()[0] + 100
    wanted = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") * 31) % top).alias("spos"))
    return index.fetch_sentences(s, wanted).select("id", *_big("spos"), F.size("words").cast("bigint").alias("n"))


@query("vocabulary_lookup", f"WITH v AS (SELECT lemma, row_number() OVER (ORDER BY lemma)::BIGINT AS idx FROM (SELECT unnest([{LEMMA_LIST}]) AS lemma)), q AS (SELECT unnest(['WITH', 'Para', 'nothing']) AS requested) SELECT idx, requested FROM v JOIN q ON v.lemma = lower(requested) UNION ALL SELECT -1, requested FROM q WHERE lower(requested) NOT IN (SELECT lemma FROM v)")
def vocabulary_lookup(spark, d):
    vocab = index.vocabulary(spark.createDataFrame([(x, k) for k, x in enumerate(sorted(LEMMAS))], "value string, n int"), "value", "n")
    found, missing = index.wanted_ids(["WITH", "Para", "nothing"], vocab)
    return found.select(*_big("idx"), "requested").union(missing.select(F.lit(-1).cast("bigint"), "requested"))


# ---- language model ----


@query("surprisal_dm_mad", LM_SQL + r""", st AS (SELECT doc_id, line, i, lower(w) AS word, {clean} AS ok FROM tok),
h0 AS (SELECT doc_id, line, i, CASE WHEN ok THEN surprisal ELSE 0 END AS x FROM st LEFT JOIN ws USING (word)),
hp AS (SELECT doc_id, line, i, CASE WHEN x = 0 OR x IS NULL THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END AS x FROM h0),
m AS (SELECT doc_id, line, sum(x) AS total, count(*) FILTER (x <> 0) AS k, avg(x) FILTER (x <> 0) AS mean, median(x) FILTER (x <> 0) AS mid FROM hp GROUP BY ALL),
d AS (SELECT doc_id, line, median(abs(hp.x - mid)) AS mad FROM hp JOIN m USING (doc_id, line) WHERE hp.x <> 0 GROUP BY ALL)
SELECT doc_id, line::BIGINT AS line, round(total, 4) AS total, round(CASE WHEN k < 2 OR coalesce(mad, 0) = 0 THEN 0 ELSE (mean - mid) / mad END, 4) AS dm_mad FROM m LEFT JOIN d USING (doc_id, line)""".replace("{clean}", CLEAN_SQL))
def surprisal_dm_mad(spark, d):
    s = document_sentences(read_table(spark, d, "documents")).where("size(words) > 0")
    out = search.surprisal_index(s, keys=("doc_id", "line"))
    return out.select("doc_id", F.col("line").cast("bigint"), F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round("dm_mad", 4).alias("dm_mad"))


@query("byte_surprisal", LM_SQL.replace("q3 AS (SELECT word, CASE", "q3 AS (SELECT word, p, CASE") + "SELECT word, (p - 3)::BIGINT AS pos, round(-log2(greatest(p3, 1e-10)), 6) AS surprisal FROM q3")
def byte_surprisal(spark, d):
    f = kept(_freq(spark, d), "frequencies")
    return lm.traced_bytes(lm.score_words(f, lm.count_table(f))).select("word", *_big("pos"), F.round("surprisal", 6).alias("surprisal"))


@query("frequency_lines", "SELECT lower(p_brand) AS word, p_size::BIGINT AS freq, count(*) AS n FROM part GROUP BY ALL")
def frequency_lines(spark, d):
    p = read_table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("\t"), "p_size")).otherwise(F.concat("p_size", F.lit("  "), "p_brand")).alias("value"), "p_brand")
    return lm.parse_frequency_list(p.select("value").union(p.select(F.lit("not a line")))).groupBy("word", "freq").agg(F.count("*").alias("n"))


# ---- searches: tags, maps, batches, records ----

_CS_LABELS = "CASE WHEN i % 6 IN (1, 2) THEN 'PER' WHEN i % 6 = 3 THEN 'ORG' END"


def _switch_rows(spark, d) -> DataFrame:
    label = lambda i: F.when(i % 6 == 1, "B-PER").when(i % 6 == 2, "I-PER").when(i % 6 == 3, "B-ORG").otherwise("O")
    return long_word_index(spark, d).withColumn("labels", F.transform("words", lambda w, i: label(i)))


_TAG_SQL = """, ky AS (SELECT t.spos, t.i, t.w, CASE WHEN t.i >= b.run_start AND t.i < b.run_start + b.run_length THEN 'CS' ELSE {labels} END AS k FROM tok t JOIN best b USING (spos)),
hd AS (SELECT *, coalesce(k IS DISTINCT FROM lag(k) OVER (PARTITION BY spos ORDER BY i), true) OR k IS NULL OR i = 0 AS head FROM ky),
gr AS (SELECT *, sum(head::INT) OVER (PARTITION BY spos ORDER BY i) AS g FROM hd),
rn AS (SELECT spos, g, any_value(k) AS k, string_agg(w, ' ' ORDER BY i) AS t, string_agg({lemma}, ' ' ORDER BY i) AS lem FROM gr GROUP BY spos, g),
nm AS (SELECT *, CASE WHEN k = 'CS' THEN 'CS' WHEN k IS NOT NULL THEN 'NE' END AS p, CASE WHEN k = 'CS' THEN 'CS' WHEN k IS NOT NULL THEN 'NE' END || row_number() OVER (PARTITION BY spos, CASE WHEN k = 'CS' THEN 'CS' WHEN k IS NOT NULL THEN 'NE' END ORDER BY g) AS tag FROM rn)
""".replace("{labels}", _CS_LABELS).replace("{lemma}", LEMMA_SQL)


@query("switch_tags", RUNS_SQL + _TAG_SQL + "SELECT spos, string_agg(CASE WHEN tag IS NULL THEN t ELSE '<' || tag || '>' || t || '</' || tag || '>' END, ' ' ORDER BY g) AS sentence, string_agg(tag || '=' || CASE WHEN p = 'CS' THEN lem ELSE t END, '; ' ORDER BY tag) FILTER (tag IS NOT NULL) AS tags FROM nm GROUP BY spos")
def switch_tags(spark, d):
    rows = search.code_switch_search(_switch_rows(spark, d), scoring_config("code-switch", filter_forbid_named_entity=False, filter_require_context_lang=False, filter_require_span_lang=False), LONG, labels="labels")
    named = F.array_join(F.transform(F.array_sort(F.map_entries("tag_map")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return rows.select(*_big("spos"), "sentence", named.alias("tags"))


def _entity_rows(spark, d) -> DataFrame:
    return _label_sentences(spark, d).withColumn("words", F.transform("labels", lambda x, i: F.concat(F.lit("w"), (F.col("spos") * 10 + i).cast("string")))).withColumn("tokens", tokens_of(F.col("words")))


_ENTITY_SQL = """, k AS (SELECT spos, i, 'w' || vec_id AS w, label, CASE WHEN label LIKE '_-NE' THEN 'NE' WHEN label LIKE '_-LOAN' THEN 'LOAN' END AS k FROM lab),
ok AS (SELECT spos FROM lab GROUP BY spos HAVING bool_or(label IN ('B-NE', 'I-NE', 'B-LOAN', 'I-LOAN')) AND NOT bool_or(label IN ('B-CS', 'I-CS'))),
hd AS (SELECT *, coalesce(k IS DISTINCT FROM lag(k) OVER (PARTITION BY spos ORDER BY i), true) OR k IS NULL OR i = 0 AS head FROM k JOIN ok USING (spos)),
gr AS (SELECT *, sum(head::INT) OVER (PARTITION BY spos ORDER BY i) AS g FROM hd),
rn AS (SELECT spos, g, any_value(k) AS k, string_agg(w, ' ' ORDER BY i) AS t FROM gr GROUP BY spos, g),
nm AS (SELECT *, row_number() OVER (PARTITION BY spos, k IS NULL ORDER BY g) AS n FROM rn),
mp AS (SELECT spos, string_agg('NE' || n || ':' || label || '=' || w, '; ' ORDER BY 'NE' || n || ':' || label) AS tags, string_agg(w, ' ' ORDER BY i) AS matched FROM (SELECT *, row_number() OVER (PARTITION BY spos ORDER BY i) AS n FROM k JOIN ok USING (spos) WHERE k IS NOT NULL) GROUP BY spos)
"""


@query("entity_tags", LOGIT_SQL + _ENTITY_SQL + "SELECT spos::BIGINT AS spos, sentence, tags, matched FROM mp JOIN (SELECT spos, string_agg(CASE WHEN k IS NULL THEN t ELSE '<NE' || n || '>' || t || '</NE' || n || '>' END, ' ' ORDER BY g) AS sentence FROM nm GROUP BY spos) USING (spos)")
def entity_tags(spark, d):
    rows = search.entity_search(_entity_rows(spark, d), scoring_config("ner"), ["NE", "LOAN"], ["CS"])
    named = F.array_join(F.transform(F.array_sort(F.map_entries("tag_map")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return rows.select(*_big("spos"), "sentence", named.alias("tags"), F.array_join("matched_lemmas", " ").alias("matched"))


@query("loan_tag_maps", SENT + f", tk AS (SELECT spos, i, {LEMMA_SQL} AS lemma FROM tok), nm AS (SELECT *, row_number() OVER (PARTITION BY spos ORDER BY lemma <> 'with', i) AS k FROM tk WHERE lemma IN ({LEMMA_LIST})) SELECT spos, string_agg('L' || k || '=' || lemma, '; ' ORDER BY k) AS tags FROM nm GROUP BY spos")
def loan_tag_maps(spark, d):
    rows = search.lemma_hits(sentences(spark, d).withColumn("tokens", tokens_of(F.col("words"))), LEMMAS)
    entries = F.map_entries(islands.tagged_lemmas(F.col("tokens"), LEMMAS, "with"))
    by_number = F.array_sort(F.transform(entries, lambda e: F.struct(F.substring(e["key"], 2, 9).cast("int").alias("k"), F.concat(e["key"], F.lit("="), e["value"]).alias("s"))))
    return rows.select(*_big("spos"), F.array_join(F.transform(by_number, lambda x: x["s"]), "; ").alias("tags"))


_BATCH = {"french": (["avec", "les"], None), "mixed": (["with", "der", "para"], 200)}


@query("query_batch", SENT + f""", tk AS (SELECT spos, i, {LEMMA_SQL} AS lemma FROM tok), q AS (SELECT 'french' AS query, spos, i FROM tk WHERE lemma IN ('avec', 'les') UNION ALL SELECT 'mixed', spos, i FROM tk WHERE lemma IN ('with', 'der', 'para'))
SELECT query, spos, i::BIGINT AS match FROM q QUALIFY query = 'french' OR row_number() OVER (PARTITION BY query ORDER BY md5('42:' || spos || ':' || i), spos, i) <= 200""")
def query_batch(spark, d):
    s = sentences(spark, d).withColumn("tokens", tokens_of(F.col("words")))
    return search.query_batch(s, _BATCH).select("query", *_big("spos", "match"))


def _records(spark, d) -> DataFrame:
    return search.candidate_records(_lemma_rows(spark, d, "or").withColumn("score_total", F.round("score_total", 9)), "lemmas")


_RECORD_SQL = SENT + "," + DENSITY_SQL


@query("candidate_records", _RECORD_SQL + "SELECT 'lemmas' AS mode, spos, filtered, filter_reason, round(score_total::DOUBLE, 6) AS score_total, round(score_loanword::DOUBLE, 6) AS score_lw, matched_lemmas FROM total WHERE round(score_total::DOUBLE, 9) <> 0")
def candidate_records(spark, d):
    r = search.without_zero_scores(_records(spark, d))
    return r.select("mode", *_big("spos"), "filtered", "filter_reason", F.round("score_total", 6).alias("score_total"), F.round("score_lw", 6).alias("score_lw"), F.array_join("matched_lemmas", ",").alias("matched_lemmas"))


@query("shown_candidates", _RECORD_SQL + "SELECT spos, round(score_total::DOUBLE, 6) AS score_total FROM total ORDER BY round(score_total::DOUBLE, 9) DESC, spos LIMIT 25")
def shown_candidates(spark, d):
    rows = _records(spark, d)
    other = rows.withColumn("mode", F.lit("ner"))
    return search.shown_candidates(rows.union(other), "lemmas", 25).select(*_big("spos"), F.round("score_total", 6).alias("score_total"))


@query("code_switch_scores", RUNS_SQL + f""", n AS (SELECT spos, count(*) AS n, count(*) FILTER (regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$')) / count(*) AS alpha, count(*) FILTER (length(w) > {LONG}) / count(*) AS cs, count(*) FILTER (i > 0 AND regexp_matches(w, '^\\p{{Lu}}')) / count(*) AS ne FROM tok GROUP BY spos)
SELECT b.spos, run_start, run_length, round(alpha, 6) AS alpha, round(cs, 6) AS cs, round(exp(-pow(n - 30.0, 2) / 200.0), 6) AS score_length FROM best b JOIN n ON b.spos = n.spos""")
def code_switch_scores(spark, d):
    cfg = scoring_config("code-switch", filter_forbid_named_entity=False, filter_require_context_lang=False, filter_require_span_lang=False, min_tokens=0, max_tokens=9999, min_alpha_ratio=0.0, filter_min_code_switch_density=0.0)
    rows = search.code_switch_search(long_word_index(spark, d), cfg, LONG)
    cs = F.size(F.filter("scores", lambda x: x > LONG)) / F.size("scores")
    return rows.select(*_big("spos", "run_start", "run_length"), F.round("score_alpha", 6).alias("alpha"), F.round(cs, 6).alias("cs"), F.round("score_length", 6).alias("score_length"))


# ---- entities ----


@query("ner_convert", LOGIT_SQL + "SELECT spos::BIGINT AS spos, round(sum(round_even(conf / pow(2, greatest(floor(log2(conf)), -14) - 10), 0) * pow(2, greatest(floor(log2(conf)), -14) - 10)), 6) AS confidence, count(*) AS n FROM lab GROUP BY spos")
def ner_convert(spark, d):
    rows = ner.convert_index(_label_sentences(spark, d).drop("labels", "confs"), NER_LABELS)
    return rows.select(*_big("spos"), F.round(F.aggregate("confidence", F.lit(0.0), lambda a, x: a + x), 6).alias("confidence"), F.size("labels").cast("bigint").alias("n"))


@query("label_thresholds", LOGIT_SQL + "SELECT label, count(*) AS n FROM (SELECT CASE WHEN conf < CASE label WHEN 'B-NE' THEN 0.9 WHEN 'I-NE' THEN 0.5 WHEN 'B-LOAN' THEN 0.7 WHEN 'I-LOAN' THEN 0.7 ELSE 0 END THEN 'O' ELSE label END AS label FROM lab) GROUP BY label")
def label_thresholds(spark, d):
    need = ner.parse_thresholds(["B-NE:0.9", "I-NE:0.5", "LOAN:0.7"])
    return _logits(spark, d).groupBy(ner.best_label(F.col("l"), NER_LABELS, need).alias("label")).agg(F.count("*").alias("n"))


# ---- text ----


@query("slashes", "SELECT item_id, replace(replace(text, ' ', '//zx'), '//zx', '/') AS text FROM benchmark")
def slashes(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", X.normalize_slashes(F.replace("text", F.lit(" "), F.lit("//zx"))).alias("text"))


@query("sentence_split", r"SELECT conv_id, turn, len(string_split_regex(text, '[.!?]\s+')) + 0 AS n, len(text) - len(regexp_replace(text, '([.!?])\s+', '\1', 'g')) AS gaps FROM conversations")
def sentence_split(spark, d):
    parts = X.split_sentences("text")
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.size(parts).cast("bigint").alias("n"), (F.length("text") - F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))).cast("bigint").alias("gaps"))


@query("protected_spans", SHEET_SQL + r", p AS (SELECT doc_id, line, string_agg(CASE prefix WHEN 'CS' THEN '[[TERM_' || c || ']]' WHEN 'o' THEN w ELSE '<' || prefix || k || '>' || w || '</' || prefix || k || '>' END, ' ' ORDER BY i) AS text, max(c) AS n FROM (SELECT *, count(*) FILTER (prefix = 'CS') OVER (PARTITION BY doc_id, line ORDER BY i) AS c FROM tg) GROUP BY ALL) SELECT doc_id, line::BIGINT AS line, text, n, lab AS restored FROM p JOIN sh USING (doc_id, line)")
def protected_spans(spark, d):
    s = sheet(spark, d).select("doc_id", "line", X.protect_spans(F.col(annotation.LABEL)).alias("p"))
    return s.select("doc_id", *_big("line"), "p.text", F.size("p.terms").cast("bigint").alias("n"), X.restore_spans(F.col("p.text"), F.col("p.terms")).alias("restored"))


@query("exact_queries", r"""SELECT item_id, (SELECT string_agg('[word="' || regexp_replace(w, '([.?*+()\[\]{}|\\^$"])', '\\\1', 'g') || '" %c]', ' ' ORDER BY k) FROM (SELECT unnest(p) AS w, generate_subscripts(p, 1) AS k FROM (SELECT list_filter(string_split_regex(regexp_replace(text, '([.,!?;:()"])', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS p))) AS query FROM benchmark""")
def exact_queries(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", X.exact_token_query("text").alias("query"))


_STRAY = "(?:" + "|".join(X.STRAY_LANGUAGES) + ")"
_STRAY_TEXT = "text || CASE item_id % 3 WHEN 0 THEN chr(10) || '  Russian : x' || chr(10) || 'y' WHEN 1 THEN ' french: z' ELSE ' French z ' END"


def _stray(spark, d) -> DataFrame:
    tail = F.when(F.col("item_id") % 3 == 0, "\n  Russian : x\ny").when(F.col("item_id") % 3 == 1, " french: z").otherwise(" French z ")
    return read_table(spark, d, "benchmark").select("item_id", F.concat("text", tail).alias("text"))


@query("translation_prompts", rf"SELECT item_id, 'Translate the following text from Latvian into English.' || chr(10) || 'Latvian: ' || trim(regexp_replace(regexp_replace(t, '\s+{_STRAY}\s*:.*', '', 'is'), '\s+', ' ', 'g')) || chr(10) || 'English:' AS prompt FROM (SELECT item_id, {_STRAY_TEXT} AS t FROM benchmark)")
def translation_prompts(spark, d):
    return _stray(spark, d).select("item_id", X.pair_prompt("text", "Latvian", "English").alias("prompt"))


@query("reply_cleaning", rf"SELECT item_id, regexp_replace(regexp_replace(t, '\n\s*{_STRAY}\s*:.*', '', 's'), '^\s+|\s+$', '', 'g') AS reply FROM (SELECT item_id, {_STRAY_TEXT} AS t FROM benchmark)")
def reply_cleaning(spark, d):
    return _stray(spark, d).select("item_id", X.clean_reply("text").alias("reply"))


@query("language_codes", "SELECT language, code FROM (VALUES ('Latvian'), (' german '), ('FRENCH'), ('Klingon')) q(language) LEFT JOIN (VALUES ('lv', 'Latvian'), ('de', 'German'), ('fr', 'French')) l(code, name) ON lower(trim(language)) = lower(name)")
def language_codes(spark, d):
    known = spark.createDataFrame([("lv", "Latvian"), ("de", "German"), ("fr", "French")], "code string, canonical_name string")
    return wiki.language_codes(spark.createDataFrame([("Latvian",), (" german ",), ("FRENCH",), ("Klingon",)], "language string"), known)


# ---- selection ----


@query("split_assign", "SELECT doc_id, CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM labels")
def split_assign(spark, d):
    return select.hash_split(read_table(spark, d, "labels").select("doc_id"), "doc_id")


@query("kfold_sizes", "WITH c AS (SELECT count(*) AS n FROM labels), f AS (SELECT unnest(range(5)) AS fold) SELECT fold::BIGINT AS fold, CASE WHEN fold = 4 THEN n - 4 * (n // 5) ELSE n // 5 END AS n, (n * (n - 1) // 2)::BIGINT AS places FROM f, c")
def kfold_sizes(spark, d):
    folds = select.kfold(spark, read_table(spark, d, "labels").count(), 5)
    total = folds.agg(F.sum("pos").alias("places"))
    return folds.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row on the right


@query("shuffle_cap", "SELECT doc_id FROM labels ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def shuffle_cap(spark, d):
    return select.shuffled(read_table(spark, d, "labels").select("doc_id"), "doc_id", 50)


@query("sentence_sample", SENT + "SELECT spos FROM sent WHERE spos < 500")
def sentence_sample(spark, d):
    n = document_sentences(read_table(spark, d, "documents")).count()
    return select.sentence_sample(spark, n, 500, sequential=True)


@query("selection_summary", _RECORD_SQL + ", p AS (SELECT spos, string_split(matched_lemmas, ',') AS l, filtered FROM total), s AS (SELECT spos, l FROM p WHERE NOT filtered), o AS (SELECT l, count(*) AS n FROM (SELECT unnest(l) AS l FROM s) GROUP BY l) SELECT (SELECT count(*) FROM p) AS pool, (SELECT count(*) FROM s) AS selected, (SELECT count(DISTINCT l) FROM (SELECT unnest(l) AS l FROM p)) AS lemmas, (SELECT count(*) FROM o) AS covered, (SELECT count(*) FROM o WHERE n >= 3) AS saturated, (SELECT round(avg(len(l)), 6) FROM s) AS avg_density, (SELECT count(*) FROM s WHERE len(l) > 1) AS multi")
def selection_summary(spark, d):
    rows = lemma_pool(spark, d)
    return select.selection_summary(rows.where("not filtered"), rows, max_per_lemma=3).withColumn("avg_density", F.round("avg_density", 6))


@query("fold_summary", "SELECT c_mktsegment AS metric, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std FROM customer GROUP BY 1")
def fold_summary(spark, d):
    r = classify.fold_summary(read_table(spark, d, "customer").select(F.col("c_mktsegment").alias("metric"), "c_acctbal"), "metric", "c_acctbal")
    return r.select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("stratified_quota", _RECORD_SQL + """, st AS (SELECT spos, round(score_total::DOUBLE, 9) AS s, string_split(matched_lemmas, ',')[1] AS stratum FROM total WHERE NOT filtered),
n AS (SELECT stratum, row_number() OVER (ORDER BY stratum) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT stratum FROM st))
SELECT spos, stratum FROM st JOIN n USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY s DESC, spos) <= 43 // any_value(m) OVER (PARTITION BY stratum) + (any_value(k) OVER (PARTITION BY stratum) < 43 % any_value(m) OVER (PARTITION BY stratum))::INT""")
def stratified_quota(spark, d):
    rows = lemma_pool(spark, d).where("not filtered").withColumn("first_lemma", F.slice("matched_lemmas", 1, 1))
    return select.select_stratified(rows, 43, "first_lemma").select(*_big("spos"), "stratum")


# ---- sheets and reports ----


@query("sheet_replacements", SHEET_SQL + r"SELECT doc_id, line::BIGINT AS line, CASE WHEN line % 5 IN (0, 1) THEN 'skipped_unselected' ELSE 'transformed' END AS status, CASE WHEN line % 5 IN (0, 1) THEN rep ELSE regexp_replace(lab, '<(/?)L([0-9]+)>', '<\1N\2>', 'g') END AS replacement FROM sh")
def sheet_replacements(spark, d):
    r = annotation.generate_replacements(sheet(spark, d), "extended", overwrite=True)
    return r.select("doc_id", F.col("line").cast("bigint"), "status", F.col(annotation.REPLACEMENT).alias("replacement"))


def _flawed(spark, d) -> DataFrame:
    """Sheets with one flaw each, by line."""
    k, label = F.col("line") % 8, F.col("label")
    flaws = {0: "<L1>a</L1> b", 1: "<L>a</L>", 2: "<X1>a</X1>", 3: "<N1>a</N1>", 4: "<L1></L1> <L1> </L1>", 5: "<L2>a</L2>.", 6: "<L1>a, b</L1>c", 7: "a</L1> <L1>b"}
    for n, text in flaws.items():
        label = F.when(k == n, text).otherwise(label)
    rows = document_sentences(read_table(spark, d, "documents")).select("doc_id", "line", F.lit("").alias("label"))
    return rows.select(F.concat_ws("-", "doc_id", "line").alias("row_index"), label.alias(annotation.LABEL), F.lit("<N1>a</N1>").alias(annotation.REPLACEMENT), F.when(k == 0, "<L1>t</L1>").otherwise("").alias("Target"), F.when(k == 1, "?").when(k == 2, " ").when(k == 3, "-").otherwise("+").alias("Valid"), F.when(k == 4, "NE").otherwise("").alias("Reason"))


_FLAWS = [
    (0, "V4.1", "Target"), (1, "V0.1", "Valid"), (1, "V1.2", "Label sentence"), (1, "V3.1", "Label/Replacement"), (2, "S9", "Valid"), (2, "V1.3", "Label sentence"), (2, "V3.1", "Label/Replacement"),
    (3, "V0.2", "Reason"), (3, "V1.8", "Label sentence"), (3, "V3.1", "Label/Replacement"), (4, "V0.3", "Reason"), (4, "V2.1", "Label sentence"), (4, "V4.4", "Label sentence"), (4, "V4.5", "Label sentence"),
    (5, "V2.2", "Label sentence"), (5, "V3.1", "Label/Replacement"), (6, "V4.2", "Label sentence"), (6, "V4.3", "Label sentence"), (7, "V1.4", "Label sentence"), (7, "V1.7", "Label sentence"),
]


@query("sheet_validate", SENT + ", f(k, rule_id, field) AS (VALUES " + ", ".join(f"({k}, '{r}', '{f}')" for k, r, f in _FLAWS) + ") SELECT rule_id, field, CASE rule_id WHEN 'S9' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM s0 JOIN f ON line % 8 = k GROUP BY ALL")
def sheet_validate(spark, d):
    """Every flaw that a row has, by the rules: the table of flaws is written out by hand."""
    return annotation.error_rows(annotation.validate_rows(_flawed(spark, d), "extended")).groupBy("rule_id", "field", "severity").agg(F.count("*").alias("n"))


@query("dataset_export", SHEET_SQL + "SELECT regexp_replace(lab, '</?[A-Z]+[0-9]+>', '', 'g') AS source_plain, n_loans, n_loans AS n_pairs FROM sh JOIN (SELECT doc_id, line, count(*) FILTER (prefix = 'L') AS n_loans, bool_or(prefix <> 'o' AND (w = '' OR (prefix = 'L' AND regexp_matches(w, '[.?!,;]')))) OR count(*) FILTER (prefix = 'CS') <> coalesce(max(k) FILTER (prefix = 'CS'), 0) AS flaw FROM tg GROUP BY ALL) USING (doc_id, line) WHERE line % 5 NOT IN (0, 1) AND NOT flaw")
def dataset_export(spark, d):
    r = annotation.dataset_records(sheet(spark, d), "extended")
    return r.select("source_plain", F.size("words_in_L_tags").cast("bigint").alias("n_loans"), F.size("corresponding_words").cast("bigint").alias("n_pairs"))


@query("near_dupe_clusters", "WITH RECURSIVE " + NEAR_SQL.removeprefix("WITH ").replace("SELECT a, b, round(similarity, 6) AS similarity FROM p UNION ALL", ", pr AS (SELECT a, b, similarity FROM p UNION ALL").replace(", pr AS", ", pr AS", 1) + """),
e AS (SELECT a AS u, b AS v FROM pr UNION SELECT b, a FROM pr), r AS (SELECT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u),
c AS (SELECT node, min(reach) AS cluster FROM r GROUP BY node) SELECT c.node, c.cluster, round(CASE WHEN node = cluster THEN 1.0 ELSE coalesce(pr.similarity, 0.0) END, 6) AS similarity FROM c LEFT JOIN pr ON pr.a = cluster AND pr.b = node""")
def near_dupe_clusters(spark, d):
    c = assistant.clusters(assistant.similar_pairs(_lemma_sets(spark, d), "doc_id", "items", 0.8))
    return c.select("node", "cluster", F.round("similarity", 6).alias("similarity"))


@query("contradiction_contexts", SHEET_SQL + f""", t AS (SELECT *, {LEMMA_SQL} AS lemma_key FROM tg), odd AS (SELECT lemma_key FROM t WHERE lemma_key <> '' GROUP BY lemma_key HAVING count(DISTINCT prefix) > 1)
SELECT lemma_key, a.doc_id, a.line::BIGINT AS line, i::BIGINT AS tok, prefix, w AS surface, array_to_string(words[greatest(i - 1, 1):i + 3], ' ') AS context FROM t a JOIN odd USING (lemma_key) JOIN s0 s ON a.doc_id = s.doc_id AND a.line = s.line WHERE prefix <> 'o'""")
def contradiction_contexts(spark, d):
    c = assistant.contradiction_contexts(_tokens(spark, d), sheet(spark, d), annotation.LABEL, KEYS, 2)
    return c.select("lemma_key", "doc_id", *_big("line", "tok"), "prefix", "surface", "context")


@query("sheet_changes", SHEET_SQL + ", h AS (SELECT DISTINCT file, lab, rep, sha1(lab || chr(0) || rep) AS row_hash, line FROM sh), o AS (SELECT DISTINCT file, row_hash FROM h WHERE line % 10 <> 7), n AS (SELECT DISTINCT file, row_hash FROM h WHERE line % 10 <> 8) SELECT 'added' AS change, * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def sheet_changes(spark, d):
    s = sheet(spark, d)
    return assistant.changed_rows(s.where("line % 10 != 7"), s.where("line % 10 != 8"), annotation.LABEL, annotation.REPLACEMENT)


# ---- dictionary dump ----


def _dump(spark, d) -> DataFrame:
    """A dump with a page of ten lines for each row of pages; its headings differ by the page's number."""
    p = read_table(spark, d, "pages").select("page_id", F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("w"))
    kind = F.col("page_id") % 4
    heading = F.when(kind == 1, "===Etymology 1===").when(kind == 2, "=== Etymology ===").otherwise("===Etymology===")
    more = F.when(kind == 3, "===Etymology 2===").otherwise("====Noun====")
    lines = F.array(F.concat(F.lit("  <title>"), "w", F.lit("</title>")), F.lit("==Latvian=="), heading, F.concat(F.lit("From {{bor|lv|de|"), "w", F.lit("}},  see  ")), more, F.lit("\tthe end"), F.lit("==Estonian=="), F.lit("===Etymology==="), F.lit("other"), F.lit("x ==Latvian== y"))
    return p.select(F.posexplode(lines).alias("k", "line"), "page_id").select((F.col("page_id") * 10 + F.col("k")).alias("line_no"), "line")


@query("wiki_entries", "SELECT page_id * 10 + 6 AS line, 'Latvian' AS language, 'w' || page_id AS word, 'From {{bor|lv|de|w' || page_id || '}}, see' || CASE page_id % 4 WHEN 3 THEN ' ===Etymology 2=== the end' ELSE '' END AS etymology_text FROM pages WHERE page_id % 4 IN (0, 3)")
def wiki_entries(spark, d):
    return wiki.entries(_dump(spark, d), ["Latvian"])


@query("wiki_all_entries", "SELECT page_id * 10 + 6 AS line, 'w' || page_id AS word FROM pages UNION ALL SELECT (page_id + 1) * 10, 'w' || page_id FROM pages WHERE page_id < (SELECT max(page_id) FROM pages)")
def wiki_all_entries(spark, d):
    return wiki.entries(_dump(spark, d), ["Latvian"], "all").select("line", "word")


# ---- token classification ----


@query("prediction_view", SEQ_SQL + "SELECT seq_id, i::BIGINT AS idx, coalesce('B-' || g, 'O') AS gold, coalesce('B-' || p, 'O') AS pred, round((i % 10) / 10, 6) AS conf, g IS DISTINCT FROM p AS differs FROM pr")
def prediction_view(spark, d):
    return classify.prediction_view(_sequences(spark, d), ["seq_id"]).select("seq_id", *_big("idx"), "gold", "pred", F.round("conf", 6).alias("conf"), "differs")


@query("label_view", SENT + "SELECT doc_id, line::BIGINT AS line, (2 * i + k)::BIGINT AS idx, CASE k WHEN 0 THEN substr(w, 1, 3) ELSE substr(w, 4) END AS token, CASE WHEN k = 1 THEN '~~' WHEN i % 7 = 3 THEN 'B-LOAN' ELSE 'O' END AS label FROM tok, (SELECT unnest([0, 1]) AS k)")
def label_view(spark, d):
    """Each word as two sub-words, the second masked."""
    s = document_sentences(read_table(spark, d, "documents")).where("size(words) > 0")
    pieces = F.flatten(F.transform("words", lambda w: F.array(F.substring(w, 1, 3), F.substring(w, 4, 1 << 20))))
    names = ["O", "B-LOAN", "I-LOAN"]
    labels = F.transform("words", lambda w, i: F.when(i % 7 == 3, "B-LOAN").otherwise("O"))
    word_ids = F.flatten(F.transform("words", lambda w, i: F.array(i, i)))
    rows = s.select("doc_id", "line", pieces.alias("pieces"), classify.align_subwords(labels, word_ids, {n: k for k, n in enumerate(names)}).alias("ids"))
    return classify.label_view(rows, ["doc_id", "line"], "pieces", "ids", names).select("doc_id", *_big("line", "idx"), "token", "label")
