"""The searches: lemmas, code switches, named entities, positions. Each is one lazy plan over sentences and indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import half_precision, is_clean_word
from lexarium.operators.islands import best_runs, entity_keys, entity_tag_map, switch_keys, tag_loanwords, tag_map, tag_runs, tagged_lemmas
from lexarium.operators.language import LanguageModel, with_languages
from lexarium.operators.lm import ORDER, count_table, held_counts, held_means, mean_deviation, score_words, word_surprisal
from lexarium.operators.ner import sentences_with
from lexarium.operators.scoring import ScoringConfig, entity_mask, label_mask, loanword_mask, score_mask, score_sentences
from lexarium.operators.index import aligned
from lexarium.operators.select import dedup_best, reduced_matches
from lexarium.sources.shared import kept


def top(rows: DataFrame, k: int = 0, score: str = "score_total", tie: tuple[str, ...] = ("spos",)) -> DataFrame:
    """Best first, the earlier sentence among equals; k = 0: all."""
    ranked = rows.orderBy(F.desc(score), *tie)
    return ranked.limit(k) if k else ranked


def lemma_hits(sentences: DataFrame, lemmas: list[str], mode: str = "or", tokens: str = "tokens") -> DataFrame:
    """sentences plus matched_lemmas (sorted). or: any requested lemma; xor: exactly one distinct requested lemma."""
    wanted = F.array(*[F.lit(x) for x in sorted({x.lower() for x in lemmas})])
    hit = F.array_sort(F.array_intersect(F.transform(tokens, lambda t: F.lower(t["lemma"])), wanted))
    df = sentences.withColumn("matched_lemmas", hit)
    return df.where(F.size("matched_lemmas") == 1) if mode == "xor" else df.where(F.size("matched_lemmas") > 0)


def lemma_search(sentences: DataFrame, lemmas: list[str], cfg: ScoringConfig, mode: str = "or", primary: str | None = None, dedup: bool = False, labels: str | None = None) -> DataFrame:
    """Scored and tagged sentences with the lemmas; filtered ones stay, with score 0 and a reason."""
    rows = lemma_hits(sentences, lemmas, mode)
    n = F.size("tokens")
    entities = entity_mask(F.col("tokens")) if labels is None else label_mask(F.col(labels), n, cfg.ner_ignore_labels)
    scored = score_sentences(rows, cfg, {"loanword": loanword_mask(F.col("tokens"), lemmas), "named_entity": entities})
    if dedup:
        scored = dedup_best(scored, F.to_json("tokens"))
    return scored.withColumn("sentence", tag_loanwords(F.col("tokens"), lemmas, primary)).withColumn("tag_map", tagged_lemmas(F.col("tokens"), lemmas, primary))


def code_switch_search(index: DataFrame, cfg: ScoringConfig, threshold: float, scores: str = "scores", lang: str | None = None, min_run: int = 2, max_run: int | None = None, labels: str | None = None, languages: LanguageModel | None = None, context_confidence: float = 0.0, span_confidence: float = 0.0) -> DataFrame:
    """Sentences whose longest run of scores above threshold is long enough, scored, with CS (and NE) tags, their tag_map (lemmas of CS, words of NE), matched_lemmas, the run's, and context_lang and span_lang: the languages of the words outside and inside the run, null without a model or under the confidence asked for. index: spos, tokens and scores arrays."""
    rows = best_runs(index, scores, threshold, min_run, max_run)
    words = F.transform("tokens", lambda t: t["word"])
    if languages is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("context_lang", "span_lang")})
    else:
        span = F.slice(words, F.col("run_start") + 1, F.col("run_length"))
        context = F.concat(F.slice(words, F.lit(1), F.col("run_start")), F.slice(words, F.col("run_start") + F.col("run_length") + 1, F.size(words)))
        rows = with_languages(rows, "spos", {"context_lang": (context, context_confidence), "span_lang": (span, span_confidence)}, languages)
    in_run = F.transform(words, lambda _, i: (i >= F.col("run_start")) & (i < F.col("run_start") + F.col("run_length")))
    n = F.size("tokens")
    entities = entity_mask(F.col("tokens")) if labels is None else label_mask(F.col(labels), n, cfg.ner_ignore_labels)
    scored = score_sentences(rows, cfg, {"code_switch": score_mask(F.col(scores), threshold, n), "named_entity": entities}, context_lang=F.col("context_lang"), span_lang=F.col("span_lang"), lang=lang)
    keys = switch_keys(in_run, F.col(labels) if labels else None, sorted(cfg.ner_ignore_labels))
    lemmas = F.transform("tokens", lambda t: t["lemma"])
    return scored.withColumns({"sentence": tag_runs(words, keys), "tag_map": tag_map(keys, {"CS": lemmas, "NE": words}), "matched_lemmas": F.slice(lemmas, F.col("run_start") + 1, F.col("run_length"))})


def entity_search(index: DataFrame, cfg: ScoringConfig, wanted: list[str], excluded: list[str] = (), labels: str = "labels") -> DataFrame:
    """Sentences with a wanted entity and no excluded one, scored, with NE tags, matched_lemmas (the wanted entities' words) and tag_map (NEk:label to word)."""
    rows = sentences_with(index, labels, wanted, list(excluded))
    scored = score_sentences(rows, cfg, {"named_entity": label_mask(F.col(labels), F.size("tokens"), cfg.ner_ignore_labels, excluded=set(excluded))})
    words, ignored = F.transform("tokens", lambda t: t["word"]), sorted(cfg.ner_ignore_labels)
    hits = F.filter(F.arrays_zip(words.alias("w"), entity_keys(F.col(labels), wanted).alias("k")), lambda x: x["k"].isNotNull())
    return scored.withColumns({
        "sentence": tag_runs(words, entity_keys(F.col(labels), wanted, ignored)), "matched_lemmas": F.transform(hits, lambda x: x["w"]),
        "tag_map": entity_tag_map(words, F.col(labels), wanted, ignored),
    })


def position_slice(sentences: DataFrame, first: int, last: int) -> DataFrame:
    """Sentences first to last, both included."""
    return sentences.where(F.col("spos").between(first, last))


def surprisal_index(sentences: DataFrame, order: int = ORDER, words: str = "words", keys: tuple[str, ...] = ("spos",), counts: DataFrame | None = None) -> DataFrame:
    """sentences plus mean (per-token bits per byte, half precision, 0 for unclean words) and dm_mad. Words are scored where they stand by a model that can be held, else each distinct word once; without counts the model is trained on the sentences themselves."""
    if counts is None:
        own = sentences.select(F.explode(words).alias("word")).where(is_clean_word("word"))
        counts = kept(count_table(own.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("freq")), order), "counts")
    if (held := held_counts(counts, order)) is not None:
        asked = F.transform(words, lambda w: F.when(is_clean_word(w), w))
        return mean_deviation(sentences.withColumn("mean", held_means(held)(asked)))
    tokens = sentences.select(*keys, F.posexplode(words).alias("tok", "word"))
    clean = tokens.where(is_clean_word("word")).select(*keys, "tok", F.lower("word").alias("word"))
    scores = word_surprisal(score_words(clean.select("word").distinct(), counts, order))
    placed = clean.join(scores, "word").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("tok", "surprisal"))).alias("_m"))
    df = sentences.join(placed, list(keys), "left")
    bits: Column = F.transform(words, lambda _, i: half_precision(F.coalesce(F.element_at(F.coalesce("_m", F.create_map().cast("map<int,double>")), i), F.lit(0.0))))
    return mean_deviation(df.withColumn("mean", bits)).drop("_m")


def candidate_records(rows: DataFrame, mode: str, seed: int = 42) -> DataFrame:
    """The JSON-lines record of scored sentences."""
    have = set(rows.columns)
    opt = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    lemmas = opt("matched_lemmas", "array<string>")
    tags = F.col("tag_map") if "tag_map" in have else F.map_from_entries(F.transform(F.coalesce(lemmas, F.array().cast("array<string>")), lambda x, i: F.struct(F.concat(F.lit("L"), (i + 1).cast("string")), x)))
    return rows.select(
        F.lit(mode).alias("mode"), opt("sentence", "string").alias("sentence"), "score_total", F.col("score_loanword").alias("score_lw"), F.col("score_code_switch").alias("score_cs"), F.col("score_named_entity").alias("score_ne"),
        "score_length", "score_alpha", opt("cqp_id", "bigint").alias("cqp_id"), opt("cpos", "bigint").alias("cpos"), opt("spos", "bigint").alias("spos"), F.lit(seed).cast("bigint").alias("seed"),
        "filtered", F.coalesce("filter_reason", F.lit("")).alias("filter_reason"), lemmas.alias("matched_lemmas"), tags.alias("tag_map"), opt("token_surprisals", "map<string,double>").alias("token_surprisals"),
    )


def query_batch(sentences: DataFrame, queries: dict[str, tuple[list[str], int | None]], seed: int = 42) -> DataFrame:
    """query, spos, match (place of the token): one row per match of each query's lemmas, in one scan; a query with a limit keeps that many of its matches, drawn by seed."""
    asked = F.array(*[F.struct(F.lit(name).alias("query"), F.array(*[F.lit(x.lower()) for x in lemmas]).alias("lemmas")) for name, (lemmas, _) in queries.items()])
    lows = F.transform("tokens", lambda t: F.lower(t["lemma"]))
    hits = F.flatten(F.transform(lows, lambda low, i: F.transform(F.filter(asked, lambda q: F.array_contains(q["lemmas"], low)), lambda q: F.struct(q["query"].alias("query"), i.alias("match")))))
    matches = sentences.select("spos", F.explode(hits).alias("h")).select("h.query", "spos", "h.match")
    return reduced_matches(matches, "query", ["spos", "match"], {name: n for name, (_, n) in queries.items() if n}, seed)


def shown_candidates(candidates: DataFrame, mode: str = "all", results: int = 0) -> DataFrame:
    """Candidate records of a mode ("all": any), the `results` best of them (0: all)."""
    rows = candidates if mode == "all" else candidates.where(F.col("mode") == mode)
    return rows.orderBy(F.desc("score_total"), "spos").limit(results) if results else rows


def without_zero_scores(candidates: DataFrame) -> DataFrame:
    return candidates.where("score_total != 0")


def mask_sources(sentences: DataFrame, surprisal: DataFrame | None = None, entities: DataFrame | None = None, vocabulary: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Sentences (spos, cpos, count, ...) with the columns of the given indices, which must describe the same sentences, and the lower-case loan lemmas. An index that differs from the sentences anywhere is an error."""
    rows = sentences
    for index in (surprisal, entities):
        if index is not None:
            rows = aligned(rows, index)
    return rows, sorted({x.strip().lower() for x in vocabulary or [] if x.strip()})
