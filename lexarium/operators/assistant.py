"""Reports over annotated rows: token and span facts, contradictions, duplicates, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions import spans
from lexarium.functions.text import kwic, lemma_stub, let, line_stub, row_hash, strip_tags
from lexarium.sources.shared import dropped, kept

#: In the replacement, this tag answers the label's tag.
ANSWERS = {"L": "N", "CS": "CS", "NE": "NE"}


def token_facts(rows: DataFrame, text: str, keys: list[str], lemma=lemma_stub) -> DataFrame:
    """keys, tok, surface, lemma_key, prefix, tag_id: every whitespace-separated word of the text without tags, labelled by the span that covers its first character, else "o"."""
    labelled = spans.by_row(spans.labelled_pieces, spans.PIECES)(F.col(f"`{text}`"))
    df = rows.select(*keys, F.posexplode(labelled).alias("tok", "_x"))
    return df.select(*keys, "tok", F.col("_x.w").alias("surface"), lemma(F.col("_x.w")).alias("lemma_key"), F.coalesce("_x.prefix", F.lit("o")).alias("prefix"), F.concat("_x.prefix", "_x.num").alias("tag_id"))


def _joined_lemma(content: Column) -> Column:
    """The lemma stubs of the content's words, joined by single spaces, without empty ones."""
    return F.trim(F.regexp_replace(line_stub(content), " +", " "))


def span_facts(rows: DataFrame, label: str, replacement: str, keys: list[str]) -> DataFrame:
    """keys, tag_id, prefix, surface, lemma_key, paired_tag_id, paired_surface, paired_lemma_key, is_replaced: the label's spans with the replacement's answering span, empty where there is none."""
    paired = spans.by_row(lambda a, b: spans.answered_spans(a, b, ANSWERS), spans.ANSWERED)(F.col(f"`{label}`"), F.col(f"`{replacement}`"), needed=1)
    df = rows.select(*keys, F.explode(paired).alias("a"))
    own, other = _joined_lemma(F.col("a.content")), _joined_lemma(F.col("a.other"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        *keys, F.col("a.tag").alias("tag_id"), F.col("a.prefix").alias("prefix"), F.col("a.content").alias("surface"), own.alias("lemma_key"),
        text(F.col("a.other_tag")).alias("paired_tag_id"), text(F.col("a.other")).alias("paired_surface"), text(other).alias("paired_lemma_key"),
        (F.col("a.other").isNotNull() & (other != own)).alias("is_replaced"),
    )


def contradictions(tokens: DataFrame) -> DataFrame:
    """lemma_key, prefixes (sorted), n: lemmas that occur under more than one prefix, "o" included."""
    by = tokens.where("lemma_key != ''").groupBy("lemma_key", "prefix").agg(F.count("*").alias("n"))
    return by.groupBy("lemma_key").agg(F.array_join(F.array_sort(F.collect_list("prefix")), ",").alias("prefixes"), F.sum("n").alias("n"), F.count("*").alias("_k")).where("_k > 1").drop("_k")


def replacement_conflicts(spans: DataFrame) -> DataFrame:
    """kind, lemma_key, n: loans with several replacements, replacements of several loans, loans both replaced and not."""
    loans = spans.where("prefix = 'L'")
    pairs = loans.where("paired_lemma_key != ''").select("lemma_key", "paired_lemma_key").distinct()
    many = pairs.groupBy("lemma_key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("several_replacements").alias("kind"), "lemma_key", "n")
    back = pairs.groupBy(F.col("paired_lemma_key").alias("lemma_key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("several_sources"), "lemma_key", "n")
    mixed = loans.groupBy("lemma_key").agg(F.countDistinct("is_replaced").alias("d"), F.count("*").alias("n")).where("d > 1").select(F.lit("replaced_and_not"), "lemma_key", "n")
    return many.union(back).union(mixed)


def replacements(spans: DataFrame) -> DataFrame:
    """lemma_key, answers: the sorted set of replacements of each loan."""
    return spans.where("prefix = 'L' and paired_lemma_key != ''").groupBy("lemma_key").agg(F.array_join(F.array_sort(F.collect_set("paired_lemma_key")), "|").alias("answers"))


def multiword_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.withColumn("n_words", F.size(F.filter(F.split("surface", " "), lambda x: x != ""))).where("n_words > 1").select(*keys, "tag_id", "surface", "n_words")


def collisions(rows: DataFrame, label: str, replacement: str, file: str = "file") -> DataFrame:
    """file, row_hash, n: rows of a file with the same label and replacement."""
    return rows.groupBy(file, row_hash(f"`{label}`", f"`{replacement}`").alias("row_hash")).agg(F.count("*").alias("n")).where("n > 1")


def frequencies(tokens: DataFrame, spans: DataFrame, unit: str = "word", by: str = "lemma") -> DataFrame:
    """prefix, form, n: words or spans by surface or lemma."""
    source = tokens if unit == "word" else spans
    form = "lemma_key" if by == "lemma" else "surface"
    return source.where(f"{form} != ''").groupBy("prefix", F.col(form).alias("form")).agg(F.count("*").alias("n"))


def statistics(tokens: DataFrame, spans: DataFrame, file: str = "file", row: str = "row_index") -> DataFrame:
    """One row per file and one over all (file null): words, lemmas, rows, mean and median sentence length, spans, replaced, replaced_percent (of words), duplicate_lemmas."""
    def both(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.rollup(file).agg(*aggs)

    lengths = tokens.groupBy(file, row).agg(F.count("*").alias("n"))
    # One row a file and lemma goes into the distinct count, not one a word.
    a = both(tokens.groupBy(file, "lemma_key").agg(F.count("*").alias("n")), F.sum("n").alias("words"), F.countDistinct("lemma_key").alias("lemmas"))
    b = both(lengths, F.count("*").alias("rows"), F.avg("n").alias("mean_len"), F.median("n").alias("median_len"), F.min("n").alias("min_len"), F.max("n").alias("max_len"))
    c = both(spans, F.count("*").alias("spans"), F.count_if("is_replaced").alias("replaced"))
    d = both(spans.groupBy(file, "lemma_key").agg(F.count("*").alias("n")), F.count_if(F.col("n") > 1).alias("duplicate_lemmas"))
    out = a
    for x in (b, c, d):
        out = out.withColumnRenamed(file, "_f").join(x, F.col("_f").eqNullSafe(x[file]), "left").drop(file).withColumnRenamed("_f", file)
    return out.withColumn("replaced_percent", 100 * F.coalesce("replaced", F.lit(0)) / F.col("words"))


def keyword_context(rows: DataFrame, words: str, keyword: str, width: int, keys: list[str]) -> DataFrame:
    """keys, at, context: every place of the keyword (by lemma stub) with width words on either side."""
    hits = F.filter(F.transform(words, lambda w, i: F.when(lemma_stub(w) == keyword.lower(), i)), lambda i: i.isNotNull())
    return rows.select(*keys, F.col(words), F.explode(hits).alias("at")).select(*keys, "at", kwic(F.col(words), F.col("at"), width).alias("context"))


def changed_rows(old: DataFrame, new: DataFrame, label: str, replacement: str, file: str = "file") -> DataFrame:
    """change (added or removed), file, row_hash between two states of the sheets."""
    h = lambda d: d.select(file, row_hash(f"`{label}`", f"`{replacement}`").alias("row_hash")).distinct()
    a, b = h(old), h(new)
    return b.join(a, [file, "row_hash"], "left_anti").select(F.lit("added").alias("change"), file, "row_hash").union(a.join(b, [file, "row_hash"], "left_anti").select(F.lit("removed"), file, "row_hash"))


#: Words of 64 bits in the parity sketch of a set.
SKETCH = 16


def _sketch(numbers: Column) -> Column:
    """array<bigint>: for each of SKETCH * 64 bits whether an odd number of the set's items falls on it. Two sets differ in at least as many items as their sketches do in bits."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p)
    word = lambda ps, k: F.aggregate(ps, F.lit(0).cast("bigint"), lambda a, p: F.when(F.shiftright(p, 6) == k, a.bitwiseXOR(bit(p))).otherwise(a))
    places = F.transform(numbers, lambda c: F.pmod(F.xxhash64(c), F.lit(SKETCH * 64)).cast("int"))
    return let(places, lambda ps: F.array(*[word(ps, k) for k in range(SKETCH)]))


def similar_pairs(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """a, b, similarity: pairs of rows whose sets of items have a Jaccard similarity of threshold or more. Rows of one key are one set.

    Exact, without comparing all pairs of a common item: items are ordered from rare to frequent, and two sets that
    similar share one of their first |s| - ceil(t |s|) + 1 items, so only those prefixes are joined, without items that
    one set alone has. Sizes, places and sketches go before the exact check, so that few but similar sets are moved for
    it, and a pair whose items before this one are the same too was met there. Items are numbered in that order, and
    sets are compared as numbers. Rows with equal sets, by SHA-256 of the numbers, are compared once and joined by a
    chain.
    """
    base = kept(sets.select(F.col(key).alias("id"), F.array_distinct(items).alias("s")).where(F.size("s") > 0), "sets")
    items_ = base.select("id", F.explode("s").alias("x"))
    rarity = items_.groupBy("x").agg(F.count("*").alias("f"))
    # Written once: the numbers must be the same wherever they are read. Those of items that occur once lie below 0.
    number = F.monotonically_increasing_id()
    order = kept(rarity.orderBy("f", "x").select("x", F.when(F.col("f") > 1, number).otherwise(number - F.lit((1 << 63) - 1)).alias("c")), "items")
    ranked = items_.join(order, "x").groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("r"))
    ranked = kept(ranked.select("id", "r", _sketch(F.col("r")).alias("g"), F.unhex(F.sha2(F.array_join("r", ",").cast("binary"), 256)).alias("h")), "ranked")
    dropped(base, order)
    classes = kept(ranked.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("_n")), "classes")
    same = ranked.select("id", "h").join(classes.where("_n > 1"), "h").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    n = F.size("r")
    first = F.slice("r", F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
    places = F.transform(first, lambda x, k: F.struct(k.alias("k"), x.alias("x"), F.get(F.col("r"), k - 1).alias("p")))
    prefix = ranked.join(classes.select(F.col("first").alias("id")), "id", "left_semi").select("id", n.alias("n"), "g", F.explode(F.filter(places, lambda p: p["x"] >= 0)).alias("_p"))
    prefix = prefix.select("id", "n", "g", "_p.k", "_p.x", "_p.p")
    a, b = prefix.toDF("a", "na", "ga", "ka", "x", "pa"), prefix.toDF("b", "nb", "gb", "kb", "x", "pb")
    # What the two share lies before, at or after this item.
    most = F.least("ka", "kb") + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    fits = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (most * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-6)
    unlike = sum((F.bit_count(F.get("ga", F.lit(k)).bitwiseXOR(F.get("gb", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    alike = unlike * (1 + threshold) <= (1 - threshold) * (F.col("na") + F.col("nb")) + 1e-6
    pairs = a.join(b, "x").where((F.col("a") < F.col("b")) & fits & F.coalesce(F.col("pa") != F.col("pb"), F.lit(True)) & alike).select("a", "b").distinct()
    sa, sb = ranked.select(F.col("id").alias("a"), F.col("r").alias("sa")), ranked.select(F.col("id").alias("b"), F.col("r").alias("sb"))
    both = kept(pairs, "candidates").join(sa, "a").join(sb, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("a", "b", F.size("sa").alias("_a"), F.size("sb").alias("_b"), shared.alias("_x")).select("a", "b", (F.col("_x") / (F.col("_a") + F.col("_b") - F.col("_x"))).alias("similarity")).where(F.col("similarity") >= threshold)
    return scored.union(same)


def clusters(pairs: DataFrame) -> DataFrame:
    """node, cluster (least node reachable), similarity (to that anchor; 0 where the two are no pair) by label spreading with shortcuts; each round is checkpointed to the shared folder."""
    from lexarium.operators.graph import least_reachable

    pairs = kept(pairs, "pairs")
    found = least_reachable(pairs, "a", "b").withColumnRenamed("component", "cluster")
    direct = pairs.select(F.least("a", "b").alias("cluster"), F.greatest("a", "b").alias("node"), F.col("similarity").alias("_s"))
    own = F.when(F.col("node") == F.col("cluster"), 1.0).otherwise(F.coalesce("_s", F.lit(0.0)))
    return found.join(direct, ["node", "cluster"], "left").select("node", "cluster", own.alias("similarity"))


def contradiction_contexts(tokens: DataFrame, rows: DataFrame, text: str, keys: list[str], width: int = 3) -> DataFrame:
    """lemma_key, keys, tok, prefix, surface, context: every labelled place of a contradictory lemma with the words around it in its row's plain sentence."""
    odd = contradictions(tokens).select("lemma_key")
    plain = rows.select(*keys, F.filter(F.split(strip_tags(F.col(f"`{text}`")), " "), lambda w: w != "").alias("_w"))
    # Token numbers count non-empty words, which are the plain sentence's items.
    places = tokens.where("prefix != 'o'").join(odd, "lemma_key", "left_semi").join(plain, keys)
    return places.select("lemma_key", *keys, "tok", "prefix", "surface", kwic(F.col("_w"), F.col("tok"), width).alias("context"))
