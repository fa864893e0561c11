"""Quality rules by weak supervision, DataFrame functions only.

Each rule looks at one measure of a text and votes good (1) on one side, bad (-1) on the other, and abstains (0) in
between or where the text is too short to tell. Expectation-maximisation over the counts of vote patterns (one row for
each pattern that occurs, 3^10 at most, whatever the input) estimates how often each rule errs on good and on bad
documents, both freely; a document's posterior is then the prior's log-odds and those of the votes it got. A rule that
votes bad where the others see a good document loses its weight and is outvoted; votes that go together gain theirs.

Cases: a null text counts as empty (no words, so base_failed); null and repeated doc_ids are kept row by row; an empty
table gives an empty result; a document on which all rules abstain has the prior; extra columns, whatever their names,
are ignored by the query and kept by `filter_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WS, WS, let, materialize, read_table, words

WINDOW = 5
STRETCH = 1000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_FROM = 0.5
ROUNDS = 500
SYMBOLS = "#*$%&|<>"


def _repeat_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; one sort by (hash, position), then neighbours."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    twice = let(pairs, lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(a, i + 1)["h"] == x["h"], F.lit(False))))
    at = F.sort_array(F.transform(twice, lambda x: x["p"]))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
    covered = F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), step)["n"]
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """_row (struct of keep's columns, or of all) and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_stops, n_upper, n_marked_words, n_marked_lines (long). Distinct words are counted in each STRETCH words by themselves and added up, so that their share doesn't fall with a text's length."""
    t = F.col("_t")
    df = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words(t)).withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_WS)))
    n = F.size("_w")
    gram = let(F.col("_w"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    df = df.withColumn("_g", F.when(n >= WINDOW, gram).otherwise(F.array().cast("array<bigint>")))
    only = lambda cls: F.length(F.regexp_replace(t, f"[^{cls}]+", ""))
    marked = lambda parts: F.when(t.rlike(f"[{SYMBOLS}]"), F.size(F.filter(parts, lambda x: x.rlike(f"[{SYMBOLS}]")))).otherwise(0)
    long = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(t, WS + "+", "")),
        "n_symbols": only(SYMBOLS),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _repeat_words(F.col("_g")),
        "n_distinct": let(F.col("_w"), lambda w: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(STRETCH)), F.lit(0), lambda a, k: a + F.size(F.array_distinct(F.slice(w, k, STRETCH))))),
        "n_stops": only(".!?"),
        "n_upper": only("A-Z"),
        "n_marked_words": marked(F.col("_w")),
        "n_marked_lines": marked(F.col("_l")),
    }
    return df.select("_row", *[c.cast("long").alias(k) for k, c in long.items()])


def rules() -> dict[str, Column]:
    """name -> vote: 1 good, -1 bad, 0 abstain; over measure()'s columns."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")

    def vote(judges: Column, bad: Column, good: Column) -> Column:
        return F.when(~judges, 0).when(bad, -1).when(good, 1).otherwise(0)

    def share(judges: Column, part: str, of: Column, bad: float, good: float) -> Column:
        return vote(judges, F.col(part) > bad * of, F.col(part) <= good * of)

    mean, stops = chars / F.greatest(n, F.lit(1)), F.col("n_stops") / F.greatest(n, F.lit(1))
    return {
        "length": vote(F.lit(True), n < MIN_WORDS, n >= 40),
        "symbols": share(n > 0, "n_symbols", chars, 0.04, 0.01),
        "marked_words": share(n >= 10, "n_marked_words", n, 0.15, 0.05),
        "marked_lines": share(n >= 10, "n_marked_lines", lines, 0.5, 0.2),
        "repetition": share(n >= 20, "n_repeat_words", n, MAX_REPEAT_PERCENT / 100, 0.05),
        "vocabulary": vote(n >= 50, F.col("n_distinct") < 0.35 * n, F.col("n_distinct") >= 0.5 * n),
        "lines": share(lines >= 4, "n_dup_lines", lines, 0.3, 0.1),
        "capitals": share(n >= 10, "n_upper", chars, 0.35, 0.15),
        "word_length": vote(n >= 20, ~mean.between(3.5, 7), mean.between(4, 6.5)),
        "stops": vote(n >= 20, ~stops.between(0.01, 0.6), stops.between(0.03, 0.3)),
    }


#: What EM starts from, and, as so many documents, a weak prior: the share of good documents; of a rule's votes on good and on bad documents, the bad ones' share.
PRIOR, BAD_VOTES, STRENGTH = 0.9, (0.05, 0.6), 20


def log_odds(votes: tuple[int, ...], prior: float, shares: list[tuple[float, float]]) -> float:
    total = math.log(prior / (1 - prior))
    for v, share in zip(votes, shares, strict=True):
        total += _weight(share, v)
    return total


def _weight(share: tuple[float, float], vote: int) -> float:
    """Log-odds of good that a vote gives; abstaining gives none."""
    good, bad = share
    return 0.0 if vote == 0 else math.log(good / bad) if vote < 0 else math.log((1 - good) / (1 - bad))


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS) -> dict:
    """EM over (votes, count) rows until nothing moves: the prior and, per rule, the share of bad votes among its votes on good and on bad documents."""
    n, prior, shares = sum(c for _, c in patterns), PRIOR, [BAD_VOTES] * len(names)
    for _ in range(rounds):
        good = PRIOR * STRENGTH
        down, base = [[x * STRENGTH for x in BAD_VOTES] for _ in names], [[STRENGTH, STRENGTH] for _ in names]
        for votes, count in patterns:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds(votes, prior, shares)))))
            good += count * p
            for j, v in enumerate(votes):
                if v:
                    for y, weight in enumerate((p, 1 - p)):
                        base[j][y] += count * weight
                        down[j][y] += count * weight * (v < 0)
        before, prior = (prior, shares), good / (n + STRENGTH)
        shares = [(d[0] / b[0], d[1] / b[1]) for d, b in zip(down, base, strict=True)]
        if abs(prior - before[0]) + sum(abs(x - y) for s, t in zip(shares, before[1], strict=True) for x, y in zip(s, t, strict=True)) < 1e-9:
            break
    return {"prior": prior, "shares": dict(zip(names, shares, strict=True))}


def posterior(model: dict) -> Column:
    """P(good | votes) from the vote columns v_<rule>: log-odds add up."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, share in model["shares"].items():
        v = F.col(f"v_{name}")
        odds = odds + F.when(v == 1, _weight(share, 1)).when(v == -1, _weight(share, -1)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """(_row, a struct of keep's columns or of all of docs', with measures, votes, base_failed, p_good, kept; the fitted model). Measures are computed once, into a shared table."""
    votes = rules()
    table = materialize(measure(docs, text, keep).withColumns({f"v_{k}": v.cast("byte") for k, v in votes.items()}), "rules")
    model = fit([(tuple(r[:-1]), r[-1]) for r in table.groupBy(*[f"v_{k}" for k in votes]).count().collect()], list(votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = table.withColumn("base_failed", failed).withColumn("p_good", posterior(model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM)), model


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with docs' columns."""
    out, _ = judge(docs)
    return out.where("kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
