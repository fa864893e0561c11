"""Per-token indices, their statistics and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions.text import byte_len, char_len


def length_index(sentences: DataFrame, words: str = "words") -> DataFrame:
    """sentences plus char_len, byte_len: array<int>, null for excluded tokens, at most 254."""
    return sentences.withColumn("char_len", F.transform(words, char_len)).withColumn("byte_len", F.transform(words, byte_len))


def length_stats(values: DataFrame, column: str) -> DataFrame:
    """n, mean, var, std, median, min, max of the non-null values."""
    c = F.col(column)
    return values.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("var"), F.stddev_samp(c).alias("std"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"))


def ranged_stats(values: DataFrame, column: str) -> DataFrame:
    """length_stats plus lo1, hi1, lo2, hi2: one and two standard deviations around the mean."""
    at = lambda k: F.col("mean") + k * F.col("std")
    return length_stats(values, column).select("*", at(-1).alias("lo1"), at(1).alias("hi1"), at(-2).alias("lo2"), at(2).alias("hi2"))


def value_ranks(values: DataFrame, column: str, mu: float | None = None, sigma: float | None = None, percentile_of: float | None = None) -> DataFrame:
    """One row: n (non-null), excluded (null), in_range and percent_in of mu - sigma to mu + sigma, and the percentage of values up to percentile_of; null for what isn't asked."""
    c = F.col(column)
    null = F.lit(None).cast("double")
    n = F.count(c)
    inside = F.count_if(c.between(mu - sigma, mu + sigma)) if mu is not None and sigma is not None else F.lit(None).cast("bigint")
    upto = 100.0 * F.count_if(c <= percentile_of) / n if percentile_of is not None else null
    return values.agg(n.alias("n"), F.count_if(c.isNull()).alias("excluded"), inside.alias("in_range"), (100.0 * inside / n).alias("percent_in"), upto.alias("percentile"))


def sentence_tokens(index: DataFrame, arrays: list[str], spos: int | None = None, cpos: int | None = None, head: int = 16) -> DataFrame:
    """spos, cpos, count, idx and the arrays' items of the first head tokens of one sentence, found by its number or by a position in it. index: spos, cpos, count and the arrays."""
    if (spos is None) == (cpos is None):
        raise ValueError("give either spos or cpos")
    one = index.where(F.col("spos") == spos) if spos is not None else index.where((F.col("cpos") <= cpos) & (cpos < F.col("cpos") + F.col("count")))
    zipped = F.slice(F.arrays_zip(*arrays), 1, head)
    return one.select("spos", "cpos", "count", F.posexplode(zipped).alias("idx", "_x")).select("spos", "cpos", "count", "idx", *[F.col("_x")[a].alias(a) for a in arrays])


def describe(index: DataFrame) -> DataFrame:
    """name, type, n (non-null values) of the index's columns: one scan."""
    counts = index.agg(*[F.count(F.col(f"`{f.name}`")).alias(f.name) for f in index.schema.fields])
    rows = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`").alias("n")) for f in index.schema.fields])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lower, upper, n over equal widths between least and greatest value; the last bin holds its upper edge; empty bins are listed. Nulls don't count."""
    c = F.col(column).cast("double")
    ends = values.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((c - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = values.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row on the right
    every = ends.where("lo is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), (F.col("lo") + F.col("bin") * width).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"))
    return every.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def value_histogram(values: DataFrame, column: str) -> DataFrame:
    """value, n, share_upto: counts of whole-number values and the empirical distribution at each."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("value", "n", (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy())).alias("share_upto"))


def vocabulary(lines: DataFrame, text: str, order: str) -> DataFrame:
    """idx (from 1), lemma: distinct non-empty lines in order of first appearance. The window runs over distinct entries only."""
    first = lines.select(F.trim(text).alias("lemma"), F.col(order).alias("_o")).where("lemma != ''").groupBy("lemma").agg(F.min("_o").alias("_o"))
    return first.select(F.row_number().over(Window.orderBy("_o")).alias("idx"), "lemma")


def lemma_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """tokens plus lemma_id: the vocabulary's idx, 0 for other lemmas; letter case matters."""
    return tokens.join(vocab.select("lemma", F.col("idx").alias("_idx")), "lemma", "left").withColumn("lemma_id", F.coalesce("_idx", F.lit(0))).drop("_idx")


def wanted_ids(requested: list[str], vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, requested) pairs matched without regard to case, and the requested lemmas that match nothing."""
    spark = vocab.sparkSession
    asked = spark.createDataFrame([(k, x, x.lower()) for k, x in enumerate(requested)], "n int, requested string, low string")
    pairs = vocab.withColumn("low", F.lower("lemma")).join(F.broadcast(asked), "low")
    one = pairs.groupBy("idx").agg(F.max_by("requested", "n").alias("requested"))
    return one, asked.join(pairs.select("low").distinct(), "low", "left_anti").select("requested")


def locate_positions(points: DataFrame, sentences: DataFrame, cpos: str = "cpos", span: int = 4096) -> DataFrame:
    """points plus spos of the sentence with start <= cpos < start + count, else -1. Both sides are keyed by stretches of positions, so the range condition is checked within a stretch only."""
    reach = F.sequence(F.floor(F.col("_start") / span), F.floor((F.col("_start") + F.col("_count") - 1) / span))
    s = sentences.select(F.col("spos").alias("_spos"), F.col("cpos").alias("_start"), F.col("count").alias("_count")).where("_count > 0").withColumn("_stretch", F.explode(reach))
    p = points.withColumn("_at", F.floor(F.col(cpos) / span))
    on = (F.col("_at") == F.col("_stretch")) & F.col(cpos).between(F.col("_start"), F.col("_start") + F.col("_count") - 1)
    return p.join(s, on, "left").withColumn("spos", F.coalesce("_spos", F.lit(-1))).drop("_spos", "_start", "_count", "_stretch", "_at")


def validate_index(index: DataFrame, block_keys: int = 4096) -> DataFrame:
    """rule, spos, detail: rows whose cpos overlaps the sentence before, and gaps or repeats in spos. Neighbours come from blocks of spos, a block's first row finds its neighbour among the last rows of blocks, and those in blocks of blocks."""
    row = F.struct("spos", "cpos", "count")
    df = index.withColumn("_b", F.floor(F.col("spos") / block_keys))
    last = df.groupBy("_b").agg(F.max(row).alias("_edge")).withColumn("_c", F.floor(F.col("_b") / block_keys))
    far = last.groupBy("_c").agg(F.max("_edge").alias("_e"))
    far = far.select("_c", F.lag("_e").over(Window.orderBy("_c")).alias("_far"))
    near = F.lag("_edge").over(Window.partitionBy("_c").orderBy("_b"))
    last = last.withColumn("_near", near).join(far, "_c").select("_b", F.coalesce("_near", "_far").alias("_edge"))
    own = F.lag(row).over(Window.partitionBy("_b").orderBy("spos", "cpos"))
    df = df.withColumn("_prev", own).join(last, "_b").withColumn("_prev", F.coalesce("_prev", "_edge"))
    gap = df.where("spos != _prev.spos + 1").select(F.lit("spos_step").alias("rule"), "spos", F.col("spos").cast("long") - F.col("_prev.spos"))
    over = df.where("cpos < _prev.cpos + _prev.count").select(F.lit("cpos_overlap").alias("rule"), "spos", F.col("_prev.cpos") + F.col("_prev.count") - F.col("cpos"))
    return gap.union(over).toDF("rule", "spos", "detail")


def validate_totals(index: DataFrame, n_tokens: int, n_sentences: int | None = None) -> DataFrame:
    """rule, expected, found: the counts' sum against the stored tokens, and the number of sentences."""
    found = index.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("t"), F.count("*").alias("s"))
    checks = [F.struct(F.lit("token_total").alias("rule"), F.lit(n_tokens).cast("long").alias("expected"), F.col("t").alias("found"))]
    if n_sentences is not None:
        checks.append(F.struct(F.lit("sentence_total").alias("rule"), F.lit(n_sentences).cast("long").alias("expected"), F.col("s").alias("found")))
    return found.select(F.explode(F.array(*checks)).alias("x")).select("x.*").where("expected != found")


def sentence_strata(rows: DataFrame, size: int, each: int, seed: int = 42) -> DataFrame:
    """rows of a sample: the `each` sentences of least md5("seed:spos") in every stretch of `size` numbers. The same on every run; a stretch is a window of its own."""
    stretch = F.floor(F.col("spos") / size)
    at = F.row_number().over(Window.partitionBy("_s").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("spos").cast("string")).cast("binary")), "spos"))
    return rows.withColumn("_s", stretch).withColumn("_at", at).where(F.col("_at") <= each).drop("_s", "_at")


def validate_sample(index: DataFrame, sentences: DataFrame, size: int = 4096, each: int = 8, seed: int = 42) -> DataFrame:
    """rule, spos, detail: what recounting a sample of the index's sentences in the corpus shows. index: spos, cpos, count; sentences: spos, cpos, words. Rules: missing (the corpus has no such sentence), cpos (by how much the index is ahead), count (by how much it is larger). Arrays are recounted for sampled sentences only."""
    sample = sentence_strata(index.select("spos", "cpos", "count"), size, each, seed)
    found = sample.join(sentences.select("spos", F.col("cpos").alias("_c"), F.size("words").alias("_n")), "spos", "left")
    flaw = lambda rule, detail, bad: F.struct(F.lit(rule).alias("rule"), detail.cast("bigint").alias("detail"), F.coalesce(bad, F.lit(False)).alias("bad"))
    flaws = F.array(
        flaw("missing", F.lit(0), F.col("_n").isNull()), flaw("cpos", F.col("cpos") - F.col("_c"), F.col("cpos") != F.col("_c")), flaw("count", F.col("count") - F.col("_n"), F.col("count") != F.col("_n")),
    )
    return found.select("spos", F.explode(F.filter(flaws, lambda x: x["bad"])).alias("x")).select("x.rule", "spos", "x.detail")


def sample_bound(index: DataFrame, violations: DataFrame, size: int = 4096, each: int = 8, seed: int = 42, z: float = 1.645) -> DataFrame:
    """sampled, wrong (sentences), at_most: Wilson's upper bound, at 95 percent, for the share of wrong sentences in the whole index."""
    n = sentence_strata(index.select("spos"), size, each, seed).agg(F.count("*").alias("sampled"))
    wrong = violations.agg(F.count_distinct("spos").alias("wrong"))
    p, m = F.col("wrong") / F.col("sampled"), F.col("sampled")
    bound = (p + z * z / (2 * m) + z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return n.crossJoin(wrong).select("sampled", "wrong", F.when(m > 0, bound).otherwise(1.0).alias("at_most"))  # one row each


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the least spos at which cpos or count differ or one index has no row, null if none."""
    x, y = (d.select("spos", F.col("cpos").alias(f"c{k}"), F.col("count").alias(f"n{k}")) for k, d in enumerate((a, b)))
    differ = ~(F.col("c0").eqNullSafe(F.col("c1")) & F.col("n0").eqNullSafe(F.col("n1")))
    return x.join(y, "spos", "full").where(differ).agg(F.min("spos").alias("spos"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows with b's other columns, by spos; indices that differ anywhere in their sentences' places or lengths are an error that names the first."""
    at = first_divergence(a, b).first()[0]
    if at is not None:
        raise ValueError(f"the indices differ from sentence {at} on")
    return a.join(b.drop("cpos", "count"), "spos")


def fetch_sentences(sentences: DataFrame, wanted: DataFrame, by: str = "spos") -> DataFrame:
    """wanted's rows (with column `by`, a sentence's number or a position in it) with the sentence's columns; numbers that aren't there give none."""
    if by == "spos":
        return wanted.join(sentences, "spos")
    return locate_positions(wanted, sentences, by).where("spos >= 0").join(sentences.drop(by), "spos")
