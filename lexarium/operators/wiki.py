"""Dictionary dumps: entries with etymologies, and the funnel to loan lemmas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.functions.text import template_parts

#: Templates that mark a loan, and how they read.
LOAN_TEMPLATES = {
    "bor": "borrowed from",
    "lbor": "learned borrowing from",
    "mbor": "possibly borrowed from",
    "der": "derived from",
    "aff": "affix from",
    "suff": "suffix from",
    "pref": "prefix from",
    "inch": "inherited from",
    "relbor": "related borrowing from",
}
#: A title, a language heading (its name as it stands between the signs) and a section heading, anywhere in a line.
TITLE, LANG, SECTION = r"<title>(.*?)</title>", r"(?:^|[^=])==([A-Za-z ]+)==", r"===([A-Za-z ]+)==="
LINE_BLOCK = 1 << 16


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line. Numbers are sums in two steps over the file's blocks."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
    raw = raw.withColumn("_k", F.row_number().over(Window.partitionBy("_f", "_at").orderBy("_m")))
    blocks = raw.groupBy("_f", "_at").agg(F.count("*").alias("_c"))
    blocks = blocks.select("_f", "_at", F.coalesce(F.sum("_c").over(Window.orderBy("_f", "_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return raw.join(blocks, ["_f", "_at"]).select((F.col("_k") + F.col("_o")).alias("line_no"), "line")


def entries(lines: DataFrame, languages: list[str], mode: str = "etymology", first: int | None = None, last: int | None = None, page: str | None = None) -> DataFrame:
    """line, language, word, etymology_text from (line_no, line) in order.

    A title sets the word and ends the language; a level-two heading names a language; text after a section heading
    Etymology, up to the next section heading, is collected (a numbered heading is text like any other). An entry's
    line is that of the heading or title that ends it, so the last one of the dump isn't emitted. mode "all" keeps
    entries without etymology. page: a column that rows of one run of entries share, when the dump is partitioned.

    What holds at a line comes from its block of LINE_BLOCK lines and, before that, from one row per block.
    """
    df = lines
    if first is not None:
        df = df.where(F.col("line_no") >= first)
    if last is not None:
        df = df.where(F.col("line_no") <= last)
    keys = [page] if page else []
    title, lang, section = (F.regexp_extract("line", p, 1) for p in (TITLE, LANG, SECTION))
    is_title, is_lang = F.col("line").rlike(TITLE), F.col("line").rlike(LANG)
    event = is_title | is_lang
    df = df.withColumn("_block", F.floor(F.col("line_no") / LINE_BLOCK)).withColumn("_event", event)
    df = df.withColumn("_section", ~event & F.col("line").rlike(SECTION))
    state = {
        "_word": F.when(is_title, title),
        "_lang": F.when(is_lang, lang).when(is_title, F.lit("")),
        "_sec": F.when(F.col("_section"), section).when(event, F.lit("")),
    }
    df = df.withColumns(state)
    order = Window.partitionBy(*keys, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    blocks = df.groupBy(*keys, "_block").agg(F.count_if("_event").alias("_n"), *[known(c) for c in state])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.last(c, True).over(before).alias(f"{c}0") for c in state])
    df = df.select(*keys, "_block", "line_no", "line", "_event", "_section", F.count_if("_event").over(order).alias("_n"), *[F.last(c, True).over(order).alias(c) for c in state]).join(blocks, [*keys, "_block"])
    df = df.select(*keys, "line_no", "line", "_event", "_section", (F.col("_n") + F.col("_n0")).alias("_entry"), *[F.coalesce(c, f"{c}0").alias(c) for c in state])
    text = F.when((F.col("_sec") == "Etymology") & ~F.col("_section") & ~F.col("_event"), F.struct("line_no", "line"))
    found = df.groupBy(*keys, "_entry").agg(F.first("_word", True).alias("word"), F.first("_lang", True).alias("language"), F.sort_array(F.collect_list(text)).alias("_t"))
    ends = df.where("_event").select(*keys, (F.col("_entry") - 1).alias("_entry"), F.col("line_no").alias("line"))
    body = F.trim(F.regexp_replace(F.array_join(F.transform("_t", lambda x: x["line"]), " "), r"(?U)\s+", " "))
    out = found.join(ends, [*keys, "_entry"]).withColumn("etymology_text", body).where(F.col("language").isin(languages) & F.col("word").isNotNull())
    return (out if mode == "all" else out.where("etymology_text != ''")).select("line", "language", "word", "etymology_text")


def _is_loan(t: Column) -> Column:
    return F.lower(F.get(t, F.lit(0))).isin(list(LOAN_TEMPLATES))


def loan_funnel(rows: DataFrame, language: str = "latvian", code: str = "lv") -> DataFrame:
    """The language's rows (language, word, etymology_text) plus templates, valid_templates and reason: the first filter that excludes a row, null if none does."""
    df = rows.where(F.trim(F.lower("language")) == language).withColumn("templates", template_parts(F.coalesce("etymology_text", F.lit(""))))
    second, third = (lambda t: F.get(t, F.lit(1))), (lambda t: F.get(t, F.lit(2)))
    ok = lambda t: _is_loan(t) & F.coalesce(second(t) == code, F.lit(True)) & ~F.coalesce(F.lower(third(t)).contains("-pro"), F.lit(False))
    df = df.withColumn("valid_templates", F.filter("templates", ok))
    w = F.col("word")
    reason = (
        F.when(w.rlike(r"^\p{Lu}"), "uppercase_initial")
        .when((F.length(w) > 0) & (F.length(w) <= 2), "too_short")
        .when(w.rlike("^-|-$"), "affix_form")
        .when(F.size("templates") == 0, "no_templates")
        .when(F.size("valid_templates") == 0, "no_valid_loan_template")
        .when(~F.exists("valid_templates", lambda t: F.size(t) >= 2), "format_returned_none")
    )
    return df.withColumn("reason", reason)


def loan_lemmas(funnel: DataFrame, languages: DataFrame) -> DataFrame:
    """word, valid (empty), info: the readable templates of rows that no filter excludes, one a line. languages: code, canonical_name; an unknown code stands for itself."""
    kept = funnel.where("reason is null").withColumn("_id", F.monotonically_increasing_id())
    one = kept.select("_id", "word", F.posexplode("valid_templates").alias("_k", "_t")).where(F.size("_t") >= 2)
    code = F.when(F.size("_t") > 2, F.get("_t", F.lit(2))).otherwise(F.get("_t", F.lit(1)))
    one = one.withColumn("code", code).join(languages, "code", "left")
    reads = F.element_at(F.create_map(*[x for kv in LOAN_TEMPLATES.items() for x in map(F.lit, kv)]), F.lower(F.get("_t", F.lit(0))))
    line = F.trim(F.concat(F.lit("<C>"), reads, F.lit("</C> <L>"), F.coalesce("canonical_name", "code"), F.lit("</L> "), F.coalesce(F.get("_t", F.lit(3)), F.lit(""))))
    out = one.groupBy("_id", "word").agg(F.sort_array(F.collect_list(F.struct("_k", line.alias("s")))).alias("_s"))
    return out.select("word", F.lit("").alias("valid"), F.array_join(F.transform("_s", lambda x: x["s"]), "\n").alias("info"))


def funnel_counts(funnel: DataFrame) -> DataFrame:
    """stage, n: rows left after each filter, rows excluded by each reason, distinct words."""
    order = ["uppercase_initial", "too_short", "affix_form", "no_templates", "no_valid_loan_template", "format_returned_none"]
    counts = [F.count("*").alias("1_total"), F.count_if(F.exists("templates", _is_loan)).alias("2_raw_has_loan_template")]
    left = F.lit(True)
    for k, r in enumerate(order):
        left = left & ~F.coalesce(F.col("reason") == r, F.lit(False))
        counts += [F.count_if(left).alias(f"{k + 3}_after_{r}"), F.count_if(F.col("reason") == r).alias(f"excluded_{r}")]
    counts.append(F.countDistinct(F.when(F.col("reason").isNull(), F.col("word"))).alias("9_unique_words"))
    one = funnel.agg(*counts)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*[F.col(f"`{c}`").cast("long") for c in one.columns]))).alias("stage", "n"))


def language_codes(names: DataFrame, languages: DataFrame, column: str = "language") -> DataFrame:
    """names plus code: that of the canonical name, without regard to case and outer white space; null for an unknown one."""
    known = languages.groupBy(F.lower("canonical_name").alias("_low")).agg(F.max("code").alias("code"))
    return names.join(known, F.lower(F.trim(F.col(column))) == F.col("_low"), "left").drop("_low")


def language_code(languages: DataFrame, name: str) -> str:
    """The code of one language; an unknown name is an error."""
    row = languages.where(F.lower("canonical_name") == name.strip().lower()).agg(F.max("code")).first()[0]
    if row is None:
        raise ValueError(f"unknown language {name!r}")
    return row
