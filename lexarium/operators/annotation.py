"""Annotation sheets: rules as columns of errors, generated replacements, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import extract_tags, let, native_template, paired_tags, remap_tag, running_sum, strip_tags

#: Tags by mode, their columns, and which tag stands for which in the replacement.
MODES = {
    "baseline": {"prefixes": ["L", "N"], "label": ["L"], "replacement": ["N"], "pairs": [("L", "N")]},
    "extended": {"prefixes": ["L", "N", "CS", "NE"], "label": ["L", "CS", "NE"], "replacement": ["N", "CS", "NE"], "pairs": [("L", "N"), ("CS", "CS"), ("NE", "NE")]},
}
LABEL, REPLACEMENT = "Label sentence", "Replacement sentence"
COLUMNS = [LABEL, REPLACEMENT, "Target", "Valid", "Reason"]
REASONS = ["NL", "CS", "NE", "NF"]
ERRORS = "array<struct<rule_id:string,field:string,tag:string,severity:string>>"


def tag_tokens(text: Column) -> Column:
    """array<struct<close, prefix, num>> of the tags with a number, in order."""
    raw = F.regexp_extract_all(text, F.lit(r"</?[A-Z]+\d+>"), 0)
    return F.transform(raw, lambda t: F.struct(t.startswith("</").alias("close"), F.regexp_extract(t, "([A-Z]+)", 1).alias("prefix"), F.regexp_extract(t, r"(\d+)", 1).alias("num")))


def _error(rule: str, field: str, tag: Column | str, severity: str = "error") -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(field).alias("field"), (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"), F.lit(severity).alias("severity"))


def _none() -> Column:
    return F.array().cast(ERRORS)


def _when(condition: Column, error: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(error)).otherwise(_none())


def balance_errors(text: Column, field: str) -> Column:
    """V1.4 unclosed, V1.5 nested, V1.6 wrong close (what is open stays open), V1.7 close without open; a fold with a stack."""
    name = lambda t: F.concat(t["prefix"], t["num"])

    def step(acc: Column, t: Column) -> Column:
        stack, errors = acc["stack"], acc["errors"]
        top, empty = F.get(stack, F.size(stack) - 1), F.size(stack) == 0
        nested = F.when(~t["close"] & ~empty, F.array(_error("V1.5", field, name(t)))).otherwise(_none())
        orphan = F.when(t["close"] & empty, F.array(_error("V1.7", field, name(t)))).otherwise(_none())
        wrong = F.when(t["close"] & ~empty & (top != name(t)), F.array(_error("V1.6", field, top))).otherwise(_none())
        pushed = F.concat(stack, F.array(name(t)))
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        after = F.when(~t["close"], pushed).when(~empty & (top == name(t)), popped).otherwise(stack)
        return F.struct(after.alias("stack"), F.concat(errors, nested, orphan, wrong).alias("errors"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), _none().alias("errors"))
    return let(F.aggregate(tag_tokens(text), start, step), lambda r: F.concat(r["errors"], F.transform(r["stack"], lambda x: _error("V1.4", field, x))))


def _openings(text: Column) -> Column:
    """array<struct<prefix, num>> of opening tags, with or without a number."""
    raw = F.regexp_extract_all(text, F.lit(r"<[A-Z]+\d*>"), 0)
    return F.transform(raw, lambda t: F.struct(F.regexp_extract(t, "([A-Z]+)", 1).alias("prefix"), F.regexp_extract(t, r"(\d+)", 1).alias("num")))


def sentence_errors(text: Column, field: str, allowed: list[str], column: list[str]) -> Column:
    """V1, V2 and V4.2 to V4.5 of one sentence; a line break is the only error that is then reported."""
    # A span is an opening tag up to the first closing tag of its name.
    spans = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?s)<([A-Z]+\d+)>(.*?)</\1>"), 0), lambda s: F.struct(F.regexp_extract(s, r"^<([A-Z]+\d+)>", 1).alias("tag"), F.regexp_extract(s, r"(?s)^<[A-Z]+\d+>(.*)</[A-Z]+\d+>$", 1).alias("inner")))
    numbers = lambda a, p: F.array_sort(F.array_distinct(F.transform(F.filter(a, lambda x: x["prefix"] == p), lambda x: x["num"].cast("int"))))

    def of_tags(opened: Column) -> list[Column]:
        pick = lambda keep, rule: F.transform(F.filter(opened, keep), lambda x: _error(rule, field, F.concat(x["prefix"], x["num"])))
        return [pick(lambda x: x["num"] == "", "V1.2"), pick(lambda x: (x["num"] != "") & ~x["prefix"].isin(allowed), "V1.3"), pick(lambda x: (x["num"] != "") & x["prefix"].isin(allowed) & ~x["prefix"].isin(column), "V1.8")]

    def of_legal(legal: Column) -> Column:
        tags = F.transform(legal, lambda x: F.concat(x["prefix"], x["num"]))
        # Sorted, so that equal tags are neighbours and each is looked at once.
        twice = let(F.array_sort(tags), lambda a: F.array_distinct(F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1) == x, F.lit(False)))))
        gaps = F.filter(F.array_distinct(F.transform(legal, lambda x: x["prefix"])), lambda p: let(numbers(legal, p), lambda n: n != F.sequence(F.lit(1), F.size(n))))
        return F.concat(F.transform(twice, lambda x: _error("V2.1", field, x)), F.transform(gaps, lambda x: _error("V2.2", field, x)))

    def of_spans(found: Column) -> Column:
        of = lambda keep, rule: F.transform(F.filter(found, keep), lambda s: _error(rule, field, s["tag"]))
        return F.concat(of(lambda s: s["inner"] == "", "V4.4"), of(lambda s: (s["inner"] != "") & s["inner"].rlike(r"^\s*$"), "V4.5"), of(lambda s: s["tag"].rlike(r"^[LN]\d") & s["inner"].rlike("[.?!,;]"), "V4.2"))

    def rest(t: Column, opened: Column) -> Column:
        legal = F.filter(opened, lambda x: (x["num"] != "") & x["prefix"].isin(allowed) & x["prefix"].isin(column))
        fused = F.transform(F.regexp_extract_all(t, F.lit(r"""</[A-Z]+\d+>[^\s,.!?;:"')\]}]+"""), 0), lambda s: _error("V4.3", field, F.regexp_extract(s, r"([A-Z]+\d+)", 1)))
        return F.concat(*of_tags(opened), balance_errors(t, field), let(legal, of_legal), let(spans(t), of_spans), fused)

    broken = F.array(_error("V1.1", field, ""))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(r"[\n\r]"), broken).otherwise(let(_openings(t), lambda opened: rest(t, opened))))


def _field(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _metadata(warn_undecided: bool) -> tuple[list[Column], list[Column]]:
    """V0 and S9 of a row's validity and reason: what comes before the errors of its sentences, and what comes after."""
    raw_valid = _field("Valid")
    valid, reason = F.trim(raw_valid), F.trim(_field("Reason"))
    blank = (valid == "") & (raw_valid != "")
    rules = [
        _when(~valid.isin("", "+", "-"), _error("V0.1", "Valid", valid)),
        _when((valid == "-") & ~reason.isin(REASONS), _error("V0.2", "Reason", reason)),
        _when(valid.isin("", "+") & (reason != ""), _error("V0.3", "Reason", reason)),
    ]
    undecided = [_when(blank, _error("S9", "Valid", "", "warning")), _when((valid == "") & ~blank, _error("V0.4", "Valid", "", "warning"))]
    return rules, undecided if warn_undecided else []


def _complete(sheet: DataFrame) -> None:
    if missing := [c for c in COLUMNS if c not in sheet.columns]:
        raise ValueError(f"V0.0: missing columns {missing}")


def validate_metadata(sheet: DataFrame, warn_undecided: bool = True) -> DataFrame:
    """sheet plus errors: those of validate_rows() that speak of validity and reason (V0, S9); the sentences aren't looked at."""
    _complete(sheet)
    rules, undecided = _metadata(warn_undecided)
    return sheet.withColumn("errors", F.concat(*rules, *undecided))


def validate_rows(sheet: DataFrame, mode: str = "baseline", warn_undecided: bool = True, entity_parity: bool = False) -> DataFrame:
    """sheet plus errors. Missing columns are an error at once; more columns than needed are fine. entity_parity checks NE tags between the two sentences (V3.3, V3.4)."""
    _complete(sheet)
    cfg = MODES[mode]
    rules, undecided = _metadata(warn_undecided)
    numbers = lambda opened, p: F.array_sort(F.array_distinct(F.transform(F.filter(opened, lambda x: (x["prefix"] == p) & (x["num"] != "")), lambda x: x["num"].cast("int"))))
    both = "Label/Replacement"
    pairs = [(a, b) for a, b in cfg["pairs"] if a != "NE" or entity_parity]

    def parity(mine: Column, other: Column, a: str, b: str) -> Column:
        return _when(numbers(mine, a) != numbers(other, b), _error({"L": "V3.1", "CS": "V3.2", "NE": "V3.3"}[a], both, a))

    def content(label: Column, repl: Column, a: str, b: str) -> Column:
        unlike = lambda x, y: F.filter(F.map_keys(x), lambda k: F.coalesce(F.element_at(x, k) != F.element_at(y, k), F.lit(False)))
        differ = let(extract_tags(repl, b), lambda y: let(extract_tags(label, a), lambda x: unlike(x, y)))
        return F.transform(F.array_sort(differ), lambda k: _error("V3.5" if a == "CS" else "V3.4", both, F.concat(F.lit(a), k)))

    def of_pairs(label: Column, repl: Column, mine: Column, other: Column) -> Column:
        return F.concat(*[x for a, b in pairs for x in (parity(mine, other, a, b), *([content(label, repl, a, b)] if a != "L" else []))])

    def errors(label: Column, repl: Column) -> Column:
        return F.concat(
            *rules, _when(_field("Target").rlike(r"</?[A-Z]+\d+>"), _error("V4.1", "Target", "")),
            sentence_errors(label, LABEL, cfg["prefixes"], cfg["label"]), sentence_errors(repl, REPLACEMENT, cfg["prefixes"], cfg["replacement"]), *undecided,
            let(_openings(label), lambda mine: let(_openings(repl), lambda other: of_pairs(label, repl, mine, other))),
        )

    # Spark writes a column's expression out wherever a filter speaks of the column: here each sentence stands once.
    return sheet.withColumn("errors", let(_field(LABEL), lambda label: let(_field(REPLACEMENT), lambda repl: errors(label, repl))))


def error_rows(validated: DataFrame, key: str = "row_index") -> DataFrame:
    return validated.select(key, F.explode("errors").alias("e")).select(key, "e.*")


def valid_rows(sheet: DataFrame, mode: str = "baseline") -> DataFrame:
    """Rows marked + without any error or warning."""
    return validate_rows(sheet, mode).where((F.trim("Valid") == "+") & (F.size("errors") == 0)).drop("errors")


def generate_replacements(sheet: DataFrame, mode: str = "baseline", process_all: bool = False, overwrite: bool = False) -> DataFrame:
    """sheet with replacements made from the labels (L becomes N, other tags stay) and status: transformed, skipped_unselected, skipped_nonempty, skipped_precondition."""
    allowed = MODES[mode]["prefixes"]
    label = F.coalesce(F.col(f"`{LABEL}`"), F.lit(""))
    errors = sentence_errors(label, LABEL, allowed, allowed)
    broken = F.exists(errors, lambda e: e["rule_id"].startswith("V1."))
    chosen = F.lit(True) if process_all else F.coalesce(F.trim("Valid") == "+", F.lit(False))
    filled = F.trim(F.coalesce(F.col(f"`{REPLACEMENT}`"), F.lit(""))) != ""
    status = F.when(~chosen, "skipped_unselected").when(filled & F.lit(not overwrite), "skipped_nonempty").when(broken, "skipped_precondition").otherwise("transformed")
    made = remap_tag(label, "L", "N")
    return sheet.withColumn("status", status).withColumn(REPLACEMENT, F.when(F.col("status") == "transformed", made).otherwise(F.col(f"`{REPLACEMENT}`")))


def change_tag_prefix(sheet: DataFrame, source: str, target: str, columns: list[str] | None = None) -> DataFrame:
    """A whole tag name gives way to another in the sentence columns."""
    given = [c for c in (columns or [LABEL, REPLACEMENT]) if c in sheet.columns]
    return sheet.withColumns({c: remap_tag(F.col(f"`{c}`"), source, target) for c in given})


def disqualified(sheet: DataFrame, reasons: list[str]) -> DataFrame:
    return sheet.where(F.trim("Reason").isin(reasons))


def dataset_records(sheet: DataFrame, mode: str = "baseline") -> DataFrame:
    """The eight fields of the dataset format, from rows that pass validation."""
    a, b = F.col(f"`{LABEL}`"), F.col(f"`{REPLACEMENT}`")
    return valid_rows(sheet, mode).select(
        a.alias("source_annotated_loanwords"), b.alias("source_annotated_loanwords_replaced"), F.col("Target").alias("target"), strip_tags(a).alias("source_plain"), strip_tags(b).alias("source_annotated_plain"),
        extract_tags(a, "L").alias("words_in_L_tags"), extract_tags(b, "N").alias("words_in_N_tags"), paired_tags(a, b).alias("corresponding_words"),
    )


def replacement_pairs(sheet: DataFrame, mode: str = "baseline") -> DataFrame:
    """loan, native of every pair of tags with the same number in valid rows."""
    pairs = paired_tags(F.col(f"`{LABEL}`"), F.col(f"`{REPLACEMENT}`"))
    return valid_rows(sheet, mode).select(F.explode(F.map_values(pairs)).alias("p")).select(F.get("p", F.lit(0)).alias("loan"), F.get("p", F.lit(1)).alias("native"))


def plain_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Dataset records, otherwise blank, from non-empty trimmed lines."""
    t = F.trim(column)
    blank, empty = F.lit(""), F.create_map().cast("map<string,string>")
    return lines.where(t != "").select(t.alias("source_annotated_loanwords"), blank.alias("source_annotated_loanwords_replaced"), blank.alias("target"), t.alias("source_plain"), blank.alias("source_annotated_plain"), empty.alias("words_in_L_tags"), empty.alias("words_in_N_tags"), F.create_map().cast("map<string,array<string>>").alias("corresponding_words"))


def sheet_from_records(records: DataFrame) -> DataFrame:
    """A sheet with Valid = + from dataset records."""
    return records.select(F.col("source_annotated_loanwords").alias(LABEL), F.col("source_annotated_loanwords_replaced").alias(REPLACEMENT), F.col("target").alias("Target"), F.lit("+").alias("Valid"), F.lit("").alias("Reason"))


def sheet_from_candidates(candidates: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Sheet rows from candidate records; a requested lemma that none of them matched gets a placeholder row."""
    text = F.replace(F.col("sentence"), F.lit("//zx"), F.lit("/"))
    rows = candidates.select(text.alias(LABEL), native_template(text).alias(REPLACEMENT), F.lit("").alias("Target"), F.lit("").alias("Valid"), F.lit("").alias("Reason"))
    if not requested:
        return rows
    asked = candidates.sparkSession.createDataFrame([(x,) for x in requested], "lemma string")
    missing = F.broadcast(asked).join(candidates.select(F.explode("matched_lemmas").alias("lemma")).distinct(), "lemma", "left_anti")
    mark = F.concat(F.lit("<L1>"), F.col("lemma"), F.lit("</L1>"))
    return rows.unionByName(missing.select(mark.alias(LABEL), native_template(mark).alias(REPLACEMENT), F.lit("").alias("Target"), F.lit("").alias("Valid"), F.lit("").alias("Reason")))


def known_columns(sheet: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The known columns that are there, in the known order."""
    return sheet.select(*[F.col(f"`{c}`") for c in (order or [*COLUMNS, "Notes"]) if c in sheet.columns])


def inline_spans(text: Column) -> Column:
    """array<struct<prefix, num, content, start, end>>: tagged spans with offsets into the text without tags."""
    pattern = r"(?s)<([A-Z]+)(\d+)>(.*?)</\1\2>"

    def found(t: Column) -> Column:
        part = lambda k: F.regexp_extract_all(t, F.lit(pattern), k)
        items = F.arrays_zip(part(1).alias("p"), part(2).alias("n"), part(3).alias("c"), F.split(t, r"(?s)<([A-Z]+)(\d+)>.*?</\1\2>", -1).alias("b"))
        return let(F.filter(items, lambda x: x["p"].isNotNull()), placed)  # the text after the last span has no partner

    def placed(items: Column) -> Column:
        ends = running_sum(F.transform(items, lambda x: F.length(x["b"]) + F.length(x["c"])))
        one = lambda x, end: F.struct(x["p"].alias("prefix"), x["n"].alias("num"), x["c"].alias("content"), (end - F.length(x["c"])).alias("start"), end.alias("end"))
        return let(ends, lambda e: F.transform(items, lambda x, i: one(x, F.get(e, i))))

    empty = F.array().cast("array<struct<prefix:string,num:string,content:string,start:int,end:int>>")
    return let(text, lambda t: F.when(t.contains("</"), found(t)).when(t.isNotNull(), empty))


def concat_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
