"""Secret scan, DataFrame functions only.

Base rules are three patterns; on top, every long run of token characters outside their spans is scored by two character
Markov models, one of random strings and one of ordinary identifiers. The whole run is a secret if the log-likelihood
ratio favours random; otherwise the stretch of it with the greatest ratio is, if it is long and clear enough, so that a
key at the end of a path is found. Both models are trained on the driver from labelled samples (by default a seeded,
bounded generator); their difference travels as one literal array.

Work grows in proportion to the text: positions are prefix sums in two levels, and parts of a long text are cut from
pieces of PIECE characters. Cases: a null or empty text has no spans; spans of one kind never overlap; a Markov span
never overlaps a base span, whose characters end a run; offsets are code points; repeated rows are scanned one by one;
an empty table gives an empty result; `redact_documents` keeps every column, whatever its name, and every row.
"""

from __future__ import annotations

import base64
import math
import random
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import double_array, let, read_table

KINDS = ("assign", "access", "hex", "markov")
#: Letters in either case are spelt out: (?i) would depend on the dialect.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")) + "_?[Kk][Ee][Yy]"
ASSIGN = f"""({_KEYWORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
#: The same spans as the plain patterns with a length filter: a maximal run matches whole or, being short, not at all.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: A run is a secret if it is this many nats likelier as a random string, in sum and per character.
MIN_LLR, MIN_LLR_PER_CHAR = 9.0, 0.45
#: A stretch within a run: its least length, ratio and ratio per character. The bar is higher, as the best of many stretches is taken.
PART_MIN, PART_LLR, PART_LLR_PER_CHAR = 16, 14.0, 0.6
PIECE, BLOCK = 4096, 128
PLACEHOLDER = "[SECRET]"

#: Words from which the generator builds ordinary identifiers and long ordinary words.
WORDS = """the and for with from this that which there their other nation action station relation information ing tion
ness ment able less ful over under inter trans count index value name file path user data item list node table column row key
get set add remove update create delete find load save read write open close start stop init config build test main
http www com org net html json xml image button width height color style order price date time number string
error result request response server client handler manager service factory controller component application
le la les des une dans pour que avec sur est sont etaient leur nous vous entre aussi fait comme eaux tion ment ique
der die das und ein eine nicht mit von auf werden wurde schaft lich keit heit ung verein ge be ver sch ich isch
el los las del por para como mas pero sus este entre cuando muy sin sobre cion dad mente ando iendo ado ero""".split()


def labelled_samples(per_class: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 if random); bounded by per_class, the same for a seed."""
    rng = random.Random(seed)
    out = []
    alphabets = ["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    for k in range(per_class):
        n = rng.randint(16, 48)
        out.append((base64.b64encode(rng.randbytes(n)).decode() if k % 4 == 0 else "".join(rng.choices(rng.choice(alphabets), k=n)), 1))
        parts = rng.choices(WORDS, k=rng.randint(3, 7))
        style = k % 7
        if style == 0:
            s = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style < 4:
            s = "_-/"[style - 1].join(parts)
        elif style == 4:
            s = "_".join(parts).upper()
        else:
            s = "".join(parts)
        if style < 5 and rng.random() < 0.3:
            s += str(rng.randint(0, 2030))
        if style >= 5 and rng.random() < 0.4:
            s = s.upper() if rng.random() < 0.5 else s.capitalize()
        out.append((s, 0))
    # Numbers, dates and rulers are ordinary.
    out += [(("-" * rng.randint(3, 40)) if k % 3 == 0 else str(rng.randint(10**9, 10**18)) if k % 3 == 1 else f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", 0) for k in range(per_class // 8)]
    return out


def train(samples: Iterable[tuple[str, int]]) -> list[float]:
    """Per (previous, next) character log P(next | previous, random) - log P(next | previous, ordinary), row 0 for the start; additive smoothing, each class backing off to its character frequencies."""
    k = len(ALPHABET)
    code = {c: i for i, c in enumerate(ALPHABET)}
    two = [[[0.0] * k for _ in range(k + 1)] for _ in range(2)]
    one = [[0.5] * k for _ in range(2)]
    for s, label in samples:
        prev = 0
        for c in s:
            if (i := code.get(c)) is None:
                prev = 0
                continue
            two[label][prev][i] += 1
            one[label][i] += 1
            prev = i + 1
    out, weight = [], 20.0
    for prev in range(k + 1):
        rows = []
        for label in range(2):
            total, unigram = sum(two[label][prev]), sum(one[label])
            rows.append([math.log((c + weight * one[label][i] / unigram) / (total + weight)) for i, c in enumerate(two[label][prev])])
        out += [a - b for a, b in zip(rows[1], rows[0], strict=True)]
    return out


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters; [] for an empty one."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters start..end-1 of a text from its pieces, at the cost of a piece and their number."""
    first = F.floor(start / PIECE).cast("int")
    n = F.floor((end - 1) / PIECE).cast("int") - first + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(parts, first + 1, F.greatest(n, F.lit(1))), ""), start - first * PIECE + 1, end - start)).otherwise("")


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array<int> under op: within blocks, then over the blocks."""

    def scan(a):
        return F.aggregate(a, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.get(acc, F.size(acc) - 1), x)).cast("int"))))

    def of_blocks(blocks):
        tops = scan(F.transform(blocks, lambda x: F.element_at(x, -1)))
        shift = lambda x, before: F.transform(x, lambda v: F.when(before.isNull(), v).otherwise(op(before, v)).cast("int"))
        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda x, b: shift(x, F.get(t, b - 1)))))

    def split(a):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(a) <= BLOCK, scan(a)).otherwise(let(blocks, of_blocks))

    return let(values, split)


def ratios(run: Column, table: list[float]) -> Column:
    """struct<i, s, best, from, to>: the run's length, its log-likelihood ratio, the greatest ratio of a stretch, and where that stretch lies."""
    k, lookup = len(ALPHABET), double_array(table)

    def step(acc, c):
        code = F.instr(F.lit(ALPHABET), c) - 1
        d = F.get(lookup, acc["p"] * k + code)
        sum_here = F.when(acc["h"] > 0, acc["h"]).otherwise(0.0) + d
        begin = F.when(acc["h"] > 0, acc["b"]).otherwise(acc["i"])
        fields = {
            "p": code + 1, "i": acc["i"] + 1, "s": acc["s"] + d, "h": sum_here, "b": begin, "best": F.greatest(acc["best"], sum_here),
            "from": F.when(sum_here > acc["best"], begin).otherwise(acc["from"]), "to": F.when(sum_here > acc["best"], acc["i"] + 1).otherwise(acc["to"]),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    kinds = {"p": 0, "i": 0, "s": 0.0, "h": 0.0, "b": 0, "best": 0.0, "from": 0, "to": 0}
    start = F.struct(*[F.lit(v).alias(n) for n, v in kinds.items()])
    return F.aggregate(pieces(run), start, lambda acc, part: F.aggregate(F.split(part, ""), acc, step))


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """array<struct<s, k, e, g>> of the non-overlapping matches, by one split and one extraction; [] without either if nothing matches."""
    empty = F.array().cast("array<struct<s:int,k:int,e:int,g:string>>")
    gaps, found = F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("d"), F.transform(found, F.length).alias("n"), groups.alias("g"))

    def placed(z):
        ends = running(F.transform(z, lambda x: x["d"] + x["n"]), lambda a, b: a + b)
        span = lambda x, e: F.struct((e - x["n"]).alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["g"].alias("g"))
        return let(ends, lambda e: F.transform(z, lambda x, i: span(x, F.get(e, i))))

    return F.when(text.rlike(pattern), let(zipped, placed)).otherwise(empty)


def replaced(text: Column, found: Column, fill: Callable[[Column], Column]) -> Column:
    """text with each union of overlapping spans, given in order, replaced by fill(its length)."""

    def join(parts, top):
        # A span that begins at or after all earlier ends begins a union; the greatest end before the next such span ends it.
        before = lambda i: F.coalesce(F.get(top, i - 1), F.lit(0))
        heads = F.filter(F.transform(found, lambda x, i: F.struct(x["s"].alias("s"), before(i).alias("before"), i.alias("i"))), lambda h: (h["i"] == 0) | (h["s"] >= h["before"]))

        def of_heads(h):
            end = lambda i: F.coalesce(F.get(h, i + 1)["before"], F.element_at(top, -1))
            return F.concat(F.array_join(F.transform(h, lambda x, i: F.concat(cut(parts, x["before"], x["s"]), fill(end(i) - x["s"]))), ""), cut(parts, F.element_at(top, -1), F.length(text)))

        return let(heads, of_heads)

    tops = running(F.transform(found, lambda x: x["e"]), F.greatest)
    return F.when(F.size(found) == 0, text).otherwise(let(pieces(text), lambda parts: let(tops, lambda top: join(parts, top))))


def spans(docs: DataFrame, text: str = "text", samples: Iterable[tuple[str, int]] | None = None) -> DataFrame:
    """_row (docs' columns), _text, and base and added: arrays of struct<s, k, e> (code points, k an index of KINDS), each in order of s, then k."""
    table = train(samples if samples is not None else labelled_samples())
    t = F.col("_text")
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    df = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    assign = F.filter(_matches(t, ASSIGN, 0, 2), lambda x: F.length(x["g"]) >= ASSIGN_MIN)
    df = df.withColumn("base", F.sort_array(bare(F.concat(assign, _matches(t, ACCESS, 1), _matches(t, HEX, 2)))))
    df = df.withColumn("_runs", _matches(replaced(t, F.col("base"), lambda n: F.repeat(F.lit(" "), n)), RUN, 3))

    def judged(r):
        def span(v):
            whole = (v["s"] >= MIN_LLR) & (v["s"] >= MIN_LLR_PER_CHAR * v["i"])
            n = v["to"] - v["from"]
            part = (n >= PART_MIN) & (v["best"] >= PART_LLR) & (v["best"] >= PART_LLR_PER_CHAR * n)
            place = lambda a, b: F.struct(a.alias("s"), r["k"].alias("k"), b.alias("e"), F.substring(r["g"], a - r["s"] + 1, b - a).alias("g"))
            return F.when(whole, place(r["s"], r["e"])).when(part, place(r["s"] + v["from"], r["s"] + v["to"]))

        return let(ratios(r["g"], table), span)

    lettered = F.filter("_runs", lambda r: r["g"].rlike("[A-Za-z]"))
    found = F.filter(F.transform(lettered, judged), lambda x: x.isNotNull() & x["g"].rlike("[A-Za-z]"))
    return df.select("_row", "_text", "base", bare(found).alias("added"))


def digest(found: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, found: Column) -> Column:
    """text with each union of overlapping spans (in order) replaced by PLACEHOLDER."""
    return replaced(text, found, lambda n: F.lit(PLACEHOLDER))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars (if there) counted anew where the text changed."""
    found = spans(docs).withColumn("_all", F.sort_array(F.concat("base", "added"))).withColumn("_new", redact(F.col("_text"), F.col("_all")))
    cols = []
    for f in docs.schema.fields:
        c = F.col("_row")[f.name]
        if f.name == "text":
            c = F.when(F.size("_all") > 0, F.col("_new")).otherwise(c)
        elif f.name == "n_chars":
            c = F.when(F.size("_all") > 0, F.length("_new").cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return found.select(*cols)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("_row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.sort_array(F.concat("base", "added"))).alias("spans"))
