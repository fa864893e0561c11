"""Text predicates and transforms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPA extensions, U+0250 to U+02AF.
_IPA = "[ɐ-ʯ]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(values: Column, block: int = 128) -> Column:
    """array<int> of inclusive running sums: within blocks, then over the blocks, so that long arrays don't cost the square of their length."""

    def scan(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array((x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))).cast("int"))))

    def joined(blocks: Column) -> Column:
        tops = scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: x + F.coalesce(F.get(t, k - 1), F.lit(0))))))

    def parts(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda k: scan(F.slice(a, k * block + 1, F.lit(block))))

    return let(values, lambda a: F.when(F.size(a) <= block, scan(a)).otherwise(let(parts(a), joined)))


def lemma_stub(word: Column | str) -> Column:
    """Stand-in lemma: lower case without leading and trailing characters that are neither letters nor numbers."""
    return F.lower(F.regexp_replace(_col(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def line_stub(line: Column) -> Column:
    """lemma_stub() of every word between spaces; the spaces stay."""
    return F.lower(F.regexp_replace(line, r"(?<![^ ])[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]++(?![^ ])", ""))


def lemma_stubs(words: Column) -> Column:
    """array<string>: lemma_stub() of every word, for words without spaces (null: empty), in one pass over the joined line instead of one a word."""
    return F.when(F.size(words) > 0, F.split(line_stub(F.array_join(words, " ", "")), " ", -1)).otherwise(F.slice(words, 1, 0))


def pos_stub(word: Column | str) -> Column:
    """Stand-in tag: n for an upper-case first letter, else x."""
    return F.when(_col(word).rlike(r"^\p{Lu}"), "n").otherwise("x")


def is_clean_word(word: Column | str, allow_ner: bool = True) -> Column:
    """Words fit for statistics: no markup, IPA, digits, slashes or comparison signs, a letter, two characters or more. With allow_ner=False names and abbreviations go too."""
    w = _col(word)
    bad = w.contains("_") | w.rlike(r"^\[.*\]$") | w.rlike(_IPA) | ~w.rlike(r"\p{L}") | (F.length(w) < 2) | w.rlike(r"[=><±/]|\p{Nd}")
    if not allow_ner:
        bad = bad | (F.length(w) < 3) | w.rlike(r"\p{Lu}.*\p{Lu}") | w.contains(".")
    return ~bad


def is_alnum(word: Column | str) -> Column:
    return _col(word).rlike(r"^[\p{L}\p{N}]+$")


def half_precision(x: Column | str) -> Column:
    """The nearest IEEE half-precision value, ties to even, as double; beyond 65520 infinite, subnormals in steps of 2^-24."""
    x = _col(x).cast("double")
    e = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
    step = F.pow(F.lit(2.0), e - 10)
    rounded = F.rint(x / step) * step
    return F.when(x.isNull() | F.isnan(x) | (x == 0), x).when(F.abs(x) >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(rounded)


def char_len(word: Column | str) -> Column:
    return F.when(is_clean_word(word), F.least(F.length(_col(word)), F.lit(254)))


def byte_len(word: Column | str) -> Column:
    return F.when(is_clean_word(word), F.least(F.octet_length(_col(word)), F.lit(254)))


#: Which tags a strip removes.
STRIPS = {"pair": r"</?[LN]\d+>", "any_case": r"</?[A-Za-z]+\d+>", "upper": r"</?[A-Z]+\d+>", "markup": r"<[^>]+>"}


def strip_tags(text: Column | str, kind: str = "upper") -> Column:
    """Text without tags; kind names one of STRIPS."""
    return F.regexp_replace(_col(text), STRIPS[kind], "")


def extract_tags(text: Column | str, prefix: str) -> Column:
    """map<number, content> of <prefix k>content</prefix k>; the last of a repeated number wins."""
    t, pattern = _col(text), rf"(?s)<{prefix}(\d+)>(.*?)</{prefix}\1>"
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(t, F.lit(pattern), 2).alias("v"))
    # Usually all numbers differ; only otherwise earlier ones are looked for.
    keys = lambda a: F.transform(a, lambda x: x["k"])
    last = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(let(pairs, lambda a: F.when(F.size(F.array_distinct(keys(a))) == F.size(a), a).otherwise(last(a))))


def paired_tags(text: Column | str, replaced: Column | str) -> Column:
    """map<number, array<loan, native>> of the numbers tagged L in text and N in replaced."""
    of = lambda b: F.transform_values(F.map_filter(extract_tags(text, "L"), lambda k, _: F.map_contains_key(b, k)), lambda k, v: F.array(v, F.element_at(b, k)))
    return let(extract_tags(replaced, "N"), of)


def native_template(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"<L(\d+)>([^<]+)</L\d+>", "<N$1>$2</N$1>")


def remap_tag(text: Column | str, source: str, target: str) -> Column:
    return F.regexp_replace(_col(text), rf"<(/?){source}(\d+)>", f"<$1{target}$2>")


def normalize_slashes(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("//zx"), F.lit("/"))


def split_sentences(text: Column | str) -> Column:
    return F.split(_col(text), r"(?<=[.!?])\s+")


def row_hash(label: Column | str, replacement: Column | str) -> Column:
    return F.sha1(F.concat(F.coalesce(_col(label), F.lit("")), F.lit("\0"), F.coalesce(_col(replacement), F.lit(""))))


def protect_spans(text: Column | str, prefix: str = "CS") -> Column:
    """struct<text, terms>: each tagged span gives way to a delimited placeholder, so that term 1 is never a prefix of term 10."""
    t = _col(text)
    spans = F.regexp_extract_all(t, F.lit(rf"(?s)<{prefix}\d+>.*?</{prefix}\d+>"), 0)
    step = lambda acc, s, i: F.replace(acc, s, F.concat(F.lit("[[TERM_"), (i + 1).cast("string"), F.lit("]]")))
    indexed = F.transform(spans, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.struct(F.aggregate(indexed, t, lambda acc, x: step(acc, x["s"], x["i"])).alias("text"), spans.alias("terms"))


def restore_spans(text: Column | str, terms: Column) -> Column:
    indexed = F.transform(terms, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.aggregate(indexed, _col(text), lambda acc, x: F.replace(acc, F.concat(F.lit("[[TERM_"), (x["i"] + 1).cast("string"), F.lit("]]")), x["s"]))


#: Language names at which a translation model's output goes astray, and the format of paired prompts.
STRAY_LANGUAGES = ("Russian", "English", "German", "French", "Spanish", "Chinese", "Italian", "Portuguese", "Dutch", "Polish")
PAIR_PROMPT = "Translate the following text from {src} into {tgt}.\n{src}: {text}\n{tgt}:"
#: The instruction of chat models, in words of our own; chat_messages() takes any other.
SYSTEM_PROMPT = (
    "Translate what the user sends from {src} to {tgt}, sentence by sentence and as literally as {tgt} allows; leave nothing out and add nothing. "
    "Marks such as <L1>...</L1> belong to the text: keep each one, unchanged and around the words that translate its content. "
    "Answer with the translation alone."
)
_STRAY = "(?:" + "|".join(STRAY_LANGUAGES) + ")"


def strip_white(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def clean_request(text: Column | str) -> Column:
    """Text for a line-based prompt: cut at the first language label after white space, white space made single."""
    cut = F.regexp_replace(_col(text), rf"(?isU)\s+{_STRAY}\s*:.*", "")
    return strip_white(F.regexp_replace(cut, r"(?U)\s+", " "))


def pair_prompt(text: Column | str, src: str, tgt: str) -> Column:
    """The prompt of models that continue a pair of labelled lines."""
    before, after = PAIR_PROMPT.format(src=src, tgt=tgt, text="\0").split("\0")
    return F.concat(F.lit(before), clean_request(text), F.lit(after))


def chat_messages(text: Column | str, src: str, tgt: str, instruction: str = SYSTEM_PROMPT) -> Column:
    """array<struct<role, content>>: the messages of chat models; their template is the model's own. instruction: with {src} and {tgt}."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(one("system", F.lit(instruction.format(src=src, tgt=tgt))), one("user", _col(text)))


def clean_reply(text: Column | str, pairs: bool = True) -> Column:
    """A model's reply, stripped; with pairs, cut at the first new line that begins with a language label."""
    t = F.regexp_replace(_col(text), rf"(?sU)\n\s*{_STRAY}\s*:.*", "") if pairs else _col(text)
    return strip_white(t)


def kwic(words: Column, at: Column, width: int, before: str = " ") -> Column:
    """The words up to width places around position at (0-based), joined."""
    first = F.greatest(at - width, F.lit(0))
    return F.array_join(F.slice(words, first + 1, at + width + 1 - first), before)


def byte_trace(word: Column | str) -> Column:
    """array<struct<pos, byte, bits>> of the UTF-8 bytes; [] for an empty word."""
    hexed = F.hex(F.encode(_col(word), "UTF-8"))
    value = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.octet_length(_col(word))), lambda i: i < F.octet_length(_col(word)))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), value(i).alias("byte"), F.lpad(F.bin(value(i)), 8, "0").alias("bits")))


def exact_token_query(sentence: Column | str) -> Column:
    """A concordance query for a sentence: one case-insensitive word test per token, punctuation apart."""
    spaced = F.regexp_replace(_col(sentence), r"([.,!?;:()\"])", " $1 ")
    escaped = lambda w: F.regexp_replace(w, r'([.?*+()\[\]{}|\\^$"])', r"\\$1")
    return F.array_join(F.transform(F.filter(F.split(spaced, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit('[word="'), escaped(w), F.lit('" %c]'))), " ")


def softmax(logits: Column) -> Column:
    def run(a: Column) -> Column:
        e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
        return let(e, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y)))

    return let(logits, run)


def argmax(values: Column) -> Column:
    """0-based place of the first greatest value."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def template_parts(text: Column | str) -> Column:
    """array<array<string>> of {{a|b|c}} templates, trimmed."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"\{\{([^{}]*)\}\}"), 1), lambda t: F.transform(F.split(t, r"\|"), lambda x: F.trim(x)))
