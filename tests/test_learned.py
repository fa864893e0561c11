"""Languages, lemmas and completion against plain Python versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexarium.operators import language, lemmas, lm
from lexarium.operators.scoring import scoring_config
from lexarium.plans import search
from lexarium.sources.corpus import tokens_of

WORDS = {"en": "the water house thing with station this".split(), "fr": "le eau maison chose avec gare ceci là".split(), "de": "das wasser haus ding mit bahnhof dieses für".split()}


def plain_grams(w):
    p = f" {w.lower()} "
    return [g for n in (1, 2, 3) for g in (p[k : k + n] for k in range(len(p) - n + 1)) if g != " "]


def language_rows():
    rng = random.Random(2)
    return [(lang, w, rng.randint(1, 9)) for lang, ws in WORDS.items() for w in ws] + [(None, "water", 50), ("en", "x", 1), ("fr", "Eau", 2)]


def plain_detect(rows, words):
    counts = defaultdict(Counter)
    for lang, w, n in rows:
        if lang:
            for g in plain_grams(w):
                counts[lang][g] += n
    v = len({g for c in counts.values() for g in c})
    ll = {x: sum(math.log((c[g] + 1) / (c.total() + v)) for w in words for g in plain_grams(w)) for x, c in counts.items()}
    best = max(ll.values())
    return min(x for x in ll if ll[x] == best), 1 / sum(math.exp(x - best) for x in ll.values())


def test_detect(spark):
    rows = language_rows()
    model = language.train_languages(spark.createDataFrame(rows, "lang string, word string, n long"))
    rng = random.Random(3)
    lists = [(k, rng.choices([w for ws in WORDS.values() for w in ws] + ["zzz", "日本", "WATER", "a"], k=rng.randint(1, 6))) for k in range(40)] + [(90, []), (91, [""]), (92, None), (93, ["eau", "eau", "", None])]
    got = {r.id: (r.lang, r.confidence) for r in language.detect(spark.createDataFrame(lists, "id long, words array<string>"), ["id"], model).collect()}
    assert set(got) == set(range(40)) | {93}
    for k, ws in lists:
        if k in got:
            lang, sure = plain_detect(rows, [w for w in ws if w])
            assert got[k][0] == lang and got[k][1] == pytest.approx(sure, abs=1e-9)
    unsure = language.detect(spark.createDataFrame(lists, "id long, words array<string>"), ["id"], model, min_confidence=0.99).collect()
    assert {r.id for r in unsure if r.lang is None} == {k for k, (_, c) in got.items() if c < 0.99}
    with pytest.raises(ValueError, match="languages"):
        language.train_languages(spark.createDataFrame([(None, "x", 1)], "lang string, word string, n long"))


def test_language_gates_of_the_search(spark):
    model = language.train_languages(spark.createDataFrame(language_rows(), "lang string, word string, n long"))
    lines = ["the water with this wasser dieses thing the house", "le eau avec ceci wasser dieses chose la maison", "the house with this station station thing the water", "the house with this qqq qqq thing the water", "wasser dieses"]
    flags = [{4, 5}] * 4 + [{0, 1}]
    df = spark.createDataFrame([(k, x.split(" "), [9.0 if i in flags[k] else 1.0 for i in range(len(x.split(" ")))]) for k, x in enumerate(lines)], "spos long, words array<string>, scores array<double>").withColumn("tokens", tokens_of(F.col("words")))
    cfg = scoring_config("code-switch", filter_forbid_named_entity=False, min_tokens=0)
    ask = lambda **k: {r.spos: (r.filter_reason, r.context_lang, r.span_lang) for r in search.code_switch_search(df, cfg, 5.0, lang="en", **k).collect()}
    got = ask(languages=model, span_confidence=0.6)
    assert got[0] == (None, "en", "de") and got[1] == ("wrong_context_language", "fr", "de") and got[2] == ("span_not_foreign", "en", "en")
    assert got[4] == ("wrong_context_language", None, "de"), "no context has no language"
    assert ask(languages=model, span_confidence=1.1)[0] == ("span_lang_undetected", "en", None)
    assert ask()[0] == ("wrong_context_language", None, None), "without a model no language is known"


PAIRS = [("houses", "house", 3), ("horses", "horse", 2), ("Running", "run", 5), ("sitting", "sit", 1), ("cats", "cat", 1), ("dogs", "dog", 1), ("mice", "mouse", 4), ("lice", "louse", 1), ("went", "go", 9), ("saw", "see", 2), ("saw", "saw", 3), ("sea", "sea", 1), ("a", "a", 1), ("", "x", 1), (None, "y", 1), ("b", None, 1)]


def plain_rules(pairs, least, context=3, longest=8):
    votes = defaultdict(Counter)
    for w, x in {(w.lower(), x.lower()) for w, x, n in pairs if w and x and n}:
        n = next((k for k in range(min(len(w), len(x))) if w[k] != x[k]), min(len(w), len(x)))
        cut = len(w) - n
        for k in range(cut, min(len(w), cut + context, longest) + 1):
            votes[w[len(w) - k :]][cut, x[n:]] += 1
    return {e: min(((-n, *r) for r, n in c.items() if n >= least))[1:] for e, c in votes.items() if max(c.values()) >= least}


def test_suffix_rules_and_lemmas(spark):
    pairs = spark.createDataFrame(PAIRS, "word string, lemma string, freq long")
    rules = lemmas.suffix_rules(pairs, 1)
    assert {r.ending: (r.cut, r.add) for r in rules.collect()} == plain_rules(PAIRS, 1)
    assert {r.ending: (r.cut, r.add) for r in lemmas.suffix_rules(pairs).collect()} == plain_rules(PAIRS, 2)
    known = {r.word: r.lemma for r in lemmas.known_lemmas(pairs).collect()}
    assert known["saw"] == "saw" and known["running"] == "run" and len(known) == 12
    words = spark.createDataFrame([(w,) for w in ["Fittings", "nurses", "went", "dice", "xyz", "s", "", "SAW", "SAW", None, "é" * 30]], "word string")
    plain = plain_rules(PAIRS, 1)

    def by_rule(w):
        for k in range(min(len(w), 8), -1, -1):
            if (r := plain.get(w[len(w) - k :])) and (x := w[: len(w) - r[0]] + r[1]):
                return x
        return w

    for table in (None, lemmas.known_lemmas(pairs)):
        got = {r.word: r.lemma for r in lemmas.lemmatize(words, rules, table).collect()}
        assert got == {w: (known.get(w) if table is not None and w in known else by_rule(w)) for w in ["fittings", "nurses", "went", "dice", "xyz", "s", "", "saw", "é" * 30]}
    s = spark.createDataFrame([(1, ["The", "Cats", "went"]), (2, []), (3, ["went", "went"])], "id long, words array<string>")
    assert {r.id: r.lemmas for r in lemmas.lemmatize_sentences(s, ["id"], rules, lemmas.known_lemmas(pairs)).collect()} == {1: [by_rule("the"), "cat", "go"], 2: [], 3: ["go", "go"]}


def test_paired_forms(spark):
    v = [("walking", 3), ("walkings", 5), ("walkin", 5), ("walkingaway", 9), ("walk", 99), ("station", 1)]
    got = {(r.word, r.lemma, r.freq) for r in lemmas.paired_forms(spark.createDataFrame(v, "word string, freq long")).collect()}
    assert got == {("walking", "walkin", 3), ("walkings", "walkin", 5), ("walkin", "walkin", 5), ("station", "station", 1)}


FREQ = [("haus", 5), ("maus", 2), ("né", 1), ("haus", 1), ("laut", 3), ("hand", 2)]


def plain_probability(counts, ctx, byte, order):
    if order <= 0:
        return 1 / 256
    c = counts[order].get(ctx)
    if not c:
        return plain_probability(counts, ctx[1:], byte, order - 1)
    n, r = sum(c.values()), len(c)
    return c[byte] / (n + r) if c.get(byte) else r / (n + r) * plain_probability(counts, ctx[1:], byte, order - 1)


def plain_counts(order):
    out = {n: defaultdict(Counter) for n in range(1, order + 1)}
    for w, f in FREQ:
        raw = b" " * (order - 1) + w.lower().encode() + b" "
        for p in range(order - 1, len(raw)):
            for n in out:
                out[n][raw[p - n + 1 : p]][raw[p]] += f
    return out


def plain_complete(counts, prompt, length, order):
    raw = (prompt or "").encode()
    for _ in range(length):
        ctx = raw[-(order - 1) :]
        byte = max(range(256), key=lambda b: (plain_probability(counts, ctx, b, order), -b))
        if byte == 32:
            break
        raw += bytes([byte])
    return raw.hex().upper()


@pytest.mark.parametrize("order", [3, 2])
def test_completion(spark, order):
    table = lm.count_table(spark.createDataFrame(FREQ, "word string, freq long"), order)
    counts = plain_counts(order)
    contexts = [b"ha", b"zz", b"zu", b"", b"a", "é".encode(), b"  "] if order == 3 else [b"h", b"", b"z"]
    got = lm.next_bytes(spark.createDataFrame([(x.hex().upper(),) for x in contexts * 2], "ctx string"), table, order).collect()
    assert len(got) == 256 * len(contexts)
    for r in got:
        assert r.p == pytest.approx(plain_probability(counts, bytes.fromhex(r.ctx), r.byte, order), rel=1e-12)
    for x in contexts:
        assert sum(r.p for r in got if bytes.fromhex(r.ctx) == x) <= 1 + 1e-9
    prompts = ["ha", "m", "", "zz", "n", "laut", "la", "HA", None, "né", "ha"]
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")
    done = {r.id: r for r in lm.complete(df, table, 6, order).collect()}
    assert {k: r.bytes for k, r in done.items()} == {k: plain_complete(counts, p, 6, order) for k, p in enumerate(prompts)}
    assert done[5].text.startswith("laut") and len(done) == len(prompts)


def test_sampling_follows_the_distribution(spark):
    """Draws by id and step: reruns agree, another seed differs, and bytes appear as often as the model says; nothing unseen is impossible."""
    table = lm.count_table(spark.createDataFrame(FREQ, "word string, freq long"), 3)
    counts = plain_counts(3)
    df = spark.range(4000).select("id", F.lit("ha").alias("prompt"))
    draw = lambda seed: {r.id: r.bytes for r in lm.complete(df, table, 1, 3, temperature=1.0, seed=seed).collect()}
    one = draw(1)
    assert one == draw(1) and one != draw(2)
    seen = Counter(bytes.fromhex(x)[2:] for x in one.values())
    whole = sum(plain_probability(counts, b"ha", b, 3) for b in range(256))  # draws are from the normalised distribution
    for byte in (b"u", b"n"):
        assert seen[byte] / 4000 == pytest.approx(plain_probability(counts, b"ha", byte[0], 3) / whole, abs=0.03)
    assert sum(n for b, n in seen.items() if b not in (b"u", b"n")) > 0, "smoothing leaves room for the rest"
    made = lm.complete(spark.range(30).select("id", F.lit("").alias("prompt")), table, 8, 3, temperature=0.5, generate=True).collect()
    assert all(len(r.bytes) <= 16 and not r.bytes.startswith("20") for r in made) and {r.text for r in made} & {"haus", "hand", "laut", "maus"}


def test_held_and_joined_languages_agree(spark, monkeypatch):
    words = spark.createDataFrame([("en", "house", 3), ("en", "the", 9), ("de", "haus", 4), ("de", "straße", 2), ("fr", "maison", 5)], "lang string, word string, n bigint")
    model = language.train_languages(words)
    lists = [["The", "house", ""], ["Haus", "zzz"], [], None, [""], ["MAISON"], ["Straße", "the", "the"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, words array<string>")
    parts = {"a": (F.col("words"), 0.0), "b": (F.slice("words", 1, 1), 0.9)}
    held = language.with_languages(rows, "id", parts, model)
    # No word leaves its row.
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = sorted((r.id, r.a, r.b) for r in held.collect())
    monkeypatch.setattr(language, "HELD_GRAMS", 3)
    assert sorted((r.id, r.a, r.b) for r in language.with_languages(rows, "id", parts, model).collect()) == got
    assert [a for _, a, _ in got[:6]] == ["en", "de", None, None, None, "fr"]
