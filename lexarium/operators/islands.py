"""Runs of flagged tokens, and inline tags around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions.text import let


def key_runs(keys: Column) -> Column:
    """array<struct<start, end, key>>: maximal runs of equal keys from left to right; a null key is a run of its own."""

    def found(ks: Column) -> Column:
        heads = F.filter(F.transform(ks, lambda k, i: F.when(F.coalesce(F.get(ks, i - 1) == k, F.lit(False)), -1).otherwise(i)), lambda i: i >= 0)
        return let(heads, lambda h: F.transform(h, lambda i, n: F.struct(i.alias("start"), F.coalesce(F.get(h, n + 1), F.size(ks)).alias("end"), F.get(ks, i).alias("key"))))

    return let(keys, found)


def runs(flags: Column) -> Column:
    """array<struct<start, length>> of the maximal runs of true in array<boolean>, from left to right."""
    return F.transform(F.filter(key_runs(flags), lambda r: r["key"]), lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("length")))


def best_runs(index: DataFrame, scores: str, threshold: float, min_len: int = 2, max_len: int | None = None, key: str = "spos", block_keys: int = 4096) -> DataFrame:
    """index's rows with a run of scores above threshold, plus run_start, run_length: the longest, then leftmost.

    Runs are those of the concatenated corpus: one that goes over a sentence's edge counts for neither sentence. A
    sentence's neighbours are the nearest non-empty ones; they are looked up within blocks of keys and, at a block's
    edge, from one row per block.
    """
    df = index.withColumn("_f", F.transform(scores, lambda s: F.coalesce(s > threshold, F.lit(False))))
    df = df.withColumn("_b", F.floor(F.col(key) / block_keys))
    first = F.when(F.size("_f") > 0, F.get("_f", F.lit(0)))
    last = F.when(F.size("_f") > 0, F.get("_f", F.size("_f") - 1))
    df = df.withColumn("_first", first).withColumn("_last", last)
    order = Window.partitionBy("_b").orderBy(key)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    blocks = df.groupBy("_b").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col(key))).alias("_bl"), F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col(key))).alias("_bf"))
    # Blocks look among the blocks of their group, groups among each other (one row for some 17 million keys).
    blocks = blocks.withColumn("_g", F.floor(F.col("_b") / block_keys))
    groups = blocks.groupBy("_g").agg(F.max_by("_bl", F.when(F.col("_bl").isNotNull(), F.col("_b"))).alias("_gl"), F.min_by("_bf", F.when(F.col("_bf").isNotNull(), F.col("_b"))).alias("_gf"))
    looking = lambda last, first, w: (F.last(last, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(first, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    far = looking("_gl", "_gf", Window.orderBy("_g"))
    near = looking("_bl", "_bf", Window.partitionBy("_g").orderBy("_b"))
    blocks = blocks.select("_b", "_g", near[0].alias("_p1"), near[1].alias("_n1")).join(groups.select("_g", far[0].alias("_p2"), far[1].alias("_n2")), "_g")
    blocks = blocks.select("_b", F.coalesce("_p1", "_p2").alias("_pb"), F.coalesce("_n1", "_n2").alias("_nb"))
    df = df.withColumn("_p", F.last("_last", True).over(before)).withColumn("_n", F.first("_first", True).over(after)).join(blocks, "_b")
    prev_on, next_on = F.coalesce("_p", "_pb", F.lit(False)), F.coalesce("_n", "_nb", F.lit(False))
    df = df.withColumn("_prev", prev_on).withColumn("_next", next_on)
    fits = lambda r: (r["length"] >= min_len) & (F.lit(True) if max_len is None else r["length"] <= max_len) & ~((r["start"] == 0) & F.col("_prev")) & ~((r["start"] + r["length"] == F.size("_f")) & F.col("_next"))
    found = F.filter(runs(F.col("_f")), fits)
    df = df.withColumn("_best", F.array_max(F.transform(found, lambda r: F.struct(r["length"], (-r["start"]).alias("s")))))
    own = [c for c in index.columns]
    return df.where("_best is not null").select(*own, (-F.col("_best.s")).alias("run_start"), F.col("_best.length").alias("run_length"))


def _numbered(keys: Column) -> Column:
    """key_runs with tag: the key up to a colon and a number from 1 for each such name; null for a null key."""
    name = lambda k: F.substring_index(k, ":", 1)

    def placed(by: Column) -> Column:
        """by: the runs' names and places, sorted. array<struct<j, n>>: a run's number is its place among those of its name, in order of the runs."""

        def numbers(ps: Column) -> Column:
            kinds = F.array_distinct(F.filter(ps, lambda p: p.isNotNull()))
            first = F.map_from_arrays(kinds, F.transform(kinds, lambda p: F.array_position(ps, p)))
            return let(first, lambda f: F.sort_array(F.transform(by, lambda x, k: F.struct(x["j"].alias("j"), (k + 2 - F.element_at(f, x["p"])).alias("n")))))

        return let(F.transform(by, lambda x: x["p"]), numbers)

    def tagged(rs: Column) -> Column:
        by = F.sort_array(F.transform(rs, lambda r, j: F.struct(name(r["key"]).alias("p"), j.alias("j"))))
        one = lambda r, tag: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["key"].alias("key"), tag.alias("tag"))
        return let(let(by, placed), lambda ns: F.transform(rs, lambda r, j: one(r, F.concat(name(r["key"]), F.get(ns, j)["n"].cast("string")))))

    return let(key_runs(keys), tagged)


def tag_runs(words: Column, keys: Column) -> Column:
    """Words joined by spaces, each maximal run of equal non-null keys within <Pk>...</Pk>; P is the key up to a colon, k counts from 1 for each P."""
    part = lambda ws, r: F.array_join(F.slice(ws, r["start"] + 1, r["end"] - r["start"]), " ")
    render = lambda ws, r: F.when(r["tag"].isNull(), part(ws, r)).otherwise(F.concat(F.lit("<"), r["tag"], F.lit(">"), part(ws, r), F.lit("</"), r["tag"], F.lit(">")))
    return let(words, lambda ws: F.array_join(F.transform(_numbered(keys), lambda r: render(ws, r)), " "))


def tag_map(keys: Column, texts: dict[str, Column]) -> Column:
    """map<tag, text> of the runs that tag_runs() tags; texts: for each name P the array whose items are joined."""

    def text(r: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, items in texts.items():
            out = F.when(F.substring_index(r["key"], ":", 1) == name, F.array_join(F.slice(items, r["start"] + 1, r["end"] - r["start"]), " ")).otherwise(out)
        return out

    return F.map_from_entries(F.transform(F.filter(_numbered(keys), lambda r: r["tag"].isNotNull()), lambda r: F.struct(r["tag"], text(r))))


def entity_types(labels: Column, wanted: list[str] | None = None, ignored: list[str] = ()) -> Column:
    """The label's type per token, null for O, unwanted and ignored ones; B- and I- make no difference, so adjacent spans of a type merge."""
    def kind(x: Column) -> Column:
        t = F.regexp_replace(x, "^[BI]-", "")
        ok = (x != "O") & ~F.array_contains(F.array(*[F.lit(v) for v in ["", *ignored]]), t)
        return F.when(ok & (t.isin(wanted) if wanted else F.lit(True)), t)

    return F.transform(labels, kind)


def switch_keys(in_run: Column, labels: Column | None = None, ignored: list[str] = ()) -> Column:
    """Per token CS where it is flagged, NE:type for an entity outside, else null; without labels only CS."""
    if labels is None:
        return F.transform(in_run, lambda r: F.when(r, "CS"))
    return F.transform(F.arrays_zip(in_run.alias("r"), entity_types(labels, None, ignored).alias("k")), lambda x: F.when(x["r"], "CS").when(x["r"].isNotNull() & x["k"].isNotNull(), F.concat(F.lit("NE:"), x["k"])))


def tag_switch_and_entities(words: Column, in_run: Column, labels: Column | None = None, ignored: list[str] = ()) -> Column:
    """CS tags around the flagged tokens, NE tags around entities outside them; neighbours of one type share a tag."""
    return tag_runs(words, switch_keys(in_run, labels, ignored))


def entity_keys(labels: Column, wanted: list[str], ignored: list[str] = ()) -> Column:
    """Per token NE:type for a wanted entity, else null."""
    return F.transform(entity_types(labels, list(wanted) or None, ignored), lambda k: F.when(k.isNotNull(), F.concat(F.lit("NE:"), k)))


def entity_tag_map(words: Column, labels: Column, wanted: list[str], ignored: list[str] = ()) -> Column:
    """map<NEk:label, word>: the k-th token with a wanted label, ignored labels left out after counting."""
    items = F.filter(F.arrays_zip(words.alias("w"), labels.alias("l"), entity_types(labels, list(wanted) or None).alias("k")), lambda x: x["k"].isNotNull())
    named = F.transform(items, lambda x, i: F.struct(F.concat(F.lit("NE"), (i + 1).cast("string"), F.lit(":"), x["l"]), x["w"], x["k"].alias("k")))
    kept = F.filter(named, lambda x: ~x["k"].isin(list(ignored))) if ignored else named
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["col1"], x["w"])))


def tag_loanwords(tokens: Column, lemmas: list[str], primary: str | None = None) -> Column:
    """Each token of a listed lemma in <Lk>...</Lk>; numbers go to the primary lemma's tokens first, then from left to right."""
    wanted = F.array(*[F.lit(x.lower()) for x in lemmas])
    hit = lambda t: F.array_contains(wanted, F.lower(t["lemma"]))
    first = lambda t: F.lower(t["lemma"]) == F.lit((primary or "").lower())

    def render(ts: Column) -> Column:
        heads = F.size(F.filter(ts, lambda t: hit(t) & first(t)))

        def one(t: Column, i: Column) -> Column:
            upto = F.slice(ts, F.lit(1), i + 1)
            k = F.when(first(t), F.size(F.filter(upto, lambda u: hit(u) & first(u)))).otherwise(heads + F.size(F.filter(upto, lambda u: hit(u) & ~first(u)))).cast("string")
            return F.when(hit(t), F.concat(F.lit("<L"), k, F.lit(">"), t["word"], F.lit("</L"), k, F.lit(">"))).otherwise(t["word"])

        return F.array_join(F.transform(ts, one), " ")

    return let(tokens, render)


def valid_spans(labels: Column) -> Column:
    """array<struct<start, end, type>> of strict BIO spans: a span opens at B- and goes on over I- of its type."""
    kind = lambda x: F.substring(x, 3, 1 << 20)

    def spans(ls: Column) -> Column:
        # A label that doesn't go on from the one before begins a stretch; stretches that begin with B- are spans.
        goes_on = lambda x, i: x.startswith("I-") & F.coalesce(F.get(ls, i - 1) != "O", F.lit(False)) & F.coalesce(kind(F.get(ls, i - 1)) == kind(x), F.lit(False))
        heads = F.filter(F.transform(ls, lambda x, i: F.when(goes_on(x, i), -1).otherwise(i)), lambda i: i >= 0)

        def stretches(h: Column) -> Column:
            one = lambda i, k: F.struct(i.alias("start"), F.coalesce(F.get(h, k + 1), F.size(ls)).alias("end"), kind(F.get(ls, i)).alias("type"))
            return F.filter(F.transform(h, one), lambda x: F.get(ls, x["start"]).startswith("B-"))

        return let(heads, stretches)

    return let(F.transform(labels, lambda x: F.coalesce(x, F.lit("O"))), spans)


def tagged_lemmas(tokens: Column, lemmas: list[str], primary: str | None = None) -> Column:
    """map<Lk, lemma as requested>, numbered like tag_loanwords(); without a hit L1 is the primary lemma."""
    by_low = {x.lower(): x for x in lemmas}
    asked = F.create_map(*[F.lit(v) for kv in by_low.items() for v in kv])
    hits = F.filter(F.transform(tokens, lambda t, i: F.struct((F.lower(t["lemma"]) != F.lit((primary or "").lower())).alias("later"), i.alias("i"), F.element_at(asked, F.lower(t["lemma"])).alias("lemma"))), lambda x: x["lemma"].isNotNull())
    named = F.transform(F.array_sort(hits), lambda x, k: F.struct(F.concat(F.lit("L"), (k + 1).cast("string")).alias("k"), x["lemma"].alias("v")))
    alone = F.array(F.struct(F.lit("L1").alias("k"), F.lit(primary).cast("string").alias("v")))
    return F.map_from_entries(let(named, lambda a: F.when(F.size(a) > 0, a).otherwise(alone)))
