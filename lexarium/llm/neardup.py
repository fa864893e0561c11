"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch: in round i each element of a set is hashed to one of T bins with a value in [i, i + 1); a bin keeps its least
value, and rounds go on until every bin is filled. From round T on, round T + j sends every element to bin j, so
2 T rounds always suffice. The share of equal coordinates estimates the Jaccard similarity with the concentration of
sampling without replacement. BANDS bands of ROWS coordinates make the candidate buckets: at a similarity of 0.85 a
pair misses all of them with probability 7e-9 (0.8: 3e-6).

No bucket is ever held in one task or expanded into its pairs. Documents with equal sets are one class, compared
once. Each class is then compared with its buckets' least member, on the full shingle sets of both texts; components
of the confirmed links follow. Only buckets that still join different components go on. In those of up to LARGE
members, the members outside the least member's component meet the others in blocks of about BLOCK, where low bytes of
all T coordinates are compared as matrices; a pair goes on to the exact comparison if their agreement is less than
SIGMAS standard deviations under the threshold's (a linked pair falls short with probability 6e-8). Members of larger
buckets, such as pages of one template, are paired by their rarest shingles instead: of two linked sets, the smaller one's first n - ceil(2 t n /
(1 + t)) + 1 shingles and the larger one's first n - ceil(t n) + 1, from rare to frequent, have one in common, which
pages with too much text of their own haven't. So every pair of a bucket is in one component already, or ruled out by
its sketches or its rarest shingles, or compared exactly; and no list grows with the square of a bucket.

Cases: a null or empty text, or one of white space, has an empty set and links with nothing; under five words the
whole sequence is the only shingle; every row gets a result, and a component is named by its least doc_id; rows of one
doc_id are one document, which stays or goes as a whole: each of its texts' sets is compared once, however many rows have
it, and what any of them links with, it links with; a null doc_id links with nothing, has a null component and is kept;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, release, trim, works_as
from .components import components

SHINGLE = 5
ROWS, BANDS = 5, 32
T = 1024
BLOCK, LARGE = 256, 20_000
SIGMAS = 5.3
_MASK = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}") | 1 for k in range(n)], dtype=np.uint64)


_WORD, _SEED, _BAND, _SIG = _constants(SHINGLE, 1), _constants(2 * T, 2), _constants(ROWS + 1, 3), _constants(2, 4)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; bounded, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower and bytes.split are the contract's: A-Z, and space with U+0009 to U+000D."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(len(words), SHINGLE)
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _WORD[i]
    return np.unique(mixed(total))


def sketch(items: np.ndarray) -> np.ndarray:
    """T coordinates (round and value in one number) of a set that isn't empty."""
    out = np.full(T, _MASK, dtype=np.uint64)
    at, bins = 0, np.arange(T, dtype=np.uint64) << np.uint64(54)
    while at < T:
        rounds = np.arange(at, min(T, at + max(1, 6 * T // len(items))), dtype=np.int64)
        h = mixed(items[None, :] ^ _SEED[rounds][:, None])
        # bin in 10 bits, round in 11, value in 43
        key = (h >> np.uint64(54) << np.uint64(54)) | (rounds.astype(np.uint64)[:, None] << np.uint64(43)) | (h & np.uint64((1 << 43) - 1))
        key = np.sort(key, axis=None)
        got = key[np.minimum(np.searchsorted(key, bins), len(key) - 1)]
        hit = (got >> np.uint64(54) == bins >> np.uint64(54)) & (out == np.uint64(_MASK))
        out[hit] = got[hit] & np.uint64((1 << 54) - 1)
        at += len(rounds)
        if not (out == np.uint64(_MASK)).any():
            return out
    for j in np.flatnonzero(out == np.uint64(_MASK)):
        out[j] = np.uint64((T + int(j)) << 43) | (mixed(items ^ _SEED[T + j]) & np.uint64((1 << 43) - 1)).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit bucket keys; a key names its band too."""
    rows = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) * _BAND[ROWS]
    for k in range(ROWS):
        total = mixed(total + rows[:, k] * _BAND[k])
    return total.view(np.int64)


def signature(s: np.ndarray) -> list[int]:
    """Two signed 64-bit sums that, with the size, stand for a set."""
    return [int(mixed(s ^ c).sum(dtype=np.uint64).astype(np.int64)) for c in _SIG]


FEATURES = "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, bands array<bigint>, low binary"


def features(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("bands", pa.list_(pa.int64())), ("low", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works_as("shingles", _words.clear)
        for batch in batches:
            n, sigs, bands, low = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                sigs.append(signature(s))
                c = sketch(s) if len(s) else None
                bands.append(np.empty(0, dtype=np.int64) if c is None else band_keys(c))
                low.append(b"" if c is None else c.astype(np.uint8).tobytes())
            ends = np.cumsum([0] + [len(b) for b in bands]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands) if bands else [], pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array([s[0] for s in sigs], pa.int64()), pa.array([s[1] for s in sigs], pa.int64()), lists, pa.array(low, pa.binary())], schema=schema)
            trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FEATURES)


SET = ["sig1", "sig2", "n_shingles"]


def repeated_texts(docs: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """rep, text: one text for each class whose doc_id has several rows, found among them by its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works_as("shingles", _words.clear)
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            sigs = [signature(s) for s in sets]
            columns = [[x[0] for x in sigs], [x[1] for x in sigs], [len(s) for s in sets]]
            yield pa.record_batch([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "text", *SET])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(repeated, "doc_id", "left_semi")
    rows = rows.mapInArrow(run, "doc_id bigint, text binary, sig1 bigint, sig2 bigint, n_shingles bigint")
    one = rows.groupBy("doc_id", *SET).agg(F.first("text").alias("text"))
    return one.join(classes.where("many").select("rep", F.col("doc").alias("doc_id"), *SET), ["doc_id", *SET]).select("rep", "text")


class Texts:
    """The text of a class: that of its document, or, where the document has several rows, the one of these that has the class's set (extra: rep, text)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, extra: DataFrame | None):
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("binary").alias("_text"))
        self.classes, self.extra = classes, extra

    def named(self, rows: DataFrame, *keys: str) -> DataFrame:
        """rows plus, for each key, the class's document (doc_<key>) and whether this has several rows (many_<key>)."""
        for k in keys:
            rows = rows.join(self.classes.select(F.col("rep").alias(k), F.col("doc").alias(f"doc_{k}"), F.col("many").alias(f"many_{k}")), k)
        return rows

    def add(self, rows: DataFrame, key: str) -> DataFrame:
        """named() rows plus text_<key>. Texts move once, to their rows."""
        columns, text = rows.columns, F.col("_text").alias(f"text_{key}")
        if self.extra is None:
            return rows.join(self.docs, rows[f"doc_{key}"] == self.docs["_id"]).select(*columns, text)
        plain, many = rows.where(f"not many_{key}"), rows.where(f"many_{key}")
        out = plain.join(self.docs, plain[f"doc_{key}"] == self.docs["_id"]).select(*columns, text)
        return out.union(many.join(self.extra.select(F.col("rep").alias(key), F.col("text").alias("_text")), key).select(*columns, text))


def confirmed(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= percent * union of their full shingle sets. Texts move to the pair's first document, then, with it, to the second; AQE splits a document with many partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hits = []
            for k in range(batch.num_rows):
                if b[k] != last or kept is None:
                    last, kept = b[k], None
                text_b = batch.column(3)[k].as_py()
                if kept is None or kept[0] != text_b:
                    kept = (text_b, shingles(text_b))
                x, y = shingles(batch.column(2)[k].as_py()), kept[1]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) and both:
                    hits.append(k)
            yield pa.record_batch([pa.array([a[k] for k in hits], pa.int64()), pa.array([b[k] for k in hits], pa.int64())], names=["a", "b"])

    both = texts.add(texts.add(texts.named(pairs, "a", "b"), "a"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def least_agreement(percent: int) -> float:
    """The number of equal low bytes under which the sketches rule a link out."""
    p = percent / 100
    return T * (p + (1 - p) / 256) - SIGMAS * (T * p * (1 - p)) ** 0.5


def _ceil(a, b):
    return F.floor((a + (b - 1)) / b)


def rare_prefixes(reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """token, rep, component, n, pos, own: each set's shingles, from rare to frequent, up to the length that a link with a smaller set needs; own: also up to that for a larger one. Tokens of one component only are left out. From reps (rep, component) and their texts (doc_id: rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works_as("shingles", _words.clear)
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], names=["rep", "component", "tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("binary").alias("text"))
    sets = texts.join(reps, "rep").select("rep", "component", "text").mapInArrow(run, "rep bigint, component bigint, tokens array<bigint>")
    sets = sets.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(sets.select("row", "rep", "component", F.size("tokens").cast("bigint").alias("n"), F.explode("tokens").alias("token")), "tokens")
    often = rows.groupBy("token").agg(F.count("*").alias("df"))
    ranked = rows.join(often, "token").groupBy("row", "rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    n, part = F.col("n"), lambda a, b: F.col("n") - _ceil(a * F.col("n"), F.lit(b)) + 1
    ranked = ranked.select("rep", "component", "n", F.posexplode(F.slice("r", F.lit(1), part(percent, 100).cast("int"))).alias("pos", "t"))
    entries = ranked.where("t.df > 1").select("t.token", "rep", "component", "n", F.col("pos").cast("bigint").alias("pos"), (F.col("pos") < part(2 * percent, 100 + percent)).alias("own"))
    shared = entries.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("m")).where("_lo < _hi").select("token", "m")
    entries = materialize(entries.join(shared, "token"), "prefixes")
    release(rows)
    return entries


def paired(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a token of their prefixes and may be linked by their sizes and the token's places. The sets of a token meet as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (xr, xc, xn, xp), (yr, yc, yn, yp) = ([np.array([m[f] for m in batch.column(c)[k].as_py()], dtype=np.int64) for f in ("rep", "component", "n", "pos")] for c in (0, 1))
                found = []
                for i in range(len(xr)):
                    need = (percent * (xn[i] + yn) + 99 + percent) // (100 + percent)
                    left = np.minimum(xn[i] - xp[i], yn - yp)
                    at = np.flatnonzero((xc[i] != yc) & (xr[i] != yr) & (xn[i] <= yn) & (percent * yn <= 100 * xn[i]) & (left >= need))
                    found += [(int(xr[i]), int(yr[j])) for j in at]
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    dealt = prefixes.withColumn("_block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK)))
    lists = lambda rows, name: rows.groupBy("token", F.col("_block").alias(f"_{name}")).agg(F.collect_list(F.struct("rep", "component", "n", "pos")).alias(name))
    return lists(dealt.where("own"), "smaller").join(lists(dealt, "larger"), "token").select("smaller", "larger").mapInArrow(run, "a bigint, b bigint")


def alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches (rep, low) don't rule a link out."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, T) for c in (2, 3))
            fits = pa.array((x == y).sum(axis=1) >= least)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(fits)

    low = lambda k: sketches.select(F.col("rep").alias(k), F.col("low").alias(f"low_{k}"))
    return pairs.join(low("a"), "a").join(low("b"), "b").select("a", "b", "low_a", "low_b").mapInArrow(run, "a bigint, b bigint")


def likely(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose sketches don't rule out a link, from rows (key, odd, others): arrays of struct<rep, component, n, bands, low>. A pair that shares several buckets comes from the first of its bands only."""
    least = least_agreement(percent)

    def side(x):
        bands = np.array(x["bands"], dtype=np.int64)
        return np.array(x["rep"]), np.array(x["component"]), np.array(x["n"]), bands, np.frombuffer(b"".join(x["low"]), np.uint8).reshape(len(bands), T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py()
                x, y = (side({f: [m[f] for m in batch.column(c)[k].as_py()] for f in ("rep", "component", "n", "bands", "low")}) for c in (1, 2))
                found = []
                for i in range(len(x[0])):
                    fits = (x[1][i] != y[1]) & (x[0][i] != y[0]) & (100 * np.minimum(x[2][i], y[2]) >= percent * np.maximum(x[2][i], y[2]))
                    at = np.flatnonzero(fits)
                    at = at[(x[4][i] == y[4][at]).sum(axis=1) >= least]
                    if len(at):
                        shared = x[3][i] == y[3][at]
                        at = at[x[3][i][shared.argmax(axis=1)] == key]
                        found += [(int(x[0][i]), int(y[0][j])) for j in at]
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return blocks.select("key", "odd", "others").mapInArrow(run, "a bigint, b bigint")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    found = materialize(features(docs), "features")
    sets = found.where("n_shingles > 0 and doc_id is not null")
    repeated = materialize(sets.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    repeats = not repeated.isEmpty()
    classes = sets.groupBy(*SET, "bands").agg(F.min("doc_id").alias("doc"))
    if repeats:
        classes = classes.join(repeated.select(F.col("doc_id").alias("_many")), F.col("doc") == F.col("_many"), "left").withColumn("many", F.col("_many").isNotNull()).drop("_many")
    else:
        classes = classes.withColumn("many", F.lit(False))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    texts = Texts(docs, classes, materialize(repeated_texts(docs, classes, repeated), "texts") if repeats else None)
    entries = classes.select("rep", "doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    least = F.min(F.struct("doc", "rep"))["rep"]  # the first by doc_id, as an original mostly is
    buckets = entries.groupBy("key").agg(least.alias("low_rep"), F.count("*").alias("m")).where("m > 1")
    members = materialize(entries.drop("doc").join(buckets.select("key", "low_rep", "m"), "key"), "members")
    links = confirmed(materialize(_distinct(members.select(F.col("rep").alias("a"), F.col("low_rep").alias("b"))), "pairs"), texts, percent)
    if repeats:  # the classes of one document are linked through it
        of = sets.join(repeated, "doc_id", "left_semi").select("doc_id", *SET).distinct().join(classes.select(*SET, "rep"), SET)
        of = materialize(of.select("doc_id", "rep"), "own")
        links = links.union(of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep != b").select(F.col("rep").alias("a"), "b"))
    links = materialize(links, "links")
    labels = components(links)

    # Members with their components; buckets of two have been compared.
    named = members.where("m > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialize(named, "named")
    split = named.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key")
    home = named.where("rep = low_rep").select("key", F.col("component").alias("home"))
    scratch = [members, named]
    named = materialize(named.join(split, "key").join(home, "key"), "split")
    release(*scratch)
    sketches = found.select(*SET, "bands", "low").join(classes.select(*SET, "rep"), SET)
    sketches = materialize(sketches.join(named.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.first("bands").alias("bands"), F.first("low").alias("low")), "sketches")
    full = named.where(F.col("m") <= LARGE).join(sketches, "rep").withColumn("_block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK)))
    member = F.struct("rep", "component", "n", "bands", "low")
    others = full.where("rep != low_rep").groupBy("key", "_block").agg(F.collect_list(member).alias("others"))
    odd = full.where("component != home and rep != low_rep").groupBy("key", F.col("_block").alias("_odd_block")).agg(F.collect_list(member).alias("odd"))
    more = likely(odd.join(others, "key"), percent)
    crowded = named.where(F.col("m") > LARGE).select("rep", "component").distinct()
    if not crowded.isEmpty():
        prefixes = rare_prefixes(crowded, texts.add(texts.named(crowded, "rep"), "rep").select(F.col("rep").alias("doc_id"), F.col("text_rep").alias("text")), percent)
        more = more.union(alike(materialize(_distinct(paired(prefixes, percent)), "pairs"), sketches, percent))
    more = materialize(_distinct(more), "pairs")
    if not more.isEmpty():
        new = confirmed(more, texts, percent)
        labels = components(links.union(new))
    release(named, sketches, links, more)

    # A component goes by its least doc_id.
    linked = materialize(labels.join(classes.select(F.col("rep").alias("node"), "doc"), "node"), "linked")
    linked = linked.join(linked.groupBy("component").agg(F.min("doc").alias("_c")), "component").select(F.col("node").alias("rep"), "_c")
    of_class = classes.select(*SET, "rep", "doc").join(linked, "rep", "left").select(*SET, F.coalesce("_c", "doc").alias("_c"))
    out = found.drop("bands", "low").join(of_class, SET, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows whose document isn't its component's first."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 85)
