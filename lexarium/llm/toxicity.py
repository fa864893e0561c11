"""Toxicity by a convolutional text classifier, trained in numpy.

A text is its words, lower-cased runs of letters and numbers. A word's vector is the sum of hashed embeddings of the
word and of its first four, five, six and eight bytes, so that unseen forms of a seen stem are near it. Filters over one, two
and three words slide over the whole text; each filter's greatest response (max pooling) is rectified and enters a
linear score. Buckets that no training text touches are zero, as are the places around a text.

Thresholds differ by language: the language is guessed from the words (naive Bayes over their buckets, learned from the
same sample), and each language's offset is fitted on held-back labelled texts, drawn towards the common one by a weight
of PRIOR_WEIGHT texts. The offset is inside the score, so that 0.5 is every language's threshold.

Fitted on a bounded sample: PER_CLASS documents a label, the first by hash of doc_id among the training rows, and of
these as many, in that order, as have MOST_CHARS characters together (the first of each label always). Texts are never
cut. Scoring takes all documents in one pass without a shuffle; long ones pass through in pieces of STREAM words.

A null label or doc_id doesn't count; a document labelled both ways is toxic. A repeated doc_id trains with one of its
texts, the one of least hash. A null or empty text has no word and is scored like any other. Without labels of both
kinds every score is (toxic + 1) / (all + 3). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, release, trim

PER_CLASS, MOST_CHARS = 2500, 40_000_000
BUCKETS, DIM, FILTERS = 1 << 18, 16, 12
STEMS, LONG = (4, 5, 6, 8), 64
SPANS = (1, 2, 3)
#: One column a filter and place of its span.
COLUMNS = FILTERS * sum(SPANS)
EPOCHS, LEAST_STEPS, BATCH = 8, 600, 32
LEAST_TEXTS, DROPPED, HELD_BACK, PRIOR_WEIGHT = 3, 0.3, 4, 40.0
SLICE, STREAM = 256, 1 << 16
SEED = 11
NOT_WORD = r"[^\pL\pN]+"


def bucket_ids(words: pa.Array) -> np.ndarray:
    """int32[n, 1 + len(STEMS)]: buckets from 1 of words (large strings) and of their stems; 0 for the empty word and for stems as long as the word. FNV-1a, a byte of every word at a time; what lies beyond LONG bytes enters as its CRC."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start, size = ends[:-1], np.diff(ends)
    h, out = np.full(len(words), 0xCBF29CE484222325, np.uint64), np.zeros((len(words), 1 + len(STEMS)), np.int32)
    mixed = lambda x, salt: (1 + ((x ^ (x >> np.uint64(29))) + np.uint64(salt * 7919)) % np.uint64(BUCKETS - 1)).astype(np.int32)
    left = np.flatnonzero(size > 0)
    for j in range(LONG):
        if not len(left):
            break
        h[left] = (h[left] ^ data[start[left] + j]) * np.uint64(0x100000001B3)
        left = left[size[left] > j + 1]
        if j + 1 in STEMS:
            out[left, 1 + STEMS.index(j + 1)] = mixed(h[left], j + 1)
    for k in left:
        h[k] ^= np.uint64(zlib.crc32(data[start[k] + LONG : ends[k + 1]]))
    some = size > 0
    out[some, 0] = mixed(h[some], 0)
    return out


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts of texts (one more than texts), each word's place among the distinct words, distinct words. A text without a word has one empty word."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NOT_WORD)
    starts, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    return starts - starts[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


@dataclass
class Model:
    """Embeddings, filters (a column a filter and place), their offsets, output weights, languages and their offsets."""

    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    words_by_lang: np.ndarray
    scale: float
    offsets: np.ndarray

    def vectors(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = bucket_ids(words)
        return self.embed[ids].sum(axis=1), self.words_by_lang[ids[:, 0]]

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score before the offsets, language's place) of each text."""
        starts, codes, words = split_words(texts)
        if not len(texts):
            return np.empty(0), np.empty(0, int)
        vectors, by_lang = self.vectors(words)
        most = np.full((len(texts), FILTERS * len(SPANS)), -np.inf, np.float32)
        langs = np.zeros((len(texts), by_lang.shape[1]))
        vectors = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
        reach = max(SPANS) - 1
        stream = np.full(len(codes) + reach * len(texts), len(words), np.int64)  # zeros stand around every text
        first = starts[:-1] + reach * np.arange(len(texts))
        stream[np.arange(len(codes)) + reach * np.repeat(np.arange(len(texts)), np.diff(starts))] = codes
        last = first + np.diff(starts)
        for at in range(0, len(stream), STREAM):
            part = stream[at : at + STREAM + reach]
            here = np.flatnonzero((last > at) & (first < at + STREAM))
            if not len(here):
                continue
            found = responses(vectors[part], self.filters, min(STREAM, len(stream) - at))
            cuts = np.stack([np.maximum(first[here], at) - at, np.minimum(last[here], at + len(found)) - at], axis=1).ravel()
            cuts = cuts if cuts[-1] < len(found) else cuts[:-1]
            most[here] = np.maximum(most[here], np.maximum.reduceat(found, cuts, axis=0)[::2])
        sums = np.add.reduceat(by_lang[codes], starts[:-1], axis=0)
        langs += sums
        return np.maximum(most + self.shift, 0) @ self.out + self.bias, langs.argmax(axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        z, lang = self.judge(texts)
        return sigmoid(self.scale * z + self.offsets[lang])


def responses(x: np.ndarray, filters: np.ndarray, n: int) -> np.ndarray:
    """float32[n, filters] of the filters that begin at each of the first n places of x; beyond its end are zeros."""
    if len(x) < n + max(SPANS) - 1:
        x = np.vstack([x, np.zeros((n + max(SPANS) - 1 - len(x), DIM), np.float32)])
    flat, out, at = x @ filters, [], 0
    for span in SPANS:
        total = flat[:n, at : at + FILTERS].copy()
        for j in range(1, span):
            total += flat[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
        out.append(total)
        at += span * FILTERS
    return np.hstack(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps for one array; with rows, for those rows only."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.v, self.k = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.k += 1
        m, v = 0.9 * self.m[rows] + 0.1 * g, 0.99 * self.v[rows] + 0.01 * g * g
        self.m[rows], self.v[rows] = m, v
        self.value[rows] -= (self.rate * m / (np.sqrt(v) + 1e-6)).astype(self.value.dtype)


def learn(starts: np.ndarray, codes: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """embed, filters, shift, out, bias fitted to texts (words codes[starts[k]:starts[k + 1]] with buckets ids) and labels. Both classes weigh alike."""
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    seen = np.zeros(BUCKETS, np.int32)
    for a, b in zip(starts, starts[1:], strict=False):
        seen[np.unique(ids[np.unique(codes[a:b])])] += 1
    rare = seen < LEAST_TEXTS
    embed[rare] = 0
    embed[0] = 0
    ids = np.where(rare[ids], 0, ids)
    filters = rng.normal(0, 0.5 / np.sqrt(DIM), (DIM, COLUMNS)).astype(np.float32)
    shift, out, bias = np.zeros(FILTERS * len(SPANS), np.float32), rng.normal(0, 0.3, FILTERS * len(SPANS)).astype(np.float32), np.zeros(1, np.float32)
    steps = {"embed": Adam(embed, 0.02), "filters": Adam(filters, 0.01), "shift": Adam(shift, 0.01), "out": Adam(out, 0.01), "bias": Adam(bias, 0.01)}
    ids = np.vstack([ids, np.zeros((1, ids.shape[1]), np.int32)])  # the last word is none
    reach, none = max(SPANS) - 1, len(ids) - 1
    by_class = [np.flatnonzero(y == k) for k in (0, 1)]
    n_steps = max(LEAST_STEPS, EPOCHS * len(y) // BATCH)
    column = np.concatenate([np.arange(FILTERS) + FILTERS * sum(SPANS[:k]) for k in range(len(SPANS))])
    span = np.repeat(SPANS, FILTERS)
    for k in range(n_steps):
        chosen = np.concatenate([rng.choice(at, BATCH // 2) for at in by_class])
        target = y[chosen]
        tokens = [np.concatenate([codes[starts[d] : starts[d + 1]], np.full(reach, none)]) for d in chosen]
        begins = np.cumsum([0] + [len(t) for t in tokens])
        stream = np.where(rng.random(begins[-1]) < DROPPED, none, np.concatenate(tokens))
        x = embed[ids[stream]].sum(axis=1)
        found = responses(x, filters, len(stream))
        best = np.stack([b + found[b : e - reach].argmax(axis=0) for b, e in zip(begins, begins[1:], strict=False)])
        pooled = np.take_along_axis(found, best, axis=0) + shift
        active = np.maximum(pooled, 0)
        error = (sigmoid(active @ out + bias[0]) - target) / BATCH
        g_pooled = error[:, None] * out * (pooled > 0)
        g_filters, rows, grads = np.zeros_like(filters), [], []
        for j in range(reach + 1):
            use = np.flatnonzero(span > j)
            at, cols = best[:, use] + j, column[use] + j * FILTERS
            at_x = x[at]
            g = g_pooled[:, use]
            g_filters[:, cols] += np.einsum("nf,nfd->df", g, at_x)
            grads.append((g[:, :, None] * filters[:, cols].T).reshape(-1, DIM))
            rows.append(stream[at].ravel())
        word, place = np.unique(np.concatenate(rows), return_inverse=True)
        by_word = np.zeros((len(word), DIM), np.float32)
        np.add.at(by_word, place, np.concatenate(grads))
        bucket, place = np.unique(ids[word].ravel(), return_inverse=True)
        by_bucket = np.zeros((len(bucket), DIM), np.float32)
        np.add.at(by_bucket, place, np.repeat(by_word, ids.shape[1], axis=0))
        real = bucket > 0
        rate = min(1.0, 2 * (1 - k / n_steps))
        for name, g, which in (("embed", by_bucket[real], bucket[real]), ("filters", g_filters, slice(None)), ("shift", g_pooled.sum(axis=0), slice(None)), ("out", active.T @ error, slice(None)), ("bias", np.array([error.sum()]), slice(None))):
            steps[name].rate = rate * (0.02 if name == "embed" else 0.01)
            steps[name].step(g.astype(np.float32), which)
    return embed, filters, shift, out, float(bias[0])


def learn_languages(starts: np.ndarray, codes: np.ndarray, ids: np.ndarray, langs: list[str | None]) -> np.ndarray:
    """float32[BUCKETS, languages]: log share of each word bucket in each language; a single column without languages."""
    names = sorted({x for x in langs if x is not None}) or [None]
    counts = np.full((BUCKETS, len(names)), 0.5)
    for k, lang in enumerate(langs):
        if lang in names:
            np.add.at(counts[:, names.index(lang)], ids[codes[starts[k] : starts[k + 1]], 0], 1)
    counts[0] = 1  # the empty word tells nothing
    out = np.log(counts / counts.sum(axis=0))
    out[0] = 0
    return out.astype(np.float32)


def calibrate(z: np.ndarray, lang: np.ndarray, y: np.ndarray, n_langs: int, share: float) -> tuple[float, np.ndarray]:
    """(scale, offsets by language) by weighted logistic regression; classes weigh as the share of toxic labels says, offsets are drawn to their common value."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    weight, spread = weight * len(y) / weight.sum(), max(1e-6, float(np.std(z)))
    u, target = z / spread, np.where(y == 1, 1 - 1 / (len(y) + 2), 1 / (len(y) + 2))
    a, common, own = 1.0, float(np.log(share / (1 - share))), np.zeros(n_langs)
    for k in range(2000):
        e = weight * (sigmoid(a * u + common + own[lang]) - target)
        rate = 2.0 / (1 + k / 500)
        a = max(1e-3, a - rate * (float((e * u).mean()) + 1e-4 * a))
        common -= rate * float(e.mean())
        by_lang = np.bincount(lang, weights=e, minlength=n_langs)
        own -= rate * (by_lang + own * PRIOR_WEIGHT / 100) / len(y)
    return a / spread, common + own


def constant(share: float) -> Model:
    """Scores every text alike."""
    zero = lambda *shape: np.zeros(shape, np.float32)
    return Model(zero(BUCKETS, DIM), zero(DIM, COLUMNS), zero(FILTERS * len(SPANS)), zero(FILTERS * len(SPANS)), 0.0, zero(BUCKETS, 1), 1.0, np.array([np.log(share / (1 - share))]))


def train(texts: pa.Array, y: np.ndarray, langs: list[str | None], share: float) -> Model:
    """A model of the sample; every HELD_BACK-th text of each class (at least one; a lone one is in both parts) calibrates."""
    back = np.zeros(len(y), bool)
    for label in (0, 1):
        back[np.flatnonzero(y == label)[::HELD_BACK]] = True
    used = ~back
    for label in (0, 1):
        if not (used & (y == label)).any():
            used |= y == label
    starts, codes, words = split_words(texts)
    ids = bucket_ids(words)
    kept = np.flatnonzero(used)
    inner = np.cumsum([0, *(starts[k + 1] - starts[k] for k in kept)])
    inner_codes = np.concatenate([codes[starts[k] : starts[k + 1]] for k in kept])
    present, inner_codes = np.unique(inner_codes, return_inverse=True)
    by_lang = learn_languages(inner, inner_codes, ids[present], [langs[k] for k in kept])
    model = Model(*learn(inner, inner_codes, ids[present], y[kept]), by_lang, 1.0, np.zeros(by_lang.shape[1]))
    held = pa.array(back)
    z, lang = model.judge(texts.filter(held))
    model.scale, model.offsets = calibrate(z, lang, y[back], by_lang.shape[1], share)
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text, lang; labels: doc_id, toxic, of which those held out are passed over."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    first = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (count.get(1, 0) + 1) / (sum(count.values()) + 3)
    chosen = known.where("y = 0").orderBy(*first).limit(PER_CLASS).unionByName(known.where("y = 1").orderBy(*first).limit(PER_CLASS))
    text = F.struct(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").join(F.broadcast(chosen), "doc_id")  # 2 * PER_CLASS rows
    sample = materialize(texts.groupBy("doc_id", "y").agg(F.min_by(text, F.xxhash64("text")).alias("t")).select("doc_id", "y", "t.*"), "labelled")
    sizes = sample.select("doc_id", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n"), first[0].alias("h")).toPandas().sort_values(["h", "doc_id"])
    within = (sizes.n.cumsum() <= MOST_CHARS) | ~sizes.duplicated("y")
    held = sample.where(F.col("doc_id").isin([int(x) for x in sizes[within].doc_id])) if not within.all() else sample
    table = held.select("doc_id", "y", "text", "lang").toArrow().sort_by("doc_id")
    release(sample)
    y = table.column("y").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return constant(share)
    order = np.random.default_rng(SEED).permutation(len(y))
    table = table.take(order)
    return train(table.column("text").combine_chunks(), y[order], table.column("lang").to_pylist(), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of all rows (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                yield pa.record_batch([part.column(0), pa.array(shared.value.score(part.column(1)), pa.float64())], names=["doc_id", "score"])
            trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
