"""Quality classifier by co-training.

Two logistic models see different views of a document: its content (hashed words and shape statistics of the text) and
its page's record (source, language, recorded length; never the text). Each round, each model scores every unlabelled
document and hands those of which it is surest to the other model's training set. Both are then calibrated on held-out
labelled documents (Platt scaling) and their log-odds, less one prior, give the quality of every document.

The fit is bounded where labels come in: LABELLED labelled documents, chosen by hash of doc_id, and PER_ROUND
pseudo-labels a view and round. The driver holds their features (at most DIM values a document), no texts. Candidates
for pseudo-labels are all unlabelled documents, whose features are written once and scored anew in each round.
Scoring covers all documents in one pass without a shuffle.

Labels: null labels don't count; a document labelled both ways counts as low quality. A fourth of each class is held
out; a class with a single document has it in both parts. Without both classes every score is 0.5 and every document
is kept. A null or empty text is scored like any other. Rows with a repeated doc_id are rows of their own, in the fit
too; a null doc_id has no label. Ties go by hash of doc_id, then of the features. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table, release, trim, works_as

LABELLED = 6000
ROUNDS, PER_ROUND, SURE = 3, 400, 0.97
DIM = 1 << 14
N_SHAPE, N_META = 8, 1 << 12
WIDTHS = {"content": DIM + N_SHAPE + 1, "metadata": N_META}
KEEP_FROM = 0.5
SLICE = 512
SEED = 5
_SYMBOLS = re.compile(r"[#*$%&|<>]")


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % DIM
        return value


_hashes = Hashes()


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Column indices and values: hashed words (unit length), then shape statistics, all about within 0 to 1, and a constant."""
    raw = (text or "").encode(errors="replace")
    words = raw.lower().split()
    counts = Counter(map(_hashes.__getitem__, words))
    index = np.fromiter(counts.keys(), np.int32, len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    weight /= max(1e-9, float(np.sqrt((weight**2).sum())))
    n, size = max(1, len(words)), max(1, len(raw))
    stops = sum(raw.count(c) for c in (b".", b"!", b"?"))
    upper = sum(w.isupper() for w in raw.split())
    shape = [
        min(1.0, 10 * len(_SYMBOLS.findall(text or "")) / size), min(1.0, len(raw) / n / 15), len(set(words)) / n, min(1.0, stops / n),
        upper / n, min(1.0, np.log1p(n) / 10), min(1.0, 10 * sum(raw.count(str(d).encode()) for d in range(10)) / size), min(1.0, len(counts) / 20),
    ]
    return np.concatenate([index, np.arange(DIM, DIM + N_SHAPE + 1, dtype=np.int32)]), np.concatenate([weight, shape, [1.0]]).astype(np.float32)


def metadata(source: Column, lang: Column, n_chars: Column) -> Column:
    """array<int>: indicator features of the page's record, a null being a value of its own."""
    size = F.coalesce(F.floor(F.log2(F.greatest(n_chars, F.lit(0)) + 1)).cast("string"), F.lit("none"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("none"))
    tags = [F.lit("all"), F.concat(F.lit("source"), name(source)), F.concat(F.lit("lang"), name(lang)), F.concat(F.lit("size"), size), F.concat(F.lit("source"), name(source), F.lit("\0lang"), name(lang)), F.concat(F.lit("source"), name(source), F.lit("\0size"), size)]
    return F.array(*[(F.crc32(t) % N_META).cast("int") for t in tags])


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def content_rows(texts: list[str | None]) -> Rows:
    """Compressed rows: row starts (one more than rows), column indices, values. No row is empty."""
    parts = [content(t) for t in texts]
    empty = (np.empty(0, np.int32), np.empty(0, np.float32))
    return np.cumsum([0] + [len(i) for i, _ in parts]), *(np.concatenate([p[k] for p in parts] or [empty[k]]) for k in range(2))


def list_rows(index: pa.ListArray, value: pa.ListArray | None = None) -> Rows:
    """Compressed rows of list columns; without values all are 1."""
    starts, flat = index.offsets.to_numpy(), index.values.to_numpy(zero_copy_only=False)
    flat = flat[starts[0] : starts[-1]]
    values = np.ones(len(flat), np.float32) if value is None else value.values.to_numpy(zero_copy_only=False)[value.offsets[0].as_py() : value.offsets[-1].as_py()]
    return starts - starts[0], flat, values


def decide(rows: Rows, weights: np.ndarray) -> np.ndarray:
    starts, index, value = rows
    return np.add.reduceat(value * weights[index], starts[:-1]) if len(starts) > 1 else np.empty(0)


def joined(parts: list[Rows]) -> Rows:
    starts = np.concatenate([[0], *(np.diff(p[0]) for p in parts)]).cumsum()
    return starts, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def picked(rows: Rows, chosen: np.ndarray) -> Rows:
    starts, index, value = rows
    parts = [np.arange(starts[k], starts[k + 1]) for k in chosen]
    flat = np.concatenate(parts) if parts else np.empty(0, int)
    return np.cumsum([0] + [len(p) for p in parts]), index[flat], value[flat]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(rows: Rows, y: np.ndarray, width: int, rounds: int = 120, decay: float = 1e-4) -> np.ndarray:
    """Class-balanced logistic regression by Adam over the whole (bounded) sample."""
    starts, index, value = rows
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for k in range(1, rounds + 1):
        g = np.bincount(index, value * (balance * (sigmoid(decide(rows, w)) - y))[row], width) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 / np.sqrt(k) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) with P(y = 1) = 1 / (1 + exp(-(a z + b))); smoothed targets, a >= 0."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b, scale = 1.0, 0.0, max(1e-6, float(np.std(z)))
    u = z / scale
    for _ in range(400):
        e = sigmoid(a * u + b) - t
        a, b = max(0.0, a - 2 * float((e * u).mean())), b - 2 * float(e.mean())
    return a / scale, b


def held_out(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices to train on and to calibrate on: a fourth of each class, at least one, is held out; a class of one is in both."""
    train, held = [], []
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        n = max(1, len(at) // 4)
        held.append(at[:n])
        train.append(at[n:] if len(at) > 1 else at)
    return np.sort(np.concatenate(train)), np.sort(np.concatenate(held))


class CoTrained:
    """Both views' weights, calibrations and the prior's log-odds; no weights if the labels had one class only."""

    def __init__(self, y: np.ndarray, rows: dict[str, Rows]):
        self.weights: dict[str, np.ndarray] = {}
        self.scale: dict[str, tuple[float, float]] = {}
        self.handed = dict.fromkeys(WIDTHS, 0)
        share = float((y.sum() + 1) / (len(y) + 2))
        self.share, self.prior = share, float(np.log(share / (1 - share)))
        if len(set(y.tolist())) == 2:
            self.learn(y, rows, {v: [] for v in WIDTHS})

    def learn(self, y: np.ndarray, rows: dict[str, Rows], extra: dict[str, list[tuple[np.ndarray, Rows]]]) -> None:
        """Fit both views on the labels and on the (labels, rows) that each has been handed."""
        train, held = held_out(y)
        for v, width in WIDTHS.items():
            target = np.concatenate([y[train], *(e[0] for e in extra[v])])
            self.weights[v] = logistic(joined([picked(rows[v], train), *(e[1] for e in extra[v])]), target, width)
            self.scale[v] = platt(decide(picked(rows[v], held), self.weights[v]), y[held])
            self.handed[v] = sum(len(e[0]) for e in extra[v])

    def score(self, rows: dict[str, Rows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by content, by metadata and by both."""
        if not self.weights:
            half = np.full(len(rows["content"][0]) - 1, 0.5)
            return half, half, half
        odds = {}
        for v, w in self.weights.items():
            a, b = self.scale[v]
            odds[v] = np.clip(a * decide(rows[v], w) + b, -30, 30)
        return sigmoid(odds["content"]), sigmoid(odds["metadata"]), sigmoid(odds["content"] + odds["metadata"] - self.prior)


FEATURES = "doc_id bigint, meta array<int>, index array<int>, value array<float>"


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of all rows (doc_id, text, source, lang, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works_as("quality", _hashes.clear)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                starts, index, value = content_rows(part.column(2).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, t)) for x, t in ((index, pa.int32()), (value, pa.float32()))]
                yield pa.record_batch([part.column(0), part.column(1), *lists], names=["doc_id", "meta", "index", "value"])
            trim()

    meta = metadata(F.col("source"), F.col("lang"), F.col("n_chars"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), meta.alias("meta"), F.col("text").cast("string").alias("text")).mapInArrow(run, FEATURES)


def _views(table: pa.Table | pa.RecordBatch) -> dict[str, Rows]:
    index, value, meta = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table.column("index"), table.column("value"), table.column("meta")))
    return {"content": list_rows(index, value), "metadata": list_rows(meta)}


def _surest(table: DataFrame, labelled: DataFrame, model: CoTrained, given: DataFrame | None) -> DataFrame:
    """rid, view (whose model is sure), label of the PER_ROUND documents, divided between the labels by their shares, of which each view's model is surest, over all unlabelled rows that it hasn't handed over before."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_content, by_metadata, _ = shared.value.score(_views(batch))
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id"), batch.column("tie"), pa.array(by_content, pa.float64()), pa.array(by_metadata, pa.float64())], names=["rid", "doc_id", "tie", "content", "metadata"])

    scored = table.mapInArrow(run, "rid bigint, doc_id bigint, tie bigint, content double, metadata double")
    sure = scored.where(F.greatest("content", 1 - F.col("content"), "metadata", 1 - F.col("metadata")) >= SURE)
    sure = materialize(sure.join(labelled.select("doc_id"), "doc_id", "left_anti"), "sure")
    picks = []
    for view in WIDTHS:
        for label, confidence in ((1, F.col(view)), (0, 1 - F.col(view))):
            free = sure.where(confidence >= SURE)
            if given is not None:
                free = free.join(F.broadcast(given.where(F.col("view") == view).select("rid")), "rid", "left_anti")
            n = max(1, round(PER_ROUND * (model.share if label else 1 - model.share)))
            picks.append(free.orderBy(confidence.desc(), F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "tie").limit(n).select("rid", F.lit(view).alias("view"), F.lit(label).alias("label")))
    out = picks[0]
    for p in picks[1:]:
        out = out.union(p)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """docs: doc_id, text, source, lang, n_chars; labels: doc_id, quality."""
    target = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    tie = F.xxhash64("meta", "index", "value")
    table = materialize(features(docs).select("*", tie.alias("tie"), F.monotonically_increasing_id().alias("rid")), "features")
    chosen = table.select("rid", "doc_id", "tie").join(target, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "tie").limit(LABELLED)
    known = table.drop("doc_id", "tie").join(F.broadcast(chosen), "rid").select("doc_id", "tie", "y", "meta", "index", "value").toArrow().sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    known = known.take(np.random.default_rng(SEED).permutation(known.num_rows))
    y, rows = known.column("y").to_numpy().astype(int), _views(known)
    model = CoTrained(y, rows)
    given: DataFrame | None = None
    extra: dict[str, list[tuple[np.ndarray, Rows]]] = {v: [] for v in WIDTHS}
    for _ in range(ROUNDS if model.weights else 0):
        picks = materialize(_surest(table, target, model, given), "picks")
        got = table.select("rid", "meta", "index", "value").join(F.broadcast(picks), "rid").toArrow().sort_by([("view", "ascending"), ("rid", "ascending")])
        if not got.num_rows:
            break
        given = picks if given is None else given.union(picks)
        for view, other in (("content", "metadata"), ("metadata", "content")):
            part = got.filter(pc.equal(got.column("view"), view))
            if part.num_rows:
                extra[other].append((part.column("label").to_numpy().astype(int), _views(part)[other]))
        model.learn(y, rows, extra)
    release(table)
    del known, y, rows, extra
    trim()
    pa.default_memory_pool().release_unused()  # the driver's part; later stages run beside it
    return model


def score(docs: DataFrame, model: CoTrained, least: float | None = None) -> DataFrame:
    """_row (docs' columns) and scores (struct of p_content, p_metadata, quality) of all rows, or of those with that quality or more. A row goes through Python once; its text isn't sent again."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.struct("*").alias("_row"), metadata(F.col("source"), F.col("lang"), F.col("n_chars")).alias("meta"))
    kinds = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_content", "p_metadata", "quality")])
    schema = T.StructType([given.schema["_row"], T.StructField("scores", kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works_as("quality", _hashes.clear)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                rows = {"content": content_rows(pc.struct_field(part.column(0), "text").to_pylist()), "metadata": list_rows(part.column(1))}
                found = [pa.array(x, pa.float64()) for x in shared.value.score(rows)]
                out = pa.record_batch([part.column(0), pa.StructArray.from_arrays(found, names=kinds.names)], names=schema.names)
                yield out if least is None else out.filter(pc.greater_equal(found[2], least))
            trim()

    return given.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose quality is under KEEP_FROM."""
    model = fit(docs.select("doc_id", "text", "source", "lang", "n_chars"), labels)
    return score(docs, model, KEEP_FROM).select("_row.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select("_row.doc_id", "scores.*", (F.col("scores.quality") >= KEEP_FROM).alias("kept"))
