"""Chroma audio fingerprints: extraction, search and alignment.

A recording's spectrum is folded into twelve pitch classes per frame. Filters of a few shapes (one band against
another, in time, in pitch or both) slide over the frames; each is a difference of box sums, read from an integral
image in four look-ups a box, and is quantised to two bits; SIXTEEN filters pack one 32-bit integer per frame.

Two recordings vote for each offset at which an integer's upper BITS_EQUAL bits agree (an offset histogram), and are
aligned by the offset, of those with MIN_OVERLAP frames in common, at which the least share of bits differs.

The search compares every recording whose id is divisible by 20 with all recordings. Recordings with the same
fingerprint are one class and are compared once. Queries and classes meet in blocks: within a block the classes'
integers are sorted by their upper bits, a query marks the offsets that get a vote, and the bit errors of all marked
offsets are counted together, each until it has too many. Every pair that align() would link is found; no key is dropped for being common (silence,
a held note), and nothing but links leaves a block, however many pairs share a key.

Cases: null, empty or too short audio has an empty fingerprint and matches nothing; a null id is never a query; repeated
rows share a class; ties between matches go to the least bit error, then the least class; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

RATE = 11025
FRAME, HOP = 2048, 512
LOW_HZ, HIGH_HZ = 55.0, 3520.0
CLASSES, WIDTH = 12, 16
BITS_EQUAL = 20
MAX_BIT_ERROR = 0.1
MIN_OVERLAP = WIDTH + 1
#: Queries in a block, frames of its queries and of its classes (on average; a recording isn't cut); offsets that are looked at together.
QUERIES, FRAMES, MARKS = 1024, 1 << 20, 1 << 25


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width): kind 0 compares halves in pitch, 1 halves in time, 2 opposite quarters."""
    out = []
    for k in range(16):
        height = (2, 4, 6, 12)[k % 4]
        out.append((k % 3, (5 * k) % (CLASSES - height + 1), height, (4, 8, 12, 16)[(k // 4 + k) % 4]))
    return out


FILTERS = _filters()


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) pitch-class energies of mono samples, each frame of unit length (all zero for silence)."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    x = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64), FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    note = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % CLASSES
    fold = np.zeros((used.sum(), CLASSES))
    fold[np.arange(len(note)), note] = 1
    out = power[:, used] @ fold
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each position at which the widest filter fits."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    box = lambda t0, t1, p0, p1: image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]
    out = np.zeros(n, dtype=np.uint32)
    for kind, p, height, width in FILTERS:
        ph, th = p + height // 2, width // 2
        if kind == 0:
            a, b = box(0, width, p, ph), box(0, width, ph, p + height)
        elif kind == 1:
            a, b = box(0, th, p, p + height), box(th, width, p, p + height)
        else:
            a, b = box(0, th, p, ph) + box(th, width, ph, p + height), box(0, th, ph, p + height) + box(th, width, p, ph)
        level = (a - b) / np.maximum(a + b, 1e-9)
        q = np.digitize(level, (-0.25, 0.0, 0.25))
        out = (out << np.uint32(2)) | np.array([0, 1, 3, 2], dtype=np.uint32)[q]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset, overlap, bit error) at the best offset of b in a: a[k + offset] stands against b[k]. Every offset with a vote and MIN_OVERLAP frames is tested; without one: (0, 0, 1.0)."""
    ha, hb = a >> np.uint32(32 - BITS_EQUAL), b >> np.uint32(32 - BITS_EQUAL)
    order = np.argsort(ha, kind="stable")
    lo, hi = np.searchsorted(ha[order], hb), np.searchsorted(ha[order], hb, side="right")
    histogram = np.zeros(len(a) + len(b) + 1, dtype=np.int64)
    for k in np.flatnonzero(hi > lo):
        histogram[order[lo[k] : hi[k]] - k + len(b)] += 1
    if not histogram.any():
        return 0, 0, 1.0
    best = (0, 0, 1.0)
    for h in np.flatnonzero(histogram):
        offset = int(h) - len(b)
        first, last = max(0, offset), min(len(a), len(b) + offset)
        if last - first >= MIN_OVERLAP:
            wrong = np.bitwise_count(a[first:last] ^ b[first - offset : last - offset]).sum()
            found = (offset, last - first, float(wrong) / (32 * (last - first)))
            if (found[2], -found[1]) < (best[2], -best[1]):
                best = found
    return best


def extract(audio: DataFrame, id_col: str, media_col: str, rate: int = RATE, decode: Callable[[object], bytes] | None = None) -> DataFrame:
    """id, n_frames, fp: little-endian 16-bit mono PCM to fingerprints (array<bigint>). decode makes PCM of another media column's value; one recording is decoded at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for raw in batch.column(1):
                raw = raw.as_py()
                raw = (decode(raw) if decode else raw) or b""
                fps.append(fingerprint(chroma(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768, rate)).astype(np.int64))
            lists = pa.array([f.tolist() for f in fps], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array([len(f) for f in fps], pa.int64()), lists], names=["id", "n_frames", "fp"])

    return audio.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id bigint, n_frames bigint, fp array<bigint>")


class Classes:
    """Fingerprints that queries are aligned with: flat[starts[k] : starts[k + 1]] is class k. The integers are sorted by their upper bits once."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray):
        self.flat, self.starts, self.sizes = flat, starts, np.diff(starts)
        keys = flat >> np.uint32(32 - BITS_EQUAL)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.back = self.sizes[self.owner] - (order - starts[self.owner])  # a class's length less the place

    def align(self, a: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(k, offset, overlap, bit error) of align(a, b_k) for each class k that it links."""
        n = len(self.sizes)
        if n > 1 and n * len(a) + len(self.flat) > MARKS:  # a very long query: fewer classes at a time
            cut = n // 2
            first, rest = Classes(self.flat[: self.starts[cut]], self.starts[: cut + 1]), Classes(self.flat[self.starts[cut] :], self.starts[cut:] - self.starts[cut])
            return first.align(a) + [(cut + k, *x) for k, *x in rest.align(a)]
        # Offset o of class k has the mark begins[k] + sizes[k] + o.
        span = self.sizes + len(a)
        begins = np.cumsum(span) - span
        hashes = a >> np.uint32(32 - BITS_EQUAL)
        lo, hi = (np.searchsorted(self.keys, hashes, side=x) for x in ("left", "right"))
        marks = np.zeros(int(span.sum()) + 1, dtype=bool)
        for k in np.flatnonzero(hi > lo):
            part = slice(lo[k], hi[k])
            marks[begins[self.owner[part]] + self.back[part] + k] = True
        at = np.flatnonzero(marks)
        which = np.searchsorted(begins, at, side="right") - 1
        offset = at - begins[which] - self.sizes[which]
        left, right = np.maximum(0, offset), np.minimum(len(a), self.sizes[which] + offset)
        keep = right - left >= MIN_OVERLAP
        which, offset, left, right = which[keep], offset[keep], left[keep], right[keep]
        wrong, base, limit = np.zeros(len(which), dtype=np.int64), self.starts[which] - offset, 32 * MAX_BIT_ERROR * (right - left)
        for t in range(len(a)):
            on = np.flatnonzero((left <= t) & (t < right))
            wrong[on] += np.bitwise_count(a[t] ^ self.flat[base[on] + t])
            if t % 8 == 7 and not (able := wrong <= limit).all():  # too many errors already
                which, offset, left, right, wrong, base, limit = (x[able] for x in (which, offset, left, right, wrong, base, limit))
        error = wrong / (32 * np.maximum(1, right - left))
        good = np.flatnonzero(error <= MAX_BIT_ERROR)
        best = good[np.lexsort((offset[good], (left - right)[good], error[good], which[good]))]
        best = best[np.diff(which[best], prepend=-1) > 0]
        return [(int(which[k]), int(offset[k]), int(right[k] - left[k]), float(error[k])) for k in best]


def links(whole: DataFrame) -> DataFrame:
    """q, c, offset, overlap, error: the asked classes and the other classes that align with them. From class_id, asked, n_frames, fp."""
    asked = whole.where("asked = 1").select("class_id", "fp")
    usable = whole.where(F.col("n_frames") >= MIN_OVERLAP)
    n_queries, q_frames, frames = whole.agg(F.count_if(F.col("asked") == 1), *[F.coalesce(F.sum(F.when(c, F.col("n_frames"))), F.lit(0)) for c in (F.col("asked") == 1, F.col("n_frames") >= MIN_OVERLAP)]).first()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERIES), -(-q_frames // FRAMES)), max(1, -(-frames // FRAMES))
    at = lambda n: F.pmod(F.xxhash64("class_id", F.lit(n)), F.lit(n))
    queries = asked.groupBy(at(q_blocks).cast("int").alias("qb")).agg(F.collect_list(F.struct("class_id", "fp")).alias("queries"))
    dealt = usable.select("class_id", "fp", at(c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    classes = dealt.groupBy("qb", "cb").agg(F.collect_list(F.struct("class_id", "fp")).alias("classes"))

    def parts(column: pa.Array, k: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        rows = column[k].values
        fps = rows.field("fp")
        starts = fps.offsets.to_numpy().astype(np.int64)
        return rows.field("class_id").to_pylist(), fps.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].astype(np.uint32), starts - starts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (q_ids, q_flat, q_starts), (c_ids, c_flat, c_starts) = (parts(batch.column(j), k) for j in (0, 1))
                rows, classes = [], Classes(c_flat, c_starts)
                for i, q in enumerate(q_ids):
                    a = q_flat[q_starts[i] : q_starts[i + 1]]
                    if len(a) >= MIN_OVERLAP:
                        rows += [(q, c_ids[j], offset, overlap, error) for j, offset, overlap, error in classes.align(a) if c_ids[j] != q]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "c", "offset", "overlap", "error"])

    return classes.join(queries, "qb").select("queries", "classes").mapInArrow(run, "q bigint, c bigint, offset bigint, overlap bigint, error double")


def search(prints: DataFrame, every: int = 20) -> DataFrame:
    """id, n_frames, class_id (least id with that fingerprint), n_matches (classes that align with this one, itself excluded; for a class with a query member, else null), best_id, best_offset, best_overlap, best_error."""
    prints = materialize(prints, "prints")
    whole = prints.where("n_frames > 0").groupBy("fp").agg(F.min("id").alias("class_id"), F.max((F.pmod("id", F.lit(every)) == 0).cast("int")).alias("asked"))
    whole = materialize(whole.withColumn("n_frames", F.size("fp")), "classes")
    best = links(whole).groupBy("q").agg(F.count("*").alias("n_matches"), F.min(F.struct("error", "c", "offset", "overlap")).alias("b"))
    found = whole.join(best, whole["class_id"] == best["q"], "left")
    found = found.select("fp", "class_id", F.when(F.col("asked") == 1, F.coalesce("n_matches", F.lit(0))).alias("n_matches"), F.col("b.c").alias("best_id"), F.col("b.offset").alias("best_offset"), F.col("b.overlap").alias("best_overlap"), F.col("b.error").alias("best_error"))
    return prints.join(found, "fp", "left").select("id", "n_frames", "class_id", "n_matches", "best_id", "best_offset", "best_overlap", "best_error")


def melody(values: list[float | None] | None, note_frames: int = 2) -> bytes:
    """PCM of an embedding played as a melody, one note per number (semitone by value, two octaves around 440 Hz). The tables hold no audio, so this stands in for a media column."""
    t = np.arange(note_frames * HOP) / RATE
    notes = np.clip(np.round(np.nan_to_num(np.array([v if v is not None else 0.0 for v in values or []], dtype=np.float64)) * 40), -12, 12)
    wave = np.sin(2 * np.pi * (440.0 * 2 ** (notes / 12))[:, None] * t[None, :]).ravel()
    return (wave * 20000).astype("<i2").tobytes()


def op3_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(extract(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", decode=melody))
    return found.withColumnRenamed("id", "vec_id")
