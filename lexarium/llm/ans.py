"""Token-id files coded with static range asymmetric numeral systems.

A file is a segment. It holds whole documents in ascending order: one frequency table that its blocks share, then
independent blocks of BLOCK ids. In a block, LANES coder states take turns (id k belongs to lane k mod LANES), and each
state spills 32-bit words into one stream, so both directions work on whole vectors. The directory lists each block's
offset in the payload and the checksum of its ids: the checkpoints from which blocks can be decoded alone or in
parallel.

Layout, little-endian: magic "LXA2", u32 header length, header (zlib: u32 part, u32 segment, u32 counts of documents,
ids, symbols, blocks; symbols u32; frequencies u32; block offsets u64, one more than blocks; block CRCs u32; document
lengths u32; doc_ids i64), then the payload, by block: states u64 x LANES, words u32; last a line feed.

`encode_documents` range-partitions by doc_id and encodes each partition's segments as they fill; `write_files` lets
Spark's text writer put each segment's bytes into a file of its own, wherever Spark can write, with Spark's commit
protocol if a task is lost; `read_files` reads them as binary files. Segments are bounded by SEGMENT_IDS and the longest
document. Order and ties: null doc_ids come first; rows with the same doc_id go by the hash of their text, then by text,
and are split between partitions where many share one. A null or empty text is its end id alone; repeated rows stay, one
after the other; an empty table gives no segment; other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, scratch
from .tokens import default_path, encoder

MAGIC = b"LXA2"
SCALE = 18  # the frequencies of a segment add up to 2^SCALE, more than any vocabulary here
BLOCK, LANES = 1 << 19, 1 << 12
LOW = np.uint64(1 << 31)
END_ID = 0
SEGMENT_IDS = 1 << 22
NO_ID = -(1 << 63)  # stands for a null doc_id
SEGMENTS = "part int, segment int, data binary"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2^SCALE, in proportion to counts (all positive)."""
    total = 1 << SCALE
    f = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    while (gap := total - int(f.sum())) != 0:
        order = np.argsort(-f, kind="stable")
        if gap > 0:
            f[order[: min(gap, len(f))]] += 1 if gap < len(f) else gap // len(f)
        else:
            able = order[f[order] > 1][: -gap]
            f[able] -= 1
    return f


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """ids: indices into freq and start. The last, short row of lanes is coded first."""
    n = len(ids)
    state = np.full(LANES, LOW, dtype=np.uint64)
    shift, scale, words = np.uint64(32), np.uint64(SCALE), []
    top = LOW >> scale << shift
    for at in range((n - 1) // LANES * LANES, -1, -LANES):
        s = ids[at : at + LANES]
        x, f = state[: len(s)], freq[s]
        full = x >= top * f
        if full.any():
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> shift, x)
        q = x // f
        state[: len(s)] = (q << scale) + (x - q * f) + start[s]
    return state.tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """slots: for each of the 2^SCALE positions its symbol's index."""
    state = np.frombuffer(data, np.uint64, LANES).copy()
    words = np.frombuffer(data, np.uint32, offset=8 * LANES).astype(np.uint64)
    shift, scale, mask, used = np.uint64(32), np.uint64(SCALE), np.uint64((1 << SCALE) - 1), 0
    out = np.empty(n, dtype=np.int32)
    for at in range(0, n, LANES):
        x = state[: min(LANES, n - at)]
        low = x & mask
        s = slots[low]
        out[at : at + LANES] = s
        x = freq[s] * (x >> scale) + low - start[s]
        need = x < LOW
        if k := int(need.sum()):
            if used + k > len(words):
                raise ValueError("a block's words end early")
            x[need] = (x[need] << shift) | words[used : used + k]
            used += k
        state[: len(x)] = x
    if used != len(words) or (state != LOW).any():
        raise ValueError("a block's states don't end where they began")
    return out


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, increasing; each id's place among them; their counts. Ids of a vocabulary are counted, others sorted."""
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    places = np.zeros(len(counts), dtype=np.int32)
    places[symbols] = np.arange(len(symbols))
    return symbols, places[ids], counts[symbols]


def encode_segment(docs: list[np.ndarray], doc_ids: list[int] | None = None, part: int = 0, segment: int = 0) -> bytes:
    """docs: each one's ids, none empty; doc_ids: 0, 1, ... if not given."""
    ids = np.concatenate(docs).astype(np.uint32)
    symbols, index, counts = distinct(ids)
    if len(symbols) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} symbols")
    freq = scaled(counts).astype(np.uint64)
    start = np.cumsum(freq) - freq
    begins = range(0, len(ids), BLOCK)
    blocks = [encode_block(index[k : k + BLOCK], freq, start) for k in begins]
    arrays = [
        symbols.astype("<u4"), freq.astype("<u4"), np.cumsum([0] + [len(b) for b in blocks]).astype("<u8"),
        np.array([zlib.crc32(ids[k : k + BLOCK].astype("<u4").tobytes()) for k in begins], dtype="<u4"),
        np.array([len(d) for d in docs], dtype="<u4"), np.array(range(len(docs)) if doc_ids is None else doc_ids, dtype="<i8"),
    ]
    header = struct.pack("<6I", part, segment, len(docs), len(ids), len(symbols), len(blocks)) + b"".join(a.tobytes() for a in arrays)
    packed = zlib.compress(header, 6)
    return MAGIC + struct.pack("<I", len(packed)) + packed + b"".join(blocks)


class Segment:
    """Reads a segment; block(k) decodes one block on its own and checks it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token-id segment")
        (n,) = struct.unpack_from("<I", data, 4)
        header = zlib.decompress(data[8 : 8 + n])
        self.part, self.segment, n_docs, self.n_ids, k, n_blocks = struct.unpack_from("<6I", header)
        at = 24
        parts = []
        for count, kind in ((k, "<u4"), (k, "<u4"), (n_blocks + 1, "<u8"), (n_blocks, "<u4"), (n_docs, "<u4"), (n_docs, "<i8")):
            parts.append(np.frombuffer(header, kind, count, at))
            at += parts[-1].nbytes
        self.symbols, freq, self.offsets, self.crcs, self.lengths, self.doc_ids = parts
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(k, dtype=np.int32), freq)
        self.data, self.payload = data, 8 + n

    def block(self, k: int) -> np.ndarray:
        part = self.data[self.payload + int(self.offsets[k]) : self.payload + int(self.offsets[k + 1])]
        ids = self.symbols[decode_block(part, min(BLOCK, self.n_ids - k * BLOCK), self.freq, self.start, self.slots)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crcs[k]:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> list[np.ndarray]:
        ids = np.concatenate([self.block(k) for k in range(len(self.crcs))])
        return np.split(ids, np.cumsum(self.lengths)[:-1])


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """SEGMENTS rows: by part, then segment, the documents are in order."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, number = encoder(path), TaskContext.get().partitionId(), 0
        ids, docs, total = [], [], 0
        end = end_id.to_bytes(4, "little")

        def flush():
            nonlocal ids, docs, total, number
            data = encode_segment(ids, docs, part, number)
            ids, docs, total, number = [], [], 0, number + 1
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([number - 1], pa.int32()), pa.array([data], pa.binary())], names=["part", "segment", "data"])

        for batch in batches:
            for doc, coded in zip(batch.column(0).to_pylist(), e.encode_all(t.as_py() for t in batch.column(1)), strict=True):
                ids.append(np.frombuffer(coded + end, dtype="<u4"))
                docs.append(NO_ID if doc is None else doc)
                total += len(ids[-1])
                if total >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return slim.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").mapInArrow(run, SEGMENTS)


def write_files(segments: DataFrame, path: str) -> None:
    """One file a segment in the folder: the bytes as they are, and the line feed that ends a file."""
    segments.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A row (data) for each file of the folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("content").alias("data"))


def decode_documents(files: DataFrame) -> DataFrame:
    """doc_id, part, segment, before (ids of the segment's earlier documents), n_tokens, ids_crc32 from rows with data."""
    schema = "doc_id bigint, part int, segment int, before bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if not (raw := data.as_py()):  # an empty partition's file
                    continue
                s = Segment(raw)
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in s.documents()]
                lengths, n = s.lengths.astype(np.int64), len(s.lengths)
                cols = [
                    pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NO_ID), pa.array(np.full(n, s.part), pa.int32()), pa.array(np.full(n, s.segment), pa.int32()),
                    pa.array(np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                ]
                yield pa.record_batch(cols, names=[x.split()[0] for x in schema.split(", ")])

    return files.select("data").mapInArrow(run, schema)


def with_starts(decoded: DataFrame) -> DataFrame:
    """decoded plus start, the number of ids before the document in the whole collection: sums by segment within a part, then over the parts (one row for each)."""
    seg = decoded.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n_ids"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = seg.withColumn("_in", F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("segment"))), F.lit(0)))
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("_out"))
    at = inside.join(parts, "part").select("part", "segment", (F.col("_in") + F.col("_out")).alias("_at"))
    return decoded.join(at, ["part", "segment"]).withColumn("start", F.col("_at") + F.col("before")).drop("_at", "before")


def op5_ans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ans")
    write_files(encode_documents(read_table(spark, sf_dir, "documents")), path)
    out = with_starts(materialize(decode_documents(read_files(spark, path)), "decoded"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "segment")
