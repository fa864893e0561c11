"""Order-preserving packing of documents into sequences by dynamic programming.

The token stream of a run of documents may be cut at document ends, sentence ends and, where a sentence is longer
than a sequence, inside it. With f(j) the least cost of cutting the stream up to j,

    f(j) = penalty(j) + S + min( min over i >= j - L of f(i) + L - (j - i),  min over k of f(j - 2^k) )

(a sequence whose length is a power of two isn't padded; S is what a sequence costs in itself, so that short ones don't
win by that alone). The first minimum is one of f(i) + i over a sliding
window, kept in a monotone queue, so each cut is pushed and popped once.

Each input partition packs its documents on its own, in runs of at least RUN_TOKENS, so memory is bounded by a run
and the longest document, nothing is shuffled, and a lost task is simply run again. Cases: a null or empty text is
its end id alone; repeated rows are packed row by row; null doc_ids are kept; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .tokens import CACHE, CHUNK, default_path, encoder

LENGTH = 2048
END_ID = 1
RUN_TOKENS = 1 << 20
#: Cost of a cut in padding tokens: at a document's end, at a sentence's end, within a sentence.
PENALTIES = (0, 4, 64)
#: Cost of a sequence in padding tokens.
SEQUENCE_COST = 64
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cuts(ends: list[int], soft: list[int] | np.ndarray, length: int = LENGTH, penalties: tuple[int, int, int] = PENALTIES, sequence_cost: int = SEQUENCE_COST) -> list[int]:
    """The cheapest cut positions of a stream, its end included. ends: document ends, increasing, the last the stream's length; soft: sentence ends."""
    price = np.full(ends[-1] + 1, -1, dtype=np.int64)
    price[soft] = penalties[1]
    price[ends] = penalties[0]
    points = np.flatnonzero(price >= 0)
    gaps = np.diff(points, prepend=0)
    for p, gap in zip(points[gaps > length].tolist(), gaps[gaps > length].tolist(), strict=True):
        price[p - gap + length : p : length] = penalties[2]
    price[0] = 0
    points = np.flatnonzero(price >= 0)[1:]
    reach = np.zeros(len(points), dtype=np.int64)  # the sum of the powers of two that lead back to a point
    for w in (1 << k for k in range(length.bit_length()) if 1 << k <= length):
        far = int(np.searchsorted(points, w))
        reach[far:] += w * (price[points[far:] - w] >= 0)
    cost, back = {0: 0}, {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + i, i), increasing
    for p, penalty, powers in zip(points.tolist(), price[points].tolist(), reach.tolist(), strict=True):
        while queue[0][1] < p - length:
            queue.popleft()
        key, start = queue[0]
        best = key + length - p
        while powers:
            w = powers & -powers
            if (c := cost[p - w]) < best:
                best, start = c, p - w
            powers -= w
        best += penalty + sequence_cost
        cost[p], back[p] = best, start
        while queue and queue[-1][0] >= best + p:
            queue.pop()
        queue.append((best + p, p))
    out, p = [], ends[-1]
    while p:
        out.append(p)
        p = back[p]
    return out[::-1]


def pack_run(docs: list[tuple[int | None, np.ndarray]], closing: np.ndarray, first_sequence: int) -> tuple[dict[str, list], int]:
    """Columns of SCHEMA for the pieces of these documents, and the next sequence's id. closing[id]: the token closes a sentence."""
    sizes = [len(ids) for _, ids in docs]
    stream, ends = np.concatenate([ids for _, ids in docs]), np.cumsum(sizes).tolist()
    found = cuts(ends, np.flatnonzero(closing[stream]) + 1)
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    raw, d, begin, seq = memoryview(stream.astype("<u4").tobytes()), 0, 0, first_sequence
    for cut in found:
        at = begin
        while at < cut:
            upto = min(cut, ends[d])
            row = (docs[d][0], at - (ends[d] - sizes[d]), upto - at, zlib.crc32(raw[4 * at : 4 * upto]), sizes[d], seq, at - begin)
            for column, v in zip(out.values(), row, strict=True):
                column.append(v)
            at = upto
            d += at == ends[d]
        begin, seq = cut, seq + 1
    return out, seq


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE, chunk: int = CHUNK) -> DataFrame:
    """One row per piece, see SCHEMA. cache, chunk: the encoder's bounds, which trade memory for time. sequence_id: the partition's number times 2^33 plus the sequence's number within it."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, cache, chunk)
        closing = np.zeros(e.tokenizer.get_vocab_size() + 1, dtype=bool)
        for piece, k in e.tokenizer.get_vocab().items():
            closing[k] = piece[-1:] in ".!?" or piece.startswith("Ċ")
        seq = TaskContext.get().partitionId() << 33
        waiting, total = [], 0
        schema = pa.schema([(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])
        end = END_ID.to_bytes(4, "little")

        def flush():
            nonlocal waiting, total, seq
            columns, seq = pack_run(waiting, closing, seq)
            waiting, total = [], 0
            return pa.record_batch(list(columns.values()), schema=schema)

        for batch in batches:
            for doc, coded in zip(batch.column(0).to_pylist(), e.encode_all(t.as_py() for t in batch.column(1)), strict=True):
                ids = np.frombuffer(coded + end, dtype="<u4")
                waiting.append((doc, ids))
                total += len(ids)
                if total >= RUN_TOKENS:
                    yield flush()
        if waiting:
            yield flush()

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
