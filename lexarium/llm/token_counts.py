"""Token counts under a unigram piece model, by dynamic programming over a trie of words.

The distinct words of a batch go into a trie; a node is a prefix, and its forward score, the best log-probability of
any segmentation of the prefix into pieces, is computed once, from the nodes above it, for all words that share it.
Each node keeps the piece count of its best segmentation, so a word's count is read off its last node. A trie holds at
most NODES nodes, then the next begins; a word of more than LONG characters shares nothing and keeps only the scores of
its last few prefixes. Words between batches are remembered in a bounded table.

Pieces are a public vocabulary's (a path parameter; its files are never trained here). The file at hand ranks its pieces
by merges and has no probabilities, so the model takes the log-probability -log(rank + RANK_OFFSET) of a Zipf law, rank
being the place in the file: counts are this unigram model's, not those of the merge order. A word starts with the word
mark. A character that no piece covers is spelt in byte pieces, at BYTE_LOG for each. Ties: the smaller count wins.

Cases: a null or empty text, or one of white space, has 0 words and 0 tokens; repeated rows and null doc_ids are
counted row by row; an empty table gives an empty result; very long words cost time in proportion to their length;
columns that aren't kept don't matter.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, works_as

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
RANK_OFFSET = 2.7
BYTE_LOG = -25.0
REMEMBERED = 400_000  # words, twice
NODES, LONG = 1 << 20, 1 << 12
SLICE = 1000

_loaded: dict[str, "PieceModel"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class PieceModel:
    """pieces: text -> log-probability."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        # The lengths of the pieces that end in given characters: with any last one, with the last two, with the last three.
        ends: dict[str, set[int]] = {}
        for p in pieces:
            ends.setdefault(p[-3:], set()).add(len(p))
        self.short = tuple(sorted({n for n in map(len, pieces) if n < 3}))
        self.widths = {k: tuple(sorted({*self.short, *v})) for k, v in ends.items() if len(k) == 3}
        self.seen: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        works_as("pieces", _loaded.clear)
        if path not in _loaded:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            usual = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
            _loaded[path] = cls({p: -math.log(k + RANK_OFFSET) for k, p in enumerate(usual)})
        return _loaded[path]

    def _long(self, word: str) -> int:
        """Pieces of one word, by the scores and counts of its last prefixes."""
        text, pieces, longest = MARK + word, self.pieces, self.longest
        last = deque([(0.0, 0)], maxlen=longest)
        for end in range(1, len(text) + 1):
            score, n = last[-1]
            w = len(text[end - 1].encode(errors="replace"))
            best, count = score + BYTE_LOG * w, n + w
            for width in self.widths.get(text[max(0, end - 3) : end], self.short):
                if width <= len(last) and (p := pieces.get(text[end - width : end])) is not None:
                    score, n = last[-width]
                    if score + p > best or (score + p == best and n + 1 < count):
                        best, count = score + p, n + 1
            last.append((best, count))
        return last[-1][1]

    def count_words(self, words: Iterable[str]) -> dict[str, int]:
        """word (without its mark) -> number of pieces, by tries of the distinct words."""
        pieces, widths, short, out = self.pieces, self.widths, self.short, {}
        # Node k: the score and count of its prefix's best segmentation; the root is 0. below: node and character, in one number, to node.
        below: dict[int, int] = {}
        scores, counts = [0.0], [0]
        for word in set(words):
            if len(word) > LONG:
                out[word] = self._long(word)
                continue
            if len(scores) > NODES:
                below.clear()
                del scores[1:], counts[1:]
            text = MARK + word
            node, path = 0, [0]
            for end, c in enumerate(text, 1):
                key = node << 21 | ord(c)
                child = below.get(key)
                if child is None:
                    best, n = scores[node] + BYTE_LOG * (w := len(c.encode(errors="replace"))), counts[node] + w
                    for width in widths.get(text[end - 3 : end], short) if end > 2 else short:
                        if width <= end and (p := pieces.get(text[end - width : end])) is not None:
                            k = path[-width]
                            s = scores[k] + p
                            if s > best or (s == best and counts[k] + 1 < n):
                                best, n = s, counts[k] + 1
                    child = below[key] = len(scores)
                    scores.append(best)
                    counts.append(n)
                node = child
                path.append(node)
            out[word] = counts[node]
        return out

    def count_batch(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Words and pieces of each text."""
        bags = [Counter((t or "").encode(errors="replace").split()) for t in texts]
        known = {}
        for word in set().union(*bags):
            if (n := self.seen.get(word)) is None:
                n = self.older.get(word)
            known[word] = n
        new = [w for w, n in known.items() if n is None]
        found = self.count_words([w.decode() for w in new])
        known |= {w: found[w.decode()] for w in new}
        if len(self.seen) + len(known) > REMEMBERED:
            self.older, self.seen = self.seen, {}
        self.seen |= {w: n for w, n in known.items() if len(w) <= 64}
        return [b.total() for b in bags], [sum(map(mul, b.values(), map(known.__getitem__, b))) for b in bags]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns plus n_words and n_tokens (long)."""
    path = vocabulary or default_path()
    given = docs.select(*[F.col(c).alias(c) for c in keep], F.col("text").alias("_text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.from_file(path)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                words, tokens = model.count_batch(part.column(len(keep)).to_pylist())
                yield pa.record_batch([*part.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_words", "n_tokens"])

    return given.mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
