"""Token ids of whole texts by a public tokenizer file, with the work for repeated words done once per worker."""

from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import trim, works_as

TOKENIZER = "byte_bpe_50k.json"
#: A text falls into units at single spaces between characters that aren't white space: no pre-token crosses there.
_SPACES = [c for c in map(chr, range(1 << 14)) if c.isspace() and c != " "]
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: The pre-tokenizer's pattern of byte-level BPE files (a fixed value).
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single line feed between such stretches is a pre-token of its own.
_SOLID = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}\p{M}]+")
_PLAIN = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}\p{M} \n]+")
CACHE, CHUNK = 600_000, 8_000_000

_loaded: dict[tuple[str, int, int], "Encoder"] = {}


class Cache(dict):
    """key -> compute(key), kept in two generations of at most limit keys, so that frequent keys outlive rare ones."""

    def __init__(self, compute: Callable[[str], bytes], limit: int, longest: int):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if (out := self.older.get(key)) is None:
            out = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """encode(texts) -> the ids of each text as little-endian unsigned 32-bit bytes, without added special tokens.

    Units are looked up in a bounded cache; missing ones go to the tokenizers library. A unit of an ordinary kind is
    cut at a line feed and into pre-tokens, whose ids are again kept; any other unit is encoded by the library as it
    stands, and a text that may hold a special token's string is encoded whole.
    """

    def __init__(self, path: str, cache: int = CACHE, chunk: int = CHUNK):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk = chunk
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.units, self.pieces = Cache(self._unit, cache, 64), Cache(self._piece, cache // 4, 200)
        self.starts = Cache(self._start, cache // 4, 64)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.space = chr(256 + hidden.index(32))
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if len(piece) > self.pieces.longest:
            return self._whole(piece)
        shown = self.space + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalpha() else piece.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit that follows a space, and of that space."""
        word = unit.rstrip(punctuation)
        if word.isalpha():
            return self._piece(" " + unit) if len(word) == len(unit) else self.units[word] + self.pieces[unit[len(word) :]]
        line, newline, rest = unit.partition("\n")
        if newline and _SOLID.fullmatch(line) and _SOLID.fullmatch(rest):
            return self.units[line] + self.pieces[newline] + self.starts[rest]
        return self._start(" " + unit)

    def _start(self, unit: str) -> bytes:
        word = unit.rstrip(punctuation)
        if word.isalpha():
            return self._piece(unit) if len(word) == len(unit) else self.starts[word] + self.pieces[unit[len(word) :]]
        if _PLAIN.fullmatch(unit):
            return b"".join(map(self.pieces.__getitem__, _PRE.findall(unit)))
        return self._whole(unit)

    @staticmethod
    def _usual(text: str) -> bool:
        """The text has no special token's string, and its white space next to a space is no other white space or text edge."""
        if "<|" in text or "  " in text or text[0].isspace() or text[-1].isspace():
            return False
        return not any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._whole(text)
        first, *units = text.split(" ") if self._usual(text) else _SPLIT.split(text)
        return self.starts[first] + b"".join(map(self.units.__getitem__, units))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode() of each text, in order. About chunk characters go together, so that a unit is looked up once for all of them."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text or "")
            if size >= self.chunk:
                yield from self._encode_chunk(waiting)
                waiting, size = [], 0
                trim()
        if waiting:
            yield from self._encode_chunk(waiting)

    def _encode_chunk(self, texts: list[str | None]) -> Iterator[bytes]:
        usual = [bool(t) and self._usual(t) for t in texts]
        cut = pc.split_pattern(pa.array([t for t, u in zip(texts, usual, strict=True) if u], pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        collects = gc.isenabled()
        gc.disable()  # the many small objects made here hold no cycles
        try:
            found = [self.units[u] for u in coded.dictionary.to_pylist()]
        finally:
            if collects:
                gc.enable()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        lengths = sizes[which]
        lengths[bounds[:-1]] = 0  # a text's first unit follows no space
        ends = np.concatenate([[0], np.cumsum(lengths)])
        kind = np.int32 if max(ends[-1], sizes.sum()) < 1 << 31 else np.int64
        place = np.repeat((begins[which] - ends[:-1]).astype(kind), lengths)
        place += np.arange(len(place), dtype=kind)
        raw = memoryview(np.frombuffer(b"".join(found), "<u4")[place].tobytes())
        edges, k = (4 * ends[bounds]).tolist(), 0
        for text, is_usual in zip(texts, usual, strict=True):
            if is_usual:
                yield self.starts[text.partition(" ")[0]] + raw[edges[k] : edges[k + 1]]
                k += 1
            else:
                yield self.encode(text)


def encoder(path: str, cache: int = CACHE, chunk: int = CHUNK) -> Encoder:
    """One encoder per worker process, file and bounds: cache units are kept, chunk characters encoded at a time."""
    works_as("tokens", _loaded.clear)
    key = (path, cache, chunk)
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]
