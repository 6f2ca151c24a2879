"""Exact byte-level BPE by backtracking over Aho-Corasick matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token that starts at
each position of a pre-token. The encoder takes the longest token that is compatible
with the one before it (two tokens are compatible if merging the bytes of both gives
just these two), falls back to a token's longest proper prefix in the vocabulary, and
steps back a token where none fits; a set of dead positions makes this linear. The
result is that of applying the merges in order of rank.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Cached chunks (a word with the space before it) in each of the two generations of a Python worker's cache.
CACHE_CHUNKS = 400_000
CACHE_CHUNK_BYTES = 64
CACHE_PAIRS = 1_000_000

PRETOKEN = regex.compile(public_tokenizers.PATTERN)
CHUNK = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
#: White space beyond ASCII: such a text is cut by the full pattern at once.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BytePairEncoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.to_symbols = dict(enumerate(symbols))
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.single = frozenset(vocab[c] for c in symbols)
        self.rank = {i: -1 for i in self.single}
        self.merged: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merged[pair] = whole
            if whole not in self.split:
                self.split[whole], self.rank[whole] = pair, rank
        self.vocab = vocab
        self.symbols_of = {i: s for s, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.rank:
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.shorter_of: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.numbers = [b"%d" % i for i in range(len(pieces))]
        self.cache = TwoGenerations(lambda chunk: np.array(self.encode_words(chunk.decode()), dtype="<u4").tobytes(), CACHE_CHUNKS, CACHE_CHUNK_BYTES)

    def shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token; -1 if none."""
        found = self.shorter_of.get(token)
        if found is None:
            s = self.symbols_of[token]
            found = next((i for n in range(len(s) - 1, 0, -1) if (i := self.vocab.get(s[:n], -1)) in self.rank), -1)
            self.shorter_of[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, merged in order of rank, give just the two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the later merge of the two sides step by step; a merge across the border that would have come before it forbids the pair."""
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and rank[whole] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            # of equal ranks (the same token twice) the left one was merged first
            if rank[a] > rank[b]:
                limit, a = rank[a], self.split[a][1]
            else:
                limit, b = rank[b] + 1, self.split[b][0]

    def encode_pretoken(self, symbols: str) -> list[int]:
        n = len(symbols)
        if (whole := self.vocab.get(symbols, -1)) in self.rank:
            return [whole]  # its longest match is itself
        longest = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (i, k) in self.automaton.iter(symbols):
            start = end - k + 1
            if k > size[start]:
                longest[start], size[start] = i, k
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        lengths = self.symbols_of
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + len(lengths[token])
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                shorter = self.shorter(token)
                if shorter >= 0:
                    token = shorter
                else:
                    alive[at] = 0
                    token = out.pop()
                    at -= len(lengths[token])
                    break
        return out

    def encode_words(self, text: str) -> list[int]:
        out: list[int] = []
        for word in PRETOKEN.findall(text):
            out += self.encode_pretoken(word.encode().decode("latin-1").translate(self.to_symbols))
        return out

    def chunks(self, text: str) -> list[bytes]:
        """Parts of a text that are encoded each for itself."""
        if WIDE_SPACE.search(text):
            return [x.encode() for x in PRETOKEN.findall(text)]
        return CHUNK.findall(text.encode())

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        parts = self.special_cut.split(text) if self.special_cut and any(s in text for s in self.special) else [text]
        packed = []
        for part in parts:
            if (i := self.special.get(part)) is not None:
                packed.append(np.array([i], dtype="<u4").tobytes())
            elif part:
                packed.append(b"".join(map(self.cache.__getitem__, self.chunks(part))))
        return b"".join(packed)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), "<u4")

    def decimal(self, ids: np.ndarray) -> bytes:
        return b",".join(map(self.numbers.__getitem__, ids.tolist()))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.blob[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class TwoGenerations(dict):
    """A cache of at most twice limit entries: a full one becomes the old one, of which what is asked for again is kept."""

    def __init__(self, compute: Callable[[bytes], bytes], limit: int, longest: int) -> None:
        self.compute, self.limit, self.longest = compute, limit, longest
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, key: bytes) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every text. Null or empty: no ids. Other columns are ignored."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t or "").astype(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; special tokens are kept, broken UTF-8 gives replacement characters. Null ids: empty text."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(tidy(run), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids are decoded, in one pass.

    Null text counts as empty (no tokens). Rows are handled one by one, repeated ones and null ids too.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                rows.append((len(ids), sha(bpe.decimal(ids)), sha(bpe.decode(ids).encode())))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
