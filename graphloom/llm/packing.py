"""Packing by power-of-two decomposition.

Each document's token sequence is cut into pieces whose lengths are powers of two:
as many of the greatest length as fit, then the binary digits of the rest, longest
first. Pieces of one length form a bucket; each piece is a training sequence by
itself, so no sequence crosses documents, and none needs padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Cached words in each of the two generations of a Python worker's cache.
CACHE_WORDS = 500_000
#: A longer word is encoded each time, so that the cache's bytes stay bounded.
CACHE_WORD_BYTES = 64
#: Marks that end a word.
MARK = re.compile(rb"[!-/:-@\[-`{-~](?<=[a-z].)[!-/:-@\[-`{-~]*(?=[ \n])")
SCHEMA = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long"


class WordEncoder:
    """Ids (little-endian unsigned 32-bit) of texts, for a tokenizer that never joins across white space.

    ASCII white space separates words; any other stays inside a word and is left to
    the tokenizer, whose result is the same for a word alone as within its text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Fewer distinct words to encode, where the vocabulary makes no difference of case and of a space before a mark.
        self.folds = all(self._ids(a) == self._ids(b) for a, b in (("AZ Éa", "az éa"), ("az, éa.", "az , éa ."), ("az*** b_ c''s'' d", "az *** b _ c''s '' d")))
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: bytes) -> bytes:
        if self.folds and b"<|" not in text:  # a special token's name must keep its case
            text = MARK.sub(rb" \g<0>", text.lower())
        words, new, extra = text.split(), self.new, {}
        missing = []
        for word in {w for w in words if w not in new}:
            if (known := self.old.get(word)) is not None:
                new[word] = known
            else:
                missing.append(word)
        for at in range(0, len(missing), 2048):
            part = missing[at : at + 2048]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                (new if len(word) <= CACHE_WORD_BYTES else extra)[word] = np.array(found.ids, dtype="<u4").tobytes()
        out = b"".join([extra[w] if w in extra else new[w] for w in words]) if extra else b"".join(map(new.__getitem__, words))
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest is a power of two."""
    full, rest = divmod(n, longest)
    out = [(i * longest, longest) for i in range(full)]
    at = full * longest
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack_power_of_two(docs: DataFrame, tokenizer: str | None = None, longest: int = 2048, end_id: int | None = 1) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, bucket (log2 of length), ids (packed uint32), doc_tokens, sequence_id, offset.

    A null or empty text has end_id only (with end_id None: no tokens and no piece).
    Repeated rows and null ids are packed like any other row. Extra columns are ignored.
    sequence_id is unique over the result; each piece fills its sequence from offset 0.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode((text.as_py() or "").encode()) + tail
                n = len(ids) // 4
                rows += [(key, start, size, size.bit_length() - 1, ids[4 * start : 4 * (start + size)], n) for start, size in binary_pieces(n, longest)]
                held += len(ids)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, each file with sequences of that length only."""
    pieces.select("sequence_id", "doc_id", "start", "ids", "bucket").write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with their ids' CRC-32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
