"""Repeated-phrase automata: find every passage of some words that an earlier document has too.

A window is a run of consecutive words of one document. To find the windows that recur:

1. Winnowing picks phrases: of each stretch of as many words as a window, the phrase with the least hash.
   Whichever documents share a window therefore pick a phrase in it in common. Phrases picked in
   two documents are confirmed as recurring by a distributed count.
2. The confirmed phrases are dealt out to shards of bounded size. Each shard is compiled on the workers into an
   Aho-Corasick automaton over symbols of words, and all documents are streamed through it; every window around an
   occurrence is a candidate.
3. Candidate windows are compared by 64-bit hashes of their words: the least document of each, then the windows of
   later documents.

Any number of shards is worked off: a few a pass over the documents, so that neither what is
broadcast nor an automaton grows with the data.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashBitmap, Workspace, plain, prepare, returned_names, tidy
from .wordhash import hashed_words, mix, windows

PHRASE = 8
#: Phrases of one automaton: some 60 MB on a worker.
SHARD_PHRASES = 250_000
#: The filter before the automata has so many bits as a power of two.
FILTER_BITS = 26
#: Automata a pass; their phrases (8 bytes each) are what is broadcast at once.
SHARDS_A_PASS = 3


def _symbols(hashes: np.ndarray) -> np.ndarray:
    """One byte for each word: the alphabet of the automata, small as their nodes search their children one by one. Clashes only make more candidates."""
    return (hashes >> np.uint64(56)).astype(np.uint8)


def _picked(phrases: np.ndarray, stretch: int) -> np.ndarray:
    """Positions of the least of each stretch of consecutive phrase hashes."""
    n = len(phrases)
    if n < stretch:
        return np.zeros(0, np.int64)
    # least of blocks' suffixes and prefixes: any stretch is a suffix of one block and a prefix of the next
    size = -(-n // stretch) * stretch
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = phrases
    blocks = padded.reshape(-1, stretch)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(right[: n - stretch + 1], left[stretch - 1 : n])
    return np.flatnonzero(_within(phrases, least, stretch))


def _within(phrases: np.ndarray, least: np.ndarray, stretch: int) -> np.ndarray:
    """Which phrases equal the least of a stretch that holds them."""
    n = len(phrases)
    span = np.full(n + stretch - 1, np.uint64(0))
    # a phrase is picked if it is the least of some stretch: the greatest of the leasts of the stretches around it equals it
    span[stretch - 1 : stretch - 1 + len(least)] = least
    size = -(-len(span) // stretch) * stretch
    padded = np.zeros(size, np.uint64)
    padded[: len(span)] = span
    blocks = padded.reshape(-1, stretch)
    left = np.maximum.accumulate(blocks, axis=1).reshape(-1)
    right = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    most = np.maximum(right[:n], left[stretch - 1 : stretch - 1 + n])
    return most == phrases


def picked_phrases(docs: DataFrame, words: int) -> DataFrame:
    """(phrase, doc_id): the phrases that winnowing picks in each document, as PHRASE symbols packed in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, hashes, limits in hashed_words(batch.column(1), lower=False):
                symbols, phrases = _symbols(hashes), windows(hashes, PHRASE)
                rows, owners = [], []
                for i in np.flatnonzero(np.diff(limits) >= words):
                    at = _picked(phrases[limits[i] : limits[i + 1] - PHRASE + 1], words - PHRASE + 1) + limits[i]
                    packed = np.unique(symbols[at[:, None] + np.arange(PHRASE)].view(np.int64)[:, 0])
                    rows.append(packed)
                    owners.append(np.full(len(packed), ids[first + i], np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(owners))], ["phrase", "doc_id"])

    return docs.mapInArrow(tidy(run), "phrase long, doc_id long")


class _Automata:
    """The automata of one broadcast pass, compiled once in a Python worker."""

    made: tuple[str, list[ahocorasick.Automaton]] | None = None
    filled: tuple[str, np.ndarray] | None = None

    @classmethod
    def forget(cls) -> None:
        """For the work that comes after the last pass in the same Python workers."""
        cls.made = cls.filled = None

    @classmethod
    def stretches(cls, shared, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """Beginnings and ends of the stretches that may hold phrases of the pass, by a bitmap of their hashes (8 MB): the automata need not step through the rest."""
        key, shards = shared.value
        if cls.filled is None or cls.filled[0] != key:
            bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
            for phrases in shards:
                slots = mix(np.frombuffer(phrases, np.uint64)) >> np.uint64(64 - FILTER_BITS)
                np.bitwise_or.at(bits, (slots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
            cls.filled = key, bits
        runs = np.ndarray((len(symbols) - PHRASE + 1,), np.uint64, symbols.tobytes(), strides=(1,)).copy()
        slots = mix(runs) >> np.uint64(64 - FILTER_BITS)
        at = np.flatnonzero((cls.filled[1][(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1)
        if not len(at):
            return [], []
        cut = np.flatnonzero(np.diff(at) > PHRASE)
        return at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + PHRASE).tolist()

    @classmethod
    def of(cls, shared) -> list[ahocorasick.Automaton]:
        key, shards = shared.value
        if cls.made is None or cls.made[0] != key:
            cls.made = None
            out = []
            for phrases in filter(None, shards):
                automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
                for at in range(0, len(phrases), PHRASE):
                    automaton.add_word(phrases[at : at + PHRASE].decode("latin-1"))
                automaton.make_automaton()
                out.append(automaton)
            cls.made = key, out
        return cls.made[1]


def candidate_windows(docs: DataFrame, shared, words: int) -> DataFrame:
    """(h, doc_id, at): hash and place of each window in which an automaton finds a phrase; at holds the text's hash above bit 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _Automata.of(shared)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, hashes, limits in hashed_words(batch.column(1), lower=False):
                if len(hashes) < words:
                    continue
                symbols = _symbols(hashes)
                sequence = symbols.tobytes().decode("latin-1")
                ends = [end for a, b in zip(*_Automata.stretches(shared, symbols), strict=True) for automaton in automata for end, _ in automaton.iter(sequence, a, b)]
                if not ends:
                    continue
                # windows that hold a phrase ending at e begin from e + 1 - words to e + 1 - PHRASE
                ends = np.array(ends, np.int64)
                edge = np.zeros(len(hashes) + words + 2, np.int64)
                np.add.at(edge, np.maximum(ends + 1 - words, 0), 1)
                np.add.at(edge, np.maximum(ends + 2 - PHRASE, 0), -1)
                hit = np.cumsum(edge)[: len(hashes) - words + 1] > 0
                owner = np.searchsorted(limits, np.arange(len(hit)), "right") - 1
                hit &= np.arange(len(hit)) + words <= limits[np.minimum(owner + 1, len(limits) - 1)]
                at = np.flatnonzero(hit)
                if len(at):
                    tags = _tags(hashes, limits)
                    place = (at - limits[owner[at]]) | (tags[owner[at]] << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(windows(hashes, words)[at].view(np.int64)), pa.array(ids[first + owner[at]].astype(np.int64)), pa.array(place)], ["h", "doc_id", "at"])

    return docs.mapInArrow(tidy(run), "h long, doc_id long, at long")


def _tags(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """31 bits of a hash of each text's words, which tell rows of one doc_id apart."""
    sizes = np.diff(limits)
    out = np.zeros(len(sizes), np.int64)
    if len(hashes):
        at = np.arange(len(hashes)) - np.repeat(limits[:-1], sizes)
        some = np.flatnonzero(sizes)
        out[some] = (np.bitwise_xor.reduceat(mix(hashes + at.astype(np.uint64)), limits[some]) >> np.uint64(33)).astype(np.int64)
    return out


def repeated_windows(docs: DataFrame, words: int, work: Workspace, name: str = "") -> DataFrame:
    """(doc_id, tag, at): each window that also begins in a document of smaller doc_id, by doc_id and text (docs: doc_id, text; no null ids)."""
    spark = docs.sparkSession
    confirmed = picked_phrases(docs, words).groupBy("phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("phrase")
    confirmed = work.write(confirmed, name + "phrases")
    shards = max(1, -(-confirmed.count() // SHARD_PHRASES))
    found = []
    for at in range(0, shards, SHARDS_A_PASS):
        group = range(at, min(shards, at + SHARDS_A_PASS))
        dealt = confirmed.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)))
        parts = []
        for shard in group:  # one bounded shard at a time
            parts.append(dealt.filter(F.col("shard") == shard).select("phrase").toArrow().column(0).to_numpy().tobytes())
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, parts))
        found.append(work.write(candidate_windows(docs, shared, words), f"{name}windows-{at}"))
        shared.destroy()
    candidates = found[0]
    for other in found[1:]:
        candidates = candidates.union(other)
    # written, so that the join below stands on two plain exchanges and adaptive execution can split a window that a third of all documents share
    first = work.write(candidates.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h", "low"), name + "first")
    later = candidates.join(first, "h").filter(F.col("doc_id") > F.col("low"))
    return later.select("doc_id", F.shiftright("at", 32).alias("tag"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))


def remove_repeats(docs: DataFrame, words: int = 50, columns: list[str] | None = None, kept: bool = True) -> DataFrame:
    """All rows of docs without the words that a window shared with a document of smaller doc_id covers.

    Returns doc_id, the named columns, n_words, n_removed, kept_sha256 (of the words left, joined by one space)
    and, with kept, kept: these words, or the text as it was where none goes (null stays null). Windows are
    judged on the input. Null or empty texts have no words; a row without doc_id is neither removed
    from nor counted as earlier; rows of equal doc_id do not affect each other; equal rows are treated alike.
    A named column that has a result column's name is returned with _input after it.
    """
    if words < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    asked = [c for c in columns or [] if c not in ("doc_id", "text")]
    names = [f"c{i}" for i in range(len(asked))]
    results = ["n_words", "n_removed", "kept_sha256", *(["kept"] * kept)]
    returned = ["doc_id", *returned_names(asked, ["doc_id", *results]), *results]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(plain(c).alias(n) for c, n in zip(asked, names, strict=True)))
    work = Workspace(prepare(docs.sparkSession), "repeats")
    hits = repeated_windows(docs.select("doc_id", "text").filter("doc_id is not null"), words, work)
    spans = work.write(hits.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("hits")), "spans")
    touched = HashBitmap(spans, F.xxhash64("doc_id"))
    extra = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in names]
    schema = ", ".join(["doc_id long", *extra, "n_words long", "n_removed long", "kept_sha256 string", *(["kept string"] * kept)])
    n = 2 + len(names)

    def may_lose(batch: pa.RecordBatch) -> np.ndarray:
        return touched.test(batch.column(n).to_numpy(zero_copy_only=False)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _Automata.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                part = part.filter(pa.array(~may_lose(part)))
                yield _without(part, [None] * part.num_rows, words, n, kept)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _Automata.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                part = part.filter(pa.array(may_lose(part)))
                tags = np.zeros(part.num_rows, np.int64)
                for first, hashes, limits in hashed_words(part.column(1), lower=False):
                    tags[first : first + len(limits) - 1] = _tags(hashes, limits)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(tags)], [*part.schema.names[:n], "tag"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _Automata.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield _without(part, part.column(n).to_pylist(), words, n, kept)

    keyed = docs.withColumn("key", F.xxhash64("doc_id"))
    whole = keyed.mapInArrow(tidy(untouched), schema)
    inner = ", ".join(["doc_id long", "text string", *extra, "tag long"])
    parts = keyed.mapInArrow(tidy(tagged), inner).join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", *names, "hits")
    return whole.union(parts.mapInArrow(tidy(cut), schema)).toDF(*returned)


def _without(batch: pa.RecordBatch, hits: list[list[int] | None], words: int, n: int, kept: bool) -> pa.RecordBatch:
    """doc_id, the extra columns, counts, digest and kept text of a batch; hits: where its removed windows begin."""
    total, removed, digests, texts = [], [], [], []
    for text, at in zip(batch.column(1).to_pylist(), hits, strict=True):
        found = (text or "").encode().split()
        total.append(len(found))
        if at:
            edge = np.zeros(len(found) + 1, np.int64)
            at = np.array(at)
            edge[at] += 1
            np.add.at(edge, at + words, -1)
            keep = np.cumsum(edge[:-1]) == 0
            found = [found[i] for i in np.flatnonzero(keep).tolist()]
        removed.append(total[-1] - len(found))
        joined = b" ".join(found)
        digests.append(hashlib.sha256(joined).hexdigest())
        texts.append(joined.decode() if at is not None and removed[-1] else text)
    columns = [batch.column(0), *batch.columns[2:n], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
    names = ["doc_id", *batch.schema.names[2:n], "n_words", "n_removed", "kept_sha256"]
    if kept:
        columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept"]
    return pa.RecordBatch.from_arrays(columns, names)
