"""Word and shingle hashes against plain Python, and the bitmap's one-sided error."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import wordhash
from graphloom.llm.common import HashBitmap

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab AB\t\n\r\x0b\x0c\x1c\x85é中 .  "), max_size=40))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=12), st.integers(1, 30), st.integers(0, 3))
def test_words_and_hashes(texts, chunk, skip):
    column = pa.array([None] * skip + texts, pa.string()).slice(skip)
    old, wordhash.CHUNK_BYTES = wordhash.CHUNK_BYTES, chunk
    try:
        by_word: dict[str, int] = {}
        rows = 0
        for lower in (False, True):
            seen = []
            for first, hashes, limits in wordhash.hashed_words(column, lower):
                for i in range(len(limits) - 1):
                    seen.append((first + i, hashes[limits[i] : limits[i + 1]].tolist()))
            assert [i for i, _ in seen] == list(range(len(texts)))
            for i, found in seen:
                words = WORD.findall(texts[i] or "")
                assert len(words) == len(found)
                for w, h in zip(words, found, strict=True):
                    w = re.sub("[A-Z]", lambda m: m[0].lower(), w) if lower else w
                    assert by_word.setdefault(w, h) == h
                rows += 1
        assert len(set(by_word.values())) == len(by_word)
    finally:
        wordhash.CHUNK_BYTES = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_windows(values, k):
    hashes = wordhash.mix(np.array(values, np.uint64) + np.uint64(1))
    found = wordhash.windows(hashes, k)
    runs = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(found) == len(runs) and all((runs[i] == runs[j]) == (found[i] == found[j]) for i in range(len(runs)) for j in range(i))


def test_bitmap_never_misses(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    bitmap = HashBitmap(keys, F.col("key"))
    inside = np.array([r.key for r in keys.collect()])
    assert bitmap.test(inside).all()
    outside = wordhash.mix(np.arange(20000, dtype=np.uint64) + np.uint64(10**6))
    assert bitmap.test(outside).mean() < 0.05
    assert not HashBitmap(keys.limit(0), F.col("key")).test(outside).any()


def test_regular_words_and_runs_do_not_cancel():
    for n in (9, 16, 64, 1024, 8192):
        words = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(n)) for flip in range(2)] + ["a" * n, "a" * (n - 1) + "b", "a" * (n + 1)]
        ((_, hashes, _),) = wordhash.hashed_words(pa.array([" ".join(words)]), False)
        assert len(set(hashes.tolist())) == len(words)
    values = wordhash.mix(np.array([i.bit_count() % 2 for i in range(4096)], np.uint64) + np.uint64(1))
    runs = wordhash.windows(values, 2048)
    assert runs[0] != runs[2048] and len(np.unique(runs)) == len({values[i : i + 2048].tobytes() for i in range(len(runs))})
