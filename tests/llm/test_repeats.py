"""Removal of repeated windows against brute force over all windows."""

import hashlib
import random
import re

import pytest

from graphloom.llm import repeats
from graphloom.llm.repeats import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first = {}
    for key, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - k + 1):
            if key is not None:
                first[tuple(w[i : i + k])] = min(key, first.get(tuple(w[i : i + k]), key))
    out = []
    for key, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if key is not None and first[tuple(w[i : i + k])] < key:
                gone[i : i + k] = [True] * k
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        kept = " ".join(left) if any(gone) else text
        out.append((key, len(w), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed, k):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ä", " 　", "x\x1cy"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(k - 1, 3 * k))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 30))] + (p if rng.random() < 0.6 else p[a:])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(None, rows[5][1]), (3, rows[9][1]), (3, rows[9][1]), (100, None), (101, ""), (102, " \n"), (103, " ".join(passages[0])), (104, " ".join(["a"] * 200)), (105, " ".join(["a"] * 90))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,shard", [(1, 50, 150_000), (2, 20, 7), (3, 8, 11)])
def test_against_brute_force(spark, monkeypatch, seed, k, shard):
    monkeypatch.setattr(repeats, "SHARD_PHRASES", shard)
    monkeypatch.setattr(repeats, "SHARDS_A_PASS", 2)
    rows = corpus(seed, k)
    docs = spark.createDataFrame([(7, t, i, "x") for i, t in rows], "n_words int, text string, doc_id long, tag string").repartition(3)
    got = sorted((tuple(r) for r in remove_repeats(docs, k).collect()), key=str)
    assert got == brute(rows, k)


def test_extra_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "t")], "doc_id long, text string, hits string, tag string")
    assert remove_repeats(docs, columns=["hits", "tag"]).select("hits", "tag", "kept").collect() == [("s", "t", "a b")]
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words, "a", 5, "x", "y", "z"), (2, words, "b", 6, "x", "y", "z")], "doc_id long, text string, n_words string, KEPT int, key string, `a.b` string, kept_input string")
    got = remove_repeats(docs, columns=["n_words", "KEPT", "key", "a.b", "kept_input"])
    assert got.columns == ["doc_id", "n_words_input", "KEPT_input", "key", "a.b", "kept_input_input", "n_words", "n_removed", "kept_sha256", "kept"]
    assert [tuple(r)[:8] for r in sorted(got.collect())] == [(1, "a", 5, "x", "y", "z", 60, 0), (2, "b", 6, "x", "y", "z", 60, 60)]
    assert remove_repeats(docs.limit(0)).collect() == []


def test_a_different_regular_word_is_no_repeat(spark):
    """Words that hashes by polynomials modulo a power of two cannot tell apart."""
    word = lambda flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))
    rest = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([word(0), *rest])), (2, " ".join([word(1), *rest])), (3, " ".join([word(0), *rest])), (4, " ".join("ab"[i.bit_count() % 2] for i in range(4096))), (5, " ".join("ba"[i.bit_count() % 2] for i in range(64)))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 50)


def test_a_text_of_a_megabyte(spark):
    words = [f"w{i * 7919 % 1000003}" for i in range(200_000)]
    rows = [(1, " ".join(words[100_000:100_400])), (2, " ".join(words)), (3, " ".join(words[5:])), (4, None)]
    assert len(rows[1][1]) > 1 << 20
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 50)
