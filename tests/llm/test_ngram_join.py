"""The n-gram join against brute force over all pairs of sets."""

import random
import re

import pytest

from graphloom.llm import ngram_join
from graphloom.llm.ngram_join import Threshold, ngram_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, t):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and t.den * shared >= t.num * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    least = {g: min((x for x in keys if x is not None), default=None) for g, keys in groups.items()}
    return sorted(((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ä", "ß", "THE", "the"]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        texts.append(base)
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(copy)
    common = [rng.choice(vocab) for _ in range(25)]
    texts += [[rng.choice(vocab) for _ in range(rng.randint(1, 10))] + common for _ in range(25)]
    rows = [(rng.randint(0, 10**6), rng.choice([" ", "\n", "  "]).join(t)) for t in texts]
    rows += [(None, rows[0][1]), (7, None), (8, ""), (9, " \n"), (3, "one"), (2, "ONE"), (4, "one two"), (5, rows[3][1]), (5, "one two three"), (6, "one two three")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,t,block", [(1, 4, Threshold(85, 100), 2048), (2, 5, Threshold(), 8), (3, 3, Threshold(1, 2), 5)])
def test_against_brute_force(spark, monkeypatch, seed, k, t, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", min(block, 64))
    rows = corpus(seed)
    docs = spark.createDataFrame([(f, k, n) for n, (k, f) in enumerate(rows)], "text string, doc_id long, n_shingles long").repartition(3)
    got = sorted((tuple(r) for r in ngram_classes(docs, k, t).collect()), key=str)
    assert got == brute(rows, k, t)


def test_empty(spark):
    assert ngram_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def thue_morse(n, flip):
    """A text over a and b that hashes by polynomials modulo a power of two take for its counterpart."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_regular_words_and_sequences_stay_apart(spark):
    rows = [(i, thue_morse(n, i % 2)) for i, n in enumerate([1024, 1024, 4096, 4096])]
    rows += [(10 + i, " ".join(thue_morse(1024, i))) for i in range(2)] + [(20, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (4, 1024):
        assert sorted((tuple(r) for r in ngram_classes(docs, k).collect()), key=str) == brute(rows, k, Threshold())


def test_sets_of_one_class_are_told_apart(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_classes(docs, 4, Threshold(85, 100), class_bits=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, Threshold(85, 100))


def test_a_text_of_a_megabyte(spark):
    words = [f"w{i * 7919 % 1000003}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], "x"])), (3, " ".join(words[:150_000])), (4, None)]
    assert len(rows[0][1]) > 1 << 20
    got = ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 4, Threshold(85, 100)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert [tuple(r) for r in sorted(got)] == brute(rows, 4, Threshold(85, 100))
