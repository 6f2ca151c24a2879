"""Statistics against plain Python, isotonic calibration, and accuracy on labels that were held out."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm.quality import STATISTICS, _isotonic, score_quality, statistics

GOOD = "the of and to in that with over under quick lazy house tree river stone walks sings reads".split()


def text(rng, good):
    words = [rng.choice(GOOD) + rng.choice(["", "", "ly", "er"]) for _ in range(rng.randint(5, 150))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
    return rng.choice([lambda: " ".join(w.upper() + "!!" for w in words), lambda: " | ".join(words), lambda: " ".join(w for w in words for _ in range(6))])()


def test_statistics():
    got = dict(zip(STATISTICS, statistics(pa.array(["Ab cd\ncd CD x!! 1é", None, "", "q"]))[0].tolist(), strict=True))
    assert np.isclose(got["log_words"], np.log1p(6)) and np.isclose(got["distinct_words"], 4 / 6) and np.isclose(got["next_equal"], 2 / 6)
    assert np.isclose(got["capital_words"], 1 / 6) and np.isclose(got["first_capital"], 1 / 6) and np.isclose(got["doubled_marks"], 1 / 6)
    assert np.isclose(got["log_lines"], np.log1p(2)) and np.isclose(got["top_word"], 3 / 6) and np.isclose(got["digit"], 1 / 19)
    many = [text(random.Random(i), i % 2) for i in range(300)]
    assert np.allclose(statistics(pa.array(many)), np.concatenate([statistics(pa.array([x])) for x in many]))


def test_isotonic_is_monotone_and_least_squares_on_a_small_case():
    x, y = _isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.allclose(y, [0, 0.5, 1]) and np.allclose(x, [1, 2.5, 4])


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, i % 5 != 0), i % 5 != 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t, _ in rows] + [(None, None, 1.0, False), (5000, "", 1.0, False), (5000, "", 1.0, False)], "doc_id long, text string, score double, held_out boolean").repartition(3)
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in rows if i % 7] + [(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == rows[r.doc_id][2] for r in test) / len(test) > 0.95
    wide = score_quality(docs, labels, ["score", "held_out", "text"])
    assert wide.columns == ["doc_id", "score_input", "held_out_input", "text", "held_out", "score", "predicted"]
    again = {r.doc_id: r.score for r in wide.collect()}
    assert all(r.score_input == (0.5 if r.doc_id is not None and r.doc_id < 900 else 1.0) for r in wide.collect())
    assert all(np.isclose(again[r.doc_id], r.score) for r in got)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in score_quality(docs, none).collect()] == [(0.5, 1)]
    assert score_quality(docs.limit(0), none).collect() == []


def test_scores_equal_a_plain_fit_of_all_labelled_rows(spark):
    """The whole fit in numpy: random features, ridge on two thirds of the labelled rows, isotonic calibration on the others."""
    rng = random.Random(8)
    rows = [(i, text(rng, i % 3 != 0), i % 3 != 0) for i in range(600)] + [(700, None, False), (701, "", False), (702, "w " * 600_000, False)]
    assert len(rows[-1][1]) > 1 << 20
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}

    learnt = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    key = {r.doc_id: r.key for r in docs.select("doc_id", F.xxhash64("doc_id").alias("key")).collect()}
    every = statistics(pa.array([t for _, t, _ in rows]))
    place = {i: n for n, (i, _, _) in enumerate(rows)}
    x, y = every[[place[i] for i in learnt]], np.array([float(rows[place[i]][2]) for i in learnt])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1
    draw = np.random.default_rng(7)
    w, b = draw.normal(size=(len(STATISTICS), 384)) / 4.0, draw.uniform(0, 2 * np.pi, 384)
    features = lambda s: np.column_stack([np.cos(np.clip((s - mean) / scale, -6, 6) @ w + b) * np.sqrt(2 / 384), np.ones(len(s))])
    fold = np.array([key[i] % 3 for i in learnt])
    a = features(x[fold != 2])
    weights = np.linalg.lstsq(np.vstack([a, np.sqrt(1e-3) * np.eye(385)]), np.concatenate([y[fold != 2], np.zeros(385)]), rcond=None)[0]
    raw, held = features(x[fold == 2]) @ weights, y[fold == 2]
    order = np.argsort(raw, kind="stable")
    raw, held = raw[order], held[order]
    # the least of the greatest means: what isotonic regression is, by its definition
    n, total = len(raw), np.concatenate([[0], np.cumsum(held)])
    level = [max(min((total[k] - total[j]) / (k - j) for k in range(i + 1, n + 1)) for j in range(i + 1)) for i in range(n)]
    knots = [(raw[[j for j in range(n) if np.isclose(level[j], v)]].mean(), v) for v in sorted({round(v, 9) for v in level})]
    want = np.interp(features(every) @ weights, [k for k, _ in knots], [v for _, v in knots])
    assert np.allclose([got[i] for i, _, _ in rows], want, atol=1e-4)
