"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

A document is described by counts over its whole text (no label, language, source or
number goes in). Standardised statistics are mapped to cos(w x + b) with Gaussian w, so that
their inner products approximate a Gaussian kernel. Partitions sum their parts of the normal equations; the
driver adds up a bounded number of these and solves for the ridge weights. Scores of
labelled documents that took no part in the fit give a monotone map to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, plain, prepare, returned_names, tidy
from .wordhash import mix, text_chunks, windows, word_bounds, word_hashes

#: Labelled documents that a fit takes at most (those with the least hashes): a classifier this small learns no more from more.
MAX_LABELLED = 200_000
#: Partitions of the labelled sample, and so of sums that reach the driver.
PARTS = 12

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "capital", "digit", "mark", "rare_mark", "bar", "beyond_ascii",
    "capital_words", "first_capital", "marked_words", "doubled_marks", "distinct_words", "next_equal", "distinct_pairs", "top_word", "log_lines", "line_words", "distinct_lines", "stops",
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3
for _c in b"#$%&*=<>[]{}\\^_~@/!":
    _CLASS[_c] = 4
_CLASS[ord("|")] = 5
_CLASS[128:] = 6


def _sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[limits[1:]] - total[limits[:-1]]).astype(np.float64)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners how many different keys it has and how often the most frequent comes."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    both = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    who = (both[first] >> np.uint64(40)).astype(np.int64)
    runs = np.diff(np.concatenate([first, [len(both)]]))
    most = np.zeros(n)
    np.maximum.at(most, who, runs)
    return np.bincount(who, minlength=n).astype(np.float64), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; null counts as empty, and an empty text has zeros."""
    out = np.zeros((len(column), len(STATISTICS)))
    for first, data, limits in text_chunks(column):
        n = len(limits) - 1
        kinds = _CLASS[data]
        starts, ends, counts = word_bounds(data, limits)
        words = np.concatenate([[0], np.cumsum(counts)])
        hashes = word_hashes(data, starts, ends, True)
        owner = np.repeat(np.arange(n), counts)
        size, lengths = np.diff(limits).astype(np.float64), (ends - starts).astype(np.float64)
        chars, total = np.maximum(size, 1), np.maximum(counts, 1).astype(np.float64)
        count = [_sums(kinds == k, limits) for k in range(7)]
        capital = np.concatenate([[0], np.cumsum(kinds == 1)])
        marks = np.concatenate([[0], np.cumsum((kinds >= 3) & (kinds <= 5))])
        capitals, marked = capital[ends] - capital[starts], marks[ends] - marks[starts]
        pairs = windows(hashes, 2)
        inner = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
        distinct, top = _distinct(mix(hashes), owner, n)
        distinct_pairs, _ = _distinct(mix(pairs[inner]), owner[:-1][inner], n) if len(pairs) else (np.zeros(n), None)
        equal = np.bincount(owner[:-1][inner & (hashes[:-1] == hashes[1:])], minlength=n) if len(owner) else np.zeros(n)
        breaks = data == 10
        line_starts = np.unique(np.concatenate([limits[:-1][size > 0], np.flatnonzero(breaks) + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.concatenate([line_starts[1:], [len(data)]])[: len(line_starts)]
        line_owner = np.searchsorted(limits, line_starts, "right") - 1
        lines = np.bincount(line_owner, minlength=n).astype(np.float64)
        line_hash = word_hashes(data, line_starts, np.minimum(line_ends, limits[line_owner + 1]), True)
        distinct_lines, _ = _distinct(mix(line_hash), line_owner, n)
        mean = _sums(lengths, words) / total
        ends_sentence = (data == ord(".")) | (data == ord(","))
        columns = (
            np.log1p(size), np.log1p(counts), mean, np.sqrt(np.maximum(_sums(lengths**2, words) / total - mean**2, 0)),
            count[1] / chars, count[2] / chars, count[3] / chars, count[4] / chars, count[5] / chars, count[6] / chars,
            _sums((capitals >= 2) & (2 * capitals > lengths), words) / total, _sums(capitals == 1, words) / total, _sums(marked > 0, words) / total, _sums(marked >= 2, words) / total,
            distinct / total, equal / total, distinct_pairs / np.maximum(counts - 1, 1), top / total, np.log1p(lines), np.log1p(counts / np.maximum(lines, 1)), distinct_lines / np.maximum(lines, 1), _sums(ends_sentence, limits) / total,
        )
        out[first : first + n] = np.where(size[:, None] > 0, np.stack(columns, axis=1), 0)
    return out


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs and stats, an array of STATISTICS of text."""
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(stats.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat], [*(f"c{i}" for i in range(len(keep))), "stats"])

    return docs.select("text", *keep).mapInArrow(tidy(run), f"{fields}, stats array<double>").toDF(*keep, "stats")


@dataclass
class QualityModel:
    """Weights of the fitted score and its calibration (knots of a monotone step map)."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        fourier = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([fourier, np.ones((len(stats), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels, between which a score is interpolated."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += t
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(labelled: DataFrame, features: int = 384, width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """A model of labelled (stats, label, key): two thirds of the keys for the weights, one third for the calibration.

    label may be a fraction (the mean of a document's labels). Without labels every score is a half.
    """
    spark = labelled.sparkSession
    sample = labelled.filter("label is not null").orderBy("key").limit(MAX_LABELLED).repartition(PARTS, "key")
    sample = Workspace(spark, "quality").write(sample.withColumn("fold", F.pmod("key", F.lit(3))), "sample")
    d = len(STATISTICS)
    moments = sample.agg(*(F.avg(F.col("stats")[i]) for i in range(d)), *(F.stddev_pop(F.col("stats")[i]) for i in range(d))).first()
    rng = np.random.default_rng(seed)
    if moments[0] is None:
        return QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, features)), np.zeros(features), np.zeros(features + 1))
    scale = np.array(moments[d:])
    model = QualityModel(np.array(moments[:d]), np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            x = model.features(np.array(batch.column(0).flatten()).reshape(-1, d))
            a += x.T @ x
            b += x.T @ np.array(batch.column(1), dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    a, b = np.eye(features + 1) * ridge, np.zeros(features + 1)
    for part in sample.filter("fold <> 2").select("stats", "label").mapInArrow(tidy(sums), "a binary, b binary").toLocalIterator():
        a += np.frombuffer(part["a"]).reshape(features + 1, -1)
        b += np.frombuffer(part["b"])
    model.weights = np.linalg.solve(a, b)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(np.array(batch.column(0).flatten()).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], ["raw", "label"])

    held = sample.filter("fold = 2").select("stats", F.col("label").cast("double")).mapInArrow(tidy(scored), "raw double, label double").toArrow()
    if held.num_rows:
        model.knots, model.levels = _isotonic(held.column("raw").to_numpy(), held.column("label").to_numpy())
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document's label is kept for testing: crc32 of the doc_id as text, modulo 3, is 1 (false for null)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each row of docs (doc_id, text): doc_id, the named columns, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    labels (doc_id, quality): of several labels of one doc_id the mean counts; null labels and ids
    do not; only those not held_out are learnt from. Null or empty texts are scored by zero statistics. Rows are
    scored one by one, repeated and without id too. A named column that has a result column's name is returned with _input after it.
    """
    asked = [c for c in columns or [] if c != "doc_id"]
    results = ["held_out", "score", "predicted"]
    returned = ["doc_id", *returned_names(asked, ["doc_id", *results]), *results]
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(asked)]
    extra = [c for c in names if c != "text"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(plain(c).alias(n) for c, n in zip(asked, names, strict=True) if c != "text"))
    work = Workspace(prepare(docs.sparkSession), "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    stats = work.write(described(docs.select("doc_id", "text"), ["doc_id"]), "stats")
    labelled = stats.join(known, "doc_id").select("stats", "label", F.xxhash64("doc_id").alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled))
    n = len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(n + 2)
            is_text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
            stats = statistics(values) if is_text else np.array(values.flatten()).reshape(-1, len(STATISTICS))
            score = np.clip(shared.value.score(stats), 0.0, 1.0)
            kept = [values if c == "text" else batch.column(1 + extra.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, batch.column(n + 1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", *names, "held_out", "score", "predicted"])

    source = docs if names else stats  # statistics are made again rather than joined to wide rows
    given = source.select("doc_id", *extra, held_out(F.col("doc_id")).alias("held_out"), "text" if names else "stats")
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in names]
    return given.mapInArrow(tidy(run), ", ".join(["doc_id long", *fields, "held_out boolean", "score double", "predicted int"])).toDF(*returned)
