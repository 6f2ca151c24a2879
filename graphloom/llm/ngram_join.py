"""N-gram Jaccard join: which documents' shingle sets overlap enough, and the classes that the links form.

The incidence matrix of documents by n-grams is multiplied with itself in blocks, after
two exact reductions. Documents of equal shingle sets are one row. Of a set of n
shingles only the n - ceil(t n) + 1 rarest (in an order common to all documents, by a
count sketch of fixed size and then by hash) can be the first that a partner shares, so
only these columns are multiplied. A column's documents are first linked to one leader;
what is then connected needs no further pairs, so a group of near copies costs one pair
a member. Columns that still hold several components are multiplied in full, in blocks of bounded
size: a lower bound of the difference from parity bits, size bounds, and the overlap counted over all
columns discard pairs; the rest are compared by their whole sets.

n-grams are compared by 64-bit hashes, sets by 128 bits; sets whose first 64 bits clash are told apart by the other 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import HashBitmap, Workspace, prepare, tidy
from .wordhash import hashed_words, mix, windows

SKETCH = 1 << 20
SKETCH_PARTS = 64
#: Documents of a column that are multiplied at once; a column of more is dealt out in pairs of blocks.
BLOCK = 2048
PARITY_WORDS = 8
#: Columns of up to so many documents are multiplied without parity bits.
SMALL = 64
#: A pair is compared by way of a leader if it meets in one column for each so many shingles of the overlap it needs.
STAR_COLUMNS = 100
#: Classes that different sets may share; their table (16 bytes a row) is kept in the driver and the workers.
MOST_CLASHES = 100_000


@dataclass(frozen=True)
class Threshold:
    """Two sets link when den * |intersection| >= num * |union|."""

    num: int = 80
    den: int = 100

    def least_overlap(self, n: np.ndarray) -> np.ndarray:
        """The overlap that a set of n needs with any partner."""
        return (self.num * n + self.den - 1) // self.den

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.least_overlap(n) + 1

    def pair_overlap(self, a, b):
        """The overlap that sets of a and b need."""
        both = self.num + self.den
        return (self.num * (a + b) + both - 1) // both


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); a shorter text is one shingle of all its words, one without words none."""
    for first, hashes, limits in hashed_words(column, lower=True):
        runs = windows(hashes, k)
        for i in range(len(limits) - 1):
            a, b = int(limits[i]), int(limits[i + 1])
            if b - a >= k:
                yield first + i, np.unique(runs[a : b - k + 1])
            elif b > a:
                yield first + i, mix(windows(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield first + i, np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _fingerprint(shingles: np.ndarray, bits: int) -> tuple[int, int]:
    """Two hashes of a set; the first, its class, has so many bits."""
    f = np.array([np.bitwise_xor.reduce(mix(shingles)), np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64)
    f, g = mix(f + np.uint64(len(shingles)))
    return tuple(_signed([f >> np.uint64(64 - bits), g]).tolist())


def _class(shingles: np.ndarray, bits: int, clashing: dict[int, int]) -> int:
    f, g = _fingerprint(shingles, bits)
    return f ^ g if clashing.get(f, g) != g else f


def _first_pass(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """kind 0: doc_id, n, f (class), g (second fingerprint); kind 1: part, counts of the sketch, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            n, f, g = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, shingles in shingle_sets(batch.column(1), k):
                n[row] = len(shingles)
                if len(shingles):
                    f[row], g[row] = _fingerprint(shingles, bits)
                    np.add.at(sketch, (shingles >> np.uint64(44)).astype(np.int64), 1)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), batch.column(0), pa.array(n), pa.array(f), pa.array(g), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if sketch.any():
            parts = sketch.reshape(SKETCH_PARTS, -1)
            blank = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SKETCH_PARTS, np.int32)), blank, blank, blank, blank, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    names = ["kind", "doc_id", "n", "f", "g", "part", "counts"]
    return docs.mapInArrow(tidy(run), "kind int, doc_id long, n long, f long, g long, part int, counts binary")


def _sketch(first: DataFrame) -> np.ndarray:
    """The tasks' sketches added up, part by part; 64 rows reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(part, np.zeros(SKETCH // SKETCH_PARTS, np.uint32))
                sums[part] += np.frombuffer(counts.as_py(), np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    parts = first.filter("kind = 1").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(tidy(add), "part int, counts binary").toArrow()
    out = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.uint32)
    for part, counts in zip(parts["part"].to_pylist(), parts["counts"], strict=True):
        out[part] += np.frombuffer(counts.as_py(), np.uint32)
    return out.reshape(-1)


class Incidence:
    """The rows of the incidence matrix, one for each distinct shingle set, made anew from the texts whenever they are needed."""

    def __init__(self, docs: DataFrame, k: int, threshold: Threshold, work: Workspace, bits: int = 64) -> None:
        self.docs, self.k, self.threshold, self.work, self.bits = docs, k, threshold, work, bits
        self.first = work.write(_first_pass(docs, k, bits), "first")
        members = self.first.filter("kind = 0").select("doc_id", "n", "f", "g")
        self.members, self.classes = members, self._classes(members, "classes")
        #: Sets that share a class: all but those of the least second fingerprint take another class (some n * n / 2**65 of n sets, so few).
        self.clashing: dict[int, int] = {}
        clashes = self.classes.filter("low <> high").select("f", "low")
        if not clashes.isEmpty():
            if clashes.count() > MOST_CLASHES:
                raise RuntimeError("more sets share a class than chance allows for any corpus")
            self.clashing = {f: low for f, low in clashes.collect()}
            moved = members.join(F.broadcast(clashes), "f", "left")
            self.members = work.write(moved.select("doc_id", "n", F.when(F.col("g") != F.col("low"), F.col("f").bitwiseXOR(F.col("g"))).otherwise(F.col("f")).alias("f"), "g"), "members")
            self.classes = self._classes(self.members, "classes-apart")
            if not self.classes.filter("low <> high").isEmpty():
                raise RuntimeError("sets share a class again after they were told apart")
        # the copies of a set are not read again, but for a few where the bitmap errs
        self.reps = HashBitmap(self.classes, F.col("f").bitwiseXOR(F.coalesce("rep", F.lit(0))))
        self.sketch = docs.sparkSession.sparkContext.broadcast(_sketch(self.first))

    def _classes(self, members: DataFrame, name: str) -> DataFrame:
        return self.work.write(members.filter("n > 0").groupBy("f").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.min("doc_id").alias("rep")), name)

    def rows(self, keep_class: HashBitmap | None = None, keep_doc: HashBitmap | None = None) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
        """A generator of (f, shingles) of a batch, for representatives (and, if given, classes in keep_class, of documents in keep_doc) only."""
        reps, k, bits, clashing = self.reps, self.k, self.bits, self.clashing

        def of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            if keep_doc is not None:
                batch = batch.filter(pa.array(keep_doc.test(batch.column(2).to_numpy(zero_copy_only=False))))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, shingles in shingle_sets(batch.column(1), k):
                if len(shingles):
                    f = np.array([_class(shingles, bits, clashing)], np.int64)
                    if reps.test(f ^ ids[row])[0] and (keep_class is None or keep_class.test(f)[0]):
                        yield int(f[0]), shingles

        return of

    def documents(self, classes: DataFrame) -> HashBitmap:
        """A test for the documents that represent classes (f), so that the others' texts need not be read into sets again."""
        reps = self.classes.join(classes.select("f").distinct(), "f", "left_semi")
        return HashBitmap(reps, F.xxhash64("rep"))

    def prefixes(self, columns: HashBitmap | None = None, parity: bool = False, keep_doc: HashBitmap | None = None) -> DataFrame:
        """(h, f, n, c) for each prefix column h of each row; c: the sketch's count of the row's rarest shingle. columns: only those in the bitmap; parity: bits of the whole set too."""
        sketch, threshold, of = self.sketch, self.threshold, self.rows(keep_doc=keep_doc)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = sketch.value
            for batch in batches:
                hs, fs, ns, cs, bits = [], [], [], [], []
                for f, shingles in of(batch):
                    n = len(shingles)
                    count = counts[(shingles >> np.uint64(44)).astype(np.int64)]
                    p = int(threshold.prefix(n))
                    order = np.lexsort((shingles, count))[:p]
                    head = shingles[order]
                    if columns is not None:
                        head = head[columns.test(head)]
                        if not len(head):
                            continue
                    hs.append(head)
                    fs.append(np.full(len(head), f, np.int64))
                    ns.append(np.full(len(head), n, np.int64))
                    cs.append(np.full(len(head), count[order[0]], np.int64))
                    if parity:
                        at = mix(shingles) & np.uint64(64 * PARITY_WORDS - 1)
                        odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                        bits += [np.packbits(odd.astype(np.uint8)).tobytes()] * len(head)
                if hs:
                    arrays = [pa.array(_signed(np.concatenate(hs))), *(pa.array(np.concatenate(x)) for x in (fs, ns, cs))]
                    yield pa.RecordBatch.from_arrays(arrays + ([pa.array(bits, pa.binary())] if parity else []), names)

        names = ["h", "f", "n", "c"] + ["bits"] * parity
        return self.docs.mapInArrow(tidy(run), "h long, f long, n long, c long" + ", bits binary" * parity)

    def sets(self, classes: DataFrame) -> DataFrame:
        """(f, shingles as packed 64-bit) of the classes (f), and of a few others."""
        of = self.rows(HashBitmap(classes, F.col("f")), self.documents(classes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fs, blobs, held = [], [], 0
                for f, shingles in of(batch):
                    fs.append(f)
                    blobs.append(shingles.tobytes())
                    held += len(blobs[-1])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(fs, pa.int64()), pa.array(blobs, pa.binary())], ["f", "shingles"])
                        fs, blobs, held = [], [], 0
                if fs:
                    yield pa.RecordBatch.from_arrays([pa.array(fs, pa.int64()), pa.array(blobs, pa.binary())], ["f", "shingles"])

        return self.docs.mapInArrow(tidy(run), "f long, shingles binary")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the (a, b) that link, by their whole sets."""
        threshold = self.threshold
        if pairs.isEmpty():
            return self.work.write(pairs.select("a", "b"), name)
        sets = self.work.write(self.sets(pairs.select(F.explode(F.array("a", "b")).alias("f")).distinct()), name + "-sets")
        both = pairs.join(sets.toDF("b", "right"), "b").join(sets.toDF("a", "left"), "a").select("a", "b", "left", "right")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    shared = int((y[at] == x).sum())
                    keep.append(threshold.den * shared >= threshold.num * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

        links = self.work.write(both.mapInArrow(tidy(run), "a long, b long").distinct(), name)
        self.work.drop(name + "-sets")
        return links


def _need(threshold: Threshold, a: F.Column, b: F.Column) -> F.Column:
    """The overlap that sets of a and b need."""
    return F.ceil(F.lit(threshold.num) * (a + b) / (threshold.num + threshold.den))


def _sizes_fit(threshold: Threshold, a: str, b: str) -> F.Column:
    return threshold.den * F.least(a, b) >= threshold.num * F.greatest(a, b)


def _products(blocks: DataFrame, threshold: Threshold) -> DataFrame:
    """(a, b, na, nb) once for each shared column: pairs of one (h, i, j) whose components differ and that sizes and parity bits allow.

    Rows arrive sorted by (h, i, j); side tells the block (0: both are one).
    """

    def multiply(f, n, comp, bits, side) -> Iterator[pa.RecordBatch]:
        order = np.argsort(f, kind="stable")
        f, n, comp, bits, side = f[order], n[order], comp[order], bits[order], side[order]
        rows = np.flatnonzero(side <= 1)
        for at in range(0, len(rows), 256):
            x = rows[at : at + 256]
            ok = comp[x][:, None] != comp[None, :]
            ok &= np.where(side[x][:, None] == 0, f[x][:, None] < f[None, :], side[None, :] == 2)
            low, high = np.minimum(n[x][:, None], n[None, :]), np.maximum(n[x][:, None], n[None, :])
            ok &= threshold.den * low >= threshold.num * high
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            i = x[i]
            # odd bits that differ come from elements of one set only
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1).astype(np.int64)
            most = n[i] + n[j] - 2 * threshold.pair_overlap(n[i], n[j])
            fine = differ <= most
            i, j = i[fine], j[fine]
            swap = f[i] > f[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b]), pa.array(n[a]), pa.array(n[b])], ["a", "b", "na", "nb"])

    def pairs_of_small(column, few, f, n, comp) -> Iterator[pa.RecordBatch]:
        """All pairs of many small columns at once: rows one, two, three and so on apart."""
        for lag in range(1, SMALL):
            x = np.flatnonzero((column[:-lag] == column[lag:]) & few[:-lag]) if lag < len(column) else np.zeros(0, np.int64)
            if not len(x):
                return
            y = x + lag
            low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            fine = (comp[x] != comp[y]) & (f[x] != f[y]) & (threshold.den * low >= threshold.num * high)
            x, y = x[fine], y[fine]
            a, b = np.where(f[x] < f[y], x, y), np.where(f[x] < f[y], y, x)
            yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b]), pa.array(n[a]), pa.array(n[b])], ["a", "b", "na", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table_: pa.Table) -> Iterator[pa.RecordBatch]:
            h, i, j, f, n, comp, side = (table_.column(c).to_numpy() for c in ("h", "i", "j", "f", "n", "comp", "side"))
            blank = bytes(8 * PARITY_WORDS)
            bits = np.frombuffer(b"".join([x or blank for x in table_.column("bits").to_pylist()]), np.uint64).reshape(-1, PARITY_WORDS)
            cut = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]])
            column = np.repeat(np.arange(len(begins)), ends - begins)
            few = (ends - begins <= SMALL) & (side[begins] == 0) & (side[ends - 1] == 0)
            yield from pairs_of_small(column, few[column], f, n, comp)
            for a, b in zip(begins[~few], ends[~few], strict=True):
                if b - a > 1:
                    yield from multiply(f[a:b], n[a:b], comp[a:b], bits[a:b], side[a:b])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = [batch.column(c).to_numpy() for c in ("h", "i", "j")]
            last = [x[-1] for x in keys]
            differs = np.flatnonzero(np.logical_or.reduce([x != y for x, y in zip(keys, last, strict=True)]))
            ahead = batch.num_rows - (int(differs[-1]) + 1 if len(differs) else 0)  # rows of the last key, which may go on
            if len(differs) or len(held) > 1 and any(held[0].column(c)[0].as_py() != y for c, y in zip(("h", "i", "j"), last, strict=True)):
                whole = pa.Table.from_batches(held)
                yield from flush(whole.slice(0, whole.num_rows - ahead))
                held = whole.slice(whole.num_rows - ahead).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return blocks.mapInArrow(tidy(run), "a long, b long, na long, nb long")


def ngram_classes(docs: DataFrame, k: int = 5, threshold: Threshold = Threshold(), class_bits: int = 64) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, A-Z folded; a document's set is its distinct k-word
    shingles (all words as one, if fewer). component_id is the least doc_id reachable by
    links, the row's own included. A text that is null, empty or without words has an empty set and
    links with nothing; rows of equal sets link; rows of equal doc_id are documents of their own; a null doc_id takes
    part but names no component (null, if no other is reached). Other columns are ignored. class_bits: length of the hash that names a set.
    """
    work = Workspace(prepare(docs.sparkSession), "ngram")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id"))
    matrix = Incidence(source, k, threshold, work, class_bits)
    # columns that two classes share, and in each the leader: of the rows with the most common content one, so that an original leads its copies
    shared = matrix.prefixes().groupBy("h").agg(F.min("f").alias("low"), F.max("f").alias("high")).filter("low <> high").select("h")
    shared = work.write(shared, "shared")
    cells = work.write(matrix.prefixes(HashBitmap(shared, F.col("h"))).distinct().join(shared, "h"), "cells")
    leaders = cells.groupBy("h").agg(F.max(F.struct("c", "f", "n")).alias("lead"))
    stars = cells.join(leaders, "h").filter("f <> lead.f").filter(_sizes_fit(threshold, "n", "lead.n"))
    # a pair that meets in few of its columns by way of a leader waits for the products below, where its overlap is counted in full
    enough = F.ceil(F.col("need") / STAR_COLUMNS)
    stars = stars.groupBy(F.least("f", "lead.f").alias("a"), F.greatest("f", "lead.f").alias("b"), _need(threshold, F.col("n"), F.col("lead.n")).alias("need")).agg(F.count("*").alias("seen")).filter(F.col("seen") >= enough)
    stars = work.write(stars.select("a", "b").distinct(), "stars")
    links = matrix.verified(stars, "links-stars")
    joined = work.write(connected_components(links, "a", "b"), "joined").toDF("f", "comp")

    # what several components share is multiplied in full
    of = cells.join(joined, "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    open_columns = of.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).filter("low <> high")
    open_columns = work.write(open_columns.select("h", "m", F.ceil(F.col("m") / BLOCK).alias("blocks")), "open")
    small, large = open_columns.filter(F.col("m") <= SMALL), open_columns.filter(F.col("m") > SMALL)
    rows = cells.select("h", "f", "n").join(small, "h").withColumn("bits", F.lit(None).cast("binary"))
    if not large.isEmpty():
        holders = cells.join(large, "h", "left_semi")
        marked = matrix.prefixes(HashBitmap(large, F.col("h")), parity=True, keep_doc=matrix.documents(holders)).select("h", "f", "n", "bits").dropDuplicates(["h", "f"])
        rows = rows.unionByName(marked.join(large, "h"))
    rows = rows.join(joined, "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    own = F.pmod(F.xxhash64("f"), F.col("blocks"))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("h", i.cast("long").alias("i"), j.cast("long").alias("j"), "f", "n", "comp", "bits", side.cast("int").alias("side"))
    products = _products(dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j"), threshold)
    counted = products.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("seen"))
    # an element both share is seen in a column, or lies beyond the prefix of the one whose prefix ends first
    beyond = F.greatest(*(F.ceil(F.lit(threshold.num) * F.col(x) / threshold.den) - 1 for x in ("na", "nb")))
    need = _need(threshold, F.col("na"), F.col("nb"))
    pairs = work.write(counted.filter(F.col("seen") + beyond >= need).select("a", "b").join(stars, ["a", "b"], "left_anti"), "pairs")
    links = links.union(matrix.verified(pairs, "links-products"))

    final = connected_components(links, "a", "b").toDF("f", "comp")
    named = work.write(matrix.classes.select("f", "rep").join(final, "f", "left").select("f", "rep", F.coalesce("comp", "f").alias("comp")), "named")
    # written before it is joined, so that the join can be split where a component is large
    names = work.write(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    of_class = work.write(named.join(names, "comp").select("f", "component_id"), "names")
    return matrix.members.join(of_class, "f", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
