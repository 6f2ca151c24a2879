"""Near-duplicate vectors by a robust-pruned flat graph.

Distinct vectors (equal ones are one node with a count) are normalised and each is put into
the cells of its OVERLAP nearest centres; a large cell is cut into parts. Every part gets a
flat graph: of a node's near candidates an edge stays unless a kept neighbour is nearer to the candidate than
the node is, by a factor (robust pruning). The adjacency lists that a node has in its
different cells are united. Each vector then searches the parts of its PROBES nearest centres, greedily from
the part's medoid and from its own place; once in range, the search goes on through all neighbours in range.
What is found is verified in double precision. Recall is audited on a sample against brute force, and
where it falls short the search is widened to all cells, and in the end gives way to a scan of all parts.

The verified pairs of distinct vectors, whichever side or cell found them, are made distinct and count on both sides; copies
cost a count, not pairs. Components are joined part by part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Workspace, prepare, tidy
from .mtree import groups

#: Vectors a centre stands for, centres at most, vectors of a part.
CELL, MAX_CENTRES, PART = 2048, 4096, 4096
OVERLAP, PROBES = 2, 4
DEGREE, NEAR, ALPHA, BEAM = 24, 64, 1.2, 8
#: Nodes of the audit's first and largest sample, nodes with links that it should hold, the recall it asks for.
AUDIT_QUERIES, AUDIT_MOST, AUDIT_LINKED, AUDIT_RECALL = 64, 4096, 32, 0.98
#: What single precision may lose; candidates this far below the threshold are verified.
MARGIN = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(blobs: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.float64).reshape(-1, width)


def pruned_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours of each of the unit vectors x, DEGREE at most, filled up with -1: robust pruning of the NEAR nearest."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int32)
    x = x.astype(np.float32)
    near = min(NEAR, n - 1)
    if near < 1:
        return out
    for at in range(0, n, 512):
        rows = np.arange(at, min(n, at + 512))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        part = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        order = np.argsort(-np.take_along_axis(sims, part, axis=1), axis=1, kind="stable")
        part = np.take_along_axis(part, order, axis=1)
        y = x[part]
        # squared distances are 2 - 2 cos
        own, between = 2 - 2 * np.take_along_axis(sims, part, axis=1), 2 - 2 * (y @ y.transpose(0, 2, 1))
        alive, kept = np.ones(part.shape, bool), np.zeros(len(rows), np.int64)
        for c in range(near):
            take = np.flatnonzero(alive[:, c] & (kept < DEGREE))
            out[rows[take], kept[take]] = part[take, c]
            kept[take] += 1
            alive[take] &= ALPHA**2 * between[take, c] > own[take]
    return out


def _connected(graph: np.ndarray, medoid: int) -> np.ndarray:
    """The graph with an edge from the medoid's side to each piece that it does not reach: a chain over one node of each piece."""
    n = len(graph)
    seen = np.zeros(n, bool)
    extra: list[tuple[int, int]] = []
    last = medoid
    for root in [medoid, *range(n)]:
        if seen[root]:
            continue
        if root != medoid:
            extra.append((last, root))
            last = root
        front = np.array([root])
        seen[root] = True
        while len(front):
            following = graph[front].reshape(-1)
            following = np.unique(following[following >= 0])
            front = following[~seen[following]]
            seen[front] = True
    if extra:
        graph = np.concatenate([graph, np.full((n, 2), -1, np.int32)], axis=1)
        for a, b in extra:
            graph[a, -2], graph[b, -1] = b, a
    return graph


def range_search(x: np.ndarray, graph: np.ndarray, query: np.ndarray, starts: list[int], least: float) -> np.ndarray:
    """Nodes with a product of at least least that a greedy search from starts reaches; in range it expands every neighbour, all new ones at a time."""
    visited = np.zeros(len(x), bool)
    nodes = np.unique(np.array(starts))
    found: list[np.ndarray] = []
    queue: list[tuple[float, int]] = []
    best: list[float] = []  # the BEAM best products so far, least first
    while True:
        visited[nodes] = True
        products = x[nodes] @ query
        hit = products >= least
        inside = nodes[hit]
        if len(inside):
            found.append(inside)
            for s in np.sort(products[hit])[-BEAM:].tolist():
                heapq.heappush(best, s)
                if len(best) > BEAM:
                    heapq.heappop(best)
        near = ~hit if len(best) < BEAM else ~hit & (products > best[0])
        for s, i in zip(products[near].tolist(), nodes[near].tolist(), strict=True):
            if len(best) == BEAM and s <= best[0]:
                continue
            heapq.heappush(queue, (-s, i))
            heapq.heappush(best, s)
            if len(best) > BEAM:
                heapq.heappop(best)
        following = graph[inside].reshape(-1) if len(inside) else np.zeros(0, np.int32)
        while True:
            following = following[following >= 0]
            following = following[~visited[following]]
            if len(following):
                break
            if not queue or len(best) == BEAM and -queue[0][0] < best[0]:
                return np.concatenate(found) if found else np.zeros(0, np.int64)
            following = graph[heapq.heappop(queue)[1]]
        nodes = np.unique(following) if len(inside) > 1 else following


class _Index:
    """Cells and graphs of the nodes (node, x, n)."""

    def __init__(self, nodes: DataFrame, width: int, work: Workspace, overlap: int, probes: int, round_: int) -> None:
        spark = nodes.sparkSession
        self.width, self.work, self.round = width, work, round_
        centres = min(MAX_CENTRES, -(-nodes.count() // CELL)) or 1
        sample = nodes.orderBy(F.xxhash64("node"), "node").limit(centres).select("x").toArrow()
        shared = spark.sparkContext.broadcast(_matrix(sample.column(0), width))
        overlap, probes = min(overlap, centres), min(max(overlap, probes), centres)
        #: Whether every vector asks in every part, so that an exact search misses nothing.
        self.everywhere = probes == centres

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    sims = _matrix(part.column(1), width) @ shared.value.T
                    order = np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * probes), pa.array(order.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*part.columns, flat], ["node", "x", "n", "probes"])

        near_ = nodes.select("node", "x", "n").mapInArrow(tidy(near), "node long, x binary, n long, probes array<int>").withColumn("cells", F.slice("probes", 1, overlap))
        self.placed = work.write(near_, f"placed-{round_}")
        members = self.placed.withColumn("cell", F.explode("cells"))
        sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))  # a row for each centre at most
        self.sizes = F.broadcast(work.write(sizes, f"sizes-{round_}"))
        # a cell's parts are dealt by hash; key = part of the cell, cell
        members = members.join(self.sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")) * MAX_CENTRES + F.col("cell"))
        self.members = members.select("part", "node", "x", "n")
        lists = self.members.select("part", "node", "x").repartition("part").sortWithinPartitions("part", "node").mapInArrow(tidy(self._build), "node long, near array<long>")
        united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        self.united = work.write(united, f"united-{round_}")

    @property
    def _build(self):
        width = self.width

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in groups(batches):
                names = part.column("node").to_numpy()
                graph = pruned_graph(_matrix(part.column("x"), width))
                real = graph >= 0
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)), pa.array(names[graph[real]]))
                yield pa.RecordBatch.from_arrays([pa.array(names), near], ["node", "near"])

        return build

    def links(self, threshold: float, exact: bool = False) -> DataFrame:
        """(a, b, na, nb): verified pairs of nodes a < b with the counts of their copies, as often as they were found, and (na = nb = 0) edges that join the pieces of a part. If exact, the parts that a vector asks are scanned."""
        width = self.width
        rows = self.members.join(self.united, "node", "left")
        rows = rows.select("part", F.lit(0).alias("kind"), "node", "x", "n", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
        asking = self.placed.withColumn("cell", F.explode("probes")).join(self.sizes, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("part", F.col("share") * MAX_CENTRES + F.col("cell"))
        asking = asking.select(F.col("part").cast("long").alias("part"), F.lit(1).alias("kind"), "node", "x", "n", F.array().cast("array<long>").alias("near"))
        both = rows.unionByName(asking).repartition("part").sortWithinPartitions("part", "kind", "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A part's nodes come first and are held; the vectors that ask stream by."""
            part: int | None = None
            held: list[pa.RecordBatch] = []
            state: dict | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if keys[a] != part:
                        if state:
                            yield from _joined(state)
                        part, held, state = int(keys[a]), [], None
                    if kinds[a] == 0:
                        held.append(batch.slice(a, b - a))
                        continue
                    if state is None:
                        if not held:
                            continue
                        state = _opened(pa.Table.from_batches(held), width, exact)
                    yield from _answered(state, batch.slice(a, b - a), width, threshold)
            if state:
                yield from _joined(state)

        return self.work.write(both.mapInArrow(tidy(run), "a long, b long, na long, nb long"), f"found-{self.round}{'-exact' * exact}")


def _opened(rows: pa.Table, width: int, exact: bool = False) -> dict:
    names = rows.column("node").to_numpy()  # in order
    x = _matrix(rows.column("x"), width)
    state = {"names": names, "x": x, "small": x.astype(np.float32), "n": rows.column("n").to_numpy(), "label": np.arange(len(names)), "linked": np.zeros(len(names), bool), "seen": np.zeros((len(names), len(names)), bool)}
    if exact:
        return state
    lists = rows.column("near").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    inside = names[at] == flat if len(flat) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(names)), sizes)[inside]
    counts = np.bincount(owner, minlength=len(names))
    graph = np.full((len(names), max(1, int(counts.max(initial=0)))), -1, np.int32)
    graph[owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)] = at[inside]
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    return state | {"graph": _connected(graph, medoid), "medoid": medoid}


#: Pairs in a batch, some more at most.
PAIRS = 1 << 16


def _answered(state: dict, asking: pa.RecordBatch, width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    names, x, n = state["names"], state["x"], state["n"]
    out: list[np.ndarray] = []
    rows = 0
    for node, copies, query in zip(asking.column("node").to_pylist(), asking.column("n").to_pylist(), _matrix(asking.column("x"), width), strict=True):
        at = int(np.searchsorted(names, node))
        own = at if at < len(names) and names[at] == node else -1
        small = query.astype(np.float32)
        if "graph" in state:
            found = np.asarray(range_search(state["small"], state["graph"], small, [state["medoid"]] + ([own] if own >= 0 else []), threshold - MARGIN), np.int64)
        else:
            found = np.flatnonzero(state["small"] @ small >= threshold - MARGIN)
        found = found[found != own]
        real = found[x[found] @ query >= threshold]
        if not len(real):
            continue
        base = own if own >= 0 else int(real[0])
        label = state["label"]
        roots = np.unique(label[np.append(real, base)])
        if len(roots) > 1:  # at most once for each node of the part
            label[np.isin(label, roots)] = roots[0]
        state["linked"][real] = state["linked"][base] = True
        out.append(np.array([[node], [names[base]], [0], [0]]))
        if own >= 0:  # a pair of the part's own nodes leaves it once
            seen = state["seen"]
            fresh = ~seen[own, real]
            seen[own, real] = seen[real, own] = True
            real = real[fresh]
        first = names[real] < node
        others, counts = names[real], n[real]
        out.append(np.array([np.where(first, others, node), np.where(first, node, others), np.where(first, counts, copies), np.where(first, copies, counts)]))
        rows += len(real) + 1
        if rows >= PAIRS:
            yield _edges(out)
            out, rows = [], 0
    if out:
        yield _edges(out)


def _edges(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(parts, axis=1)], ["a", "b", "na", "nb"])


def _joined(state: dict) -> Iterator[pa.RecordBatch]:
    """An edge from each linked node of a part to the root of its piece."""
    at = np.flatnonzero(state["linked"])
    if len(at):
        none = np.zeros(len(at), np.int64)
        yield _edges([np.array([state["names"][at], state["names"][state["label"][at]], none, none])])


def link_counts(found: DataFrame) -> DataFrame:
    """(node, found, partners): of each node in a verified pair the rows and the distinct vectors it links to; a pair counts once and on both sides."""
    pairs = found.filter("na > 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("nb").alias("n")), F.struct(F.col("b").alias("node"), F.col("na").alias("n")))).alias("end"))
    return ends.groupBy("end.node").agg(F.sum("end.n").alias("found"), F.count("*").alias("partners"))


def audit(nodes: DataFrame, counts: DataFrame, width: int, threshold: float) -> float:
    """Mean recall of counts (node, partners), a node's distinct partners, against a scan of all, over the nodes of a sample that have partners; 1 if none has.

    The sample is the first of the nodes by hash, whatever has been found for them; it grows until it holds AUDIT_LINKED nodes with partners or
    AUDIT_MOST nodes.
    """
    size = AUDIT_QUERIES
    while True:
        sample = nodes.select("node", "x").orderBy(F.xxhash64("node", F.lit(1)), "node").limit(size)
        got, truth = _partners(nodes, sample, counts, width, threshold)
        linked = truth > 0
        if linked.sum() >= AUDIT_LINKED or len(truth) < size or size >= AUDIT_MOST:
            return float(np.mean(np.minimum(got[linked], truth[linked]) / truth[linked])) if linked.any() else 1.0
        size = min(AUDIT_MOST, size * 8)


def _partners(nodes: DataFrame, sample: DataFrame, counts: DataFrame, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a bounded sample its partners in counts, and those that a scan of all nodes finds."""
    asked = sample.toArrow()
    if not asked.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(asked.column("node").to_numpy())
    names = asked.column("node").to_numpy()[order]
    shared = nodes.sparkSession.sparkContext.broadcast((names, _matrix(asked.column("x"), width)[order]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = shared.value
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                hit = (_matrix(part.column(1), width) @ x.T >= threshold) & (part.column(0).to_numpy()[:, None] != names[None, :])
                total += hit.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["node", "partners"])

    out = []
    chosen = F.broadcast(nodes.sparkSession.createDataFrame(pa.table({"node": names})))
    for table in (counts.join(chosen, "node").select("node", "partners"), nodes.select("node", "x").mapInArrow(tidy(scan), "node long, partners long").groupBy("node").agg(F.sum("partners").alias("partners"))):
        rows, total = table.toArrow(), np.zeros(len(names), np.int64)
        total[np.searchsorted(names, rows.column("node").to_numpy())] = rows.column("partners").to_numpy()
        out.append(total)
    return out[0], out[1]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, overlap: int = OVERLAP, probes: int = PROBES) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors link if the search finds them (all pairs are tried where its audited recall stays short) and their cosine, in double precision, is at least
    threshold; n_links counts rows, component_id is the least vec_id reachable, kept whether that is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; those of different length do not link.
    Rows of equal vectors link with each other; rows of equal vec_id are rows of their own; a null vec_id takes part but names no
    component (null if no other is reached, and not kept). Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    work = Workspace(spark, "flatgraph")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.coalesce(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = work.write(rows.select("vec_id", "embedding", good.alias("good"), F.size("embedding").alias("width")), "rows")
    classes = rows.filter("good").groupBy("embedding", "width").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = work.write(classes.select(F.monotonically_increasing_id().alias("node"), "embedding", "width", "n", "least"), "classes")
    linked: DataFrame | None = None
    counts: DataFrame | None = None
    for width in sorted(r[0] for r in classes.select("width").distinct().collect()):  # one, as a rule
        found, counted = _search(classes.filter(F.col("width") == width), width, threshold, overlap, probes, work)
        linked = found if linked is None else linked.union(found)
        counts = counted if counts is None else counts.union(counted)
    if linked is None or counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    pieces = connected_components(linked.filter("na = 0").select("a", "b"), "a", "b").toDF("node", "piece")
    named = classes.join(counts.select("node", "found"), "node", "left").join(pieces, "node", "left").select("embedding", "least", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("piece", "node").alias("piece"))
    named = work.write(named, "named")
    least = work.write(named.groupBy("piece").agg(F.min("least").alias("component_id")), "least")
    named = work.write(named.join(least, "piece").select("embedding", "n_links", "component_id"), "components")
    joined = rows.filter("good").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _search(classes: DataFrame, width: int, threshold: float, overlap: int, probes: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """_Index.links and link_counts of the vectors of one width, at an audited recall."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(1).flatten().to_numpy().reshape(-1, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["node", "x", "n"])

    nodes = work.write(classes.select("node", "embedding", "n").mapInArrow(tidy(pack), "node long, x binary, n long"), f"nodes-{width}")
    for round_ in range(4):
        index = _Index(nodes, width, work, overlap, probes, round_ * 100_000 + width)
        found = index.links(threshold)
        counts = work.write(link_counts(found), f"counts-{width}-{round_}")
        if audit(nodes, counts, width, threshold) >= AUDIT_RECALL:
            return found, counts
        if index.everywhere:
            break
        overlap, probes = overlap + 1, MAX_CENTRES if round_ == 2 else probes * 4
    found = index.links(threshold, exact=True)
    return found, work.write(link_counts(found), f"counts-{width}-exact")
