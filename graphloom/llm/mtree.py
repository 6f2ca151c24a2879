"""Exact top-k by inner product with M-trees.

Vectors get one more component so that all have the norm of the longest; the Euclidean distance
from a query (with 0 there) then falls as the inner product rises, and a metric tree finds the
greatest products. Vectors are dealt out to their nearest pivots, large shares in parts of
bounded size. Each part is an M-tree of paged nodes: a routing object has a covering
radius and its distance to the parent, a leaf page its vectors and their distances to the page's
object. Best-first search opens pages in order of their least possible distance; stored
parent distances and the triangle inequality spare distance computations.

A query is first answered by the part of its nearest pivot; its k-th best score there bounds the
search in the others, and parts that the bound rules out are not searched.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, prepare, tidy

#: Vectors of one tree, of a leaf page, and routing objects of an inner page.
PART, PAGE, FANOUT = 8192, 1024, 16
MAX_PIVOTS = 1024
#: Queries of a block; blocks that one copy of a tree serves.
BLOCK, BLOCKS_A_COPY = 256, 32
SLACK = 1e-9


@dataclass
class Node:
    vectors: np.ndarray  # routing objects of the children, or a leaf's vectors
    parent: np.ndarray  # their distances to this node's own object
    radii: np.ndarray | None  # covering radii of the children; None in a leaf
    children: list[Node] | None
    ids: np.ndarray | None  # of a leaf's vectors: row numbers and vec_ids
    names: np.ndarray | None


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that gives each the norm of the longest."""
    rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - y) ** 2).sum(axis=-1), 0))


def build(vectors: np.ndarray, ids: np.ndarray, names: np.ndarray, longest: float, center: np.ndarray | None = None, page: int = PAGE, fanout: int = FANOUT) -> Node:
    """An M-tree in bulk: routing objects far from each other, each vector below the nearest."""
    points = lifted(vectors, longest)
    at = points[0] if center is None else center
    return _build(points, vectors, ids, names, at, page, fanout)


def _build(points, vectors, ids, names, center, page, fanout) -> Node:
    if len(points) <= page:
        return Node(vectors, _distances(points, center), None, None, ids, names)
    chosen = [int(np.argmax(_distances(points, center)))]
    nearest = _distances(points, points[chosen[0]])
    owner = np.zeros(len(points), np.int64)
    while len(chosen) < fanout and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        d = _distances(points, points[chosen[-1]])
        closer = d < nearest
        owner[closer], nearest = len(chosen) - 1, np.minimum(nearest, d)
    if len(chosen) == 1:  # equal vectors: pages side by side
        owner = np.arange(len(points)) // page
        chosen = [int(i) for i in range(0, len(points), page)]
    routing, radii, children = [], [], []
    for i, c in enumerate(chosen):
        below = np.flatnonzero(owner == i)
        routing.append(points[c])
        radii.append(_distances(points[below], points[c]).max())
        children.append(_build(points[below], vectors[below], ids[below], names[below], points[c], page, fanout))
    routing = np.array(routing)
    return Node(routing, _distances(routing, center), np.array(radii), children, None, None)


_MOST, _INTEGERS = 2**63 - 1, np.frompyfunc(int, 1, 1)


def _products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products: in double precision where every partial sum is exact, else of Python's integers, held to the range of a long."""
    if exact:
        return (vectors @ query).astype(np.int64)
    products = (_INTEGERS(vectors).astype(object) * _INTEGERS(query).astype(object)).sum(axis=1)
    return np.array([min(max(int(p), -_MOST), _MOST) for p in products], np.int64)


def search(root: Node, center: np.ndarray, query: np.ndarray, own: int, k: int, longest: float, floor: int | None, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, names, ids) of the k greatest products with vectors other than row own, ties to smaller names; with floor, only those that reach it."""
    lifted_query = np.append(query, 0.0)
    norm = float(query @ query) + longest
    slack = SLACK * (norm + 1)
    reach = lambda score: np.sqrt(max(norm - 2 * score, 0) + slack)  # noqa: E731  the distance of a score
    bound = np.inf if floor is None else reach(floor)
    scores, names, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    queue = [(0.0, 0, root, float(_distances(lifted_query, center)))]
    serial = 0
    while queue:
        least, _, node, to_parent = heapq.heappop(queue)
        if least > bound:
            break
        gap = np.abs(to_parent - node.parent)  # at least this far, by the stored distance
        if node.children is not None:
            open_ = np.flatnonzero(gap - node.radii <= bound)
            d = _distances(lifted_query, node.vectors[open_])
            least_d = np.maximum(d - node.radii[open_] - slack**0.5, 0.0)
            for i, away, low in zip(open_.tolist(), d.tolist(), least_d.tolist(), strict=True):
                if low <= bound:
                    serial += 1
                    heapq.heappush(queue, (low, serial, node.children[i], away))
            continue
        near = gap - slack**0.5 <= bound
        vectors, own_names, own_ids = (node.vectors, node.names, node.ids) if near.all() else (node.vectors[near], node.names[near], node.ids[near])
        found = _products(vectors, query, exact)
        keep = own_ids != own
        if len(scores) == k:
            keep &= found >= scores[-1]
        elif floor is not None:
            keep &= found >= floor
        if not keep.any():
            continue
        scores = np.concatenate([scores, found[keep]])
        names, ids = np.concatenate([names, own_names[keep]]), np.concatenate([ids, own_ids[keep]])
        order = np.lexsort((ids, names, -scores))[:k]
        scores, names, ids = scores[order], names[order], ids[order]
        if len(scores) == k:
            bound = reach(scores[-1])
    return scores, names, ids


def _matrix(blobs: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.float64).reshape(-1, width)


def _prepared(vectors: DataFrame, width: int) -> DataFrame:
    """(row, vec_id, x): the valid vectors' floor(64 x) as packed doubles, shorter ones padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(64 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            out = np.zeros((len(sizes), width))
            out[np.arange(width) < sizes[:, None]] = flat
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in out], pa.binary()), pa.array((out**2).sum(axis=1)), pa.array(np.abs(out).max(axis=1, initial=0))], ["row", "vec_id", "x", "norm", "most"])

    return vectors.mapInArrow(tidy(run), "row long, vec_id long, x binary, norm double, most double")


def top_inner_products(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors (vec_id, embedding): queries are the rows whose vec_id is divisible by every, candidates all rows but the query's own.

    The vectors are floor(64 x); scores are exact integers. One beyond the range of a long is given, and ranked, as its end
    (2**63 - 1 of its sign), so that such ones tie; components are finite below 2**400. Null vectors and those with null or
    non-finite components take no part; shorter vectors count as padded with zeros. Rows of equal vec_id are candidates of each
    other and queries of their own; rows without vec_id take no part. Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    work = Workspace(spark, "mtree")
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    valid = valid.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    width = valid.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = work.write(_prepared(valid.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), width), "rows")
    count, longest, most = rows.agg(F.count("*"), F.max("norm"), F.max("most")).first()
    schema = "query_row long, query_id long, vec_id long, row long, score long"
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact = most**2 * width < 2**53
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(min(MAX_PIVOTS, -(-count // PART))).select("x").toArrow()
    pivots = spark.sparkContext.broadcast(lifted(_matrix(sample.column(0), width), longest))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = pivots.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                points = lifted(_matrix(part.column(2), width), longest)
                d = (points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.argmin(d, axis=1))], ["row", "vec_id", "x", "pivot"])

    dealt = work.write(rows.select("row", "vec_id", "x").mapInArrow(tidy(deal), "row long, vec_id long, x binary, pivot long"), "dealt")
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / PART).alias("parts"))
    placed = dealt.join(F.broadcast(sizes), "pivot")  # a row for each of MAX_PIVOTS pivots at most
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")) * MAX_PIVOTS + F.col("pivot"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in groups(batches):
            center = pivots.value[key % MAX_PIVOTS]
            points = _matrix(part.column("x").combine_chunks(), width)
            tree = build(points, part.column("row").to_numpy(), part.column("vec_id").to_numpy(), longest, center)
            radius = float(_distances(lifted(points, longest), center).max())
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([radius]), pa.array([pickle.dumps(tree, 5)], pa.binary())], ["part", "radius", "tree"])

    trees = placed.select("part", "row", "vec_id", "x").repartition("part").sortWithinPartitions("part").mapInArrow(tidy(plant), "part long, radius double, tree binary")
    trees = work.write(trees, "trees")

    # the trees' rows come before the queries' in each (part, copy)
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Node | None = None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                held = pickle.loads(blob.as_buffer())
                if isinstance(held, Node):
                    tree = held
                    continue
                center, out = pivots.value[part % MAX_PIVOTS], []
                for row, vec_id, floor, x in zip(*held, strict=True):
                    scores, names, ids = search(tree, center, x, row, k, longest, floor, exact)
                    out.append((np.full(len(scores), row), np.full(len(scores), vec_id), names, ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["query_row", "query_id", "vec_id", "row", "score"])

    def asked(blocks: DataFrame, name: str) -> DataFrame:
        """Answers to blocks of queries (part, copy, kind 1, blob): a part's tree goes to as many tasks as its own blocks need."""
        blocks = work.write(blocks, "blocks-" + name)
        demand = work.write(blocks.groupBy("part").agg(F.ceil(F.count("*") / BLOCKS_A_COPY).cast("int").alias("copies")), "demand-" + name)
        given = trees.join(demand, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.col("tree").alias("blob"))
        blocks = blocks.join(demand, "part").select("part", F.pmod("copy", "copies").alias("copy"), "kind", "blob")
        both = given.unionByName(blocks).repartition("part", "copy").sortWithinPartitions("part", "copy", "kind")
        return both.mapInArrow(tidy(answer), schema)

    queries = placed.filter(F.col("vec_id") % every == 0).select("part", "row", "vec_id", "x")

    def own_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows_, names, xs = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _matrix(batch.column(3), width)
            for part in np.unique(parts):
                at = np.flatnonzero(parts == part)
                for i in range(0, len(at), BLOCK):
                    some = at[i : i + BLOCK]
                    yield _block(int(part), rows_[some[0]] & 0x7FFFFFFF, [rows_[j] for j in some], [names[j] for j in some], [None] * len(some), xs[some])

    first = work.write(asked(queries.mapInArrow(tidy(own_blocks), _BLOCK), "own"), "own")
    floors = first.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asking = queries.join(floors, queries["row"] == floors["query_row"], "left").select("part", "row", "vec_id", "x", "floor")
    shares = trees.groupBy(F.pmod("part", F.lit(MAX_PIVOTS)).alias("pivot")).agg(F.count("*").alias("parts"), F.max("radius").alias("radius")).toArrow()  # a row for each pivot
    shares = list(zip(*(shares.column(c).to_pylist() for c in ("pivot", "parts", "radius")), strict=True))

    def other_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own, rows_, names, floors_ = (part.column(i).to_pylist() for i in (0, 1, 2, 4))
                xs = _matrix(part.column(3), width)
                copy = rows_[0] & 0x7FFFFFFF
                norms = np.einsum("ij,ij->i", xs, xs) + longest
                low = np.array([-np.inf if f is None else f for f in floors_])
                bound = np.sqrt(np.maximum(norms - 2 * low, 0) + SLACK * (norms + 1))
                points = np.concatenate([xs, np.zeros((len(xs), 1))], axis=1)
                for pivot, parts, radius in shares:
                    open_ = _distances(points, pivots.value[pivot]) - radius <= bound
                    for i in range(parts):
                        key = i * MAX_PIVOTS + pivot
                        some = [j for j in np.flatnonzero(open_) if own[j] != key]
                        if some:
                            yield _block(key, copy, [rows_[j] for j in some], [names[j] for j in some], [floors_[j] for j in some], xs[some])

    rest = asked(asking.mapInArrow(tidy(other_blocks), _BLOCK), "others")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_BLOCK = "part long, copy int, kind int, blob binary"


def _block(part: int, copy: int, rows: list[int], names: list[int], floors: list[int | None], xs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([copy], pa.int32()), pa.array([1], pa.int32()), pa.array([pickle.dumps((rows, names, floors, xs), 5)], pa.binary())], ["part", "copy", "kind", "blob"])


def groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of consecutive rows with equal key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(column)[0].as_py() != keys[a]:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
