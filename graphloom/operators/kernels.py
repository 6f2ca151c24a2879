"""Vectorised kernels for graphs that fit in one task: they run in Python workers, on bounded inputs only."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

from ..functions.theory import BASE_CASE, contraction_target, recursion_trials


def dense_ids(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Endpoints as 0 .. n - 1, and the vertices that these stand for."""
    names, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return flat[: len(src)], flat[len(src) :], names


def component_labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each of n vertices the least vertex of its component, by label propagation with pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[src], label[dst])
        after = label.copy()
        np.minimum.at(after, label[src], low)
        np.minimum.at(after, label[dst], low)
        while True:
            jumped = after[after]
            if np.array_equal(jumped, after):
                break
            after = jumped
        if np.array_equal(after, label):
            return label
        label = after


def prefix_components(n: int, src: np.ndarray, dst: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """(edges, labels): the shortest prefix of an ordered edge list that leaves k components, and each vertex's label then; all edges where no prefix does."""
    def left(m: int) -> tuple[int, np.ndarray]:
        labels = component_labels(n, src[:m], dst[:m])
        return len(np.unique(labels)), labels

    low, high = 0, len(src)
    if left(high)[0] > k:
        return high, left(high)[1]
    while low < high:  # the count of components falls as the prefix grows
        middle = (low + high) // 2
        if left(middle)[0] <= k:
            high = middle
        else:
            low = middle + 1
    return low, left(low)[1]


def to_matrix(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The symmetric weight matrix without loops; parallel edges add up."""
    m = np.zeros((n, n), np.int64)
    np.add.at(m, (src, dst), weight)
    np.add.at(m, (dst, src), weight)
    np.fill_diagonal(m, 0)
    return m


def contract_matrix(m: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows and columns of equal label (0 .. k - 1) added up, without loops."""
    k = int(labels.max()) + 1
    rows = np.zeros((k, m.shape[1]), m.dtype)
    np.add.at(rows, labels, m)
    out = np.zeros((k, k), m.dtype)
    np.add.at(out.T, labels, rows.T)
    np.fill_diagonal(out, 0)
    return out


def stoer_wagner(m: np.ndarray) -> tuple[int, np.ndarray]:
    """(value, side) of a minimum cut of a symmetric weight matrix of two vertices or more; exact, O(n^3)."""
    m = m.copy()
    n = len(m)
    groups = np.eye(n, dtype=bool)
    alive = np.ones(n, bool)
    best, side = None, groups[0]
    for phase in range(n, 1, -1):
        reach = np.where(alive, 0, -1)
        last = before = -1
        value = 0
        pending = alive.copy()
        for _ in range(phase):
            v = int(np.argmax(np.where(pending, reach, -1)))
            before, last, value = last, v, int(reach[v])
            pending[v] = False
            reach = reach + m[v]
        if best is None or value < best:
            best, side = value, groups[last].copy()
        m[before] += m[last]
        m[:, before] = m[before]
        m[before, before] = 0
        m[last] = m[:, last] = 0
        groups[before] |= groups[last]
        alive[last] = False
    return best, side


def _scan_first_search(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, bound: int) -> np.ndarray:
    """Labels of vertices that no cut below bound separates: in a maximum-adjacency order a vertex is joined to the scanned one once its attachment reaches the bound."""
    ends, others, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
    order = np.argsort(ends, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]).tolist()
    others, w = others[order].tolist(), w[order].tolist()
    attached, open_ = [0] * n, [True] * n
    parent = list(range(n))
    heap: list[tuple[int, int]] = []
    for root in range(n):
        if not open_[root]:
            continue
        heap.append((0, root))
        while heap:
            _, v = heappop(heap)
            if not open_[v]:
                continue
            open_[v] = False
            for at in range(first[v], first[v + 1]):
                u = others[at]
                if open_[u]:
                    was = attached[u]
                    if was >= bound:  # joined, and before all others in the queue, already; this edge joins it too
                        parent[u] = v
                        continue
                    now = attached[u] = was + w[at]
                    heappush(heap, (-now if now < bound else -bound, u))
                    if now >= bound:
                        parent[u] = v
    # each vertex points to one that was scanned earlier
    label = np.array(parent)
    while True:
        after = label[label]
        if np.array_equal(after, label):
            return label
        label = after


def forest_cut(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[int, np.ndarray]:
    """(value, side) of a minimum cut of a connected graph, exact: phases of maximum-adjacency orders contract what the best cut so far cannot separate (Nagamochi, Ono and Ibaraki)."""
    labels = np.arange(n)
    best, side = None, np.zeros(n, bool)
    while True:
        low, high = np.minimum(src, dst), np.maximum(src, dst)
        apart = low != high
        key, where = np.unique(low[apart] * n + high[apart], return_inverse=True)
        summed = np.zeros(len(key), np.int64)
        np.add.at(summed, where, weight[apart])
        weight = summed
        src, dst = key // n, key % n
        size = int(labels.max()) + 1
        degree = np.zeros(size, np.int64)
        np.add.at(degree, src, weight)
        np.add.at(degree, dst, weight)
        weakest = int(np.argmin(degree))
        if best is None or degree[weakest] < best:
            best, side = int(degree[weakest]), labels == weakest
        if size <= 2:
            return best, side
        found = _scan_first_search(size, src, dst, weight, best)
        names, dense = np.unique(found, return_inverse=True)
        if len(names) < 2:
            return best, side
        if len(names) == size:
            return best, side  # only without edges
        labels, src, dst = dense[labels], dense[src], dense[dst]


def inseparable(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, bound: int, most_classes: int = 32) -> np.ndarray:
    """For each vertex the least of a group that no cut below bound separates, by what the edges at hand prove: in any larger graph that holds them it is so too.

    Ends of an edge of weight bound belong together. Else edges are dealt at random into classes, a heavier edge into several; vertices that are connected within every class have as many
    disjoint paths as there are classes, each of unit weight or more. What belongs together is contracted, again and again, until two drawings in a row join nothing.
    """
    labels, rng, idle = np.arange(n), np.random.default_rng(n), 0
    while True:
        low, high = np.minimum(src, dst), np.maximum(src, dst)
        apart = low != high
        size = int(labels.max()) + 1 if n else 0
        ends = low[apart] * size + high[apart]
        del low, high  # of millions of edges each array counts
        key, where = np.unique(ends, return_inverse=True)
        if not len(key):
            break
        summed = np.zeros(len(key), np.int64)
        np.add.at(summed, where, weight[apart])
        del ends, where, apart
        src, dst, weight = key // size, key % size, summed
        strong = weight >= bound
        if strong.any():
            found = component_labels(size, src[strong], dst[strong])
        else:
            unit = -(-bound // most_classes)
            classes = -(-bound // unit)
            copies = np.minimum(weight // unit, classes)
            row = np.repeat(np.arange(len(key)), copies)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            at = (rng.integers(classes, size=len(key))[row] + nth) % classes * size
            a, b = at + src[row], at + dst[row]
            del copies, row, nth, at
            group = np.zeros(size, np.int64)
            for one in component_labels(classes * size, a, b).reshape(classes, size):
                group = np.unique(group * (classes * size) + one, return_inverse=True)[1]
            found = np.unique(group, return_index=True)[1][group]
        names, dense = np.unique(found, return_inverse=True)
        idle = idle + 1 if len(names) == size else 0
        if idle == 2:
            break
        labels, src, dst = dense[labels], dense[src], dense[dst]
    return np.unique(labels, return_index=True)[1][labels] if n else labels


def contract_to(m: np.ndarray, target: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, labels) after random contraction, by weight, to target vertices (more, if the graph has more components).

    Edges in the order of exponential scores are contracted in Karger's order; the shortest prefix that leaves target components is one step.
    """
    i, j = np.nonzero(np.triu(m, 1))
    order = np.argsort(rng.exponential(size=len(i)) / m[i, j], kind="stable")
    _, labels = prefix_components(len(m), i[order], j[order], target)
    labels = np.unique(labels, return_inverse=True)[1]
    return contract_matrix(m, labels), labels


def recursive_cut(m: np.ndarray, rng: np.random.Generator, base: int = BASE_CASE) -> tuple[int, np.ndarray]:
    """(value, side) of the best cut of one recursive contraction with two branches; below base vertices it is exact."""
    n = len(m)
    if n <= base:
        return stoer_wagner(m)
    best: tuple[int, np.ndarray] | None = None
    for _ in range(2):
        smaller, labels = contract_to(m, max(2, min(contraction_target(n), n - 1) if base == BASE_CASE else int(np.ceil(n / np.sqrt(2))) + 1), rng)
        if len(smaller) < 2:
            continue
        if len(smaller) >= n:  # not connected enough to contract
            value, side = stoer_wagner(smaller)
        else:
            value, side = recursive_cut(smaller, rng, base)
        if best is None or value < best[0]:
            best = value, side[labels]
    return best if best is not None else stoer_wagner(m)


def cut_trial(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: int, seed: int, base: int = BASE_CASE) -> tuple[int, np.ndarray]:
    """(value, side) of one trial: shrink the edge list to size vertices by weighted random contraction, then contract recursively."""
    rng = np.random.default_rng(seed)
    labels = np.arange(n)
    if size < n:
        order = np.argsort(rng.exponential(size=len(src)) / weight, kind="stable")
        labels = np.unique(prefix_components(n, src[order], dst[order], max(2, size))[1], return_inverse=True)[1]
    k = int(labels.max()) + 1
    value, side = recursive_cut(to_matrix(k, labels[src], labels[dst], weight), rng, base)
    return value, side[labels]


def recursive_cut_once(m: np.ndarray, rng: np.random.Generator, base: int = BASE_CASE) -> tuple[int, np.ndarray]:
    """As recursive_cut, but contracted once before the two branches."""
    if len(m) <= base:
        return stoer_wagner(m)
    smaller, labels = contract_to(m, max(2, int(np.ceil(len(m) / np.sqrt(2))) + 1), rng)
    value, side = min((recursive_cut(smaller, rng, base) for _ in range(2)), key=lambda x: x[0])
    return value, side[labels]


def karger_stein(m: np.ndarray, success: float = 0.9, seed: int = 0, base: int = BASE_CASE) -> tuple[int, np.ndarray]:
    """(value, side) of the best of as many recursive contractions as find a minimum cut with the given probability; success 0 asks for one."""
    trials = recursion_trials(len(m), success)
    return min((recursive_cut(m, np.random.default_rng((seed, t)), base) for t in range(trials)), key=lambda x: x[0])
