"""Planning formulas of randomised minimum cuts."""

from __future__ import annotations

import math

#: Graphs of so many vertices are solved without chance, recursion has two branches, a trial first shrinks to 2 sqrt(m) + 1 vertices.
BASE_CASE, FANOUT, SHRINK = 128, 2, 2


def contraction_target(vertices: int) -> int:
    """Vertices left for each branch of the recursion, never fewer than the base case."""
    return max(math.ceil(vertices / math.sqrt(FANOUT)) + 1, BASE_CASE)


def recursion_depth(vertices: int) -> int:
    depth = 0
    while vertices > BASE_CASE:
        vertices, depth = contraction_target(vertices), depth + 1
    return depth


def success_of_recursion(vertices: int) -> float:
    """A lower bound of one recursive contraction's success."""
    sizes = [vertices]
    while sizes[-1] > BASE_CASE:
        sizes.append(contraction_target(sizes[-1]))
    p = 1.0
    for _ in sizes[1:]:
        p = 1.0 - (1.0 - 0.5 * p) ** 2
    return p


def recursion_trials(vertices: int, success: float) -> int:
    """Trials of the recursion that together succeed with the given probability; 0 asks for one trial."""
    if vertices <= BASE_CASE or success == 0:
        return 1
    return max(1, math.ceil(math.log(1.0 - success) / math.log(1.0 - success_of_recursion(vertices)) - 1e-12))


def intermediate_size(vertices: int, edges: int) -> int:
    """Vertices to which a trial shrinks the graph before the recursion."""
    return min(vertices, math.ceil(SHRINK * math.sqrt(edges) + 1))


def cut_trials(vertices: int, edges: int, success: float) -> int:
    """Trials of shrinking and one recursion that together find a minimum cut with the given probability."""
    if edges == 0:
        return 1
    p = success_of_recursion(intermediate_size(vertices, edges))
    return math.ceil(vertices * vertices * math.log(1.0 / (1.0 - success)) / (SHRINK**2 * edges * p))


def approximate_trials(success: float) -> int:
    """Independent thinnings a level of the approximate cut."""
    return math.ceil(math.log(1.0 - success) / math.log(1.0 - math.exp(-0.75)))


def sample_size_unweighted(vertices: int, edges: int, epsilon: float = 0.09, delta: float = 0.2) -> int:
    return min(edges, math.ceil(vertices ** (1 + epsilon / 2) * (1 + delta)))


def sample_size_weighted(vertices: int, epsilon: float = 0.1) -> int:
    return math.ceil(vertices ** (1 + epsilon / 2))


def concurrency(processors: int, trials: int) -> str:
    """low: whole trials on each processor; high: a group of processors for each trial."""
    return "low" if processors < 2 * trials else "high"


def group_size(processors: int, trials: int) -> int:
    """Processors that share a trial at high concurrency: the greatest power of two that fits; 1 at low concurrency."""
    if concurrency(processors, trials) == "low":
        return 1
    return 1 << ((processors // trials).bit_length() - 1)


def trials_each(processors: int, trials: int) -> int:
    return math.ceil(trials / processors)


def trial_shares(trials: int, memory: list[int], copy_bytes: int) -> list[int]:
    """How many of the trials each executor takes, given its memory: as evenly as what fits beside each other allows, in waves where not all fit at once.

    An executor holds memory // copy_bytes trials at a time; one that holds none takes none. Raises ValueError if no executor holds one.
    """
    slots = [m // copy_bytes for m in memory]
    if not any(slots):
        raise ValueError("no executor holds a copy of the graph")
    waves, left = divmod(trials, sum(slots))
    shares = [waves * s for s in slots]
    # the last wave goes to the executors with the most room, one trial each in turn
    order = sorted((i for i, s in enumerate(slots) if s), key=lambda i: (-slots[i], i))
    given = [0] * len(slots)
    while left:
        for i in order:
            if left and given[i] < slots[i]:
                given[i] += 1
                left -= 1
    return [a + b for a, b in zip(shares, given, strict=True)]
