"""Split points between key ranges and the range partition that they define."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Split points up to which the comparison tree is compiled as one expression.
TREE = 512


def pivot_indices(samples: int, partitions: int) -> list[int]:
    """0-based places, in the sorted sample, of the equi-depth split points; none if samples are too few.

    Gaps between neighbouring places differ by one at most.
    """
    if partitions < 1:
        raise ValueError("partitions must be positive")
    if samples < partitions:
        return []
    share, rest = divmod(samples, partitions)
    return [i * share + min(i, rest) for i in range(1, partitions)]


def select_pivots(sample: Sequence[bytes], partitions: int) -> list[bytes]:
    """Equi-depth split points of a sample held by the driver."""
    ordered = sorted(sample)
    return [bytes(ordered[i]) for i in pivot_indices(len(ordered), partitions)]


def weighted_pivots(sample: Sequence[tuple[bytes, int]], partitions: int) -> list[bytes]:
    """Equi-depth split points of a sample of (key, times that it was met)."""
    ordered = sorted(sample)
    places = pivot_indices(sum(n for _, n in ordered), partitions)
    out, upto = [], 0
    for key, n in ordered:
        upto += n
        while len(out) < len(places) and places[len(out)] < upto:
            out.append(bytes(key))
    return out


def collect_pivots(sample: DataFrame, key: str, partitions: int) -> list[bytes]:
    """Split points of a sample of bounded size, which comes to the driver as Arrow batches."""
    return select_pivots(sample.select(key).toArrow().column(0).to_pylist(), partitions)


def tree_of(below, count: int) -> Column:
    """How many of `count` sorted bounds are at most a row's value, where below(i) tells that the value precedes bound i: a balanced tree."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(mid), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, count)


def partition_of(key: Column, pivots: Sequence[bytes]) -> Column:
    """0-based partition of a key: how many split points are at most the key.

    A key equal to a split point belongs to the upper side. A balanced tree of
    comparisons, so a key costs log2(partitions) of them; with over TREE split points
    the tree finds one of about sqrt(partitions) stretches, in which they are counted.
    """
    points = sorted(bytes(p) for p in pivots)
    if len(points) <= TREE:
        return tree_of(lambda i: key < F.lit(points[i]), len(points))
    size = max(-(-len(points) // max(TREE, 1)), math.isqrt(len(points)))
    stretches = [points[k : k + size] for k in range(0, len(points), size)]
    # Stretch k holds the split points after its first one; the tree counts the first ones.
    at = tree_of(lambda i: key < F.lit(stretches[i][0]), len(stretches))
    rest = F.array(F.array().cast("array<binary>"), *[F.array(*map(F.lit, x[1:])) if x[1:] else F.array().cast("array<binary>") for x in stretches])
    inside = F.size(F.filter(F.get(rest, at), lambda p: p <= key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * size + 1 + inside)
