"""Octrees over boxes that are no cubes: some levels halve only the longest axes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


class Level(NamedTuple):
    depth: int
    size: tuple[int, int, int]
    child: tuple[int, int, int]

    @property
    def unsplit(self) -> int:
        """The axes that stay whole: 4 for x, 2 for y, 1 for z."""
        return sum(w for w, a, b in zip((4, 2, 1), self.size, self.child) if a == b)


def schedule(size: tuple[int, int, int], before: int = 0, smallest: int = 0) -> Iterator[Level]:
    """Levels from the root's box (powers of two) to single cells.

    The first ``before`` levels and those whose shortest side has come down to ``smallest`` halve only the longest axes.
    """
    if min(size) < 0 or before < 0 or smallest < 0:
        raise ValueError("sizes and counts are not negative")
    before, smallest, depth = min(before, max(size) - min(size)), min(smallest, min(size)), 0
    while max(size) > 0:
        if min(size) == max(size):
            smallest = 0
        partial = before > depth or min(size) == smallest
        child = tuple(v - (v == max(size) or not partial) for v in size)
        yield Level(depth, size, child)
        size, depth = child, depth + 1


def split_octree(cells: DataFrame, levels: list[Level]) -> DataFrame:
    """depth, nx, ny, nz and the mask of occupied children. Each level is grouped from the one below it, which has at most as many rows."""
    out, below, fine = [], cells.select(*AXES).distinct(), (0, 0, 0)
    for level in reversed(levels):
        if level.child != fine:
            raise ValueError("a level's children are the nodes of the next one")
        halved = [a - b for a, b in zip(level.size, level.child)]
        child = reduce(lambda a, b: a + b, [F.col(c).bitwiseAND(F.lit(1)) * (w * h) for c, w, h in zip(AXES, (4, 2, 1), halved)])
        node = [F.shiftright(c, h).alias(f"n{c}") for c, h in zip(AXES, halved)]
        mask = F.bit_or(F.call_function("shiftleft", F.lit(1), child.cast("int"))).cast("long").alias("occupancy")
        nodes = below.groupBy(*node).agg(mask).withColumn("depth", F.lit(level.depth).cast("long"))
        out.append(nodes)
        below, fine = nodes.select(*[F.col(f"n{c}").alias(c) for c in AXES]), level.size
    return reduce(DataFrame.unionByName, out)
