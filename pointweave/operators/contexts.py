"""Neighbour contexts of octree nodes: equi-joins on shifted cells of the same level, one row per node or child.

Nodes: level, node, occupancy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.columns import unmorton

#: Per child the places of its three face and three edge neighbours in a 3x3x3 block in x, y, z order.
CHILD_NEIGHBOURS = (
    (4, 10, 12, 1, 3, 9),
    (4, 10, 14, 1, 5, 11),
    (4, 16, 12, 7, 3, 15),
    (4, 16, 14, 7, 5, 17),
    (22, 10, 12, 19, 21, 9),
    (22, 10, 14, 19, 23, 11),
    (22, 16, 12, 25, 21, 15),
    (22, 16, 14, 25, 23, 17),
)
BLOCK = [(i // 9 - 1, i // 3 % 3 - 1, i % 3 - 1) for i in range(27)]
FACES_AND_EDGES = [i for i, d in enumerate(BLOCK) if 1 <= sum(map(abs, d)) <= 2]


def with_cell(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({c: unmorton(F.col("node"), p) for c, p in (("x", 2), ("y", 1), ("z", 0))})


#: The bits of each axis in a code.
FIELDS = tuple(sum(1 << 3 * i + place for i in range(21)) for place in (2, 1, 0))


def moved(*offset: int) -> Column:
    """Code of the node moved by -1, 0 or 1 on each axis, worked out on the code itself; null outside the codes' space."""
    node, parts, inside = F.col("node"), [], F.lit(True)
    for field, d in zip(FIELDS, offset):
        own, unit = node.bitwiseAND(F.lit(field)), field & -field
        if d > 0:  # with all foreign bits set, a carry passes through them
            parts.append((node.bitwiseOR(F.lit(~field)) + F.lit(unit)).bitwiseAND(F.lit(field)))
            inside = inside & (own != field)
        elif d < 0:
            parts.append((own - F.lit(unit)).bitwiseAND(F.lit(field)))
            inside = inside & (own != 0)
        else:
            parts.append(own)
    return F.when(inside, reduce(lambda a, b: a.bitwiseOR(b), parts))


def neighbour_mask(nodes: DataFrame) -> DataFrame:
    """mask per node: bit i is set if the cell at BLOCK[i] is occupied, for the 18 faces and edges.

    One row per node and offset meets the node table once; the bits come back by a partial aggregate.
    """
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), moved(*BLOCK[i]).alias("other")) for i in FACES_AND_EDGES]))
    spread = nodes.select("level", "node", places.alias("o")).select("level", "node", "o.*").where(F.col("other").isNotNull())
    hit = spread.join(nodes.select("level", F.col("node").alias("other")), ["level", "other"]).groupBy("level", "node").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("i"))).cast("long").alias("mask"))
    return nodes.join(hit, ["level", "node"], "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))


def parent_child_context(masked: DataFrame) -> DataFrame:
    """One row per node and child: the 5-bit context of three face bits and the number of edge neighbours."""
    bit = lambda i: F.shiftright("mask", i).bitwiseAND(F.lit(1))
    contexts = []
    for child, (f0, f1, f2, e0, e1, e2) in enumerate(CHILD_NEIGHBOURS):
        faces = bit(f0) + 2 * bit(f1) + 4 * bit(f2)
        contexts.append(F.struct(F.lit(child).alias("child"), (faces * 4 + bit(e0) + bit(e1) + bit(e2)).alias("parent_ctx")))
    return masked.withColumn("c", F.explode(F.array(*contexts))).select("level", "node", "occupancy", F.col("c.child").alias("child"), F.col("c.parent_ctx").alias("parent_ctx"))


def siblings(nodes: DataFrame, offsets: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Adds for each name the occupancy of the node at that offset, 0 where there is none."""
    out = nodes
    known = nodes.select("level", F.col("node").alias("__other"), F.col("occupancy").alias("__occ"))
    for name, d in offsets.items():
        own = known.withColumnsRenamed({"__occ": name})
        out = out.withColumn("__other", moved(*d)).join(own, ["level", "__other"], "left").drop("__other")
        out = out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def causal_context(nodes: DataFrame) -> DataFrame:
    """One row per node and child: three bits, whether the child beside it on -x, -y, -z is set.

    These children are coded before: they lie in the same byte or in a node with a smaller code.
    """
    around = siblings(nodes, {"px": (-1, 0, 0), "py": (0, -1, 0), "pz": (0, 0, -1)})
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1))
    rows = []
    for child in range(8):
        parts = [bit("occupancy", child - w) if child & w else bit(p, child + w) for w, p in ((4, "px"), (2, "py"), (1, "pz"))]
        rows.append(F.struct(F.lit(child).alias("child"), (parts[0] + 2 * parts[1] + 4 * parts[2]).alias("child_ctx"), bit("occupancy", child).alias("bit")))
    return around.withColumn("c", F.explode(F.array(*rows))).select("level", "node", "occupancy", "c.*")


#: Per child the bits of childX, childY, childZ, leanX, leanY, leanZ and the corner: (neighbour or "u" for the node itself, bit).
PLANES = {"p0": (-1, 0, 0), "p1": (0, -1, 0), "p2": (0, 0, -1), "p3": (-1, -1, 0), "p4": (-1, 0, -1), "p5": (0, -1, -1), "p6": (-1, -1, -1)}
CHILD_SOURCES = {
    0: (("p0", 4), ("p1", 2), ("p2", 1), ("p5", 3), ("p4", 5), ("p3", 6), ("p6", 7)),
    2: (("p0", 6), ("u", 0), ("p2", 3), ("p2", 1), ("p4", 7), ("p0", 4), ("p4", 5)),
    4: (("u", 0), ("p1", 6), ("p2", 5), ("p5", 7), ("p1", 1), ("p1", 2), ("p5", 3)),
    6: (("u", 2), ("u", 4), ("p2", 7), ("p2", 5), ("p2", 3), ("u", 0), ("p2", 1)),
    1: (("p0", 5), ("p1", 3), ("u", 0), ("p1", 2), ("p0", 4), ("p3", 7), ("p3", 6)),
    3: (("p0", 7), ("u", 1), ("u", 2), ("u", 0), ("p0", 6), ("p0", 5), ("p0", 4)),
    5: (("u", 1), ("p1", 7), ("u", 4), ("p1", 6), ("u", 0), ("p1", 3), ("p1", 2)),
    7: (("u", 3), ("u", 5), ("u", 6), ("u", 4), ("u", 2), ("u", 1), ("u", 0)),
}


#: Neighbours whose presence is known from the level above.
AHEAD = {"ax": (1, 0, 0), "ay": (0, 1, 0), "az": (0, 0, 1)}


def plane_context(nodes: DataFrame) -> DataFrame:
    """One row per node and child: face and extern patterns from seven causal neighbours and the node's own earlier bits.

    ctx is the bin's context: child and the neighbours ahead where both patterns are empty, else the patterns.
    """
    around = siblings(nodes, PLANES | AHEAD)
    ahead = sum((F.when(F.col(c) > 0, w).otherwise(0) for c, w in (("ay", 2), ("az", 4))), F.when(F.col("ax") > 0, 1).otherwise(0))
    bit = lambda s: F.shiftright("occupancy" if s[0] == "u" else s[0], s[1]).bitwiseAND(F.lit(1))
    rows = []
    for child, sources in CHILD_SOURCES.items():
        b = [bit(s) for s in sources]
        face, extern = b[0] + 2 * b[1] + 4 * b[2], 2 * (b[3] + 2 * b[4] + 4 * b[5]) + b[6]
        ctx = F.when((face == 0) & (extern == 0), ahead + 8 * child).otherwise(64 + 8 * extern + face).cast("long")
        rows.append(F.struct(F.lit(child).alias("child"), face.alias("face"), extern.alias("extern"), bit(("u", child)).alias("bit"), ctx.alias("ctx")))
    return around.withColumn("c", F.explode(F.array(*rows))).select("level", "node", "c.*")


def entropy_bits(counts: DataFrame, by: list[str]) -> DataFrame:
    """Ideal adaptive-free cost: per context the bits of its ones and zeros under their own shares."""
    n, ones = F.col("n"), F.col("ones")
    part = lambda k: F.when(k > 0, -k * F.log2(k / n)).otherwise(0.0)
    return counts.select(*by, "n", "ones", (part(ones) + part(n - ones)).alias("bits"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
