"""Grid, duplicate and statistics operators: projections and partial aggregates by voxel or slice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import clip, morton3, norm_l1

AXES = ("x", "y", "z")
ATTRIBUTES = {"r": 255, "g": 255, "b": 255, "refl": 32767}


def bbox(points: DataFrame, *by: str) -> DataFrame:
    """True minima and maxima, of negative axes too."""
    sides = [f(c).alias(f"{name}_{c}") for c in AXES for name, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(*by).agg(*sides)


def bbox_grid(points: DataFrame, step: float) -> DataFrame:
    """Origin (floor of the minima) and cells per axis of the quantised cloud."""
    box = bbox(points)
    origin = [F.floor(f"min_{c}").cast("long").alias(f"origin_{c}") for c in AXES]
    size = [(F.round((F.col(f"max_{c}") - F.floor(f"min_{c}")) / step) + 1).cast("long").alias(f"size_{c}") for c in AXES]
    return box.select(*origin, *size)


def shift_to_origin(points: DataFrame) -> DataFrame:
    """Subtracts the floored minima; the box is one row, so it is broadcast."""
    box = bbox(points).select(*[F.floor(f"min_{c}").cast("long").alias(f"origin_{c}") for c in AXES])
    return points.join(F.broadcast(box)).withColumns({c: F.col(c) - F.col(f"origin_{c}") for c in AXES})


def voxelize(points: DataFrame, step: float, prefix: str = "v") -> DataFrame:
    return points.withColumns({f"{prefix}{c}": F.round(F.col(c) / step).cast("long") for c in AXES})


def dequantize(points: DataFrame, step: float, origin: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    return points.withColumns({c: F.col(c) * step + o for c, o in zip(AXES, origin)})


def dedupe_first(points: DataFrame, *by: str) -> DataFrame:
    """The first point of every voxel in input order, by partial aggregation."""
    rest = [c for c in points.columns if c not in by]
    return points.groupBy(*by).agg(F.min_by(F.struct(*rest), "point_id").alias("p")).select(*by, "p.*")


def fast_recolor(points: DataFrame, step: float) -> DataFrame:
    """One row per voxel; attributes are means weighted by closeness to the voxel's centre, rounded and clipped."""
    vox = voxelize(points, step)
    apart = norm_l1(*[F.col(c) - F.col(f"v{c}") * step for c in AXES])
    weighted = vox.withColumn("w", F.round(1024 / (0.1 + apart / step)).cast("long"))
    sums = [F.sum(F.col("w") * F.col(a)).alias(a) for a in ATTRIBUTES]
    summed = weighted.groupBy("vx", "vy", "vz").agg(F.sum("w").alias("w"), *sums)
    means = [clip(F.round(F.col(a) / F.col("w")).cast("long"), 0, top).alias(a) for a, top in ATTRIBUTES.items()]
    return summed.select(*[F.col(f"v{c}").alias(c) for c in AXES], *means)


def dedupe_mean(points: DataFrame) -> DataFrame:
    """Plain means per voxel, cut to integers, and how many points merged."""
    means = [F.floor(F.sum(a) / F.count("*")).cast("long").alias(a) for a in ATTRIBUTES]
    return points.groupBy(*AXES).agg(F.count("*").alias("n_points"), *means)


def dup_report(points: DataFrame) -> DataFrame:
    cells = points.groupBy(*AXES).agg(F.count("*").alias("n"))
    return cells.agg(F.sum("n").alias("points_in"), F.count("*").alias("points_out"), (F.sum("n") - F.count("*")).alias("duplicates"))


def voxels(points: DataFrame, bits: int = 7) -> DataFrame:
    """Distinct cells with their Morton codes."""
    return points.select(*AXES).distinct().withColumn("code", morton3(*map(F.col, AXES), bits))


def slice_by_morton(cells: DataFrame, slices: int) -> DataFrame:
    """slice_id per cell: the smallest shift under which the code prefixes span fewer than ``slices`` values.

    Occupied prefixes are numbered densely; they are fewer than ``slices``, so their table is broadcast.
    """
    low, high = cells.agg(F.min("code"), F.max("code")).first()
    if low is None:
        return cells.withColumn("slice_id", F.lit(0))
    shift = next(m for m in range(64) if (high >> m) - (low >> m) < slices)
    prefix = F.shiftright("code", shift).alias("prefix")
    dense = cells.select(prefix).distinct().select("prefix", (F.row_number().over(W.orderBy("prefix")) - 1).alias("slice_id"))
    return cells.withColumn("prefix", prefix).join(F.broadcast(dense), "prefix").drop("prefix")


def octree_level(cells: DataFrame, level: int) -> DataFrame:
    """Nodes of one level with the 8-bit mask of their occupied children."""
    child = F.shiftright("code", 3 * level).bitwiseAND(F.lit(7)).cast("int")
    bits = F.call_function("shiftleft", F.lit(1), child)
    return cells.groupBy(F.shiftright("code", 3 * (level + 1)).alias("node")).agg(F.bit_or(bits).cast("long").alias("occupancy")).withColumn("level", F.lit(level).cast("long"))


def octree(cells: DataFrame, depth: int = 7) -> DataFrame:
    """All levels. Each is grouped from the one below, which has at most as many rows."""
    levels, below = [], cells.select("code")
    for level in range(depth):
        nodes = octree_level(below.withColumn("code", F.shiftleft("code", 3 * level)), level)
        levels.append(nodes)
        below = nodes.select(F.col("node").alias("code"))
    return reduce(DataFrame.unionByName, levels)


def decode_octree(nodes: DataFrame, depth: int = 7) -> DataFrame:
    """Leaf codes from node masks: set bits explode into children, level by level from the root."""
    found = nodes.where(F.col("level") == depth - 1).select("node", "occupancy")
    for level in range(depth - 1, -1, -1):
        bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("occupancy").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
        codes = found.select(F.explode(F.transform(bits, lambda i: F.col("node") * 8 + i)).alias("code"))
        if level == 0:
            return codes
        found = codes.join(nodes.where(F.col("level") == level - 1), F.col("code") == F.col("node")).select("node", "occupancy")
    return found


def residual_stats(residuals: DataFrame, first: int = 512) -> DataFrame:
    """Of the first residuals of every slice: sum, how many are 0, 1 and 2, and the integer mean of the larger ones."""
    head = residuals.withColumn("n", F.row_number().over(W.partitionBy("slice_id").orderBy("pos"))).where(F.col("n") <= first)
    size = F.abs("residual")
    count = lambda c: F.sum(c.cast("long"))
    large = F.sum(F.when(size > 2, size).otherwise(0))
    more = count(size > 2)
    return head.groupBy("slice_id").agg(
        F.sum(size).alias("total"), count(size == 0).alias("n0"), count(size == 1).alias("n1"), count(size == 2).alias("n2"),
        F.when(more > 0, F.floor(large / F.when(more > 0, more))).otherwise(0).cast("long").alias("mean_large"),
    )


def lod_shift(points: DataFrame, shifts: range) -> DataFrame:
    """(slice_id, shift) of points with code and pos; a slice without such a size gives no row."""
    sizes = points.groupBy("slice_id").agg(F.greatest(F.floor(F.count("*") / 100), F.lit(1)).alias("step"))
    rows = points.select("slice_id", "code", "pos", F.explode(F.array(*[F.lit(m).cast("long") for m in shifts])).alias("m")).join(F.broadcast(sizes), "slice_id")
    asked = ((F.col("pos") > 0) & (F.col("pos") % F.col("step") == 0)).cast("long")
    cell = F.call_function("shiftright", F.col("code"), (F.col("m") + 3).cast("int")).alias("cell")
    cells = rows.groupBy("slice_id", "m", cell).agg(F.count("*").alias("n"), F.max((F.col("pos") == 0).cast("long")).alias("head"), F.sum(asked).alias("asked"))
    others = F.sum(F.col("asked") * (F.col("n") - 1 - F.col("head")))
    means = cells.groupBy("slice_id", "m").agg((others / F.when(F.sum("asked") > 0, F.sum("asked"))).alias("mean"))
    return means.where("mean >= 1").groupBy("slice_id").agg((F.min("m") + 3).alias("shift"))
