"""Attribute prediction at quantisation parameter 0, where reconstruction equals the input: windows and joins.

Rows: slice_id, point_id, x, y, z, code, r, g, b, refl, one for each cell.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import hilbert3, morton3, norm_l1

SHIFT = 42
#: Positions of a stretch, which bounds a task; a key beyond every distance.
CHUNK, FAR = 65_536, np.int64(1) << 62
#: Candidate cells in order: one axis back (weight 2), then two axes back (weight 1).
COLOR_STEPS = ((-1, 0, 0, 2), (0, -1, 0, 2), (0, 0, -1, 2), (-1, -1, 0, 1), (-1, 0, -1, 1), (0, -1, -1, 1))


def ranked(points: DataFrame, name: str = "pos") -> DataFrame:
    """Position in Morton order inside the slice."""
    return points.withColumn(name, F.row_number().over(W.partitionBy("slice_id").orderBy("code", "point_id")).cast("long") - 1)


def hilbert_ranked(points: DataFrame, bits: int, name: str = "pos") -> DataFrame:
    """Position in Hilbert order inside the slice; the code is kept as hilbert."""
    coded = points.withColumn("hilbert", hilbert3(*map(F.col, "xyz"), bits))
    return coded.withColumn(name, F.row_number().over(W.partitionBy("slice_id").orderBy("hilbert", "point_id")).cast("long") - 1)


def shifted_rank(points: DataFrame, name: str = "pos2") -> DataFrame:
    """Position in the order of codes shifted by 42 on every axis."""
    code = morton3(F.col("x") + SHIFT, F.col("y") + SHIFT, F.col("z") + SHIFT)
    return points.withColumn(name, F.row_number().over(W.partitionBy("slice_id").orderBy(code, "point_id")).cast("long") - 1)


def color_neighbours(points: DataFrame, reach: int = 128) -> DataFrame:
    """(slice_id, pos, step, weight, r, g, b) of the candidates among the last ``reach`` points."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), *[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "dz", "weight"), s)]) for i, s in enumerate(COLOR_STEPS)]))
    spread = points.select("slice_id", "pos", "x", "y", "z", steps.alias("s"))
    spread = spread.select("slice_id", "pos", "s.step", "s.weight", *[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "xyz"])
    other = points.select("slice_id", "x", "y", "z", F.col("pos").alias("npos"), "r", "g", "b")
    met = spread.join(other, ["slice_id", "x", "y", "z"])
    return met.where((F.col("npos") < F.col("pos")) & (F.col("npos") >= F.col("pos") - reach)).select("slice_id", "pos", "step", "weight", "npos", "r", "g", "b")


def predict_color(points: DataFrame, reach: int = 128) -> DataFrame:
    """Weighted integer means of all six candidates; with several, g and b come from the first; none: the point before."""
    near = color_neighbours(points, reach)
    sums = [F.sum(F.col("weight") * F.col(c)).alias(f"s_{c}") for c in "rgb"]
    first = [F.min_by(c, "step").alias(f"f_{c}") for c in "gb"]
    met = near.groupBy("slice_id", "pos").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), *sums, *first)
    before = W.partitionBy("slice_id").orderBy("pos")
    joined = points.join(met, ["slice_id", "pos"], "left")
    out = []
    for c in "rgb":
        mean = F.floor(F.col(f"s_{c}") / F.col("w")).cast("long")
        own = mean if c == "r" else F.when(F.col("n") > 1, F.col(f"f_{c}")).otherwise(mean)
        out.append(F.coalesce(own, F.lag(c).over(before), F.lit(0)).cast("long").alias(f"pred_{c}"))
    return joined.select("slice_id", "pos", "r", "g", "b", *out)


def inverse_distance(neighbours: Column) -> Column:
    """Prediction from three (distance, value) structs in product form with integer division; zero distances are averaged."""
    w = [F.get(neighbours, F.lit(i))["d"] for i in range(3)]
    v = [F.get(neighbours, F.lit(i))["v"] for i in range(3)]
    # Integer division: a double's would be wrong past 2 ** 53.
    over = w[1] * w[2] * v[0] + w[0] * w[2] * v[1] + w[0] * w[1] * v[2]
    under = w[0] * w[1] + w[1] * w[2] + w[0] * w[2]
    zeros = reduce(lambda a, b: a + b, [F.when(d == 0, x).otherwise(0) for d, x in zip(w, v)])
    count = reduce(lambda a, b: a + b, [F.when(d == 0, 1).otherwise(0) for d in w])
    whole = lambda a, b: F.call_function("div", a.cast("long"), F.when(b != 0, b).cast("long"))
    return F.when(under > 0, whole(over, under)).otherwise(whole(zeros, count))


def previous_nearest(points: DataFrame, reach: int = 128, k: int = 3) -> DataFrame:
    """near: the k nearest (L1) of the previous ``reach`` points as (d, back, v), nearer ones and then later ones first.

    Stretches of CHUNK positions are tasks of their own; the last ``reach`` points before a stretch are dealt to it too.
    """
    own = F.floor(F.col("pos") / CHUNK)
    ahead = F.when(F.col("pos") % CHUNK >= CHUNK - reach, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = points.select("slice_id", "pos", "x", "y", "z", "refl", F.explode(ahead).alias("chunk"))
    schema = "slice_id long, pos long, near array<struct<d:long,back:long,v:long>>"

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, x, y, z, refl = (rows[c].to_numpy().astype(np.int64) for c in ("pos", "x", "y", "z", "refl"))
        begin = int(np.searchsorted(pos, rows["chunk"][0].as_py() * CHUNK))
        parts = []
        for at in range(begin, len(pos), 4096):
            here = np.arange(at, min(at + 4096, len(pos)))
            before = here[:, None] - np.arange(1, reach + 1)
            there = np.maximum(before, 0)
            apart = sum(np.abs(c[here, None] - c[there]) for c in (x, y, z))
            keys = np.where(before >= 0, apart * (reach + 1) + np.arange(1, reach + 1), FAR)  # distance, then places back
            best = np.sort(np.partition(keys, k - 1, axis=1)[:, :k], axis=1)
            fine = best < FAR
            d, back = best[fine] // (reach + 1), best[fine] % (reach + 1)
            value = refl[np.repeat(here, fine.sum(axis=1)) - back]
            entries = pa.StructArray.from_arrays([pa.array(d), pa.array(back), pa.array(value)], names=["d", "back", "v"])
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fine.sum(axis=1))]).astype(np.int32)), entries))
        kept = rows.slice(begin)
        near = pa.chunked_array(parts, type=pa.list_(pa.struct([("d", pa.int64()), ("back", pa.int64()), ("v", pa.int64())])))
        return pa.table({"slice_id": kept["slice_id"].cast(pa.int64()), "pos": kept["pos"], "near": near})

    near = dealt.groupBy("slice_id", "chunk").applyInArrow(run, schema)
    return points.join(near, ["slice_id", "pos"])


def after_first_three(prediction: Column) -> Column:
    """First 0, second the point before, third two points weighted with 16 times z, then the given prediction."""
    by = W.partitionBy("slice_id").orderBy("pos")
    lagged = lambda c, n: F.lag(c, n).over(by)
    weight = lambda n: F.abs(F.col("x") - lagged("x", n)) + F.abs(F.col("y") - lagged("y", n)) + 16 * F.abs(F.col("z") - lagged("z", n))
    w1, w2 = weight(1), weight(2)
    third = F.round((w2 * lagged("refl", 1) + w1 * lagged("refl", 2)) / F.when(w1 + w2 > 0, w1 + w2)).cast("long")
    # Cells are distinct, so both weights are never 0.
    return F.when(F.col("pos") == 0, F.lit(0)).when(F.col("pos") == 1, lagged("refl", 1)).when(F.col("pos") == 2, third).otherwise(prediction).cast("long")


def predict_refl(points: DataFrame) -> DataFrame:
    """The three nearest of the last 128 points predict each from the fourth on."""
    return previous_nearest(points).select("slice_id", "pos", "refl", after_first_three(inverse_distance(F.col("near"))).alias("pred_refl"))


def dual_candidates(points: DataFrame) -> DataFrame:
    """near: of four predecessors in Morton order and four in the shifted order that also precede, the three nearest."""
    rows = shifted_rank(points)
    entry = F.struct("pos", "x", "y", "z", F.col("refl").alias("v"))
    first = F.collect_list(entry).over(W.partitionBy("slice_id").orderBy("pos").rowsBetween(-4, -1))
    second = F.collect_list(entry).over(W.partitionBy("slice_id").orderBy("pos2").rowsBetween(-4, -1))
    rows = rows.withColumn("a", first).withColumn("b", second)
    both = F.array_union("a", F.filter("b", lambda s: s["pos"] < F.col("pos")))
    apart = lambda s: norm_l1(*[F.col(c) - s[c] for c in "xyz"])
    near = F.array_sort(F.transform(both, lambda s: F.struct(apart(s).alias("d"), (F.col("pos") - s["pos"]).alias("back"), s["v"].alias("v"))))
    return rows.withColumn("near", F.slice(near, 1, 3)).drop("a", "b")
