"""Exact nearest neighbours, ties and distortion on integer clouds.

Points meet by equi-joins on grid cells, never by a range predicate. The first cells are as wide as the points are
apart; a query looks in the 27 cells around its own, and a neighbour closer than the border of what was probed is settled. The
others look again in wider cells, until none is left or the 27 cells hold the whole cloud: no query is ever dropped.
Distances are integers, so ties are exact. Joins with as many rows as points are merges: Spark takes a small file of many points for
a small table, and a broadcast is built in the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.columns import norm_l2sq, psnr, rgb_to_yuv
from pointweave.operators.cuts import Written

AXES = ("x", "y", "z")
CELLS = ("cx", "cy", "cz")
#: Sides tried for the first cells, points per occupied cell that they may hold, and how much wider the next cells are.
FIRST_SIDES, CROWD, WIDER = tuple(1 << i for i in range(21)), 3.0, 4
#: Points that are broadcast to the queries; more are merged with them.
FEW = 50_000


def _cell(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def _meet(queries: DataFrame, points: DataFrame, side: int, reach: int, *keep: str, few: bool, within: str | None = None) -> DataFrame:
    """kept columns of queries, pid and d2 of all points in the cells up to ``reach`` around each query's cell.

    few: the points can be broadcast. within: a column of squared distances; cells that lie farther away than that are left out.
    """
    around = queries
    for n, c in zip(CELLS, AXES):
        around = around.withColumn(n, F.explode(F.sequence(_cell(c, side) - reach, _cell(c, side) + reach)))
    if within:
        apart = [F.greatest(F.col(n) * side - F.col(c), F.col(c) - (F.col(n) + 1) * side + 1, F.lit(0).cast("long")) for n, c in zip(CELLS, AXES)]
        around = around.where(norm_l2sq(*apart) <= F.col(within))
    near = points.select(*[_cell(c, side).alias(n) for n, c in zip(CELLS, AXES)], "pid", *[F.col(c).alias(f"p{c}") for c in AXES])
    d2 = norm_l2sq(*[F.col(c) - F.col(f"p{c}") for c in AXES])
    return around.join(near.hint("broadcast" if few else "merge"), list(CELLS)).select(*keep, "pid", d2.alias("d2"))


def candidates(queries: DataFrame, points: DataFrame, side: int, reach: int) -> DataFrame:
    """(qid, pid, d2) of all points in the cells up to ``reach`` around each query's cell."""
    return _meet(queries, points, side, reach, "qid", few=points.count() <= FEW)


def _plan(queries: DataFrame, points: DataFrame) -> tuple[int, int, bool]:
    """The side of the first cells, the side from which 27 cells hold both clouds, and whether the points can be broadcast."""
    cells = [F.approx_count_distinct(F.struct(*[_cell(c, s) for c in AXES])).alias(f"n{s}") for s in FIRST_SIDES]
    seen = points.agg(F.count("*").alias("n"), *cells, *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in AXES]).first()
    asked = queries.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in AXES]).first()
    if not seen["n"] or asked["min_x"] is None:
        return 1, 1, True
    extent = max(max(seen[f"max_{c}"], asked[f"max_{c}"]) - min(seen[f"min_{c}"], asked[f"min_{c}"]) for c in AXES)
    fit = [s for s in FIRST_SIDES if seen["n"] <= CROWD * max(1, seen[f"n{s}"])]
    return (fit or [1])[-1], extent + 1, seen["n"] <= FEW


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, skip_zero: bool = False) -> DataFrame:
    """(qid, pid, d2): the k nearest points of each query and all that tie with the k-th; k > 1 adds the rank.

    queries: qid, x, y, z; points: pid, x, y, z. For k = 1 only the least distance is aggregated, before any shuffle of
    candidates; the tied points come from a second look into the cells that this distance reaches.
    Equal places are different points; a query without any point (at another place, with skip_zero) gives no row.
    """
    asked, given = Written(queries.select("qid", *AXES), "queries"), Written(points.select("pid", *AXES), "points")
    side, whole, few = _plan(asked.df, given.df)
    found: list[DataFrame] = []
    open_ = asked.df
    while True:
        last = side >= whole
        sure = F.lit(True) if last else F.col("best") < (side + 1) * (side + 1)  # what wasn't probed is over a side away
        near = _meet(open_, given.df, side, 1, "qid", few=few)
        if skip_zero:
            near = near.where("d2 > 0")
        if k == 1:
            best = near.groupBy("qid").agg(F.min("d2").alias("best")).where(sure)
            settled = Written(open_.join(best.hint("merge"), "qid"), "settled")
            found.append(_meet(settled.df, given.df, side, 1, "qid", "best", few=few, within="best").where(F.col("d2") == F.col("best")).drop("best"))
        else:
            ranked = near.withColumn("rank", F.rank().over(W.partitionBy("qid").orderBy("d2"))).where(F.col("rank") <= k)
            known = W.partitionBy("qid")
            ranked = ranked.withColumn("best", F.max("d2").over(known)).withColumn("n", F.count("*").over(known))
            settled = Written(ranked.where(sure if last else sure & (F.col("n") >= k)).select("qid", "pid", "d2", "rank"), "settled")
            found.append(settled.df)
        if last:
            break
        left = Written(open_.join(settled.df.select("qid").distinct().hint("merge"), "qid", "left_anti"), "open")
        if left.df.isEmpty():
            break
        open_, side = left.df, side * WIDER
    return reduce(DataFrame.unionByName, found)


def distortion(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row of error sums from source to target: geometry, YUV and RGB colour, reflectance.

    Both: pid, x, y, z, r, g, b, refl without duplicates. Attributes of tied neighbours are averaged and rounded.
    """
    asked = source.select(F.col("pid").alias("qid"), *AXES)
    ties = nearest(asked, target.select("pid", *AXES))
    attributes = ("r", "g", "b", "refl")
    theirs = target.select("pid", *attributes)
    means = [F.round(F.sum(a) / F.count("*")).cast("long").alias(f"t_{a}") for a in attributes]
    met = ties.join(theirs.hint("merge"), "pid").groupBy("qid").agg(F.min("d2").alias("d2"), *means)
    both = met.join(source.select(F.col("pid").alias("qid"), *attributes).hint("merge"), "qid")
    own, other = rgb_to_yuv(F.col("r"), F.col("g"), F.col("b")), rgb_to_yuv(F.col("t_r"), F.col("t_g"), F.col("t_b"))
    square = {f"{n}": (a - b) * (a - b) for n, a, b in zip("yuv", own, other)}
    square |= {f"{n}": (F.col(n) - F.col(f"t_{n}")) * (F.col(n) - F.col(f"t_{n}")) for n in attributes}
    mean = lambda c: F.sum(c) / F.count("*")
    return both.agg(
        mean(F.col("d2")).alias("geo_mse"), F.max("d2").alias("geo_hausdorff"),
        *[mean(square[c]).alias(f"{c}_mse") for c in "yuv"],
        *[F.max(square[c]).alias(f"{c}_hausdorff") for c in "rgb"],
        mean(square["refl"]).alias("refl_mse"), F.max(square["refl"]).alias("refl_hausdorff"),
    )


def psnr_report(errors: DataFrame, peak: float) -> DataFrame:
    one = F.lit(1.0)
    return errors.select(
        psnr(F.col("geo_mse"), one * peak, 3).alias("geo_psnr"),
        *[psnr(F.col(f"{c}_mse"), one * 255.0).alias(f"{c}_psnr") for c in "yuv"],
        psnr(F.col("refl_mse"), one * 65535.0).alias("refl_psnr"),
    )


def symmetric(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """The worse of both directions, column by column; both have one row."""
    back = backward.select(*[F.col(c).alias(f"__{c}") for c in backward.columns])
    return forward.join(F.broadcast(back)).select(*[F.greatest(c, f"__{c}").alias(c) for c in forward.columns])
