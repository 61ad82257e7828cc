"""Nearest neighbours, distortion, attribute transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.functions.columns import psnr
from pointweave.operators import groups, neighbors
from pointweave.operators.cuts import Written
from pointweave.plans.base import STEP, coded_cells, first_points, lossy, point_cloud, query

ATTRS = ("r", "g", "b", "refl")
#: The lossy cloud put back to scale; every coordinate is whole.
BACK = "back AS (SELECT x * 4 AS x, y * 4 AS y, z * 4 AS z, r, g, b, refl, (x * 1000 + y) * 1000 + z AS pid FROM lossy)"
ASK = "ask AS (SELECT point_id AS qid, x, y, z, r, g, b, refl FROM first)"
#: The reconstruction of the transfer queries has one more cell along x, so that some of its points lie apart from all originals.
GROWN = "grown AS (SELECT DISTINCT x, y, z, (x * 250 + y // 4) * 1000 + z // 4 AS pid FROM (SELECT x, y, z FROM back UNION ALL SELECT x + 4, y, z FROM back))"


def _near(name: str, source: str, target: str, side: int) -> str:
    """Pairs of DuckDB: the source's points with all target points in the 27 cells of ``side`` around; no nearest point lies beyond them here."""
    return f"""{name} AS MATERIALIZED (SELECT qid, pid, CAST((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y) + (a.z - p.z) * (a.z - p.z) AS BIGINT) AS d2
 FROM (SELECT qid, x, y, z, x // {side} + i AS cx, y // {side} + j AS cy, z // {side} + k AS cz FROM {source}, range(-1, 2) u(i), range(-1, 2) v(j), range(-1, 2) w(k)) a
 JOIN (SELECT pid, x, y, z, x // {side} AS cx, y // {side} AS cy, z // {side} AS cz FROM {target}) p USING (cx, cy, cz))"""


PAIRS = _near("pairs", "ask", "back", 8)
PUSHES = _near("pairs", "ask", "grown", 8)


def _sql(body: str, *more: str, pairs: str = PAIRS) -> str:
    return f"SELECT * FROM (WITH {', '.join((BACK, GROWN, ASK, pairs, *more))} {body})"


def restored(spark, d):
    """The lossy twin in the source's scale, written once; pid is made of its cell."""
    cells = Written(lossy(spark, d), "lossy").df
    pid = ((F.col("x") * 1000 + F.col("y")) * 1000 + F.col("z")).alias("pid")
    return cells.select(pid, *[(F.col(c) * int(STEP)).alias(c) for c in "xyz"], *ATTRS)


def grown(spark, d):
    """pid, x, y, z: the restored cells and the ones after them along x."""
    cells = restored(spark, d).select("x", "y", "z")
    cells = cells.unionByName(cells.withColumn("x", F.col("x") + int(STEP))).distinct()
    return cells.select(((F.col("x") * 250 + F.floor(F.col("y") / 4)) * 1000 + F.floor(F.col("z") / 4)).alias("pid"), "x", "y", "z")


def asked(spark, d):
    return first_points(spark, d).select(F.col("point_id").alias("qid"), "x", "y", "z", *ATTRS)


_TIED = "tied AS (SELECT qid, pid, d2 FROM pairs JOIN (SELECT qid, min(d2) AS d2 FROM pairs GROUP BY qid) USING (qid, d2))"


@query("knn_exact", "first lossy", _sql("SELECT qid, d2, CAST(n AS BIGINT) AS n FROM (SELECT qid, d2, count(*) AS n, sum(count(*)) OVER (PARTITION BY qid ORDER BY d2) - count(*) AS before FROM pairs GROUP BY qid, d2) WHERE before < 3"))
def knn_exact(spark, d):
    """The three nearest of each query with all that tie with the third, as counts per distance."""
    near = neighbors.nearest(asked(spark, d).select("qid", "x", "y", "z"), restored(spark, d).select("pid", "x", "y", "z"), k=3)
    return near.groupBy("qid", "d2").agg(F.count("*").alias("n"))


@query("knn_ties", "first lossy", _sql("SELECT * FROM tied", _TIED))
def knn_ties(spark, d):
    return neighbors.nearest(asked(spark, d).select("qid", "x", "y", "z"), restored(spark, d).select("pid", "x", "y", "z")).select("qid", "pid", "d2")


@query("tie_pred", "first lossy", _sql("SELECT qid, count(*) AS ties FROM tied GROUP BY qid HAVING count(*) > 1", _TIED))
def tie_pred(spark, d):
    return knn_ties(spark, d).groupBy("qid").agg(F.count("*").alias("ties")).where("ties > 1")


@query("knn_heap", "first lossy", _sql("SELECT qid, pid, d2, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS INTEGER) AS place FROM pairs QUALIFY place <= 2"))
def knn_heap(spark, d):
    from pyspark.sql import Window as W

    near = neighbors.nearest(asked(spark, d).select("qid", "x", "y", "z"), restored(spark, d).select("pid", "x", "y", "z"), k=2)
    return near.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("d2", "pid"))).where("place <= 2").select("qid", "pid", "d2", "place")


@query("radius_search", "first lossy", _sql("SELECT qid, count(*) AS n, CAST(sum(d2) AS BIGINT) AS total FROM pairs WHERE d2 <= 36 GROUP BY qid"))
def radius_search(spark, d):
    near = neighbors.candidates(asked(spark, d).select("qid", "x", "y", "z"), restored(spark, d).select("pid", "x", "y", "z"), 6, 1)
    return near.where("d2 <= 36").groupBy("qid").agg(F.count("*").alias("n"), F.sum("d2").alias("total"))


@query("tied_mean", "first lossy", _sql("SELECT qid, " + ", ".join(f"CAST(round(sum({a}) / count(*)) AS BIGINT) AS {a}" for a in ATTRS) + " FROM tied JOIN back USING (pid) GROUP BY qid", _TIED))
def tied_mean(spark, d):
    near, theirs = knn_ties(spark, d), restored(spark, d).select("pid", *ATTRS)
    return near.join(theirs, "pid").groupBy("qid").agg(*[F.round(F.sum(a) / F.count("*")).cast("long").alias(a) for a in ATTRS])


_FORWARD = "pushed AS MATERIALIZED (SELECT pid, " + ", ".join(f"CAST(round(sum(a.{c}) / count(*)) AS BIGINT) AS {c}" for c in ATTRS) + " FROM tied JOIN ask a USING (qid) GROUP BY pid)"


def _transfer(body: str, *more: str) -> str:
    return _sql(body, _TIED, _FORWARD, *more, pairs=PUSHES)


def _means():
    return [F.round(F.sum(a) / F.count("*")).cast("long").alias(a) for a in ATTRS]


@query("nearest_forward", "first lossy", _transfer("SELECT * FROM pushed"))
def nearest_forward(spark, d):
    """Every original point pushes its attributes to all its nearest reconstructed points; those take means."""
    return _pushed(asked(spark, d), grown(spark, d))


def _pushed(own, cells):
    near = neighbors.nearest(own.select("qid", "x", "y", "z"), cells)
    return near.join(own.select("qid", *ATTRS).hint("merge"), "qid").groupBy("pid").agg(*_means())


@query("projected_mean", "first lossy", _transfer("SELECT pid, refl FROM pushed"))
def projected_mean(spark, d):
    return nearest_forward(spark, d).select("pid", "refl")


_BACKWARD = f"""lonely AS (SELECT pid AS qid, x, y, z FROM grown WHERE pid NOT IN (SELECT pid FROM pushed)),
{_near("far", "lonely", "(SELECT qid AS pid, x, y, z FROM ask)", 8)},
pulled AS (SELECT far.qid AS pid, {', '.join(f'CAST(round(sum({c}) / count(*)) AS BIGINT) AS {c}' for c in ATTRS)} FROM far JOIN (SELECT qid, min(d2) AS d2 FROM far GROUP BY qid) USING (qid, d2) JOIN ask ON ask.qid = far.pid GROUP BY far.qid)"""


@query("nearest_backward", "first lossy", _transfer("SELECT * FROM pulled", _BACKWARD))
def nearest_backward(spark, d):
    """Reconstructed points that nothing was pushed to take the mean of their tied nearest originals."""
    own, cells = asked(spark, d), grown(spark, d)
    return _pulled(own, cells, _pushed(own, cells))


def _pulled(own, cells, pushed):
    lonely = cells.join(pushed.select("pid").hint("merge"), "pid", "left_anti")
    near = neighbors.nearest(lonely.select(F.col("pid").alias("qid"), "x", "y", "z"), own.select(F.col("qid").alias("pid"), "x", "y", "z"))
    met = near.select(F.col("qid").alias("own"), F.col("pid").alias("qid")).join(own.select("qid", *ATTRS).hint("merge"), "qid")
    return met.groupBy(F.col("own").alias("pid")).agg(*_means())


@query("recolour", "first lossy", _transfer("SELECT * FROM pushed UNION ALL SELECT * FROM pulled", _BACKWARD))
def recolour(spark, d):
    own, cells = asked(spark, d), grown(spark, d)
    pushed = Written(_pushed(own, cells), "pushed").df
    return pushed.unionByName(_pulled(own, cells, pushed))


@query("color_transfer", "first lossy", _transfer("SELECT pid, r, g, b FROM pushed UNION ALL SELECT pid, r, g, b FROM pulled", _BACKWARD))
def color_transfer(spark, d):
    return recolour(spark, d).select("pid", "r", "g", "b")


@query("reflectance_transfer", "first lossy", _transfer("SELECT pid, refl FROM pushed UNION ALL SELECT pid, refl FROM pulled", _BACKWARD))
def reflectance_transfer(spark, d):
    return recolour(spark, d).select("pid", "refl")


def _yuv(p: str) -> list[str]:
    r, g, b = (f"CAST({p}{c} AS DOUBLE)" for c in "rgb")
    forms = (f"0.212600::DOUBLE * {r} + 0.715200::DOUBLE * {g} + 0.072200::DOUBLE * {b}", f"-0.114572::DOUBLE * {r} - 0.385428::DOUBLE * {g} + 0.5::DOUBLE * {b} + 128", f"0.5::DOUBLE * {r} - 0.454153::DOUBLE * {g} - 0.045847::DOUBLE * {b} + 128")
    return [f"least(greatest(CAST(round({f}) AS BIGINT), 0), 255)" for f in forms]


def _errors(source: str, target: str, side: int, name: str) -> str:
    """DuckDB's cells of ``side`` around each source point; enough as no nearest point lies beyond them."""
    own, other = _yuv("s."), _yuv("m.")
    mse = ", ".join(f"sum(({a} - {b}) * ({a} - {b})) / count(*) AS {c}_mse" for c, a, b in zip("yuv", own, other))
    hau = ", ".join(f"max((s.{c} - m.{c}) * (s.{c} - m.{c})) AS {c}_hausdorff" for c in "rgb")
    return f"""{name} AS (SELECT sum(d2) / count(*) AS geo_mse, max(d2) AS geo_hausdorff, {mse}, {hau}, sum((s.refl - m.refl) * (s.refl - m.refl)) / count(*) AS refl_mse, max((s.refl - m.refl) * (s.refl - m.refl)) AS refl_hausdorff
FROM (SELECT qid, min(d2) AS d2, {', '.join(f'CAST(round(sum({a}) / count(*)) AS BIGINT) AS {a}' for a in ATTRS)} FROM (
 SELECT s.pid AS qid, t.r, t.g, t.b, t.refl, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) AS d2
 FROM {source} s, range(-1, 2) i(dx), range(-1, 2) j(dy), range(-1, 2) k(dz), {target} t
 WHERE t.x // {side} = s.x // {side} + dx AND t.y // {side} = s.y // {side} + dy AND t.z // {side} = s.z // {side} + dz QUALIFY d2 = min(d2) OVER (PARTITION BY s.pid)) GROUP BY qid) m JOIN {source} s ON s.pid = m.qid)"""


_BOTH = "full_ AS (SELECT point_id AS pid, x, y, z, r, g, b, refl FROM first)"
_FORTH_SQL = f"SELECT * FROM (WITH {BACK}, {_BOTH}, {_errors('full_', 'back', 8, 'f')} SELECT * FROM f)"
_SYM = f"WITH {BACK}, {_BOTH}, {_errors('full_', 'back', 8, 'f')}, {_errors('back', 'full_', 8, 'b')}"
METRICS = ("geo_mse", "geo_hausdorff", "y_mse", "u_mse", "v_mse", "r_hausdorff", "g_hausdorff", "b_hausdorff", "refl_mse", "refl_hausdorff")


def both_clouds(spark, d):
    full = first_points(spark, d).select(F.col("point_id").alias("pid"), "x", "y", "z", *ATTRS)
    return full, restored(spark, d)


def forward(spark, d):
    full, back = both_clouds(spark, d)
    return neighbors.distortion(full, back)


def _part(name: str, columns: tuple[str, ...]) -> None:
    @query(name, "first lossy", f"SELECT {', '.join(columns)} FROM ({_FORTH_SQL})")
    def run(spark, d):
        return forward(spark, d).select(*columns)


_part("geo_mse", ("geo_mse",))
_part("geo_hausdorff", ("geo_hausdorff",))
_part("color_mse", ("y_mse", "u_mse", "v_mse"))
_part("color_hausdorff", ("r_hausdorff", "g_hausdorff", "b_hausdorff"))
_part("refl_mse", ("refl_mse",))
_part("refl_hausdorff", ("refl_hausdorff",))

_PSNR = ", ".join(f"round(10 * log10({k} * {peak}::DOUBLE * {peak}::DOUBLE / {c}_mse), 9) AS {c}_psnr" for c, k, peak in (("geo", 3, 127), ("y", 1, 255), ("u", 1, 255), ("v", 1, 255), ("refl", 1, 65535)))


@query("psnr_report", "first lossy", f"SELECT {_PSNR} FROM ({_FORTH_SQL})")
def psnr_report(spark, d):
    report = neighbors.psnr_report(forward(spark, d), 127.0)
    return report.select(*[F.round(c, 9).alias(c) for c in report.columns])


@query("symmetric_metric", "first lossy", f"SELECT * FROM ({_SYM} SELECT " + ", ".join(f"greatest(f.{c}, b.{c}) AS {c}" for c in METRICS) + " FROM f, b)")
def symmetric_metric(spark, d):
    full, back = both_clouds(spark, d)
    return neighbors.symmetric(neighbors.distortion(full, back), neighbors.distortion(back, full))


_SELF = f"SELECT sqrt(max(d2)) AS resolution FROM (WITH own AS (SELECT point_id AS qid, point_id AS pid, x, y, z FROM first), {_near('pairs', 'own', 'own', 4)} SELECT qid, min(d2) AS d2 FROM pairs WHERE qid <> pid GROUP BY qid)"


@query("intrinsic_resolution", "first", _SELF)
def intrinsic_resolution(spark, d):
    cells = coded_cells(spark, d).select(F.monotonically_increasing_id().alias("pid"), "x", "y", "z")
    near = neighbors.nearest(cells.withColumnRenamed("pid", "qid"), cells, skip_zero=True)
    return near.agg(F.sqrt(F.max("d2").cast("double")).alias("resolution"))


#: Frames lie side by side, this far apart along x, so that no frame's points are near another's.
APART = 1 << 16
_FRAMES = f"""WITH moved AS (SELECT x + frame * {APART} AS x, y, z, min(point_id) AS qid FROM pc GROUP BY 1, 2, 3),
twin AS (SELECT *, row_number() OVER () AS pid FROM (SELECT DISTINCT CAST(round(x / 4.0) AS BIGINT) * 4 AS x, CAST(round(y / 4.0) AS BIGINT) * 4 AS y, CAST(round(z / 4.0) AS BIGINT) * 4 AS z FROM moved)),
{_near('pairs', 'moved', 'twin', 8)}
SELECT avg(db) AS mean_psnr FROM (SELECT x // {APART} AS frame, round(10 * log10(3 * 127.0::DOUBLE * 127 / (sum(d2) / count(*))), 9) AS db FROM (SELECT qid, min(d2) AS d2 FROM pairs GROUP BY qid) JOIN moved USING (qid) GROUP BY 1)"""


@query("frame_average", "pc", f"SELECT * FROM ({_FRAMES})")
def frame_average(spark, d):
    """The mean over frames of the geometry PSNR of each frame against its own lossy twin."""
    moved = point_cloud(spark, d).withColumn("x", F.col("x") + F.col("frame") * APART)
    full = groups.dedupe_first(moved, "x", "y", "z").select(F.col("point_id").alias("qid"), "frame", "x", "y", "z")
    twin = groups.fast_recolor(moved, STEP).select(F.monotonically_increasing_id().alias("pid"), *[(F.col(c) * int(STEP)).alias(c) for c in "xyz"])
    best = neighbors.nearest(full.select("qid", "x", "y", "z"), twin).groupBy("qid").agg(F.min("d2").alias("d2"))
    per = best.join(full.select("qid", "frame"), "qid").groupBy("frame").agg((F.sum("d2") / F.count("*")).alias("mse"))
    return per.agg(F.avg(F.round(psnr(F.col("mse"), F.lit(127.0), 3), 9)).alias("mean_psnr"))


def flagship(spark, d):
    """Nodes, points and mean reflectance per octree level of the voxelised, recoloured cloud."""
    from pointweave.functions.columns import morton3

    cells = lossy(spark, d).withColumn("code", morton3(*map(F.col, "xyz")))
    nodes = groups.octree(cells, 5)
    total = cells.agg(F.count("*").alias("n_points"), F.avg("refl").alias("mean_refl"))
    return nodes.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum(F.bit_count("occupancy")).alias("n_children")).join(F.broadcast(total))
