"""Aggregations, orders, sets, slices, octree and its contexts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import columns as C
from pointweave.operators import contexts, groups, kernels, splits
from pointweave.operators.cuts import Written, shared_place
from pointweave.plans.base import BITS, DEPTH, coded_cells, first_points, loose_points, lossy, point_cloud, points_with_first, query, signed_cloud, sliced, sql_morton
from pointweave.sources.ply import PlyDataSource, scan_ply

SIDES = ", ".join(f"{f}({c}) AS {f}_{c}" for c in "xyz" for f in ("min", "max"))


@query("bbox", "sc", f"SELECT {SIDES} FROM sc")
def bbox(spark, d):
    return groups.bbox(signed_cloud(spark, d))


@query("bbox_grid", "pc", "SELECT " + ", ".join(f"min({c}) AS origin_{c}, CAST(round((max({c}) - min({c})) / 4.0) + 1 AS BIGINT) AS size_{c}" for c in "xyz") + " FROM pc")
def bbox_grid(spark, d):
    return groups.bbox_grid(loose_points(spark, d), 4.0)


@query("slice_bbox", "sliced", f"SELECT slice_id, {SIDES} FROM sliced GROUP BY slice_id")
def slice_bbox(spark, d):
    return groups.bbox(sliced(spark, d), "slice_id")


@query("dedupe_first", "first", "SELECT x, y, z, point_id, r, g, b, refl FROM first")
def dedupe_first(spark, d):
    return groups.dedupe_first(points_with_first(spark, d), "x", "y", "z").select("x", "y", "z", "point_id", "r", "g", "b", "refl")


@query("fast_recolor", "lossy", "SELECT * FROM lossy")
def fast_recolor(spark, d):
    return lossy(spark, d)


@query("dedupe_mean", "pc", "SELECT x, y, z, count(*) AS n_points, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b, CAST(sum(refl) // count(*) AS BIGINT) AS refl FROM pc GROUP BY x, y, z")
def dedupe_mean(spark, d):
    return groups.dedupe_mean(loose_points(spark, d))


@query("dup_report", "pc", "SELECT CAST(count(*) AS BIGINT) AS points_in, count(DISTINCT (x, y, z)) AS points_out, count(*) - count(DISTINCT (x, y, z)) AS duplicates FROM pc")
def dup_report(spark, d):
    return groups.dup_report(loose_points(spark, d))


@query("distinct_voxels", "pc", f"SELECT DISTINCT x, y, z, {sql_morton('x', 'y', 'z', BITS)} AS code FROM pc")
def distinct_voxels(spark, d):
    return groups.voxels(loose_points(spark, d), BITS)


@query("leaf_dup_count", "pc", f"SELECT {sql_morton('x', 'y', 'z', BITS)} AS code, count(*) AS n FROM pc GROUP BY ALL HAVING count(*) > 1")
def leaf_dup_count(spark, d):
    code = C.morton3(*map(F.col, "xyz"), BITS)
    return loose_points(spark, d).groupBy(code.alias("code")).agg(F.count("*").alias("n")).where("n > 1")


@query("octree_occupancy", "coded", "SELECT code >> 6 AS node, CAST(bit_or(1 << CAST((code >> 3) & 7 AS INTEGER)) AS BIGINT) AS occupancy FROM coded GROUP BY ALL")
def octree_occupancy(spark, d):
    return groups.octree_level(coded_cells(spark, d), 1).select("node", "occupancy")


@query("octree_bfs", "nodes", "SELECT CAST(level AS BIGINT) AS level, node, occupancy FROM nodes")
def octree_bfs(spark, d):
    return groups.octree(coded_cells(spark, d), DEPTH).select("level", "node", "occupancy")


@query("octree_dfs", "nodes", "SELECT CAST(level AS BIGINT) AS level, node, row_number() OVER (ORDER BY node << (3 * (level + 1)), level DESC) - 1 AS place FROM nodes WHERE level < 2")
def octree_dfs(spark, d):
    """Depth-first places below level 2; places are counted inside subtrees and moved by their first places."""
    nodes = groups.octree(coded_cells(spark, d), DEPTH).where("level < 2")
    path = F.when(F.col("level") == 0, F.shiftleft("node", 3)).otherwise(F.shiftleft("node", 6))
    rows = nodes.select("level", "node", path.alias("path"), F.shiftright(path, 15).alias("part"))
    counts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("path", F.desc("level"))) - 1
    return rows.withColumn("inside", inside).join(counts, "part").select("level", "node", (F.col("first") + F.col("inside")).cast("long").alias("place"))


@query("octree_leaf", "pc", f"SELECT {sql_morton('x', 'y', 'z', BITS)} AS code, min(point_id) AS first_point, count(*) AS n FROM pc GROUP BY ALL")
def octree_leaf(spark, d):
    return point_cloud(spark, d).groupBy(C.morton3(*map(F.col, "xyz"), BITS).alias("code")).agg(F.min("point_id").alias("first_point"), F.count("*").alias("n"))


SINGLE_SQL = f"""SELECT max(level) AS level, code FROM (SELECT v AS level, code, count(*) OVER (PARTITION BY v, code >> (3 * (v + 1))) AS n FROM coded, range({DEPTH - 1}) t(v)) WHERE n = 1 GROUP BY code"""


@query("octree_single_point", "coded", SINGLE_SQL)
def octree_single_point(spark, d):
    """The highest level at which a point is alone in its node; levels are grouped one by one, without exploding points."""
    cells = coded_cells(spark, d).select("code")
    alone = []
    for v in range(DEPTH - 1):
        node = F.shiftright("code", 3 * (v + 1)).alias("node")
        alone.append(cells.groupBy(node).agg(F.min("code").alias("code"), F.count("*").alias("n")).where("n = 1").select(F.lit(v).cast("long").alias("level"), "code"))
    return contexts.union_all(alone).groupBy("code").agg(F.max("level").alias("level")).select("level", "code")


@query("decode_octree", "coded", "SELECT code FROM coded")
def decode_octree(spark, d):
    return groups.decode_octree(groups.octree(coded_cells(spark, d), DEPTH), DEPTH)


@query("slice_by_morton", "sliced", "SELECT point_id, code, CAST(slice_id AS BIGINT) AS slice_id FROM sliced")
def slice_by_morton(spark, d):
    return sliced(spark, d).select("point_id", "code", "slice_id")


@query("union_slices", "sliced", "SELECT slice_id, point_id, x, y, z FROM sliced")
def union_slices(spark, d):
    """Slices are coded relative to their own corner and put back by it."""
    cells = sliced(spark, d)
    corner = groups.bbox(cells, "slice_id").select("slice_id", *[F.col(f"min_{c}").alias(f"o{c}") for c in "xyz"])
    moved = cells.join(F.broadcast(corner), "slice_id").withColumns({c: F.col(c) - F.col(f"o{c}") for c in "xyz"})
    return moved.select("slice_id", "point_id", *[(F.col(c) + F.col(f"o{c}")).alias(c) for c in "xyz"])


@query("morton_rank", "ordered", "SELECT slice_id, point_id, pos FROM ordered")
def morton_rank(spark, d):
    from pointweave.operators.predict import ranked

    return ranked(sliced(spark, d)).select("slice_id", "point_id", "pos")


@query("shifted_morton_rank", "sliced", f"SELECT slice_id, point_id, row_number() OVER (PARTITION BY slice_id ORDER BY {sql_morton('(x + 42)', '(y + 42)', '(z + 42)', 8)}, point_id) - 1 AS pos2 FROM sliced")
def shifted_morton_rank(spark, d):
    from pointweave.operators.predict import shifted_rank

    return shifted_rank(sliced(spark, d)).select("slice_id", "point_id", "pos2")


@query("sort_codes", "coded", "SELECT code, point_id FROM coded ORDER BY code, point_id")
def sort_codes(spark, d):
    return first_points(spark, d).select("code", "point_id").orderBy("code", "point_id")


@query("sort_lexi", "first", "SELECT x, y, z FROM first ORDER BY x, y, z")
def sort_lexi(spark, d):
    return coded_cells(spark, d).select("x", "y", "z").orderBy("x", "y", "z")


@query("topk_insert", "pc", "SELECT frame, list(point_id ORDER BY refl, point_id)[1:3] AS ids FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY refl, point_id) AS n FROM pc) WHERE n <= 3 GROUP BY frame")
def topk_insert(spark, d):
    best = F.row_number().over(W.partitionBy("frame").orderBy("refl", "point_id"))
    top = point_cloud(spark, d).withColumn("n", best).where("n <= 3")
    return top.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("refl", "point_id"))), lambda x: x["point_id"]).alias("ids"))


SHIFTS = range(0, 60, 3)
_SAMPLED = f"""sized AS (SELECT slice_id, code, pos, greatest(count(*) OVER (PARTITION BY slice_id) // 100, 1) AS step FROM ordered),
cell AS (SELECT slice_id, m, code >> CAST(m + 3 AS INTEGER) AS cell, count(*) AS n, max(CAST(pos = 0 AS INTEGER)) AS head, count(*) FILTER (pos > 0 AND pos % step = 0) AS asked FROM sized, range(0, 60, 3) t(m) GROUP BY ALL),
mean AS (SELECT slice_id, m, sum(asked * (n - 1 - head)) / sum(asked) AS mean FROM cell GROUP BY ALL HAVING sum(asked) > 0)"""


@query("lod_shift", "ordered", f"SELECT * FROM (WITH {_SAMPLED} SELECT slice_id, CAST(min(m) + 3 AS BIGINT) AS shift FROM mean WHERE mean >= 1 GROUP BY slice_id)")
def lod_shift(spark, d):
    """The bits that a layer's cells drop: every hundredth point of a slice asks how many others share its cell; the first size with
    a mean of 1 is enlarged once. The slice's first point is no neighbour."""
    return groups.lod_shift(ranked_points(spark, d), SHIFTS)


def ranked_points(spark, d):
    from pointweave.operators.predict import ranked

    return ranked(sliced(spark, d))


@query("except_flagged", "coded", "SELECT code FROM coded WHERE code NOT IN (SELECT min(code) FROM coded GROUP BY code >> 6)")
def except_flagged(spark, d):
    cells = coded_cells(spark, d).select("code")
    kept = cells.groupBy(F.shiftright("code", 6).alias("cell")).agg(F.min("code").alias("code")).select("code")
    return cells.join(kept, "code", "left_anti")


def level_nodes(spark, d):
    """The nodes of all levels, written once: every context query meets them several times."""
    return Written(groups.octree(coded_cells(spark, d), DEPTH).select("level", "node", "occupancy"), "nodes").df


def _sql_unmorton(c: str, place: int) -> str:
    return "(" + " + ".join(f"((({c} >> {3 * i + place}) & 1) << {i})" for i in range(8)) + ")"


N = f"""n AS MATERIALIZED (SELECT CAST(level AS BIGINT) AS level, node, occupancy, {_sql_unmorton('node', 2)} AS x, {_sql_unmorton('node', 1)} AS y, {_sql_unmorton('node', 0)} AS z FROM nodes)"""


def with_n(body: str, more: str = "") -> str:
    """Further common tables follow the shared chain, so they stand in a nested WITH."""
    return f"SELECT * FROM (WITH {N}{more} {body})"


_OFFSETS = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in ((i, contexts.BLOCK[i]) for i in contexts.FACES_AND_EDGES))
_MASK = f""", o(i, dx, dy, dz) AS (VALUES {_OFFSETS}),
hit AS (SELECT a.level, a.node, CAST(bit_or(1 << i) AS BIGINT) AS mask FROM (SELECT level, node, i, x + dx AS x, y + dy AS y, z + dz AS z FROM n, o) a JOIN n b USING (level, x, y, z) GROUP BY a.level, a.node),
masked AS (SELECT n.level, n.node, occupancy, coalesce(mask, 0) AS mask FROM n LEFT JOIN hit USING (level, node))"""


@query("ctx_parent18", "nodes", with_n("SELECT level, node, mask FROM masked", _MASK))
def ctx_parent18(spark, d):
    return contexts.neighbour_mask(level_nodes(spark, d)).select("level", "node", "mask")


_CHILDREN = ", ".join(f"({c}, {', '.join(map(str, v))})" for c, v in enumerate(contexts.CHILD_NEIGHBOURS))
PARENT_SQL = _MASK + f""", k(child, f0, f1, f2, e0, e1, e2) AS (VALUES {_CHILDREN}),
pctx AS (SELECT level, node, occupancy, child, (((mask >> f0) & 1) + 2 * ((mask >> f1) & 1) + 4 * ((mask >> f2) & 1)) * 4 + ((mask >> e0) & 1) + ((mask >> e1) & 1) + ((mask >> e2) & 1) AS parent_ctx FROM masked, k)"""


@query("ctx_parent_child", "nodes", with_n("SELECT level, node, CAST(child AS INTEGER) AS child, parent_ctx FROM pctx", PARENT_SQL))
def ctx_parent_child(spark, d):
    return contexts.parent_child_context(contexts.neighbour_mask(level_nodes(spark, d))).select("level", "node", "child", "parent_ctx")


#: Per child and axis, where the child before it lies: in the node itself or in its neighbour on that axis.
_BESIDE = ", ".join(f"({c}, {', '.join(f'{int(bool(c & w))}, {c ^ w}' for w in (4, 2, 1))})" for c in range(8))
SIBLING_SQL = f""", beside(child, ix, cx, iy, cy, iz, cz) AS (VALUES {_BESIDE}),
cctx AS (SELECT a.level, a.node, a.occupancy, child, (a.occupancy >> child) & 1 AS bit, ((CASE WHEN ix = 1 THEN a.occupancy ELSE coalesce(p.occupancy, 0) END >> cx) & 1)
 + 2 * ((CASE WHEN iy = 1 THEN a.occupancy ELSE coalesce(q.occupancy, 0) END >> cy) & 1) + 4 * ((CASE WHEN iz = 1 THEN a.occupancy ELSE coalesce(s.occupancy, 0) END >> cz) & 1) AS child_ctx
 FROM n a LEFT JOIN n p ON p.level = a.level AND p.x = a.x - 1 AND p.y = a.y AND p.z = a.z LEFT JOIN n q ON q.level = a.level AND q.x = a.x AND q.y = a.y - 1 AND q.z = a.z
 LEFT JOIN n s ON s.level = a.level AND s.x = a.x AND s.y = a.y AND s.z = a.z - 1, beside)"""


@query("ctx_sibling", "nodes", with_n("SELECT level, node, CAST(child AS INTEGER) AS child, child_ctx, bit FROM cctx", SIBLING_SQL))
def ctx_sibling(spark, d):
    return contexts.causal_context(level_nodes(spark, d)).select("level", "node", "child", "child_ctx", "bit")


COUNTS_SQL = "SELECT level, parent_ctx * 8 + child_ctx AS ctx, CAST(count(*) AS BIGINT) AS n, CAST(sum(bit) AS BIGINT) AS ones FROM pctx JOIN cctx USING (level, node, child) GROUP BY ALL"


@query("context_counts", "nodes", with_n(COUNTS_SQL, PARENT_SQL + SIBLING_SQL))
def context_counts(spark, d):
    """Occupancy bins of mode 0 per level and context."""
    nodes = level_nodes(spark, d)
    parent = contexts.parent_child_context(contexts.neighbour_mask(nodes)).select("level", "node", "child", "parent_ctx")
    own = contexts.causal_context(nodes).select("level", "node", "child", "child_ctx", "bit")
    return parent.join(own, ["level", "node", "child"]).groupBy("level", (F.col("parent_ctx") * 8 + F.col("child_ctx")).alias("ctx")).agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))


_AHEAD_SQL = "SELECT a.level, a.node, CAST(p.node IS NOT NULL AS BIGINT) + 2 * CAST(q.node IS NOT NULL AS BIGINT) + 4 * CAST(s.node IS NOT NULL AS BIGINT) AS ctx FROM n a LEFT JOIN n p ON p.level = a.level AND p.x = a.x + 1 AND p.y = a.y AND p.z = a.z LEFT JOIN n q ON q.level = a.level AND q.x = a.x AND q.y = a.y + 1 AND q.z = a.z LEFT JOIN n s ON s.level = a.level AND s.x = a.x AND s.y = a.y AND s.z = a.z + 1"


@query("ctx_mode1_parent3", "nodes", with_n(_AHEAD_SQL))
def ctx_mode1_parent3(spark, d):
    around = contexts.siblings(level_nodes(spark, d), {"a": (1, 0, 0), "b": (0, 1, 0), "c": (0, 0, 1)})
    some = lambda c: F.when(F.col(c) > 0, 1).otherwise(0).cast("long")
    return around.select("level", "node", (some("a") + 2 * some("b") + 4 * some("c")).alias("ctx"))


_PLANE_JOINS = " ".join(f"LEFT JOIN n {k} ON {k}.level = a.level AND {k}.x = a.x + ({v[0]}) AND {k}.y = a.y + ({v[1]}) AND {k}.z = a.z + ({v[2]})" for k, v in contexts.PLANES.items())
_PLANE_SQL = "SELECT a.level, a.node, " + ", ".join(f"coalesce({k}.occupancy, 0) AS {k}" for k in contexts.PLANES) + f" FROM n a {_PLANE_JOINS}"


@query("ctx_mode1_planes", "nodes", with_n(_PLANE_SQL))
def ctx_mode1_planes(spark, d):
    return contexts.siblings(level_nodes(spark, d), contexts.PLANES).select("level", "node", *contexts.PLANES)


def _bit(s) -> str:
    return f"((a.occupancy >> {s[1]}) & 1)" if s[0] == "u" else f"((coalesce({s[0]}.occupancy, 0) >> {s[1]}) & 1)"


_CHILD_SQL = " UNION ALL ".join(
    f"SELECT a.level, a.node, {c} AS child, {_bit(s[0])} + 2 * {_bit(s[1])} + 4 * {_bit(s[2])} AS face, 2 * ({_bit(s[3])} + 2 * {_bit(s[4])} + 4 * {_bit(s[5])}) + {_bit(s[6])} AS extern, (a.occupancy >> {c}) & 1 AS bit FROM n a {_PLANE_JOINS}"
    for c, s in contexts.CHILD_SOURCES.items()
)


@query("ctx_mode1_child", "nodes", with_n(_CHILD_SQL))
def ctx_mode1_child(spark, d):
    return contexts.plane_context(level_nodes(spark, d)).select("level", "node", "child", "face", "extern", "bit")


_CTX1 = "CASE WHEN face = 0 AND extern = 0 THEN child * 8 + ctx ELSE 64 + 8 * extern + face END"


@query("context_counts_mode1", "nodes", with_n(f"SELECT level, CAST({_CTX1} AS BIGINT) AS context, CAST(count(*) AS BIGINT) AS n, CAST(sum(bit) AS BIGINT) AS ones FROM ({_CHILD_SQL}) JOIN ({_AHEAD_SQL}) USING (level, node) GROUP BY ALL"))
def context_counts_mode1(spark, d):
    """Occupancy bins of mode 1 per level and context."""
    bins = contexts.plane_context(level_nodes(spark, d))
    return bins.groupBy("level", F.col("ctx").alias("context")).agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))


#: The fold of a context's bins, its state packed as surprises, probable, cycle, level.
_LEVEL, _CYCLE, _PROBABLE, _SURPRISES = "(s & 2047)", "((s >> 11) & 3)", "((s >> 13) & 1)", "(s >> 14)"
_RATE, _UP = f"{list(kernels.ADAPT_RATES)}[{_CYCLE} + 1]", f"({_LEVEL} + {list(kernels.ADAPT_STEPS)}[{_CYCLE} + 1])"
_ADAPT = f"""CASE WHEN b = {_PROBABLE} THEN {_LEVEL} - ({_LEVEL} >> {_RATE}) - ({_LEVEL} >> ({_RATE} + 2)) + (greatest({_CYCLE}, 1) << 11) + ({_PROBABLE} << 13) + ({_SURPRISES} << 14)
 WHEN {_UP} >= 1024 THEN 2047 - {_UP} + (least({_CYCLE} + 1, 3) << 11) + ((1 - {_PROBABLE}) << 13) + (({_SURPRISES} + 1) << 14)
 ELSE {_UP} + (least({_CYCLE} + 1, 3) << 11) + ({_PROBABLE} << 13) + (({_SURPRISES} + 1) << 14) END"""
_ADAPTED = f"""SELECT slice_id, ctx, {_LEVEL} AS level, {_CYCLE} AS cycle, {_PROBABLE} AS probable, {_SURPRISES} AS surprises FROM (
 SELECT slice_id, ctx, list_reduce(list_prepend(CAST({kernels.ADAPT_START} AS BIGINT), list(CAST(bit AS BIGINT) ORDER BY node, child)), lambda s, b: CAST({_ADAPT} AS BIGINT)) AS s FROM (
 SELECT (level << 32) + (node >> 9) AS slice_id, parent_ctx * 8 + child_ctx AS ctx, node, child, bit FROM pctx JOIN cctx USING (level, node, child)) GROUP BY slice_id, ctx)"""


@query("ctx_adapt", "nodes", with_n(_ADAPTED, PARENT_SQL + SIBLING_SQL))
def ctx_adapt(spark, d):
    """Adaptive bin models of mode 0 after each slice of 512 node places of a level; the level is the slice's high part."""
    nodes = level_nodes(spark, d)
    parent = contexts.parent_child_context(contexts.neighbour_mask(nodes)).select("level", "node", "child", "parent_ctx")
    own = contexts.causal_context(nodes).select("level", "node", "child", "child_ctx", "bit")
    bins = parent.join(own, ["level", "node", "child"])
    return kernels.adapt_contexts(bins.select((F.shiftleft("level", 32) + F.shiftright("node", 9)).alias("slice_id"), (F.col("parent_ctx") * 8 + F.col("child_ctx")).cast("long").alias("ctx"), (F.col("node") * 8 + F.col("child")).alias("pos"), "bit"))


#: A box that is no cube, its first partial levels and the side from which levels are partial again.
BOX, BEFORE, SMALLEST = (9, 7, 6), 1, 3
_LOW, _HIGH, _PART = "least(sx, sy, sz)", "greatest(sx, sy, sz)", "(k > 0 OR least(sx, sy, sz) = CASE WHEN sx = sy AND sy = sz THEN 0 ELSE m END)"
_HALF = [f"s{c} - CAST(s{c} = {_HIGH} OR NOT {_PART} AS BIGINT)" for c in "xyz"]
_SCHEDULE = f"""WITH RECURSIVE r(depth, sx, sy, sz, k, m) AS (SELECT CAST(0 AS BIGINT), CAST({BOX[0]} AS BIGINT), CAST({BOX[1]} AS BIGINT), CAST({BOX[2]} AS BIGINT), least({BEFORE}, {max(BOX) - min(BOX)}), least({SMALLEST}, {min(BOX)})
 UNION ALL SELECT depth + 1, {', '.join(_HALF)}, greatest(k - 1, 0), CASE WHEN sx = sy AND sy = sz THEN 0 ELSE m END FROM r WHERE {_HIGH} > 0),
c AS (SELECT *, {', '.join(f'{h} AS c{c}' for h, c in zip(_HALF, 'xyz'))} FROM r WHERE {_HIGH} > 0)
SELECT depth, sx, sy, sz, CAST(4 * CAST(sx = cx AS BIGINT) + 2 * CAST(sy = cy AS BIGINT) + CAST(sz = cz AS BIGINT) AS BIGINT) AS unsplit FROM c"""


@query("qtbt_schedule", "", _SCHEDULE)
def qtbt_schedule(spark, d):
    rows = [(v.depth, *v.size, v.unsplit) for v in splits.schedule(BOX, BEFORE, SMALLEST)]
    return spark.createDataFrame(rows, "depth long, sx long, sy long, sz long, unsplit long")


_LEVELS = list(splits.schedule(BOX, BEFORE, SMALLEST))
_SPLIT_SQL = " UNION ALL ".join(
    f"SELECT CAST({v.depth} AS BIGINT) AS depth, " + ", ".join(f"{c} >> {s} AS n{c}" for c, s in zip("xyz", v.size)) + ", CAST(bit_or(1 << CAST("
    + " + ".join(f"(({c} >> {b}) & 1) * {w if a > b else 0}" for c, w, a, b in zip("xyz", (4, 2, 1), v.size, v.child)) + " AS INTEGER)) AS BIGINT) AS occupancy FROM first GROUP BY ALL"
    for v in _LEVELS
)


@query("qtbt_octree", "first", _SPLIT_SQL)
def qtbt_octree(spark, d):
    """Nodes of every level of a box whose levels partly halve only the longest axes."""
    return splits.split_octree(loose_points(spark, d), _LEVELS)


_HALVES = ", ".join(f"({v}, {3 * v + 2})" for v in range(DEPTH))


@query("occ_lookup", "nodes", with_n(f"SELECT q.level, q.node, coalesce(n.occupancy, 0) AS occupancy FROM (SELECT DISTINCT CAST(v AS BIGINT) AS level, code >> m AS node FROM coded, (VALUES {_HALVES}) t(v, m)) q LEFT JOIN n USING (level, node)"))
def occ_lookup(spark, d):
    """Occupancy of asked places on every level, 0 where no node is; the places are codes cut one bit short, so that some are empty."""
    halves = F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("level"), F.shiftright("code", 3 * v + 2).alias("node")) for v in range(DEPTH)]))
    asked = coded_cells(spark, d).select(halves.alias("q")).select("q.*").distinct()
    return asked.join(level_nodes(spark, d), ["level", "node"], "left").select("level", "node", F.coalesce("occupancy", F.lit(0).cast("long")).alias("occupancy"))


@query("child_occ_lookup", "nodes", with_n("SELECT level, x * 2 + (c >> 2) AS cx, y * 2 + ((c >> 1) & 1) AS cy, z * 2 + (c & 1) AS cz, ((occupancy >> c) & 1) = 1 AS occupied FROM n, range(8) t(c)"))
def child_occ_lookup(spark, d):
    cells = contexts.with_cell(level_nodes(spark, d)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = lambda w: F.shiftright("c", w).bitwiseAND(F.lit(1))
    places = [(F.col(a) * 2 + bit(w)).alias(f"c{a}") for a, w in (("x", 2), ("y", 1), ("z", 0))]
    return cells.select("level", *places, (F.call_function("shiftright", F.col("occupancy"), F.col("c")).bitwiseAND(F.lit(1)) == 1).alias("occupied"))


_HELD = " UNION ALL ".join(f"SELECT CAST({v} AS BIGINT) AS level, code >> {3 * (v + 1)} AS node, count(*) AS n FROM coded GROUP BY ALL" for v in range(DEPTH))


@query("occ_insert", "nodes", f"SELECT CAST(a.level AS BIGINT) AS level, a.node, CASE WHEN k.n = 1 THEN 0 ELSE a.occupancy END AS occupancy FROM nodes a JOIN ({_HELD}) k ON k.level = a.level AND k.node = a.node")
def occ_insert(spark, d):
    """A node of a single point is recorded with occupancy 0."""
    held = F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("level"), F.shiftright("code", 3 * (v + 1)).alias("node")) for v in range(DEPTH)]))
    count = coded_cells(spark, d).select(held.alias("h")).groupBy("h.level", "h.node").agg(F.count("*").alias("n"))
    return level_nodes(spark, d).join(count, ["level", "node"]).select("level", "node", F.when(F.col("n") == 1, 0).otherwise(F.col("occupancy")).alias("occupancy"))


@query("history_swap", "nodes", "SELECT CAST(a.level AS BIGINT) AS level, a.node, b.occupancy AS parent_occupancy FROM nodes a JOIN nodes b ON b.level = a.level + 1 AND b.node = a.node >> 3")
def history_swap(spark, d):
    nodes = level_nodes(spark, d)
    parents = nodes.select((F.col("level") - 1).alias("level"), F.col("node").alias("parent"), F.col("occupancy").alias("parent_occupancy"))
    return nodes.withColumn("parent", F.shiftright("node", 3)).join(parents, ["level", "parent"]).select("level", "node", "parent_occupancy")


def _through_files(spark, d, encoding):
    """The lossy cloud written as PLY files by its tasks and scanned again."""
    spark.dataSource.register(PlyDataSource)
    place = shared_place(spark, "ply")
    lossy(spark, d).write.format("ply").option("encoding", encoding).mode("append").save(place)
    return scan_ply(spark, place).select("x", "y", "z", *[F.col(c).cast("long").alias(c) for c in ("r", "g", "b", "refl")])


_FILES = "SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, r, g, b, refl FROM lossy"


@query("ply_ascii", "lossy", _FILES)
def ply_ascii(spark, d):
    return _through_files(spark, d, "ascii")


@query("ply_binary", "lossy", _FILES)
def ply_binary(spark, d):
    return _through_files(spark, d, "binary_little_endian")
