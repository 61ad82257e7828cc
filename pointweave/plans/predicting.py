"""Prediction, residuals, symbols and sequential kernels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators import groups, kernels, predict
from pointweave.plans.base import BITS, query, sliced, sql_morton
from pointweave.plans.grouped import SHIFTS
from pointweave.streaming.frames import windowed_counts

QP = 16


def ordered(spark, d):
    return predict.ranked(sliced(spark, d))


_STEPS = ", ".join(f"({i}, {a}, {b}, {c}, {w})" for i, (a, b, c, w) in enumerate(predict.COLOR_STEPS))
_NEAR = f"""k(step, dx, dy, dz, weight) AS (VALUES {_STEPS}),
near AS (SELECT a.slice_id, a.pos, k.step, k.weight, b.pos AS npos, b.r, b.g, b.b FROM ordered a, k, ordered b WHERE b.slice_id = a.slice_id AND b.x = a.x + k.dx AND b.y = a.y + k.dy AND b.z = a.z + k.dz AND b.pos < a.pos AND b.pos >= a.pos - 128)"""


@query("color_neighbors", "ordered", f"SELECT * FROM (WITH {_NEAR} SELECT slice_id, pos, CAST(step AS INTEGER) AS step, CAST(weight AS INTEGER) AS weight, npos FROM near)")
def color_neighbors(spark, d):
    return predict.color_neighbours(ordered(spark, d)).select("slice_id", "pos", "step", "weight", "npos")


PRED_SQL = f"""{_NEAR}, met AS (SELECT slice_id, pos, count(*) AS n, sum(weight) AS w, sum(weight * r) AS sr, sum(weight * g) AS sg, sum(weight * b) AS sb, arg_min(g, step) AS fg, arg_min(b, step) AS fb FROM near GROUP BY ALL),
pred AS (SELECT o.slice_id, o.pos, o.r, o.g, o.b, CAST(coalesce(sr // w, lag(o.r) OVER p, 0) AS BIGINT) AS pred_r, CAST(coalesce(CASE WHEN n > 1 THEN fg ELSE sg // w END, lag(o.g) OVER p, 0) AS BIGINT) AS pred_g,
 CAST(coalesce(CASE WHEN n > 1 THEN fb ELSE sb // w END, lag(o.b) OVER p, 0) AS BIGINT) AS pred_b FROM ordered o LEFT JOIN met USING (slice_id, pos) WINDOW p AS (PARTITION BY slice_id ORDER BY o.pos))"""


@query("pred_color", "ordered", f"SELECT * FROM (WITH {PRED_SQL} SELECT slice_id, pos, pred_r, pred_g, pred_b FROM pred)")
def pred_color(spark, d):
    return predict.predict_color(ordered(spark, d)).select("slice_id", "pos", "pred_r", "pred_g", "pred_b")


@query("residual_color", "ordered", f"SELECT * FROM (WITH {PRED_SQL} SELECT slice_id, pos, r - pred_r AS d0, g - pred_g - (r - pred_r) AS d1, b - pred_b - (g - pred_g) AS d2 FROM pred)")
def residual_color(spark, d):
    """With cross-component prediction: each channel's residual less the one before."""
    p = predict.predict_color(ordered(spark, d))
    d0, d1, d2 = (F.col(c) - F.col(f"pred_{c}") for c in "rgb")
    return p.select("slice_id", "pos", d0.alias("d0"), (d1 - d0).alias("d1"), (d2 - d1).alias("d2"))


@query("recon_color", "ordered", "SELECT slice_id, pos, r, g, b FROM ordered")
def recon_color(spark, d):
    """Residuals put back on their predictions give the colours again."""
    p = predict.predict_color(ordered(spark, d))
    d0, d1, d2 = (F.col(c) - F.col(f"pred_{c}") for c in "rgb")
    coded = p.select("slice_id", "pos", "pred_r", "pred_g", "pred_b", d0.alias("d0"), (d1 - d0).alias("d1"), (d2 - d1).alias("d2"))
    back = [F.col("d0"), F.col("d1") + F.col("d0"), F.col("d2") + F.col("d1") + F.col("d0")]
    return coded.select("slice_id", "pos", *[(F.col(f"pred_{c}") + v).alias(c) for c, v in zip("rgb", back)])


@query("prev_n_nearest", "ordered", """SELECT slice_id, pos, list(d ORDER BY d, back)[1:3] AS distances, list(back ORDER BY d, back)[1:3] AS backs FROM (
 SELECT a.slice_id, a.pos, a.pos - b.pos AS back, abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) AS d FROM ordered a JOIN ordered b ON a.slice_id = b.slice_id AND b.pos BETWEEN a.pos - 128 AND a.pos - 1) GROUP BY slice_id, pos""")
def prev_n_nearest(spark, d):
    near = predict.previous_nearest(ordered(spark, d)).where(F.size("near") > 0)
    return near.select("slice_id", "pos", F.transform("near", lambda n: n["d"]).alias("distances"), F.transform("near", lambda n: n["back"]).alias("backs"))


_IDW = "CASE WHEN w1 * w2 + w2 * w3 + w1 * w3 > 0 THEN (w2 * w3 * v1 + w1 * w3 * v2 + w1 * w2 * v3) // (w1 * w2 + w2 * w3 + w1 * w3) END"
REFL_SQL = f"""pairs AS (SELECT a.slice_id, a.pos, a.pos - b.pos AS back, b.refl AS v, abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) AS d FROM ordered a JOIN ordered b ON a.slice_id = b.slice_id AND b.pos BETWEEN a.pos - 128 AND a.pos - 1),
three AS (SELECT slice_id, pos, l[1][1] AS w1, l[2][1] AS w2, l[3][1] AS w3, l[1][3] AS v1, l[2][3] AS v2, l[3][3] AS v3 FROM (SELECT slice_id, pos, list([d, back, v] ORDER BY d, back)[1:3] AS l FROM pairs GROUP BY ALL)),
lags AS (SELECT *, lag(refl) OVER p AS r1, lag(refl, 2) OVER p AS r2, abs(x - lag(x) OVER p) + abs(y - lag(y) OVER p) + 16 * abs(z - lag(z) OVER p) AS u1, abs(x - lag(x, 2) OVER p) + abs(y - lag(y, 2) OVER p) + 16 * abs(z - lag(z, 2) OVER p) AS u2 FROM ordered WINDOW p AS (PARTITION BY slice_id ORDER BY pos)),
guess AS (SELECT o.slice_id, o.pos, o.refl, CAST(CASE o.pos WHEN 0 THEN 0 WHEN 1 THEN r1 WHEN 2 THEN round((u2 * r1 + u1 * r2) / (u1 + u2)) ELSE {_IDW} END AS BIGINT) AS pred_refl FROM lags o LEFT JOIN three USING (slice_id, pos))"""


@query("hilbert_rank", "hordered", "SELECT slice_id, point_id, hilbert, pos FROM hordered")
def hilbert_rank(spark, d):
    return predict.hilbert_ranked(sliced(spark, d), BITS).select("slice_id", "point_id", "hilbert", "pos")


@query("pred_refl_hilbert", "hordered", f"SELECT * FROM (WITH {REFL_SQL.replace('ordered', 'hordered')} SELECT slice_id, pos, pred_refl FROM guess)")
def pred_refl_hilbert(spark, d):
    return predict.predict_refl(predict.hilbert_ranked(sliced(spark, d), BITS)).select("slice_id", "pos", "pred_refl")


@query("residual_refl", "ordered", f"SELECT * FROM (WITH {REFL_SQL} SELECT slice_id, pos, refl - pred_refl AS residual FROM guess)")
def residual_refl(spark, d):
    p = predict.predict_refl(ordered(spark, d))
    return p.select("slice_id", "pos", (F.col("refl") - F.col("pred_refl")).alias("residual"))


_STATS = """stat AS (SELECT slice_id, CAST(sum(s) AS BIGINT) AS total, count(*) FILTER (s = 0) AS n0, count(*) FILTER (s = 1) AS n1, count(*) FILTER (s = 2) AS n2,
 CAST(coalesce(sum(s) FILTER (s > 2) // nullif(count(*) FILTER (s > 2), 0), 0) AS BIGINT) AS mean_large FROM (SELECT slice_id, abs(refl - pred_refl) AS s FROM guess WHERE pos < 512) GROUP BY slice_id)"""


@query("residual_stats", "ordered", f"SELECT * FROM (WITH {REFL_SQL}, {_STATS} SELECT * FROM stat)")
def residual_stats(spark, d):
    return groups.residual_stats(residual_refl(spark, d))


@query("adapt_decision", "ordered", f"SELECT * FROM (WITH {REFL_SQL}, {_STATS} SELECT slice_id, mean_large > 50 AS switch FROM stat)")
def adapt_decision(spark, d):
    """Per slice: at parameter 0 a mean over 50 switches the predictor."""
    return residual_stats(spark, d).select("slice_id", (F.col("mean_large") > 50).alias("switch"))


_DUAL = f"""two AS (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY {sql_morton('(x + 42)', '(y + 42)', '(z + 42)', 8)}, point_id) - 1 AS pos2 FROM ordered),
cand AS (SELECT DISTINCT a.slice_id, a.pos, a.pos - b.pos AS back, b.refl AS v, abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) AS d FROM two a JOIN two b ON a.slice_id = b.slice_id AND b.pos < a.pos AND (b.pos >= a.pos - 4 OR b.pos2 BETWEEN a.pos2 - 4 AND a.pos2 - 1))"""


@query("dual_order_candidates", "ordered", f"SELECT * FROM (WITH {_DUAL} SELECT slice_id, pos, list(d ORDER BY d, back)[1:3] AS distances, list(back ORDER BY d, back)[1:3] AS backs FROM cand GROUP BY ALL)")
def dual_order_candidates(spark, d):
    near = predict.dual_candidates(ordered(spark, d)).where(F.size("near") > 0)
    return near.select("slice_id", "pos", F.transform("near", lambda n: n["d"]).alias("distances"), F.transform("near", lambda n: n["back"]).alias("backs"))


_LAGS = REFL_SQL[REFL_SQL.index("lags AS") : REFL_SQL.index("guess AS")].rstrip().rstrip(",")


@query("pred_refl_dual", "ordered", f"""SELECT * FROM (WITH {_DUAL}, {_LAGS}, three AS (SELECT slice_id, pos, l[1][1] AS w1, l[2][1] AS w2, l[3][1] AS w3, l[1][3] AS v1, l[2][3] AS v2, l[3][3] AS v3 FROM (SELECT slice_id, pos, list([d, back, v] ORDER BY d, back)[1:3] AS l FROM cand GROUP BY ALL))
 SELECT o.slice_id, o.pos, CAST(CASE o.pos WHEN 0 THEN 0 WHEN 1 THEN r1 WHEN 2 THEN round((u2 * r1 + u1 * r2) / (u1 + u2)) ELSE {_IDW} END AS BIGINT) AS pred_refl FROM lags o LEFT JOIN three USING (slice_id, pos))""")
def pred_refl_dual(spark, d):
    near = predict.dual_candidates(ordered(spark, d))
    return near.select("slice_id", "pos", predict.after_first_three(predict.inverse_distance(F.col("near"))).alias("pred_refl"))


@query("topk_heap", "ordered", "SELECT slice_id, list(refl ORDER BY refl DESC)[1:3] AS top FROM ordered GROUP BY slice_id")
def topk_heap(spark, d):
    best = W.partitionBy("slice_id").orderBy(F.desc("refl"), "pos")
    top = ordered(spark, d).withColumn("n", F.row_number().over(best)).where("n <= 3")
    return top.groupBy("slice_id").agg(F.reverse(F.array_sort(F.collect_list("refl"))).alias("top"))


_BINS = [("zero", "s = 0"), ("one", "s = 1"), ("two", "s = 2"), ("three", "s = 3"), ("escape", "s > 3")]


@query("residual_bins", "ordered", f"SELECT * FROM (WITH {REFL_SQL}, s AS (SELECT slice_id, abs(refl - pred_refl) AS s FROM guess) SELECT slice_id, " + ", ".join(f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}" for n, c in _BINS) + " FROM s GROUP BY slice_id)")
def residual_bins(spark, d):
    """How many residuals end at each step of the binarisation."""
    rows = residual_refl(spark, d).withColumn("s", F.abs("residual"))
    return rows.groupBy("slice_id").agg(*[F.sum(F.expr(c).cast("long")).alias(n) for n, c in _BINS])


@query("duplicate_bins", "pc", "SELECT n - 2 AS escape, count(*) AS cells FROM (SELECT count(*) AS n FROM pc GROUP BY x, y, z) WHERE n > 1 GROUP BY ALL")
def duplicate_bins(spark, d):
    from pointweave.sources.cloud import loose_points

    counts = loose_points(spark, d).groupBy("x", "y", "z").agg(F.count("*").alias("n")).where("n > 1")
    return counts.groupBy((F.col("n") - 2).alias("escape")).agg(F.count("*").alias("cells"))


@query("recon_refl", "ordered", "SELECT slice_id, pos, refl FROM ordered")
def recon_refl(spark, d):
    """Residuals put back on their predictions give the reflectances again."""
    p = predict.predict_refl(ordered(spark, d))
    coded = p.select("slice_id", "pos", "pred_refl", (F.col("refl") - F.col("pred_refl")).alias("residual"))
    return coded.select("slice_id", "pos", (F.col("pred_refl") + F.col("residual")).alias("refl"))


#: The cache as a list, oldest first, one point of every slice a step.
_GAPS = "list_transform(cache, lambda c: abs(c - v[pos + 2]))"
CACHED_SQL = f"""SELECT * FROM (WITH RECURSIVE held AS MATERIALIZED (SELECT slice_id, list(refl ORDER BY pos) AS v FROM ordered GROUP BY slice_id),
run(slice_id, pos, refl, cache_index, pred_refl, cache) AS (SELECT slice_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM held
 UNION ALL SELECT slice_id, pos + 1, own, CAST(place - 1 AS INTEGER), coalesce(cache[place], 0),
  CASE WHEN same > 0 THEN list_transform(cache, lambda c, i: CASE WHEN i = 1 THEN own WHEN i = same THEN cache[1] ELSE c END) WHEN len(cache) = {kernels.CACHE} THEN list_append(cache[2:], own) ELSE list_append(cache, own) END
 FROM (SELECT r.slice_id, pos, cache, v[pos + 2] AS own, coalesce(list_position({_GAPS}, list_min({_GAPS})), 0) AS place, coalesce(list_position(cache, v[pos + 2]), 0) AS same FROM run r JOIN held h ON h.slice_id = r.slice_id WHERE pos + 1 < len(v)))
SELECT slice_id, pos, refl, cache_index, pred_refl FROM run WHERE pos >= 0)"""


@query("pred_refl_cache", "ordered", CACHED_SQL)
def pred_refl_cache(spark, d):
    return kernels.predict_refl_cache(ordered(spark, d))


@query("cache_nearest", "ordered", f"SELECT cache_index, count(*) AS n FROM ({CACHED_SQL}) GROUP BY cache_index")
def cache_nearest(spark, d):
    return kernels.predict_refl_cache(ordered(spark, d)).groupBy("cache_index").agg(F.count("*").alias("n"))


def refl_geometry(spark, d):
    near = predict.previous_nearest(ordered(spark, d))
    return near.withColumn("distances", F.transform("near", lambda n: n["d"])).withColumn("backs", F.transform("near", lambda n: n["back"]))


def color_geometry(spark, d):
    points = ordered(spark, d)
    met = predict.color_neighbours(points).groupBy("slice_id", "pos").agg(F.array_sort(F.collect_list(F.struct("step", "weight", "npos"))).alias("near"))
    none = F.array().cast("array<bigint>")
    weights, places = F.transform("near", lambda n: n["weight"].cast("long")), F.transform("near", lambda n: n["npos"].cast("long"))
    lists = [F.coalesce(weights, none).alias("weights"), F.coalesce(places, none).alias("places")]
    return points.join(met, ["slice_id", "pos"], "left").select("slice_id", "pos", "r", "g", "b", *lists)


@query("encode_refl")
def encode_refl(spark, d):
    return kernels.code_refl(refl_geometry(spark, d), QP).select("slice_id", "pos", "refl", "coded", "recon")


@query("decode_refl")
def decode_refl(spark, d):
    return kernels.decode_refl(kernels.code_refl(refl_geometry(spark, d), QP).drop("refl", "recon"), QP)


@query("encode_refl_lossless", "ordered", f"SELECT * FROM (WITH {REFL_SQL} SELECT slice_id, pos, refl - pred_refl AS coded, refl AS recon FROM guess)")
def encode_refl_lossless(spark, d):
    """At parameter 0 the sequential coder equals the windows over the input."""
    return kernels.code_refl(refl_geometry(spark, d), 0).select("slice_id", "pos", "coded", "recon")


@query("decode_refl_lossless", "ordered", "SELECT slice_id, pos, refl AS recon FROM ordered")
def decode_refl_lossless(spark, d):
    return kernels.decode_refl(kernels.code_refl(refl_geometry(spark, d), 0).drop("refl", "recon"), 0)


@query("encode_color")
def encode_color(spark, d):
    return kernels.code_color(color_geometry(spark, d), QP).drop("weights", "places")


@query("decode_color")
def decode_color(spark, d):
    return kernels.decode_color(kernels.code_color(color_geometry(spark, d), QP).drop("r", "g", "b"), QP)


@query("encode_color_lossless", "ordered", f"SELECT * FROM (WITH {PRED_SQL} SELECT slice_id, pos, r - pred_r AS d0, g - pred_g - (r - pred_r) AS d1, b - pred_b - (g - pred_g) AS d2 FROM pred)")
def encode_color_lossless(spark, d):
    """At parameter 0 the sequential coder equals the windows over the input."""
    return kernels.code_color(color_geometry(spark, d), 0).select("slice_id", "pos", "d0", "d1", "d2")


@query("decode_color_lossless", "ordered", "SELECT slice_id, pos, r, g, b FROM ordered")
def decode_color_lossless(spark, d):
    return kernels.decode_color(kernels.code_color(color_geometry(spark, d), 0).drop("r", "g", "b"), 0)


def layered(spark, d):
    """Layers whose first cells have the size that the slice's sample chose."""
    points = ordered(spark, d)
    return kernels.lod_layers(points.join(F.broadcast(groups.lod_shift(points, SHIFTS)), "slice_id", "left"))


@query("lod_layers")
def lod_layers(spark, d):
    return layered(spark, d)


@query("lod_counts")
def lod_counts(spark, d):
    return layered(spark, d).groupBy("slice_id", "layer").agg(F.count("*").alias("n"))


@query("stream_windows", "", "SELECT CAST(time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_windows(spark, d):
    return windowed_counts(spark.read.parquet(f"{d}/events.parquet"))
