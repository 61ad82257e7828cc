"""Projections, scalar functions, predicates, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.functions import columns as C
from pointweave.operators import groups
from pointweave.plans.base import BITS, loose_points, point_cloud, query, signed_cloud, sql_hilbert, sql_morton
from pointweave.sources.chunks import as_chunk

ID = ("point_id",)


def _clip(x: str) -> str:
    return f"least(greatest(CAST(round({x}) AS BIGINT), 0), 255)"


YUV = [_clip("0.212600 * r + 0.715200 * g + 0.072200 * b"), _clip("-0.114572 * r - 0.385428 * g + 0.5 * b + 128.0"), _clip("0.5 * r - 0.454153 * g - 0.045847 * b + 128.0")]
#: DuckDB reads 0.2126 as a decimal; the sums have to be doubles.
YUV = [y.replace(" * r", "::DOUBLE * r").replace(" * g", "::DOUBLE * g").replace(" * b", "::DOUBLE * b").replace("128.0", "128.0::DOUBLE") for y in YUV]


@query("scan_geom_only", "pc", "SELECT point_id, x, y, z FROM pc")
def scan_geom_only(spark, d):
    return point_cloud(spark, d).select(*ID, "x", "y", "z")


@query("attr_coerce", "pc", "SELECT point_id, CAST(x AS DOUBLE) AS x, CAST(r % 256 AS INTEGER) AS r, CAST((refl * 37 + 32768) % 65536 - 32768 AS INTEGER) AS refl FROM pc")
def attr_coerce(spark, d):
    wrapped = (F.pmod(F.col("refl") * 37 + 32768, F.lit(65536)) - 32768).cast("int")
    return point_cloud(spark, d).select(*ID, F.col("x").cast("double").alias("x"), F.col("r").bitwiseAND(F.lit(255)).cast("int").alias("r"), wrapped.alias("refl"))


@query("scan_frames", "pc", "SELECT frame, count(*) AS n_points, min(point_id) AS first_point FROM pc GROUP BY frame")
def scan_frames(spark, d):
    path = F.format_string("cloud_%04d.ply", "frame")
    return point_cloud(spark, d).groupBy(C.frame_number(path).alias("frame")).agg(F.count("*").alias("n_points"), F.min("point_id").alias("first_point"))


@query("frame_number", "", "SELECT o_orderkey, CAST(regexp_extract('seq_' || o_orderkey || '.ply', '([0-9]+)\\.[^.]*$', 1) AS BIGINT) AS frame FROM orders")
def frame_number(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", C.frame_number(F.concat(F.lit("seq_"), F.col("o_orderkey").cast("string"), F.lit(".ply"))).alias("frame"))


@query("tokenize", "", "SELECT p_partkey, len(list_filter(string_split_regex(p_name || ' ' || p_type, '[ \\t\\r\\n]+'), lambda t: t <> '')) AS n, list_filter(string_split_regex(p_name || ' ' || p_type, '[ \\t\\r\\n]+'), lambda t: t <> '')[2] AS second FROM part")
def tokenize(spark, d):
    tokens = C.tokenize(F.concat_ws(" ", "p_name", "p_type"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.size(tokens).cast("long").alias("n"), F.get(tokens, F.lit(1)).alias("second"))


@query("sink_chunk", "", "SELECT o_orderkey, '000001' || hex(161 + o_orderkey % 7) || hex(encode(o_orderpriority)) AS chunk FROM orders")
def sink_chunk(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", F.hex(as_chunk(161 + F.col("o_orderkey") % 7, F.col("o_orderpriority").cast("binary"))).alias("chunk"))


@query("digest", "pc", "SELECT frame, md5(string_agg(x || ',' || y || ',' || z || ',' || r || ',' || g || ',' || b || ',' || refl, ';' ORDER BY point_id)) AS digest FROM pc GROUP BY frame")
def digest(spark, d):
    """Canonical form: rows in point order, joined; one string per frame."""
    row = F.concat_ws(",", "x", "y", "z", "r", "g", "b", "refl")
    rows = point_cloud(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("point_id", row.alias("s")))).alias("rows"))
    return rows.select("frame", F.md5(F.array_join(F.transform("rows", lambda x: x["s"]), ";").cast("binary")).alias("digest"))


@query("bits_report", "pc", "SELECT frame, CAST(sum(length(x || ',' || y || ',' || z)) * 8 AS BIGINT) AS bits, sum(length(x || ',' || y || ',' || z)) * 8 / count(*) AS bits_per_point FROM pc GROUP BY frame")
def bits_report(spark, d):
    bits = F.sum(F.length(F.concat_ws(",", "x", "y", "z"))) * 8
    return loose_points(spark, d).groupBy("frame").agg(bits.alias("bits"), (bits / F.count("*")).alias("bits_per_point"))


@query("rgb_to_yuv", "pc", f"SELECT point_id, {YUV[0]} AS y, {YUV[1]} AS u, {YUV[2]} AS v FROM pc")
def rgb_to_yuv(spark, d):
    y, u, v = C.rgb_to_yuv(F.col("r"), F.col("g"), F.col("b"))
    return point_cloud(spark, d).select(*ID, y.alias("y"), u.alias("u"), v.alias("v"))


@query("yuv_to_rgb", "pc", f"SELECT point_id, {_clip('r + 1.57480::DOUBLE * (b - 128)')} AS r, {_clip('r - 0.18733::DOUBLE * (g - 128) - 0.46813::DOUBLE * (b - 128)')} AS g, {_clip('r + 1.85563::DOUBLE * (g - 128)')} AS b FROM pc")
def yuv_to_rgb(spark, d):
    r, g, b = C.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return point_cloud(spark, d).select(*ID, r.alias("r"), g.alias("g"), b.alias("b"))


@query("shift_to_origin", "sc", "SELECT vec_id, x - (SELECT min(x) FROM sc) AS x, y - (SELECT min(y) FROM sc) AS y, z - (SELECT min(z) FROM sc) AS z FROM sc")
def shift_to_origin(spark, d):
    return groups.shift_to_origin(signed_cloud(spark, d)).select("vec_id", "x", "y", "z")


@query("voxelize", "sc", "SELECT vec_id, CAST(round(x / 2.5::DOUBLE) AS BIGINT) AS vx, CAST(round(y / 2.5::DOUBLE) AS BIGINT) AS vy, CAST(round(z / 2.5::DOUBLE) AS BIGINT) AS vz FROM sc")
def voxelize(spark, d):
    return groups.voxelize(signed_cloud(spark, d), 2.5).select("vec_id", "vx", "vy", "vz")


@query("dequantize", "sc", "SELECT vec_id, x * 2.5::DOUBLE + 7 AS x, y * 2.5::DOUBLE - 3 AS y, z * 2.5::DOUBLE AS z FROM sc")
def dequantize(spark, d):
    return groups.dequantize(signed_cloud(spark, d), 2.5, (7, -3, 0)).select("vec_id", "x", "y", "z")


@query("clip", "sc", "SELECT vec_id, greatest(-50, least(x, 50)) AS x FROM sc")
def clip(spark, d):
    return signed_cloud(spark, d).select("vec_id", C.clip(F.col("x"), -50, 50).alias("x"))


@query("norm_l1", "sc", "SELECT vec_id, abs(x) + abs(y) + abs(z) AS n FROM sc")
def norm_l1(spark, d):
    return signed_cloud(spark, d).select("vec_id", C.norm_l1(*map(F.col, "xyz")).alias("n"))


@query("norm_l2sq", "sc", "SELECT vec_id, x * x + y * y + z * z AS n FROM sc")
def norm_l2sq(spark, d):
    return signed_cloud(spark, d).select("vec_id", C.norm_l2sq(*map(F.col, "xyz")).alias("n"))


@query("vec_arith", "pc", "SELECT point_id, x + r AS added, y - g AS taken, z * b AS times, x << 3 AS up, (y - g) >> 2 AS down FROM pc")
def vec_arith(spark, d):
    return point_cloud(spark, d).select(*ID, (F.col("x") + F.col("r")).alias("added"), (F.col("y") - F.col("g")).alias("taken"), (F.col("z") * F.col("b")).alias("times"), F.shiftleft("x", 3).alias("up"), F.shiftright(F.col("y") - F.col("g"), 2).alias("down"))


@query("vec_minmax", "pc", "SELECT point_id, least(x, y, z) AS low, greatest(x, y, z) AS high FROM pc")
def vec_minmax(spark, d):
    return point_cloud(spark, d).select(*ID, F.least("x", "y", "z").alias("low"), F.greatest("x", "y", "z").alias("high"))


@query("vec_cmp", "pc", "SELECT point_id, x = r AND y = g AND z = b AS same, (x, y, z) < (r, g, b) AS less FROM pc")
def vec_cmp(spark, d):
    own, other = F.struct("x", "y", "z"), F.struct(F.col("r").alias("x"), F.col("g").alias("y"), F.col("b").alias("z"))
    return point_cloud(spark, d).select(*ID, (own == other).alias("same"), (own < other).alias("less"))


@query("ceil_log2", "pc", "SELECT point_id, CASE WHEN refl <= 1 THEN refl - 1 ELSE CAST(length(bin(refl - 1)) AS BIGINT) END AS n FROM pc")
def ceil_log2(spark, d):
    return point_cloud(spark, d).select(*ID, C.ceil_log2(F.col("refl")).alias("n"))


@query("floor_log2", "pc", "SELECT point_id, CAST(CASE WHEN refl <= 0 THEN 0 ELSE length(bin(refl)) END AS BIGINT) AS n FROM pc")
def floor_log2(spark, d):
    return point_cloud(spark, d).select(*ID, C.bit_length(F.col("refl")).cast("long").alias("n"))


@query("morton3", "pc", f"SELECT point_id, {sql_morton('x', 'y', 'z', BITS)} AS code FROM pc")
def morton3(spark, d):
    return point_cloud(spark, d).select(*ID, C.morton3(*map(F.col, "xyz"), BITS).alias("code"))


@query("hilbert3", "pc", f"SELECT point_id, hilbert AS code FROM ({sql_hilbert('pc', BITS)})")
def hilbert3(spark, d):
    return point_cloud(spark, d).select(*ID, C.hilbert3(*map(F.col, "xyz"), BITS).alias("code"))


_BOX = "x % 8 AS a, y % 8 AS b, z % 8 AS c, r % 4 AS k, g % 5 AS m"


@query("qtbt_params", "pc", f"SELECT point_id, least(k, greatest(a, b, c) - least(a, b, c)) AS before, CASE WHEN a = b AND b = c THEN 0 ELSE least(m, least(a, b, c)) END AS smallest FROM (SELECT point_id, {_BOX} FROM pc)")
def qtbt_params(spark, d):
    before, smallest = C.split_params([F.col(v) % 8 for v in "xyz"], F.col("r") % 4, F.col("g") % 5)
    return point_cloud(spark, d).select(*ID, before.alias("before"), smallest.alias("smallest"))


_LONG = "CAST(greatest(a, b, c) > 0 AND ({0} = greatest(a, b, c) OR (k = 0 AND least(a, b, c) <> m)) AS BIGINT)"


@query("qtbt_split", "pc", f"SELECT point_id, {', '.join(f'{v} - {_LONG.format(v)} AS {v}' for v in 'abc')} FROM (SELECT point_id, {_BOX} FROM pc)")
def qtbt_split(spark, d):
    sizes = C.split_sizes([F.col(v) % 8 for v in "xyz"], F.col("r") % 4, F.col("g") % 5)
    return point_cloud(spark, d).select(*ID, *[v.alias(n) for v, n in zip(sizes, "abc")])


@query("morton_add", "pc", f"SELECT point_id, {sql_morton('(x + r)', '(y + g)', '(z + b)', 9)} AS code FROM pc")
def morton_add(spark, d):
    """Codes are added in coordinates; masked carries would overflow a signed long."""
    return point_cloud(spark, d).select(*ID, C.morton3(F.col("x") + F.col("r"), F.col("y") + F.col("g"), F.col("z") + F.col("b"), 9).alias("code"))


@query("child_index", "pc", "SELECT point_id, ((x >> 2) & 1) * 4 + ((y >> 2) & 1) * 2 + ((z >> 2) & 1) AS child FROM pc")
def child_index(spark, d):
    return point_cloud(spark, d).select(*ID, C.child_index(*map(F.col, "xyz"), 2).alias("child"))


_MULT, _STEP = ([*C.QUANT_MULTIPLIERS], [*C.QUANT_STEPS])


@query("quant_residual", "pc", f"SELECT point_id, (refl * {_MULT}[x % 64 + 1] + 8192) >> 14 AS q FROM pc")
def quant_residual(spark, d):
    return point_cloud(spark, d).select(*ID, C.quant_residual(F.col("refl"), F.col("x") % 64).alias("q"))


@query("dequant_residual", "pc", f"SELECT point_id, (refl * {_STEP}[x % 64 + 1] + 32) >> 6 AS v FROM pc")
def dequant_residual(spark, d):
    return point_cloud(spark, d).select(*ID, C.dequant_residual(F.col("refl"), F.col("x") % 64).alias("v"))


@query("zigzag", "sc", "SELECT vec_id, CASE WHEN x < 0 THEN -1 - 2 * x ELSE 2 * x END AS u FROM sc")
def zigzag(spark, d):
    return signed_cloud(spark, d).select("vec_id", C.zigzag(F.col("x")).alias("u"))


@query("unzigzag", "sc", "SELECT vec_id, x AS v FROM sc")
def unzigzag(spark, d):
    return signed_cloud(spark, d).select("vec_id", C.unzigzag(C.zigzag(F.col("x"))).alias("v"))


@query("psnr", "pc", "SELECT point_id, CASE WHEN refl = 0 THEN 'inf'::DOUBLE ELSE round(10 * log10(3 * 127.0::DOUBLE * 127.0::DOUBLE / refl), 9) END AS db FROM pc")
def psnr(spark, d):
    return point_cloud(spark, d).select(*ID, F.round(C.psnr(F.col("refl"), F.lit(127.0), 3), 9).alias("db"))


@query("split_u32", "pc", "SELECT point_id, (refl * 65537 + x) >> 16 AS high, (refl * 65537 + x) & 65535 AS low FROM pc")
def split_u32(spark, d):
    n = F.col("refl") * 65537 + F.col("x")
    return point_cloud(spark, d).select(*ID, F.shiftright(n, 16).alias("high"), n.bitwiseAND(F.lit(65535)).alias("low"))


@query("cloud_mutators", "pc", "SELECT point_id, x, y, z, 0 AS refl FROM pc WHERE point_id < 1000")
def cloud_mutators(spark, d):
    """Resize, drop the colours, add a default reflectance."""
    return point_cloud(spark, d).where("point_id < 1000").drop("frame", "r", "g", "b").withColumn("refl", F.lit(0))


@query("single_mode_pred", "pc", "SELECT point_id, (x % 3) + (y % 3) + (z % 3) > 2 * (CAST(x % 3 > 0 AS INT) + CAST(y % 3 > 0 AS INT) + CAST(z % 3 > 0 AS INT)) AS single FROM pc")
def single_mode_pred(spark, d):
    logs = [F.col(c) % 3 for c in "xyz"]
    count = sum((F.when(v > 0, 1).otherwise(0) for v in logs[1:]), F.when(logs[0] > 0, 1).otherwise(0))
    return point_cloud(spark, d).select(*ID, (logs[0] + logs[1] + logs[2] > 2 * count).alias("single"))


@query("skip_mask", "pc", "SELECT point_id, ((x >> 2) & 1) * 4 + ((y >> 2) & 1) * 2 + ((z >> 2) & 1) AS child FROM pc WHERE (frame & (((x >> 2) & 1) * 4 + ((y >> 2) & 1) * 2 + ((z >> 2) & 1))) = 0")
def skip_mask(spark, d):
    child = C.child_index(*map(F.col, "xyz"), 2)
    return point_cloud(spark, d).where(F.col("frame").bitwiseAND(child) == 0).select(*ID, child.alias("child"))


@query("boundary_flag", "pc", "SELECT point_id, (x & 15) = 15 OR (y & 15) = 15 OR (z & 15) = 15 AS edge FROM pc")
def boundary_flag(spark, d):
    last = [F.col(c).bitwiseAND(F.lit(15)) == 15 for c in "xyz"]
    return point_cloud(spark, d).select(*ID, (last[0] | last[1] | last[2]).alias("edge"))


@query("dup_equal", "pc", "SELECT point_id, first_id FROM (SELECT point_id, min(point_id) OVER c AS first_id, count(*) OVER c AS n FROM pc WINDOW c AS (PARTITION BY x, y, z)) WHERE n > 1")
def dup_equal(spark, d):
    """Equal points as classes: every point that has an equal one with the first of its class; pairs aren't made."""
    points = point_cloud(spark, d).select(*ID, "x", "y", "z")
    classes = points.groupBy("x", "y", "z").agg(F.min("point_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return points.join(classes, ["x", "y", "z"]).select(*ID, "first_id")
