"""Symbols before the coder: raw bits, bins with signs and Golomb codes, header fields and an estimate of what they cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.operators import contexts, groups, predict, symbols
from pointweave.plans.base import loose_points, query, sliced
from pointweave.plans.grouped import COUNTS_SQL, PARENT_SQL, SIBLING_SQL, SINGLE_SQL, context_counts, octree_single_point, with_n
from pointweave.plans.predicting import CACHED_SQL, PRED_SQL, REFL_SQL, ordered, pred_refl_cache, residual_color


def _golomb(v: str) -> str:
    return f"repeat('0', length(bin({v} + 1)) - 1) || bin({v} + 1)"


def _signed(v: str) -> str:
    return _golomb(f"(CASE WHEN {v} > 0 THEN 2 * {v} - 1 ELSE -2 * {v} END)")


def _residual(v: str) -> str:
    return f"CASE WHEN {v} = 0 THEN '1' ELSE '0' || CASE WHEN {v} > 0 THEN '1' ELSE '0' END || CASE abs({v}) WHEN 1 THEN '1' WHEN 2 THEN '01' WHEN 3 THEN '001' ELSE '000' || {_golomb(f'greatest(abs({v}) - 4, 0)')} END END"


_KINDS = {"ue": _golomb, "se": _signed, "u1": lambda v: f"lpad(bin({v}), 1, '0')", "u8": lambda v: f"lpad(bin({v}), 8, '0')", "u16": lambda v: f"lpad(bin({v}), 16, '0')"}


@query("single_point_bins", "coded", f"SELECT level, code, lpad(bin(code & ((CAST(1 AS BIGINT) << CAST(3 * (level + 1) AS INTEGER)) - 1)), CAST(3 * (level + 1) AS INTEGER), '0') AS bins FROM ({SINGLE_SQL})")
def single_point_bins(spark, d):
    """The raw bits that place a lone point in its node: x, y, z of each level in turn, highest first."""
    size = (3 * (F.col("level") + 1)).cast("int")
    low = F.col("code").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1)
    return octree_single_point(spark, d).select("level", "code", symbols.fixed(low, size).alias("bins"))


@query("cache_index_bins", "ordered", f"SELECT CAST(i AS BIGINT) AS place, count(*) AS n, CAST(sum((cache_index >> i) & 1) AS BIGINT) AS ones FROM ({CACHED_SQL}), range(5) t(i) WHERE cache_index >= 0 GROUP BY i")
def cache_index_bins(spark, d):
    """The five bins of each cache index, lowest first, each with a context of its own."""
    place = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("place")
    bins = pred_refl_cache(spark, d).where("cache_index >= 0").select("cache_index", place)
    bit = F.call_function("shiftright", F.col("cache_index"), F.col("place")).bitwiseAND(F.lit(1))
    return bins.groupBy(F.col("place").cast("long").alias("place")).agg(F.count("*").alias("n"), F.sum(bit).cast("long").alias("ones"))


@query("residual_symbols_refl", "ordered", f"SELECT * FROM (WITH {REFL_SQL} SELECT slice_id, pos, {_residual('(refl - pred_refl)')} AS bins FROM guess)")
def residual_symbols_refl(spark, d):
    p = predict.predict_refl(ordered(spark, d))
    return p.select("slice_id", "pos", symbols.residual_bins(F.col("refl") - F.col("pred_refl")).alias("bins"))


_COLOR = ", ".join(f"{_residual(f'd{i}')} AS bins{i}" for i in range(3))


@query("residual_symbols_color", "ordered", f"SELECT * FROM (WITH {PRED_SQL} SELECT slice_id, pos, {_COLOR} FROM (SELECT slice_id, pos, r - pred_r AS d0, g - pred_g - (r - pred_r) AS d1, b - pred_b - (g - pred_g) AS d2 FROM pred))")
def residual_symbols_color(spark, d):
    return residual_color(spark, d).select("slice_id", "pos", *[symbols.residual_bins(F.col(f"d{i}")).alias(f"bins{i}") for i in range(3)])


@query("duplicate_symbols", "pc", f"SELECT x, y, z, CASE WHEN n = 1 THEN '1' ELSE '0' || {_golomb('greatest(n - 2, 0)')} END AS bins FROM (SELECT x, y, z, count(*) AS n FROM pc GROUP BY x, y, z)")
def duplicate_symbols(spark, d):
    counts = loose_points(spark, d).groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    return counts.select("x", "y", "z", symbols.duplicate_bins(F.col("n")).alias("bins"))


@query("occupancy_entropy", "nodes", with_n(f"SELECT level, round(sum(CASE WHEN ones > 0 THEN -ones * log2(ones / n) ELSE 0 END + CASE WHEN ones < n THEN -(n - ones) * log2((n - ones) / n) ELSE 0 END), 6) AS bits FROM ({COUNTS_SQL}) GROUP BY level", PARENT_SQL + SIBLING_SQL))
def occupancy_entropy(spark, d):
    """Bits of each level's occupancy bins under their contexts' own shares."""
    costs = contexts.entropy_bits(context_counts(spark, d), ["level", "ctx"])
    return costs.groupBy("level").agg(F.round(F.sum("bits"), 6).alias("bits"))


def _halves(name: str, kind: str, value: str) -> list[tuple[str, str, str]]:
    """A 32-bit number in two halves, each with a marker behind it."""
    out = []
    for part, text in (("upper", f"(({value}) >> 16)"), ("lower", f"(({value}) & 65535)")):
        out += [(f"{name}_{part}", kind, text), ("marker", "u1", "1")]
    return out


#: The order of the fields. A brick header holds the box, its size as powers of two, and the number of points.
BRICK = [
    ("slice", "ue", "slice_id"), *[f for c in "xyz" for f in _halves(f"origin_{c}", "se", f"min_{c}")],
    *[f for c in "xyz" for f in _halves(f"size_{c}", "ue", f"length(bin(max_{c} - min_{c}))")], *_halves("points", "ue", "n"),
]
#: The parameter sets: sequence, geometry and attributes, here with this library's default options.
SEQUENCE = [
    ("level", "u8", "0"), ("marker", "u1", "1"), *[f for c in "xyz" for f in _halves(f"origin_{c}", "se", f"min_{c}")],
    *[f for c in "xyz" for f in _halves(f"size_{c}", "ue", f"max_{c} - min_{c} + 1")], *_halves("step", "u16", "65536"),
    ("remove_duplicates", "u1", "1"), ("marker", "u1", "1"), ("adapt_prediction", "u1", "0"), ("quant_parameter", "ue", "0"),
    ("depth_first", "ue", "0"), ("box_splits", "u1", "0"), ("splits_before", "ue", "0"), ("smallest_split", "ue", "0"), ("single_mode", "u1", "1"), ("context_mode", "u1", "0"),
    ("color", "u1", "1"), ("reflectance", "u1", "1"), ("neighbours", "ue", "128"), ("cross_component", "u1", "1"), ("layers", "ue", "0"), ("prediction_neighbours", "ue", "3"), ("intra_layer", "u1", "0"),
]


def _fields_sql(source: str, keys: str, fields: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}CAST({i} AS INTEGER) AS place, '{name}' AS field, CAST({value} AS BIGINT) AS value, {_KINDS[kind](f'({value})')} AS bits FROM {source}" for i, (name, kind, value) in enumerate(fields))


_SIDES = ", ".join(f"{f}({c}) AS {f}_{c}" for c in "xyz" for f in ("min", "max"))


@query("brick_headers", "sliced", f"SELECT * FROM (WITH box AS (SELECT slice_id, {_SIDES}, count(*) AS n FROM sliced GROUP BY slice_id) {_fields_sql('box', 'slice_id, ', BRICK)})")
def brick_headers(spark, d):
    """Fields of each slice's geometry header with their codes; an attribute header is the first field alone."""
    points = sliced(spark, d)
    boxes = groups.bbox(points, "slice_id").join(points.groupBy("slice_id").agg(F.count("*").alias("n")), "slice_id")
    return symbols.coded_fields(boxes, ["slice_id"], BRICK)


@query("parameter_sets", "pc", f"SELECT * FROM (WITH box AS (SELECT {_SIDES} FROM pc) {_fields_sql('box', '', SEQUENCE)})")
def parameter_sets(spark, d):
    """Fields of the three parameter sets, one after the other."""
    return symbols.coded_fields(groups.bbox(loose_points(spark, d)), [], SEQUENCE)
