"""Registry of queries with the DuckDB text each is checked against, and the derived tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.columns import hilbert_tables, morton3
from pointweave.operators import groups
from pointweave.operators.cuts import Written
from pointweave.sources.cloud import SQL_CLOUD, SQL_SIGNED, loose_points, point_cloud, points_with_first, signed_cloud

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SLICES, BITS, DEPTH, STEP = 8, 7, 7, 4.0


def sql_morton(x: str, y: str, z: str, bits: int) -> str:
    return "(" + " + ".join(f"((({v} >> {i}) & 1) << {3 * i + p})" for i in range(bits) for v, p in ((x, 2), (y, 1), (z, 0))) + ")"


def sql_hilbert(source: str, bits: int) -> str:
    """The source's columns and hilbert, by one nested text per bit."""
    following, rank = hilbert_tables(bits)
    text = f"SELECT *, CAST(0 AS BIGINT) AS hs, CAST(0 AS BIGINT) AS hc FROM {source}"
    for i in reversed(range(bits)):
        at = f"hs * 8 + ((x >> {i}) & 1) * 4 + ((y >> {i}) & 1) * 2 + ((z >> {i}) & 1) + 1"
        text = f"SELECT t.* EXCLUDE (hs, hc), CAST({following}[{at}] AS BIGINT) AS hs, CAST(hc * 8 + {rank}[{at}] AS BIGINT) AS hc FROM ({text}) t"
    return f"SELECT * EXCLUDE (hs, hc), hc AS hilbert FROM ({text})"


#: Common tables of the oracle texts; each text gets the chain it needs.
SQL_STEPS = {
    "pc": SQL_CLOUD,
    "sc": SQL_SIGNED,
    "first": "first AS MATERIALIZED (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY point_id) = 1)",
    "coded": f"coded AS MATERIALIZED (SELECT *, {sql_morton('x', 'y', 'z', BITS)} AS code FROM first)",
    "span": "span AS (SELECT min(code) AS lo, max(code) AS hi FROM coded)",
    "shift": f"shift AS (SELECT min(m) AS m FROM range(64) t(m), span WHERE (hi >> m) - (lo >> m) < {SLICES})",
    "sliced": "sliced AS (SELECT coded.*, dense_rank() OVER (ORDER BY code >> m) - 1 AS slice_id FROM coded, shift)",
    "ordered": "ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY code, point_id) - 1 AS pos FROM sliced)",
    "hordered": f"hordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY hilbert, point_id) - 1 AS pos FROM ({sql_hilbert('sliced', BITS)}))",
    "lossy": """lossy AS MATERIALIZED (SELECT x, y, z, least(greatest(CAST(round(r / w) AS BIGINT), 0), 255) AS r, least(greatest(CAST(round(g / w) AS BIGINT), 0), 255) AS g,
 least(greatest(CAST(round(b / w) AS BIGINT), 0), 255) AS b, least(greatest(CAST(round(refl / w) AS BIGINT), 0), 32767) AS refl FROM (
 SELECT x, y, z, sum(w) AS w, sum(w * r) AS r, sum(w * g) AS g, sum(w * b) AS b, sum(w * refl) AS refl FROM (
 SELECT CAST(round(x / 4.0) AS BIGINT) AS x, CAST(round(y / 4.0) AS BIGINT) AS y, CAST(round(z / 4.0) AS BIGINT) AS z, r, g, b, refl,
 CAST(round(1024 / (0.1 + (abs(x - round(x / 4.0) * 4.0) + abs(y - round(y / 4.0) * 4.0) + abs(z - round(z / 4.0) * 4.0)) / 4.0)) AS BIGINT) AS w FROM pc) GROUP BY x, y, z))""",
    "nodes": "nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {v} AS level, code >> {3 * (v + 1)} AS node, CAST(bit_or(1 << CAST((code >> {3 * v}) & 7 AS INTEGER)) AS BIGINT) AS occupancy FROM coded GROUP BY ALL" for v in range(DEPTH)) + ")",
}
NEEDS = {"first": ["pc"], "coded": ["first"], "span": ["coded"], "shift": ["span"], "sliced": ["coded", "shift"], "ordered": ["sliced"], "hordered": ["sliced"], "lossy": ["pc"], "nodes": ["coded"]}


def with_steps(names: list[str], body: str) -> str:
    chain: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in chain:
            chain.append(name)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(SQL_STEPS[n] for n in chain) + "\n" if chain else "") + body


def query(name: str, needs: str = "", sql: str | None = None):
    """Registers a query; needs: common tables of its oracle text."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_steps(needs.split(), sql)
        return f

    return put


def first_points(spark: SparkSession, d: str) -> DataFrame:
    """The first point of every cell, with its code; written once, as the queries read it many times."""
    first = Written(groups.dedupe_first(points_with_first(spark, d), "x", "y", "z"), "first").df
    return first.withColumn("code", morton3(F.col("x"), F.col("y"), F.col("z"), BITS))


def coded_cells(spark: SparkSession, d: str) -> DataFrame:
    """x, y, z and code of every cell, without a shuffle of points; written once."""
    cells = Written(loose_points(spark, d).select("x", "y", "z").distinct(), "cells").df
    return cells.withColumn("code", morton3(F.col("x"), F.col("y"), F.col("z"), BITS))


def sliced(spark: SparkSession, d: str) -> DataFrame:
    return groups.slice_by_morton(first_points(spark, d), SLICES).withColumn("slice_id", F.col("slice_id").cast("long"))


def lossy(spark: SparkSession, d: str) -> DataFrame:
    return groups.fast_recolor(loose_points(spark, d), STEP)


__all__ = ["BITS", "DEPTH", "ORACLES", "QUERIES", "SLICES", "STEP", "coded_cells", "first_points", "loose_points", "lossy", "point_cloud", "points_with_first", "query", "signed_cloud", "sliced", "sql_hilbert", "sql_morton", "with_steps"]
