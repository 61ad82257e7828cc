"""The point cloud over the order lines: the table that all cloud queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
#: Orders that are ranked by one task.
STRIDE = 4096


ATTRIBUTES = ("frame", "x", "y", "z", "r", "g", "b", "refl")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key, the attributes and the stretch of every point."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    long = lambda c: F.floor(c).cast("long")
    price = long(F.col("l_extendedprice"))
    return lines.select(
        *KEY,
        (F.year("l_shipdate").cast("long") - 1995).alias("frame"),
        (F.col("l_partkey") % 128).alias("x"),
        (F.col("l_suppkey") % 64).alias("y"),
        long(F.col("l_quantity")).alias("z"),
        (price % 256).alias("r"),
        (F.round(F.col("l_discount") * 100).cast("long") * 25).alias("g"),
        (F.round(F.col("l_tax") * 100).cast("long") * 31).alias("b"),
        (price % 4096).alias("refl"),
        F.floor(F.col("l_orderkey") / STRIDE).alias("stretch"),
    )


def _numbered(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """point_id and the attributes of rows, which hold every row of their stretches; ranks count all rows of whole.

    Ranks are taken inside stretches of order keys and moved by the stretches' first ranks, so no task
    sorts the whole table.
    """
    counts = whole.groupBy("stretch").agg(F.count("*").alias("n"))
    # One row for each stretch: the only table ranked in one task has STRIDE times fewer rows than orders.
    first = counts.select("stretch", (F.sum("n").over(W.orderBy("stretch")) - F.col("n")).alias("first"))
    inside = F.row_number().over(W.partitionBy("stretch").orderBy(*KEY)) - 1
    return rows.withColumn("inside", inside).join(first, "stretch").select((F.col("first") + F.col("inside")).alias("point_id"), *ATTRIBUTES)


def point_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, frame, x, y, z, r, g, b, refl; point_id is the rank in key order. Every row is shuffled for its rank."""
    rows = _rows(spark, sf_dir)
    return _numbered(rows, rows)


def loose_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points without point_id; they come from the scan alone."""
    return _rows(spark, sf_dir).select(*ATTRIBUTES)


def points_with_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the cloud, with their point_id, among which are the first ones of all cells.

    A cell's first point has its least order key, so only stretches that hold such a key are shuffled for ranks. Cells are
    few beside the rows of a large table, and soon all of them are taken.
    """
    rows = _rows(spark, sf_dir)
    least = rows.groupBy("x", "y", "z").agg(F.min("stretch").alias("stretch"))
    return _numbered(rows.join(F.broadcast(least.select("stretch").distinct()), "stretch", "left_semi"), rows)


def signed_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x, y, z: the first three components of the vectors in thousandths, negatives included."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    parts = [F.round(F.get("embedding", F.lit(i)).cast("double") * 1000).cast("long").alias(c) for i, c in enumerate("xyz")]
    return vectors.select("vec_id", *parts)


SQL_CLOUD = """pc AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS point_id,
 CAST(year(l_shipdate) AS BIGINT) - 1995 AS frame, CAST(l_partkey % 128 AS BIGINT) AS x, CAST(l_suppkey % 64 AS BIGINT) AS y,
 CAST(floor(l_quantity) AS BIGINT) AS z, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS r, CAST(round(l_discount * 100) AS BIGINT) * 25 AS g,
 CAST(round(l_tax * 100) AS BIGINT) * 31 AS b, CAST(floor(l_extendedprice) AS BIGINT) % 4096 AS refl FROM lineitem)"""
SQL_SIGNED = """sc AS (SELECT vec_id, CAST(round(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS x, CAST(round(CAST(embedding[2] AS DOUBLE) * 1000) AS BIGINT) AS y,
 CAST(round(CAST(embedding[3] AS DOUBLE) * 1000) AS BIGINT) AS z FROM embeddings)"""
