"""How much of the order lines the cloud's queries shuffle."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from pointweave.plans import base, grouped, spatial
from pointweave.sources.cloud import STRIDE, point_cloud, points_with_first

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The order lines, 64 later copies in the same cells, each some stretches after the one before, and a late point in a cell of its own."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    copies = lines.crossJoin(spark.range(65).withColumnRenamed("id", "i")).withColumn("l_orderkey", F.col("l_orderkey") + F.col("i") * 3 * STRIDE).drop("i")
    late = lines.orderBy("l_orderkey").limit(1).withColumn("l_orderkey", F.lit(200 * STRIDE).cast("long")).withColumn("l_quantity", F.lit(99.0))
    place = str(tmp_path_factory.mktemp("repeated"))
    copies.unionByName(late).write.parquet(f"{place}/lineitem.parquet")
    return place


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_first_points_are_those_of_the_whole_cloud(spark, repeated):
    cloud = point_cloud(spark, repeated)
    want = cloud.groupBy("x", "y", "z").agg(F.min("point_id").alias("point_id")).join(cloud, ["x", "y", "z", "point_id"])
    columns = ["point_id", "frame", "x", "y", "z", "r", "g", "b", "refl"]
    assert sorted(base.first_points(spark, repeated).select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_only_stretches_with_a_first_point_are_ranked(spark, repeated):
    """F4 to F7: at 65 times the rows, the same cells; the first copy and the late cell's stretch alone are shuffled whole."""
    rows = spark.read.parquet(f"{repeated}/lineitem.parquet").count()
    assert points_with_first(spark, repeated).count() * 60 < rows


def test_octrees_shuffle_no_points(spark):
    """seven levels read the cells, not seven times the order lines."""
    for run in (grouped.decode_octree, grouped.octree_bfs, grouped.octree_single_point):
        plan = plan_of(run(spark, DATA))
        assert "lineitem" not in plan and "Window" not in plan
    assert not re.search("Window|Join", plan_of(base.lossy(spark, DATA)))


def test_transfers_read_the_order_lines_once(spark):
    """F4 to F7: every step reads written cells."""
    for run in (spatial.nearest_forward, spatial.nearest_backward, spatial.recolour, spatial.color_transfer, spatial.reflectance_transfer):
        assert "lineitem" not in plan_of(run(spark, DATA))
